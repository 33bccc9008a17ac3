"""How figures and names are written in reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "--"


def _known(value: Column, text: Column) -> Column:
    return F.when(value.isNotNull(), text).otherwise(MISSING)


def share(value: Column) -> Column:
    """0.545 as 54.5%."""
    return _known(value, F.format_string("%.1f%%", 100 * value))


def points(delta: Column) -> Column:
    """0.294 as +29.4 pp; no difference is +0.0 pp."""
    rounded = F.round(100 * delta, 1) + F.lit(0.0)
    return _known(delta, F.format_string("%+.1f pp", F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)))


def times(ratio: Column) -> Column:
    """0.5 as 0.50x."""
    return _known(ratio, F.format_string("%.2fx", ratio))


def run_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def label_of(reason: Column) -> Column:
    """The candidate named in a proposal's reason text; null if there is none."""
    return F.nullif(F.regexp_extract(reason, r"candidate=(\S+)", 1), F.lit(""))


def heading(title: Column) -> Column:
    """`## Avoid (repeat): X` as `avoid: x`."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(title), r"^\s*#+\s*", ""), r"\s*\([^)]*\)\s*(?=:)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\s*:\s*", ": "), r"\s+", " "))


# Case types with one of these words belong to the scope of that name.
SCOPES = ("ssnhl", "conductive")


def scope_name(case_type: Column) -> Column:
    """The scope that a case type names, else other."""
    out = F.lit("other")
    for scope in reversed(SCOPES):
        out = F.when(F.contains(F.lower(case_type), F.lit(scope)), F.lit(scope)).otherwise(out)
    return out
