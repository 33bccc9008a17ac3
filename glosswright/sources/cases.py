"""Evaluation cases: reading, checking, looking up; and the run bundle's JSON lines."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

FIELDS = ("id", "case_type", "question", "gold")
#: Subruns without a case type that a plan holds at most.
SUBRUNS = 1000


def read_cases(spark: SparkSession, path: str, fmt: str = "parquet", fields: dict[str, str] | None = None, order: str | None = None) -> DataFrame:
    """Cases (id, case_type, question, gold, pos) of a Parquet, JSON or CSV table.

    fields maps our names to the table's; all four must exist and be strings. order names
    the column that gives the source order, else the ids do.
    """
    df = spark.read.format(fmt).option("header", "true").load(path)
    return as_cases(df, fields, order)


def as_cases(df: DataFrame, fields: dict[str, str] | None = None, order: str | None = None) -> DataFrame:
    names = {f: (fields or {}).get(f, f) for f in FIELDS}
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for f, name in names.items():
        if name not in kinds:
            raise KeyError(f"the cases have no field {name!r} for {f}")
        if not isinstance(kinds[name], StringType):
            raise TypeError(f"field {name!r} must be a string, it is {kinds[name].simpleString()}")
    return df.select(*(F.col(n).alias(f) for f, n in names.items()), F.col(order or names["id"]).alias("pos"))


def select_cases(cases: DataFrame, n: int | None = None, case_id: str | None = None, case_type: str | None = None) -> DataFrame:
    """Filters first, then takes the first n in source order; n doesn't limit a lookup by id."""
    if case_id is not None:
        return lookup(cases, case_id)
    found = cases if case_type is None else cases.filter(F.col("case_type") == case_type)
    return found if n is None else found.orderBy("pos").limit(n)


def lookup(cases: DataFrame, case_id: str) -> DataFrame:
    """The case with this id, the last of repeated ones; ValueError if there is none."""
    found = cases.filter(F.col("id") == case_id).orderBy(F.desc("pos")).limit(1)
    if found.isEmpty():
        raise ValueError(f"no case has the id {case_id!r}")
    return found


def expand_subruns(subruns: DataFrame, cases: DataFrame) -> DataFrame:
    """Each subrun's cases: those of its case type, or all where that is null."""
    typed = subruns.filter(F.col("case_type").isNotNull()).join(cases, "case_type")
    free = subruns.filter(F.col("case_type").isNull()).drop("case_type")
    rows = free.limit(SUBRUNS + 1).collect()
    if len(rows) > SUBRUNS:
        raise ValueError(f"more than {SUBRUNS} subruns without a case type")
    # every such subrun takes every case, so cases are multiplied where they lie
    each = F.array(*(F.struct(*(F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in free.schema.fields)) for r in rows))
    return typed.unionByName(cases.withColumn("_subrun", F.explode(each)).select("_subrun.*", *cases.columns)) if rows else typed


def expand_rulesets(rulesets: list[dict], case_types: list[str | None]) -> list[dict]:
    """Subruns: each ruleset with each case type, numbered in this order."""
    return [{**r, "case_type": t, "index": i} for i, (r, t) in enumerate((r, t) for r in rulesets for t in case_types)]


def with_metadata(cases: DataFrame, dataset_id: str, split: str) -> DataFrame:
    return cases.withColumns({"dataset_id": F.lit(dataset_id), "split": F.lit(split)})


def notebook_rulesets(path: str, marker: str = "# Rules") -> list[dict]:
    """Rulesets in a notebook's text cells that start with the marker.

    Each has its header entries (`Run: x`, `Mode: y`, ...), case types and rule text.
    """
    cells = json.loads(Path(path).read_text(encoding="utf-8")).get("cells", [])
    found = [_ruleset(text, marker) for c in cells if c.get("cell_type") in ("markdown", "raw") and (text := "".join(c.get("source", []))).startswith(marker)]
    if not found:
        raise ValueError(f"no cell of {path} starts with {marker!r}")
    return found


def _ruleset(text: str, marker: str) -> dict:
    head, rules = [], []
    for line in text[len(marker) :].splitlines():
        if line.strip() == "---":
            continue
        (rules if rules or line.startswith("## ") else head).append(line.rstrip())
    out: dict = {"case_types": [], "rules": "\n".join(rules).strip()}
    for line in (x.strip() for x in head):
        key, colon, value = line.partition(":")
        if line[:2] in ("- ", "* "):
            out["case_types"].append(line[2:].strip())
        elif colon and value.strip():
            out[key.strip().lower().replace(" ", "_")] = value.strip()
    return out
