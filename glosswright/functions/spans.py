"""Spans, token alignments and patches as Columns. Spans are struct(start, stop)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glosswright.functions.text import SPACE, let, slice_text, spaced, tail

#: How far a span may be off before clamping is taken for an error.
MAX_DELTA = 8


def span(start: Column, stop: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"))


def is_valid(s: Column, text: Column) -> Column:
    return (s["start"] >= 0) & (s["start"] <= s["stop"]) & (s["stop"] <= F.length(text))


def clamp(s: Column, text: Column) -> Column:
    """The span inside the text; a reversed one becomes a point at its start."""
    low = F.least(F.greatest(s["start"], F.lit(0)), F.length(text))
    return let(low, lambda a: span(a, F.greatest(a, F.least(s["stop"], F.length(text)))))


def normalize(s: Column, text: Column, mode: str = "drop", fallback: Column | None = None) -> Column:
    """The span if it's valid, else what the mode makes of it, or null.

    drop: null. clamp: the span inside the text, if that moves no end by more than
    MAX_DELTA. fallback_then_clamp: a valid fallback first.
    """
    clamped = let(clamp(s, text), lambda c: F.when((F.abs(c["start"] - s["start"]) <= MAX_DELTA) & (F.abs(c["stop"] - s["stop"]) <= MAX_DELTA), c))
    if mode == "drop":
        return F.when(is_valid(s, text), s)
    out = F.when(is_valid(s, text), s)
    if mode == "fallback_then_clamp" and fallback is not None:
        out = out.when(is_valid(fallback, text), fallback)
    elif mode not in ("clamp", "fallback_then_clamp"):
        raise ValueError(f"unknown mode {mode!r}")
    return out.otherwise(clamped)


def token_span(s: Column, alignment: Column) -> Column:
    """The tokens that a span touches, as a half-open range of token positions."""
    touched = F.filter(F.sequence(F.lit(0), F.size(alignment) - 1), lambda i: (F.get(alignment, i)["char_start"] < s["stop"]) & (s["start"] < F.get(alignment, i)["char_end"]))
    return F.when(F.size(alignment) > 0, let(touched, lambda t: F.when(F.size(t) > 0, span(F.array_min(t), F.array_max(t) + 1))))


def snap(s: Column, alignment: Column) -> Column:
    """The span of a replacement, widened to the edges of tokens that it cuts."""
    cut = lambda at: F.get(F.filter(alignment, lambda t: (t["char_start"] < at) & (at < t["char_end"])), F.lit(0))
    wide = span(F.coalesce(cut(s["start"])["char_start"], s["start"]), F.coalesce(cut(s["stop"])["char_end"], s["stop"]))
    return F.when(s["start"] == s["stop"], s).otherwise(wide)


def alignment_error(alignment: Column, text: Column) -> Column:
    """What is wrong with an alignment, or null: bounds, order, index, gaps, pieces, coverage."""
    pairs = F.zip_with(F.slice(alignment, F.lit(1), F.greatest(F.size(alignment) - 1, F.lit(0))), F.slice(alignment, F.lit(2), F.size(alignment)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    some = lambda f: F.exists(alignment, f)
    return (
        F.when(alignment.isNull(), "missing")
        .when(F.size(alignment) == 0, F.when(F.length(text) > 0, "empty"))
        .when(some(lambda t: (t["char_start"] < 0) | (t["char_end"] > F.length(text))), "out of bounds")
        .when(some(lambda t: t["char_end"] < t["char_start"]), "reversed token")
        .when(F.exists(pairs, lambda p: p["b"]["token_index"] <= p["a"]["token_index"]), "indices not increasing")
        .when(F.exists(pairs, lambda p: p["b"]["char_start"] < p["a"]["char_end"]), "overlapping tokens")
        .when(F.exists(pairs, lambda p: p["b"]["char_start"] > p["a"]["char_end"]), "gap between tokens")
        .when(some(lambda t: t["piece_text"] != slice_text(text, t["char_start"], t["char_end"])), "piece differs from text")
        .when(F.element_at(alignment, -1)["char_end"] < F.length(text), "text not covered")
    )


def find_end(text: Column, start: Column, limit: Column, clauses: bool = False) -> Column:
    """The first sentence end (or clause end) from start on, else the limit."""
    stops = r"[^,;:.?!\n]*" if clauses else r"[^.?!\n]*"
    return start + F.length(F.regexp_extract(slice_text(text, start, limit), "^" + stops, 0))


def excerpt(text: Column, s: Column, around: int = 40) -> Column:
    """The span with some text around it, marked by brackets, on one line."""
    low = F.greatest(F.lit(0), s["start"] - around)
    marked = F.concat(slice_text(text, low, s["start"]), F.lit("["), slice_text(text, s["start"], s["stop"]), F.lit("]"), F.left(tail(text, s["stop"]), F.lit(around)))
    return F.regexp_replace(marked, f"[{SPACE}]+", " ")


def apply_op(text: Column, op: Column, s: Column, payload: Column) -> Column:
    """The text after one edit: replace, insert_before, insert_after, delete or noop."""
    put = lambda a, b, p: F.concat(F.substring(text, F.lit(1), a), p, tail(text, b))
    at = lambda x: put(x, x, spaced(text, x, x, payload))
    return (
        F.when(op == "replace", put(s["start"], s["stop"], spaced(text, s["start"], s["stop"], payload)))
        .when(op == "insert_before", at(s["start"]))
        .when(op == "insert_after", at(s["stop"]))
        .when(op == "delete", put(s["start"], s["stop"], F.lit("")))
        .otherwise(text)
    )


def patch_hash(op: Column, s: Column, payload: Column) -> Column:
    """A digest of what an edit does, whoever proposed it."""
    place = F.coalesce(F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string")), F.lit("-"))
    return F.sha1(F.concat(F.lit("op="), op, F.lit("|span="), F.when(s.isNull(), "-").otherwise(place), F.lit("|payload="), F.coalesce(payload, F.lit(""))))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the prefix that two texts share."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.when((a == "") | (b == ""), 0).otherwise(F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.least(F.length(a), F.length(b)))).cast("int")


def wrap(text: Column, width: int = 80) -> Column:
    """The text with lines broken between words at the width."""
    words = F.filter(F.split(text, " "), lambda w: w != "")

    def add(acc: Column, w: Column) -> Column:
        fits = (acc["line"] == "") | (F.length(acc["line"]) + 1 + F.length(w) <= width)
        grown = F.when(acc["line"] == "", w).otherwise(F.concat(acc["line"], F.lit(" "), w))
        return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], acc["line"], F.lit("\n"))).alias("done"), F.when(fits, grown).otherwise(w).alias("line"))

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("line"))
    return F.aggregate(words, start, add, lambda acc: F.concat(acc["done"], acc["line"]))
