"""Spans, alignments, patches, formats and reports."""

from pyspark.sql import functions as F

from glosswright.functions import formats, spans
from glosswright.operators import reports
from glosswright.plans.ir import compile_rules


def one(spark, **columns):
    r = spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()
    return {n: tuple(v) if hasattr(v, "asDict") else v for n, v in r.asDict().items()}


def test_spans(spark):
    text, s = F.lit("One two. Three, four\U0001f600"), lambda a, b: spans.span(F.lit(a), F.lit(b))
    tokens = [(0, 0, 3, "One"), (1, 3, 7, " two"), (2, 7, 8, "."), (3, 8, 14, " Three"), (4, 14, 21, ", four\U0001f600")]
    align = F.array(*(F.struct(F.lit(i).alias("token_index"), F.lit(a).alias("char_start"), F.lit(b).alias("char_end"), F.lit(p).alias("piece_text")) for i, a, b, p in tokens))
    got = one(
        spark, valid=spans.is_valid(s(0, 21), text), bad=spans.is_valid(s(3, 2), text), clamped=spans.clamp(s(-2, 30), text),
        dropped=spans.normalize(s(0, 30), text), far=spans.normalize(s(0, 40), text, "clamp"), near=spans.normalize(s(0, 23), text, "clamp"),
        fell=spans.normalize(s(0, 40), text, "fallback_then_clamp", s(1, 2)), snapped=spans.snap(s(1, 5), align), edge=spans.snap(s(3, 7), align),
        point=spans.snap(s(5, 5), align), toks=spans.token_span(s(2, 8), align), ok=spans.alignment_error(align, text),
        short=spans.alignment_error(F.slice(align, 1, 3), text), gap=spans.alignment_error(F.filter(align, lambda t: t["token_index"] != 2), text),
        sentence=spans.find_end(text, F.lit(0), F.lit(21)), clause=spans.find_end(text, F.lit(9), F.lit(21), True), open=spans.find_end(text, F.lit(15), F.lit(21)),
    )
    assert got == {
        "valid": True, "bad": False, "clamped": (0, 21), "dropped": None, "far": None, "near": (0, 21), "fell": (1, 2), "snapped": (0, 7),
        "edge": (3, 7), "point": (5, 5), "toks": (0, 3), "ok": None, "short": "text not covered", "gap": "gap between tokens",
        "sentence": 7, "clause": 14, "open": 21,
    }


def test_patches(spark):
    text, s = F.lit("The red dose."), spans.span(F.lit(4), F.lit(7))
    ops = {op: spans.apply_op(text, F.lit(op), s, F.lit("new")) for op in ("replace", "insert_before", "insert_after", "delete", "noop")}
    assert one(spark, **ops) == {
        "replace": "The new dose.", "insert_before": "The new red dose.", "insert_after": "The red new dose.", "delete": "The  dose.", "noop": "The red dose.",
    }
    got = one(
        spark, prefix=spans.common_prefix(F.lit("abcd"), F.lit("abx")), none=spans.common_prefix(F.lit(""), F.lit("x")), all=spans.common_prefix(F.lit("ab"), F.lit("abc")),
        wrapped=spans.wrap(F.lit("aa bb  cc ddddddd e"), 5), excerpt=spans.excerpt(text, s, 3), hash=F.length(spans.patch_hash(F.lit("replace"), s, F.lit("x"))),
    )
    assert got == {"prefix": 2, "none": 0, "all": 2, "wrapped": "aa bb\ncc\nddddddd\ne", "excerpt": "he [red] do", "hash": 40}


def test_formats(spark):
    d, null = (lambda x: F.lit(x).cast("double")), F.lit(None).cast("double")
    got = one(
        spark, a=formats.share(d(0.545)), b=formats.points(d(0.294)), c=formats.points(d(-0.0001)), d=formats.times(d(0.5)), e=formats.share(null), f=formats.points(null),
        g=formats.heading(F.lit("##  Avoid (repeat, word) :  Some  X")), h=formats.label_of(F.lit("valid candidate=c1 x")), i=formats.label_of(F.lit("no")),
    )
    assert got == {"a": "54.5%", "b": "+29.4 pp", "c": "+0.0 pp", "d": "0.50x", "e": "--", "f": "--", "g": "avoid: some x", "h": "c1", "i": None}


def test_reports(spark):
    means = spark.createDataFrame([("reasoning", "a", 4.0), ("baseline", "a", 2.0), ("x", "b", 1.0)], "variant string, scope string, sec double")
    assert {(r.variant, r.slowdown) for r in reports.slowdowns(means, "reasoning").collect()} == {("reasoning", 1.0), ("baseline", 0.5), ("x", None)}
    runs = spark.createDataFrame([("r1", 0.5), ("r3", None), ("r2", 0.7)], "run_id string, delta double")
    assert [r.run_id for r in reports.latest(runs, 2).collect()] == ["r3", "r2"] and [r.run_id for r in reports.best_deltas(runs, 1).collect()] == ["r2"]
    rules = "## Replace: a\nWith:\n- b\n"
    noted = reports.annotate(rules, {"## Replace: a": "fired 3"})
    assert reports.annotate(noted, {"## Replace: a": "fired 4"}).count("fired") == 1 and reports.strip_annotations(noted) == rules
    assert compile_rules(noted).rules[0].candidates == compile_rules(rules).rules[0].candidates
