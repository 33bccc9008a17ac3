"""Run reports: slowdown, index tables, summaries, and rules annotated with their use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswright.functions.formats import points, share, times


def slowdowns(means: DataFrame, baseline: str) -> DataFrame:
    """sec of each variant over the baseline's in its scope; null without a positive one."""
    base = means.filter(F.col("variant") == baseline).select("scope", F.col("sec").alias("base_sec"))
    ratio = F.when(F.col("base_sec") > 0, F.col("sec") / F.col("base_sec"))
    return means.join(base, "scope", "left").withColumn("slowdown", ratio)


def latest(runs: DataFrame, k: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("run_id")).limit(k)


def best_deltas(runs: DataFrame, k: int = 10) -> DataFrame:
    return runs.filter(F.col("delta").isNotNull()).orderBy(F.desc("delta"), "run_id").limit(k)


def summary_lines(grid: DataFrame) -> DataFrame:
    """The metric grid as text: variant, scope, accept, delta, slowdown."""
    return grid.select("variant", "scope", share(F.col("accept")).alias("accept"), points(F.col("delta")).alias("delta"), times(F.col("slowdown")).alias("slowdown"))


def annotate(rules: str, stats: dict[str, str], mark: str = "// stats:") -> str:
    """The ruleset with a comment under each heading that has statistics; old ones go.

    stats: text by heading line. A ruleset is small, so this is driver-side.
    """
    out: list[str] = []
    for line in strip_annotations(rules, mark).splitlines():
        out.append(line)
        if line.startswith("##") and (text := stats.get(line.strip())):
            out[-1:] = [f"{mark} {text}", line]
    return "\n".join(out) + "\n" * rules.endswith("\n")


def strip_annotations(rules: str, mark: str = "// stats:") -> str:
    return "\n".join(x for x in rules.splitlines() if not x.strip().startswith(mark)) + "\n" * rules.endswith("\n")
