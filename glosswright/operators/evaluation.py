"""Evaluation analytics over graded answers: grading, accuracy, comparison, metrics.

results: subrun_id, id, case_type, ok, and optionally runtime_sec and pos. All of it is
grouped aggregation with map-side partials; joins are on case ids.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswright.functions.text import safe_divide
from glosswright.plans.gold import meets, program


def _programs(gold: pd.Series) -> pd.Series:
    held: dict[str, list[str]] = {}
    return pd.Series([held[g] if g in held else held.setdefault(g, program(g)) for g in gold.fillna("")])


def grade(answers: DataFrame, answer: str = "answer", gold: str = "gold") -> DataFrame:
    """answers plus ok: whether each answer meets its row's gold predicate.

    Predicates are parsed where their rows lie, each once in a batch, and run by one
    expression: the plan doesn't grow with them, and no row is shuffled. A predicate
    that can't be read fails the job.
    """
    steps = answers.withColumn("_steps", F.pandas_udf(_programs, "array<string>")(F.col(gold)))
    return steps.withColumn("ok", meets(F.col("_steps"), F.coalesce(F.col(answer), F.lit("")))).drop("_steps")


def accuracy(results: DataFrame, *keys: str) -> DataFrame:
    """total, correct, accuracy by keys and case type; case_type null is the overall row."""
    out = results.rollup(*keys, "case_type") if not keys else results.groupingSets([[*map(F.col, keys), F.col("case_type")], list(map(F.col, keys))], *map(F.col, keys), F.col("case_type"))
    counts = out.agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("correct"))
    return counts.withColumn("accuracy", safe_divide(F.col("correct"), F.col("total")))


def last_by_id(results: DataFrame) -> DataFrame:
    """Of repeated ids the last row by pos."""
    columns = [c for c in results.columns if c != "id"]
    return results.groupBy("id").agg(F.max_by(F.struct(*columns), "pos").alias("r")).select("id", "r.*")


def paired(anchor: DataFrame, candidate: DataFrame) -> DataFrame:
    """id, case_type, anchor_ok, candidate_ok; raises if the id sets differ.

    The check is a filter over counts, so it runs whatever columns are read later.
    """
    side = lambda df, n: last_by_id(df).select("id", F.lit(n).alias("side"), "case_type", "ok")
    of = lambda n, c: F.max(F.when(F.col("side") == n, F.col(c)))
    both = side(anchor, 0).unionByName(side(candidate, 1)).groupBy("id").agg(
        F.count(F.lit(1)).alias("sides"), F.coalesce(of(0, "case_type"), of(1, "case_type")).alias("case_type"),
        of(0, "ok").alias("anchor_ok"), of(1, "ok").alias("candidate_ok"),
    )
    return both.filter(_must(F.col("sides") == 2, "the runs have different case ids")).drop("sides")


def _must(condition: Column, message: str) -> Column:
    """True, or an error; for filters."""
    return F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def common_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """The case ids that both runs have, each once."""
    return a.select("id").intersect(b.select("id"))


def paired_n(anchor: DataFrame, candidate: DataFrame, *keys: str) -> DataFrame:
    """How many cases both runs have, by keys; a key that only one run has counts 0."""
    side = lambda df, n: df.select(*keys, "id").distinct().withColumn("side", F.lit(n))
    sides = side(anchor, 0).unionByName(side(candidate, 1)).groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("sides"))
    return sides.groupBy(*keys).agg(F.count_if(F.col("sides") == 2).alias("paired_n"))


def append(*runs: DataFrame) -> DataFrame:
    """The rows of several runs one after another; columns that a run lacks are null."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def with_defaults(case_types: DataFrame, counts: DataFrame, default: float = 0) -> DataFrame:
    """Each case type with its counts, or the default where it has none."""
    columns = [c for c in counts.columns if c != "case_type"]
    return case_types.join(counts, "case_type", "left").fillna(default, subset=columns)


def transitions(pairs: DataFrame, *keys: str) -> DataFrame:
    """The 2 x 2 table of right and wrong, improved and degraded shares, and delta."""
    a, b = F.col("anchor_ok"), F.col("candidate_ok")
    counts = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(a & b).alias("cc"), F.count_if(a & ~b).alias("ci"), F.count_if(~a & b).alias("ic"), F.count_if(~a & ~b).alias("ii"),
    )
    share = lambda c: safe_divide(F.col(c), F.col("n"))
    return counts.withColumns({"improved": share("ic"), "degraded": share("ci"), "delta": safe_divide(F.col("ic") - F.col("ci"), F.col("n"))})


def case_type_deltas(anchor: DataFrame, candidate: DataFrame) -> DataFrame:
    """Accuracy of both runs by case type and their difference; a missing side counts 0."""
    side = lambda df, name: df.groupBy("case_type").agg(F.count(F.lit(1)).alias(f"{name}_total"), F.count_if("ok").alias(f"{name}_correct"))
    both = side(anchor, "anchor").join(side(candidate, "candidate"), "case_type", "full_outer").fillna(0)
    rate = lambda n: safe_divide(F.col(f"{n}_correct"), F.col(f"{n}_total"))
    return both.withColumn("delta", rate("candidate") - rate("anchor"))


def balanced_accuracy(results: DataFrame, scopes: tuple[str, ...], *keys: str) -> DataFrame:
    """Unweighted mean of the scopes' accuracies; null where one has no results."""
    by = results.filter(F.col("scope").isin(*scopes)).groupBy(*keys, "scope").agg(F.avg(F.col("ok").cast("int")).alias("a"))
    mean = F.when(F.count("a") == len(scopes), F.avg("a"))
    return by.groupBy(*keys).agg(mean.alias("balanced_accuracy"))


def runtime_means(results: DataFrame, *keys: str) -> DataFrame:
    """Mean run time over known values, and one that is null unless all are known."""
    strict = F.when(F.count("runtime_sec") == F.count(F.lit(1)), F.avg("runtime_sec"))
    return results.groupBy(*keys).agg(F.avg("runtime_sec").alias("mean_known"), strict.alias("mean_strict"))


def metric_grid(results: DataFrame, variants: tuple[str, ...], scopes: tuple[str, ...]) -> DataFrame:
    """One row for each variant and scope, also where there are no results; repeated keys are an error."""
    keys = [(v, s) for v in variants for s in scopes]
    if len(set(keys)) < len(keys):
        raise ValueError("a variant or a scope is named twice")
    spine = results.sparkSession.createDataFrame(keys, "variant string, scope string")
    got = results.groupBy("variant", "scope").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("correct"), F.avg("runtime_sec").alias("sec"))
    out = F.broadcast(spine).join(got, ["variant", "scope"], "left")
    return out.withColumn("accept", F.when(F.col("n") > 0, safe_divide(F.col("correct"), F.col("n"))))


def first_per_scope(subruns: DataFrame) -> DataFrame:
    """The anchor of each scope: its first subrun by index."""
    return subruns.groupBy("scope").agg(F.min_by("subrun_id", "index").alias("anchor_id"))


def coverage_budget(episodes: DataFrame, shares: tuple[float, ...] = (0.5, 0.8)) -> DataFrame:
    """The probe budgets that resolve a share of the episodes, by nearest rank.

    episodes: episode_id, generated, popped, exhausted. An exhausted episode needs one
    more than it popped. Budgets are few distinct numbers, so ranks come from their
    counts; no list of episodes is gathered.
    """
    needed = F.col("popped") + F.col("exhausted").cast("int")
    counts = episodes.groupBy(needed.alias("budget")).agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("budget"))).withColumn("total", F.sum("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rank = lambda q: F.greatest(F.lit(1), F.floor(F.col("total") * q + 0.9999999999))
    return upto.agg(*(F.min(F.when(F.col("upto") >= rank(q), F.col("budget"))).alias(f"budget_{round(100 * q)}") for q in shares))


def ranked(candidates: DataFrame, *group: str) -> DataFrame:
    """Rank of each candidate in its group by score, ratio to the best, gap to the next.

    Scores that are NaN count as missing; minus infinity means impossible: a group of
    these only has no winner, and its ratios are 0.
    """
    usable = candidates.filter(~F.isnan("score"))
    w = Window.partitionBy(*group)
    order = w.orderBy(F.desc("score"), "candidate_index")
    best = F.max("score").over(w)
    possible = best > float("-inf")
    return usable.withColumns(
        {
            "rank": F.row_number().over(order),
            "ratio_to_best": F.when(possible, F.exp(F.col("score") - best)).otherwise(0.0),
            "gap_to_next": F.col("score") - F.lead("score").over(order),
        }
    )


def winners(candidates: DataFrame, min_ratio: float, *group: str) -> DataFrame:
    """The best candidate of each group if it beats the next by the ratio."""
    top = ranked(candidates, *group).filter("rank = 1 and score > double('-Infinity')")
    clear = F.col("gap_to_next").isNull() | (F.exp(F.least(F.col("gap_to_next"), F.lit(700.0))) >= min_ratio)
    return top.filter(clear).drop("rank", "ratio_to_best", "gap_to_next")


def top_k(counts: DataFrame, k: int, order: list[Column], *group: str) -> DataFrame:
    """The first k rows of each group; Spark cuts groups to k rows before the shuffle."""
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("place") <= k)
