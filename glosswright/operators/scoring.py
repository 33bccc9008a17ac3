"""Scoring proposals: which can be edited, their scores, and the winner of each place.

proposals: doc_id, rule_id, start, stop, op, payload, base_version_id, candidate_index,
candidate_kind (generated, static or fallback), candidate_id, and score once scored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswright.functions.text import version
from glosswright.operators.evaluation import ranked

Scorer = Callable[[DataFrame], DataFrame]
PLACE = ("doc_id", "rule_id", "start", "stop", "op")


def checked(proposals: DataFrame, documents: DataFrame) -> DataFrame:
    """proposals with skip_reason, and with spans cut to the text where they leave it.

    Proposals without an operation go. A proposal for another version of the text, or
    whose span is missing or runs backwards, gets a reason and mustn't be scored; a cut
    span gets one, too, but stays. Only a document's version and length meet proposals.
    """
    text = F.coalesce("text", F.lit(""))
    known = documents.select("doc_id", version(text).alias("_version"), F.length(text).alias("_size"))
    both = proposals.filter("op <> 'noop'").join(known, "doc_id", "left")
    cut = lambda c: F.least(F.greatest(F.col(c), F.lit(0)), F.col("_size"))
    stale = ~F.col("base_version_id").eqNullSafe(F.col("_version"))
    bad = F.col("start").isNull() | F.col("stop").isNull() | (F.col("start") > F.col("stop"))
    moved = (F.col("start") != cut("start")) | (F.col("stop") != cut("stop"))
    reason = F.when(stale, "proposal_base_version_mismatch").when(bad, "invalid_span_dropped").when(moved, "invalid_span_clamped")
    both = both.withColumn("skip_reason", reason).withColumn("_usable", ~stale & ~bad)
    place = {c: F.when(F.col("_usable"), cut(c)).otherwise(F.col(c)) for c in ("start", "stop")}
    return both.withColumns(place).withColumnRenamed("_usable", "editable").drop("_version", "_size")


def editable(proposals: DataFrame, documents: DataFrame) -> DataFrame:
    """The proposals that can be scored."""
    return checked(proposals, documents).filter("editable").drop("editable")


@dataclass(frozen=True)
class ScoreWeights:
    """How many tokens beside an edit count, and how much."""

    left_tokens: int = 3
    left: float = 0.25
    replacement: float = 1.0
    right_tokens: int = 3
    right: float = 0.5


def weighted(left: Column, replacement: Column, right: Column, weights: ScoreWeights = ScoreWeights()) -> Column:  # noqa: B008
    """The weighted sum of token log probabilities around an edit, given as arrays."""
    total = lambda xs: F.aggregate(F.coalesce(xs, F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + x)
    last = F.slice(left, F.greatest(F.size(left) - weights.left_tokens + 1, F.lit(1)), F.lit(weights.left_tokens))
    return weights.left * total(last) + weights.replacement * total(replacement) + weights.right * total(F.slice(right, F.lit(1), F.lit(weights.right_tokens)))


def length_scorer(documents: DataFrame) -> Scorer:
    """Without a model: minus the length of the text that the edit would make."""
    sizes = documents.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("_size"))

    def score(proposals: DataFrame) -> DataFrame:
        made = F.col("_size") - (F.col("stop") - F.col("start")) + F.length("payload")
        return proposals.join(sizes, "doc_id").withColumn("score", -made.cast("double")).drop("_size")

    return score


def two_phase(proposals: DataFrame, min_ratio: float, scorer: Scorer | None = None) -> DataFrame:
    """Scored proposals with phase, ratio_to_best and winner, by place (span and operation).

    Generated and static candidates come first. Fallbacks of a place are only scored
    where these have no winner, so places that have one hold no rows of phase 1.
    """
    kinds = F.when(F.col("candidate_kind").isin("generated", "static"), 0).when(F.col("candidate_kind") == "fallback", 1)
    rows = proposals.withColumn("phase", kinds).filter("phase is not null")
    rows = ranked(scorer(rows) if scorer else rows, *PLACE, "phase")
    clear = F.col("gap_to_next").isNull() | (F.exp(F.least(F.col("gap_to_next"), F.lit(700.0))) >= min_ratio)
    won = (F.col("rank") == 1) & (F.col("score") > float("-inf")) & clear
    rows = rows.withColumn("winner", won)
    first = F.min(F.when(F.col("winner"), F.col("phase"))).over(Window.partitionBy(*PLACE))
    rows = rows.withColumn("_first", first).filter("_first is null or phase <= _first")
    return rows.drop("rank", "gap_to_next", "_first")


def numbered(winners: DataFrame) -> DataFrame:
    """patch_number: each document's winners in the order they are applied, from the right, from 0."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("start"), "rule_id", F.asc("score"))
    return winners.withColumn("patch_number", F.row_number().over(order) - 1)
