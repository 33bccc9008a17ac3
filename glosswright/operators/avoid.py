"""Avoid episodes from a table of probes: who gets which candidate, and when none is left.

requests: case_id, rule_id, cache_key, step, seq: an avoid rule asks for a candidate.
Steps don't fall as seq rises. probes: cache_key, rank (from 1), text, in the order of
generation; here a table takes the place of a language model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswright.functions.text import sentence_floor


def kept_probes(probes: DataFrame, prompt: str = "prefix", text: str = "text") -> DataFrame:
    """The probes that leave the trajectory: blanks collapsed, they don't begin with what was avoided."""
    flat = lambda c: F.trim(F.regexp_replace(F.col(c), r"\s+", " "))
    return probes.filter((flat(text) != "") & ~(F.startswith(flat(text), flat(prompt)) & (flat(prompt) != "")))


def pops(requests: DataFrame, probes: DataFrame) -> DataFrame:
    """requests with outcome, probe_rank, candidate_id, empty_count and exhausts.

    A key gives one probe a step, the next in rank, to the step's first request; its
    other requests are denied. Once all probes are gone every request is empty; the
    first empty one exhausts the key. Requests of a case and key are ordered in one
    task, which holds a document's steps, never a corpus'.
    """
    count = probes.groupBy("cache_key").agg(F.count(F.lit(1)).alias("_n"))
    rows = requests.join(count, "cache_key", "left").fillna(0, subset=["_n"])
    key = Window.partitionBy("case_id", "cache_key")
    rows = rows.withColumns({"_step": F.dense_rank().over(key.orderBy("step")), "_place": F.row_number().over(Window.partitionBy("case_id", "cache_key", "step").orderBy("seq"))})
    empty = F.col("_step") > F.col("_n")
    rank = F.when(~empty & (F.col("_place") == 1), F.col("_step"))
    rows = rows.withColumn("outcome", F.when(empty, "empty").when(F.col("_place") == 1, "popped").otherwise("denied"))
    rows = rows.withColumn("probe_rank", rank).withColumn("candidate_id", F.concat(F.lit("probe_"), rank.cast("string")))
    rows = rows.withColumn("empty_count", F.count_if(F.col("outcome") == "empty").over(key.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("exhausts", (F.col("outcome") == "empty") & (F.col("empty_count") == 1)).drop("_n", "_step", "_place")


def episodes(popped: DataFrame) -> DataFrame:
    """case_id, rule_id, cache_key with pops, denied and empty requests, and whether the key was exhausted."""
    is_ = lambda x: F.col("outcome") == x
    return popped.groupBy("case_id", "rule_id", "cache_key").agg(
        F.count_if(is_("popped")).alias("popped"), F.count_if(is_("denied")).alias("denied"), F.count_if(is_("empty")).alias("empty"), F.bool_or("exhausts").alias("exhausted")
    )


def floored_start(text: Column, start: Column, stop: Column, empty_before: Column, whole_document: bool = False) -> Column:
    """Where the edit begins: at the last sentence once its key was found empty before."""
    return start if whole_document else F.when(empty_before > 0, sentence_floor(text, start, stop)).otherwise(start)


def log(popped: DataFrame) -> DataFrame:
    """The episodes' events: case_id, rule_id, seq, type, cache_key, candidate_id, empty_request_count."""
    kind = F.when(F.col("outcome") == "popped", "AvoidProbeCandidatePopped").when(F.col("exhausts"), "AvoidProbeCacheExhausted")
    return popped.select("case_id", "rule_id", "seq", kind.alias("type"), "cache_key", "candidate_id", F.col("empty_count").alias("empty_request_count")).filter("type is not null")
