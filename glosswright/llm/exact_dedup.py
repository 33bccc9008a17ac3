"""Exact duplicates by a heavy-hitter split.

1. Every text becomes a digest (SHA-256 of the text with A-Z lower-cased).
2. Misra-Gries summaries, one for each partition, are summed; the top counters
   name the digests that may be frequent.
3. An exact count over all digests verifies them and finds their winners. At most
   `counters` winners exist, so they are broadcast, and rows of frequent digests
   are decided where they lie, without a shuffle.
4. The rest has no frequent digest any more and is shuffled by digest.

Defined results: a null text counts as an empty one, and empty texts equal each
other. Of equal texts the largest doc_id wins; null ids lose against any other and
tie with each other. doc_id names a document, so rows that repeat both doc_id and
text are one document and share its decision. An empty table gives no rows. Other
columns are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glosswright.llm._common import ascii_lower, materialize
from glosswright.llm._membership import one_of_each, without
from glosswright.sources.storage import scratch

#: Counters of a partition's summary, and candidates at most. A digest that stands more than
#: n / 4096 + 1 times among the n rows of a partition is sure to be in that partition's summary.
COUNTERS = 4096


def digest() -> Column:
    return F.unhex(F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256))


def misra_gries(df: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """Rows (column, counter), at most `counters` of them: candidates for frequent values.

    Each partition keeps a summary of bounded size. Its counters are lowered by one
    at the end, an ordinary step of the method that spares the shuffle the values
    seen once. Summaries are merged by adding counters, spread over all tasks.
    """

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for pair in pc.value_counts(batch.column(0)):
                key = pair["values"].as_py()
                held[key] = held.get(key, 0) + pair["counts"].as_py()
            if len(held) > counters:
                cut = sorted(held.values(), reverse=True)[counters]
                held = {k: n - cut for k, n in held.items() if n > cut}
        held = {k: n - 1 for k, n in held.items() if n > 1}
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), type=pa.binary()), pa.array(list(held.values()), type=pa.int64())],
            names=[column, "counter"],
        )

    return (
        df.select(F.col(column).cast("binary"))
        .mapInArrow(summarize, f"{column} binary, counter long")
        .groupBy(column)
        .agg(F.sum("counter").alias("counter"))
        .orderBy(F.desc("counter"), column)
        .limit(counters)
    )


def decide(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """A decision for each row: doc_id, keep_id, group_size, kept, digest."""
    digests = materialize(docs.select("doc_id", digest().alias("digest")), "exact-digests")
    frequent = misra_gries(digests, "digest", counters).select("digest")
    winners = materialize(
        digests.join(F.broadcast(frequent), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .coalesce(1),
        "exact-winners",
    )  # at most `counters` rows of 48 bytes
    heavy = digests.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    light = digests.join(F.broadcast(winners), "digest", "left_anti").select(
        "digest",
        "doc_id",
        F.max("doc_id").over(group).alias("keep_id"),
        F.count(F.lit(1)).over(group).alias("group_size"),
    )
    return heavy.unionByName(light).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"
    )


def drop_duplicates(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """docs without the rows that lost; its columns are as before.

    Documents that stay aren't shuffled: a bit set of the losers' ids passes them where
    they lie, see without(). Of rows that repeat the winner's doc_id and text one stays;
    the texts of such rows alone are shuffled.
    """
    key = [F.col("doc_id"), digest()]
    with scratch(docs.sparkSession) as tables:
        decided = decide(docs, counters).filter("not kept or group_size > 1").groupBy("doc_id", "digest", "kept").agg(F.count(F.lit(1)).alias("n"))
        decided = materialize(decided.filter("not kept or n > 1"), "exact-lost")
        lost = tables.keep(decided)
    again = lost.filter("kept").select("doc_id", "digest")
    kept = without(docs, lost.select("doc_id", "digest"), key, gate=1)
    return kept if again.isEmpty() else kept.union(one_of_each(docs, again, key, gate=1))


def report(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The decisions with the digest as lowercase hex."""
    return decide(docs, counters).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
