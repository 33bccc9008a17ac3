"""Streams: replay of token-by-token editing, and windowed counts of events.

A replay is not a batch step on the final text: rules see every prefix, so an insertion
lands at what was the end of the text then. State is kept by document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate, pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glosswright.functions.text import let
from glosswright.plans.ir import Plan, compile_rules
from glosswright.sources.storage import delete, new_path
from glosswright.streaming.rows import Replayer

RULES = """## Replace (word): les
With:
- ces

## After: pour
Scope:
- 1 sentence
Add:
- tous
"""

#: Tokens of a row of a stream of documents.
BLOCK = 512

OUT = "doc_id long, ticks long, edits long, text string"
STATE = "ticks long, edits long, text string, seen string"


def tokens(documents: DataFrame) -> DataFrame:
    """doc_id, tick, text, sizes: words with the white space before them, in order, up to BLOCK a row.

    tick is the first word's; text holds the words, and sizes their characters, as lists of words take several times the room.
    """
    pieces = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\s*\S+|\s+$"), F.lit(0))
    some = F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.lit("")))  # a text without tokens is one empty piece

    def blocks(held: Column) -> Column:
        last = F.floor((F.size(held) - 1) / BLOCK).cast("int")
        part = lambda i: let(F.slice(held, i * BLOCK + 1, F.lit(BLOCK)), lambda p: F.struct((i * BLOCK).alias("tick"), F.array_join(p, "").alias("text"), F.transform(p, F.length).alias("sizes")))
        return F.transform(F.sequence(F.lit(0), last), part)

    return documents.select("doc_id", F.explode(let(some, blocks)).alias("b")).select("doc_id", "b.*")


def in_order(blocks: Iterable[tuple[int, str, Sequence[int]]]) -> list[str]:
    """The words of blocks by tick, those of one tick by themselves."""
    rows = []
    for tick, text, sizes in sorted(blocks, key=lambda b: b[0]):
        ends = list(accumulate(sizes, initial=0))
        rows.append((tick, [text[a:b] for a, b in pairwise(ends)]))
    if all(t + len(p) <= after for (t, p), (after, _) in pairwise(rows)):
        return [x for _, p in rows for x in p]
    return [x for _, x in sorted((t + i, x) for t, p in rows for i, x in enumerate(p))]


def replay(stream: DataFrame, plan: Plan) -> DataFrame:
    """Final state rows of a token stream: each batch gives its documents' latest text.

    Within a batch tokens are taken by tick. An edit that was made before, at the same
    place behind the same text, isn't made again. Tokens that can't give an edit take no
    step.
    """
    advance = Replayer(plan)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ticks, edits, text, seen = state.get if state.exists else (0, 0, "", "")
        pieces = in_order((int(t), x, s.tolist()) for pdf in batches for t, x, s in zip(pdf["tick"], pdf["text"], pdf["sizes"], strict=True))
        text, ticks, edits, tried = advance(text, pieces, ticks, edits, set(filter(None, seen.split(","))))
        state.update((ticks, edits, text, ",".join(sorted(tried))))
        yield pd.DataFrame({"doc_id": [key[0]], "ticks": [ticks], "edits": [edits], "text": [text]})

    return stream.groupBy("doc_id").applyInPandasWithState(run, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def _drain(query, path: str, spark: SparkSession, schema) -> DataFrame:
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.schema(schema).parquet(path)


def replay_documents(spark: SparkSession, documents: DataFrame, rules: str) -> DataFrame:
    """Runs the documents' tokens through a replay stream and returns the final texts."""
    source, out, state = (new_path(spark, f"replay-{x}") for x in ("tokens", "out", "state"))
    tokens(documents).write.option("compression", "zstd").parquet(source)
    stream = spark.readStream.schema("doc_id long, tick int, text string, sizes array<int>").parquet(source)
    result = replay(stream, compile_rules(rules))
    batches = []

    def write(df: DataFrame, i: int) -> None:
        batches.append(i)
        df.withColumn("batch", F.lit(i)).write.mode("append").option("compression", "zstd").parquet(out)

    query = result.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    try:
        rows = _drain(query, out, spark, f"{OUT}, batch long")
    finally:
        delete(spark, source)
        delete(spark, state)
    if len(batches) == 1:  # each document has one row
        return rows.drop("batch")
    last = rows.groupBy("doc_id").agg(F.max_by(F.struct("ticks", "edits", "text"), "ticks").alias("r"))
    return last.select("doc_id", "r.*")


def windowed_counts(spark: SparkSession, path: str, window: str = "1 hour", delay: str = "2 days") -> DataFrame:
    """Events by hour and type from a stream over the event table, after all of it was read.

    The watermark bounds the state; in update mode the latest count of a window stands.
    """
    schema = spark.read.parquet(path).schema
    out = new_path(spark, "windows-out")
    events = spark.readStream.schema(schema).parquet(path[:-1] + "[" + path[-1] + "]")  # a pattern may name a file
    counts = (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("hour"), "event_type", "n")
    )
    query = (
        counts.writeStream.outputMode("update")
        .foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(out))
        .option("checkpointLocation", new_path(spark, "windows-state"))
        .trigger(availableNow=True)
        .start()
    )
    rows = _drain(query, out, spark, "hour timestamp, event_type string, n long, batch long")
    latest = rows.groupBy("hour", "event_type").agg(F.max_by("n", "batch").alias("n"))
    # events without a time belong to no window; a watermark drops them, so they are counted from the table
    untimed = spark.read.parquet(path).filter("ts is null").groupBy(F.lit(None).cast("timestamp").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    latest = latest.unionByName(untimed.select("hour", "event_type", "n"))
    return latest.select(F.to_timestamp_ntz(F.date_format("hour", "yyyy-MM-dd HH:mm:ss")).alias("hour"), "event_type", "n")
