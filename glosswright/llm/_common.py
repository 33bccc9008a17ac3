"""Helpers shared by the corpus operators: reading, materialising, Arrow maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswright.sources.storage import give_back, materialize, shared_dir

__all__ = ["arrow_filter", "arrow_map", "ascii_lower", "bounded_batches", "first_rows", "give_back", "materialize", "released", "shared_dir", "table", "utf8"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows of an Arrow batch, and rows handed to Python code at once.
BATCH_ROWS, SLICE_ROWS = 1024, 512
#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and leaves every other character alone."""
    return F.translate(text, UPPER, UPPER.lower())


def utf8(text: str = "text") -> Column:
    """The text as bytes; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def first_rows(table: DataFrame, rows: int, *key: str) -> DataFrame:
    """At most `rows` rows of a materialised table, the first by the hash of key.

    Only hashes are ordered. Rows of one hash, repeated ones, are told apart by their
    places, so the bound holds whatever repeats.
    """
    order = F.struct(F.xxhash64(*key, F.lit(11)).alias("h"), F.monotonically_increasing_id().alias("place"))
    placed = table.withColumn("_order", order)
    last = placed.select("_order").orderBy("_order").limit(rows).agg(F.max("_order").alias("m")).first().m
    if last is None:
        return table.limit(0)
    return placed.filter(F.col("_order") <= F.struct(F.lit(last.h).cast("long").alias("h"), F.lit(last.place).cast("long").alias("place"))).drop("_order")


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, after limiting the rows of a batch from Parquet and to Arrow, so that long texts fit in an executor."""
    conf = df.sparkSession.conf
    limits = {"execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "execution.arrow.maxBytesPerBatch": BATCH_BYTES, "parquet.columnarReaderBatchSize": BATCH_ROWS}
    for name, most in ((f"spark.sql.{k}", v) for k, v in limits.items()):
        # sizes read back with a unit of bytes
        if not 0 < int(conf.get(name).rstrip("b")) <= most:
            conf.set(name, most)
    return df


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, before and after which a worker hands free memory back to the system.

    Workers are used again by later tasks of other steps, and idle ones stay for a while.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return wrapped


def arrow_map(
    df: DataFrame,
    fn: Callable[[dict[str, list]], dict[str, Sequence]],
    schema: str,
) -> DataFrame:
    """mapInArrow over column lists, a bounded number of rows at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow_schema = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                out = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type) for f in arrow_schema], schema=arrow_schema
                )

    return bounded_batches(df).mapInArrow(released(run), schema)


def arrow_filter(
    df: DataFrame,
    keep: Callable[[list], Sequence[bool]],
    text: str = "text",
) -> DataFrame:
    """Keeps the rows for which keep(texts as bytes) holds; columns stay as they are."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                texts = [(t or "").encode() for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(keep(texts), type=pa.bool_()))

    return bounded_batches(df).mapInArrow(released(run), df.schema)
