"""Sinks: JSON lines, the run bundle, and event fan-out for streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line with its keys sorted."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_bundle(rows: DataFrame, path: str) -> None:
    """Rows in folders by group and subrun; ids must not be empty."""
    checked = [
        F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).otherwise(F.raise_error(F.lit(f"a row has no {c}"))).alias(c)
        for c in ("group_run_id", "subrun_id")
    ]
    rest = [c for c in rows.columns if c not in ("group_run_id", "subrun_id")]
    rows.select(*checked, *rest).write.mode("overwrite").partitionBy("group_run_id", "subrun_id").json(path)


def fan_out(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands each batch to all sinks, computing it once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            for sink in sinks:
                sink(held, batch_id)
        finally:
            held.unpersist()

    return write
