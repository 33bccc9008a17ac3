"""Bit sets over 64-bit values: filters that let few wrong values through and lose none."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswright.llm._common import bounded_batches, released

#: Bits of a set; 8 MB, whatever the number of values. Beyond some tens of millions of
#: values it lets more and more wrong ones through, which costs time and no result.
BITS = 1 << 26


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective hash of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(values: np.ndarray) -> np.ndarray:
    return (mix(values.astype(np.int64).view(np.uint64)) % np.uint64(BITS)).astype(np.int64)


def bit_set(values: DataFrame) -> np.ndarray:
    """The set of the only column of values: at most BITS / 64 words come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _words(_places(batch.column(0).to_numpy(zero_copy_only=False)))

    return _gathered(values.dropna().mapInArrow(released(run), "word long, bits long"))


def _words(places: np.ndarray) -> Iterator[pa.RecordBatch]:
    at = np.unique(places)
    if len(at):
        word, first = np.unique(at >> 6, return_index=True)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], names=["word", "bits"])


def _gathered(words: DataFrame) -> np.ndarray:
    rows = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def repeated(lists: DataFrame) -> np.ndarray:
    """The set of the values that stand more than once in the lists of the only column.

    Instead of values the last 36 bits of their hashes are dealt, by 12 of them and sorted,
    at most two of each from one window, and as planes of bytes, of which the first
    compresses well: three bytes a value at most. The few values whose bits are others', too, are let in.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def dealt() -> pa.RecordBatch:
            at = np.sort(mix(np.concatenate(held).view(np.uint64)) & np.uint64((1 << 36) - 1))
            held.clear()
            at = at[np.concatenate((np.ones(min(2, len(at)), bool), at[2:] != at[:-2]))]
            bucket, first = np.unique(at >> np.uint64(24), return_index=True)
            rest = at.astype("<u4").view(np.uint8).reshape(-1, 4)[:, 2::-1]
            planes = [np.ascontiguousarray(x.T).tobytes() for x in np.split(rest, first[1:])]
            return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(planes, pa.binary())], names=["bucket", "planes"])

        size = 0
        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy())
            size += len(held[-1])
            if size >= 1 << 20:
                yield dealt()
                size = 0
        if size:
            yield dealt()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, parts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                planes = [np.frombuffer(x, np.uint8).reshape(3, -1).astype(np.int64) for x in parts.as_py()]
                rest = np.sort(np.concatenate([p[0] << 16 | p[1] << 8 | p[2] for p in planes]))
                yield from _words((bucket << 24 | rest[1:][rest[1:] == rest[:-1]]) % BITS)

    rows = bounded_batches(lists).mapInArrow(released(deal), "bucket int, planes binary")
    buckets = rows.groupBy("bucket").agg(F.collect_list("planes").alias("planes"))
    return _gathered(bounded_batches(buckets).mapInArrow(released(again), "word long, bits long"))


def among(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value may be in the set; False is certain."""
    at = _places(values)
    return (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def without(df: DataFrame, lost: DataFrame, key: list[Column], gate: int | None = None) -> DataFrame:
    """df without the rows whose key equals (nulls too) a row of lost; columns as before.

    Rows that can't be among the lost, by the first `gate` columns of the key, are passed
    as they lie. Keys that a first bit set lets through although they aren't lost make a
    second one: what isn't in that is lost for certain. Only what both let through, few
    rows, goes to the exact join, so neither texts that stay nor texts that go are
    shuffled, whatever the number of either.
    """
    names = [f"_lost_{i}_{c}" for i, c in enumerate(lost.columns)]
    lost = lost.toDF(*names)
    same = F.lit(True)
    for c in names:
        same = same & F.col(f"_key{c}").eqNullSafe(F.col(c))
    sc, hashed = df.sparkSession.sparkContext, F.xxhash64(*key[:gate])

    def level(*sets: np.ndarray) -> Column:
        """How many of the sets, one after another, may hold the row; one worker tests them all."""
        sent = [sc.broadcast(words) for words in sets]

        def test(h: pa.Array) -> pa.Array:
            values = h.to_numpy(zero_copy_only=False)
            out, still = np.zeros(len(values), np.int32), np.ones(len(values), bool)
            for words in sent:
                still &= among(words.value, values)
                out += still
            return pa.array(out)

        return F.arrow_udf(test, "int")(hashed)

    first = bit_set(lost.select(F.xxhash64(*names[:gate])))
    keys = df.filter(level(first) == 1).select(*(k.alias(f"_key{c}") for k, c in zip(key, names, strict=True)))
    second = bit_set(keys.join(lost, same, "left_anti").select(F.xxhash64(*(f"_key{c}" for c in names[:gate]))))
    held = level(first, second)
    asked = df.filter(held == 2).withColumns({f"_key{c}": k for k, c in zip(key, names, strict=True)})
    return df.filter(held == 0).union(asked.join(lost, same, "left_anti").drop(*(f"_key{c}" for c in names)))


def one_of_each(df: DataFrame, wanted: DataFrame, key: list[Column], gate: int | None = None) -> DataFrame:
    """One row of df for each row of wanted that the key equals (nulls too); columns as before.

    Only rows that may be among the wanted, by the first `gate` columns of the key, are shuffled.
    """
    names = [f"_wanted_{i}" for i in range(len(key))]
    wanted = wanted.toDF(*names)
    sent = df.sparkSession.sparkContext.broadcast(bit_set(wanted.select(F.xxhash64(*names[:gate]))))

    def test(h: pa.Array) -> pa.Array:
        return pa.array(among(sent.value, h.to_numpy(zero_copy_only=False)))

    same = F.lit(True)
    for n in names:
        same = same & F.col(f"_key{n}").eqNullSafe(F.col(n))
    asked = df.filter(F.arrow_udf(test, "boolean")(F.xxhash64(*key[:gate]))).withColumns({f"_key{n}": k for n, k in zip(names, key, strict=True)})
    keys = [f"_key{n}" for n in names]
    return asked.join(wanted, same, "left_semi").dropDuplicates(keys).drop(*keys)
