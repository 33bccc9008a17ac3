"""Benchmark decontamination by a broadcast set of normalised n-grams.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z. A window
is 13 consecutive words of an item; an item of fewer words is one window. Training
texts are scanned window by window: a hash of the words' 64-bit hashes picks candidates,
which are then verified word by word by these.

The benchmark is cut into blocks of at most BLOCK_BYTES of text, whatever its size.
Each block's index is broadcast and the documents pass through the blocks one after
another, as narrow maps: nothing is shuffled, so no key can be hot.

Defined results: a null text has no words, an item without words has no window. A
null item_id marks words as hit but isn't counted or listed. Rows that repeat an
item_id are one item with several texts. Every document row gives one result row,
repeated ones too, and an empty table gives none. Long texts are scanned whole. Other
columns pass through `clean` whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswright.llm._common import arrow_map, materialize, utf8

WINDOW = 13
#: Text of a block of the benchmark; its index takes some four times as much.
BLOCK_BYTES = 8 << 20
#: Places that are compared word by word at once.
PAIRS = 1 << 15

#: Lower-cases A-Z and turns the bytes between words into blanks.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(rb"[0-9a-zA-Z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class WindowIndex:
    """The windows of one block of items and the scan of a text against them.

    Words are 64-bit hashes; the index is arrays: 8 bytes a word, 16 a window. A window
    is found by its own hash and then compared word by word.
    """

    def __init__(self, items: Iterable[tuple[object, bytes]], window: int = WINDOW):
        self.window = window
        self.memo: dict[bytes, int] = {}
        rng = np.random.default_rng(13)
        self.powers = rng.integers(1, 2**63, window, dtype=np.uint64) | np.uint64(1)
        numbers: dict[object, int] = {}
        stream, found, at = [np.empty(0, np.uint64)], {}, 0
        for item, text in items:
            ids = self._ids(words(text))
            if n := min(window, len(ids)):
                hashed = self._hash(ids, n)
                number = np.full(len(hashed), numbers.setdefault(item, len(numbers)), np.int32)
                found.setdefault(n, []).append((hashed, np.arange(at, at + len(hashed), dtype=np.int32), number))
                stream.append(ids)
                at += len(ids)
        self.items, self.stream, self.memo = list(numbers), np.concatenate(stream), {}
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted(found):
            hashed, places, number = (np.concatenate(x) for x in zip(*found[n], strict=True))
            order = np.argsort(hashed, kind="stable")
            self.windows[n] = (hashed[order], places[order], number[order])

    def _ids(self, ws: list[bytes]) -> np.ndarray:
        memo = self.memo
        try:
            return np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws))
        except KeyError:
            if len(memo) > 1 << 18:
                memo.clear()
            for w in ws:
                if w not in memo:
                    memo[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws))

    def _hash(self, ids: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(ids) - n + 1, np.uint64)
        for i in range(n):
            out += ids[i : len(ids) - n + 1 + i] * self.powers[i]
        return out

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words, hit spans of word positions, items."""
        ws = words(text)
        if not ws or not self.windows:
            return len(ws), [], set()
        ids = self._ids(ws)
        spans, items = [], set()
        for n, (hashes, places, numbers) in self.windows.items():
            if n > len(ids):
                continue
            hashed = self._hash(ids, n)
            low = np.searchsorted(hashes, hashed)
            at = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == hashed)
            if not len(at):
                continue
            many = np.searchsorted(hashes, hashed[at], side="right") - low[at]
            hit = np.repeat(at, many)
            entry = np.arange(len(hit)) + np.repeat(low[at] - np.cumsum(many) + many, many)
            inside = np.arange(n)
            for k in range(0, len(hit), PAIRS):
                h, e = hit[k : k + PAIRS], entry[k : k + PAIRS]
                same = (self.stream[places[e][:, None] + inside] == ids[h[:, None] + inside]).all(axis=1)
                spans += [(i, i + n) for i in np.unique(h[same]).tolist()]
                items |= {self.items[j] for j in np.unique(numbers[e[same]]).tolist()}
        return len(ws), _merged(spans), items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> tuple[int, Callable[[int], list]]:
    """Number of blocks of bounded size and the way to fetch one."""
    items = benchmark.select("item_id", utf8().alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return n, lambda b: [(r[0], bytes(r[1])) for r in items.filter(part == b).toLocalIterator()]


def hits(docs: DataFrame, benchmark: DataFrame, key: Column, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, field: str | None = None) -> DataFrame:
    """key, text (bytes), n_words, spans of hit words as a flat array, items as strings.

    field names the part of a struct key that is the text; then there is no text beside it.
    """
    n, block = _blocks(benchmark, block_bytes)
    text = [] if field else [utf8().alias("text")]
    df = docs.select(key.alias("key"), *text, F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("spans"), F.array().cast("array<string>").alias("items"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    for b in range(n):
        held = docs.sparkSession.sparkContext.broadcast(WindowIndex(block(b), window))

        def scan(cols: dict[str, list], held=held) -> dict[str, list]:
            out = {c: cols[c] for c in (("key",) if field else ("key", "text"))} | {"n_words": [], "spans": [], "items": []}
            texts = [(k[field] or "").encode() for k in cols["key"]] if field else cols["text"]
            for text, spans, items in zip(texts, cols["spans"], cols["items"], strict=True):
                count, found, got = held.value.scan(text)
                old = list(zip(spans[::2], spans[1::2], strict=True))
                out["n_words"].append(count)
                out["spans"].append([x for s in (_merged(old + found) if old else found) for x in s])
                out["items"].append(sorted({*items, *(str(i) for i in got if i is not None)}))
            return out

        df = arrow_map(df, scan, ddl)
        if n > 1:
            df = materialize(df, "decontaminate-block")
            held.unpersist()
    return df


def _over(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The verdict for each document, see the module's head."""

    def judge(cols: dict[str, list]) -> dict[str, list]:
        n_hit = [sum(s[1::2]) - sum(s[::2]) for s in cols["spans"]]
        return {
            "doc_id": cols["key"],
            "n_words": cols["n_words"],
            "n_hit": n_hit,
            "n_items": [len(i) for i in cols["items"]],
            "items_sha256": [hashlib.sha256(",".join(i).encode()).hexdigest() for i in cols["items"]],
            "contaminated": [_over(h, w) for h, w in zip(n_hit, cols["n_words"], strict=True)],
        }

    found = hits(docs, benchmark, F.col("doc_id"), window, block_bytes).drop("text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(
        found, judge, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    )


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without contaminated documents, or with hit spans cut out of them.

    The columns are those of docs. Documents that aren't contaminated by the 5 % rule
    stay untouched in either mode.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be 'documents' or 'spans', not {remove!r}")
    at = docs.columns.index("text")
    fields = [f"c{i}" for i in range(len(docs.columns))]  # clashing names don't matter

    def judge(cols: dict[str, list]) -> dict[str, list]:
        kept = []
        for row, n_words, flat in zip(cols["key"], cols["n_words"], cols["spans"], strict=True):
            spans = list(zip(flat[::2], flat[1::2], strict=True))
            if not _over(sum(b - a for a, b in spans), n_words):
                kept.append(row)
            elif remove == "spans":
                kept.append(row | {fields[at]: _cut(row[fields[at]], spans)})
        return {"key": kept}

    renamed = F.struct(*(F.col(f"`{c}`").alias(f) for c, f in zip(docs.columns, fields, strict=True)))
    found = hits(docs, benchmark, renamed, window, block_bytes, field=fields[at])
    kind = found.schema["key"].dataType.simpleString()
    out = arrow_map(found.drop("items"), judge, f"key {kind}").select("key.*")
    return out.toDF(*docs.columns)


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw)]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode()


_SPLIT = "string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL = f"""
WITH dw AS (
  SELECT doc_id, list_filter({_SPLIT}, lambda w: w <> '') AS w FROM documents
), bw AS (
  SELECT item_id, list_filter({_SPLIT}, lambda w: w <> '') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
  FROM bw, LATERAL unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0
), pos AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM dw, (SELECT DISTINCT n FROM win) AS l, LATERAL unnest(range(1, len(w) - n + 2)) AS t(i)
), hit AS (
  SELECT doc_id, item_id, i, n FROM pos JOIN win USING (n, g)
), hw AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, LATERAL unnest(range(i, i + n)) AS t(p) GROUP BY doc_id
), hi AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hit GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hw ON hw.doc_id = dw.doc_id LEFT JOIN hi ON hi.doc_id = dw.doc_id
"""
