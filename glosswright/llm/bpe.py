"""Byte-level BPE as a tree reduction over a monoid of encoded pieces.

A text is halved until its parts are short, parts are encoded, and neighbours are
joined. An encoded part keeps its text and its ids. To join two, a window around
their border is encoded again, and it grows until a safe cut lies on each side.

A safe cut is a place between a character that isn't white space and one that is.
Every alternative of the split pattern but the one for white space takes at most a
leading blank and then only characters that aren't white space, and the pattern
looks ahead only from white space. So no match crosses such a place and none ends
there differently because of what follows: ids on the far side of a safe cut are
final, whatever is joined later. A text without safe cuts is encoded whole.

Decoding goes up the same kind of tree: halves of the ids are decoded and their
bytes concatenated.

Defined results: a null text counts as empty and has no ids. Rows map one to one.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswright.llm._common import arrow_map

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Characters of a leaf of the encoding tree, ids of a leaf of the decoding tree.
LEAF_CHARS, LEAF_IDS = 8192, 8192
FIRST_WINDOW = 32


class Codec:
    """Encodes and decodes with one rank file, given as bytes."""

    def __init__(self, ranks: bytes, pattern: str = public_tokenizers.PATTERN):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self._enc = tiktoken.Encoding("glosswright", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def leaf(self, text: str) -> list[int]:
        return self._enc.encode_ordinary(text)

    def encode(self, text: str, leaf_chars: int = LEAF_CHARS) -> list[int]:
        return self._tree(text, leaf_chars).ids

    def _tree(self, text: str, leaf_chars: int) -> Part:
        if len(text) <= leaf_chars:
            return Part(text, self.leaf(text))
        half = len(text) // 2
        return self.join(self._tree(text[:half], leaf_chars), self._tree(text[half:], leaf_chars))

    def join(self, left: Part, right: Part) -> Part:
        """The part for left.text + right.text."""
        if not left.text or not right.text:
            return left if left.text else right
        a, b = _last_cut(left.text), _first_cut(right.text)
        tail, head = left.text[a:], right.text[:b]
        final_left = left.ids[: len(left.ids) - len(self.leaf(tail))]
        final_right = right.ids[len(self.leaf(head)) :]
        return Part(left.text + right.text, [*final_left, *self.leaf(tail + head), *final_right])

    def decode(self, ids: list[int], leaf_ids: int = LEAF_IDS) -> bytes:
        if len(ids) <= leaf_ids:
            return self._enc.decode_bytes(ids)
        half = len(ids) // 2
        return self.decode(ids[:half], leaf_ids) + self.decode(ids[half:], leaf_ids)


@dataclass(frozen=True, slots=True)
class Part:
    text: str
    ids: list[int]


def _last_cut(text: str) -> int:
    """The last safe cut, or 0: the window then takes the whole part."""
    n, size = len(text), FIRST_WINDOW
    while True:
        low = max(0, n - size)
        for i in range(n - 1, low, -1):
            if text[i].isspace() and not text[i - 1].isspace():
                return i
        if not low:
            return 0
        size *= 2


def _first_cut(text: str) -> int:
    """The first safe cut, or the part's length."""
    n, size = len(text), FIRST_WINDOW
    while True:
        for i in range(1, min(n, size)):
            if text[i].isspace() and not text[i - 1].isspace():
                return i
        if size >= n:
            return n
        size *= 2


_codecs: dict[bytes, Codec] = {}


def _codec(ranks: bytes) -> Codec:
    """One codec for each rank file and worker process."""
    key = hashlib.sha256(ranks).digest()
    if key not in _codecs:
        _codecs[key] = Codec(ranks)
    return _codecs[key]


def load_ranks(spark: SparkSession, path: str = VOCABULARY):
    """The rank file, read on the driver and broadcast; it must be below 64 MB."""
    with open(path, "rb") as f:
        data = f.read((64 << 20) + 1)
    if len(data) > 64 << 20:
        raise ValueError(f"{path} is too large to broadcast")
    return spark.sparkContext.broadcast(data)


def encode(docs: DataFrame, path: str = VOCABULARY, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id and ids (array of int) for each row."""
    ranks = load_ranks(docs.sparkSession, path)

    def run(cols: dict[str, list]) -> dict[str, list]:
        codec = _codec(ranks.value)
        return {"doc_id": cols["doc_id"], "ids": [codec.encode(t or "", leaf_chars) for t in cols["text"]]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and text (binary) for each row of doc_id and ids."""
    ranks = load_ranks(encoded.sparkSession, path)

    def run(cols: dict[str, list]) -> dict[str, list]:
        codec = _codec(ranks.value)
        return {"doc_id": cols["doc_id"], "text": [codec.decode(i or []) for i in cols["ids"]]}

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return arrow_map(encoded.select("doc_id", "ids"), run, f"doc_id {kind}, text binary")


def report(docs: DataFrame, path: str = VOCABULARY, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them."""
    ranks = load_ranks(docs.sparkSession, path)

    def run(cols: dict[str, list]) -> dict[str, list]:
        codec = _codec(ranks.value)
        out = {"doc_id": cols["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in cols["text"]:
            ids = codec.encode(text or "", leaf_chars)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(
        docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
