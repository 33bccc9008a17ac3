"""Quality classifier: a weak-label model and a hashed linear scorer.

Overlapping heuristic labellers vote good, bad or abstain on each document. All
documents are reduced to counts of vote patterns, of which there are at most
3 ** labellers, and expectation-maximisation over these counts estimates each
labeller's accuracies and the share of good documents. A pattern's posterior is its
documents' training label. A linear scorer over hashed token shapes, hashed words and
document statistics is then trained on a bounded sample and applied to every document, so texts
on which all labellers abstain get a score, too.

The vote count and the scoring are maps over all rows; what leaves them before a
shuffle is a row for each pattern and task.

Labellers of sentences, stop words, repeats and lines abstain on texts of under 20
words, that of runs under 6: a share of so few words says nothing. The scorer sees these
shares for every text.

Defined results: a null text counts as empty; empty texts and texts without words
score 0. Rows map one to one, repeated ones get one score, and the training sample
holds at most `rows` rows even if doc_id repeats. Without any document with words every
score is 0; an empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswright.llm._common import arrow_filter, arrow_map, bounded_batches, first_rows, give_back, materialize, released, utf8
from glosswright.sources.storage import scratch

#: Documents the scorer is trained on at most, the first by hash.
TRAIN_ROWS = 20_000
#: Buckets of token shapes and statistics, and as many of words; dimensions of the hashed features.
SHAPES = 1 << 12
DIMENSIONS = 2 * SHAPES
#: A document is kept when its score reaches this.
KEEP_AT = 0.5

# Frequent function words of the corpus' languages, in lower case.
STOP_WORDS = frozenset(
    w.encode()
    for w in (
        "the of and to in is that it for was on are as with be by this from at or an a not which have "
        "le la les de des et un une du en que qui dans pour pas sur par au avec est ce il "
        "der die das und ist von zu mit den nicht ein eine auf für im dem des sich auch es "
        "el los las y un una por con no para su al lo como más pero sus"
    ).split()
)

_SHAPE = re.compile(rb"[a-z\x80-\xff]+|[A-Z]+|[0-9]+")
_STATS = ("symbols", "upper", "digits", "pipes", "sentences", "stops", "repeats", "lines", "length", "exclaims", "word_size", "longest", "runs")


#: Bits of a remembered token: whether it's a stop word, its shape's bucket, its word's bucket, its hash.
_SHAPE_AT, _WORD_AT, _REST_AT = 1, 13, 25
#: Remembered tokens of a worker, some 12 MB.
_MEMO_TOKENS = 1 << 16
_ODD = np.random.default_rng(2).integers(1, 2**63, 3, dtype=np.uint64) | np.uint64(1)


def _shape(token: bytes) -> int:
    """Bucket of a token's shape: letters, capitals and digits by class, other bytes as they are."""
    mapped = _SHAPE.sub(lambda m: b"a" if m[0][0] >= 97 else b"A" if m[0][0] >= 65 else b"0", token)
    return zlib.crc32(mapped) % SHAPES


def _token(token: bytes) -> int:
    plain = token.lower().strip(b".,;:!?")
    word, rest = zlib.crc32(plain, 7) % SHAPES, xxhash.xxh3_64_intdigest(token) >> _REST_AT << _REST_AT
    return rest | word << _WORD_AT | _shape(token) << _SHAPE_AT | (plain in STOP_WORDS)


@dataclass
class Looked:
    """What both the labellers and the scorer see of a text."""

    words: int
    stats: np.ndarray
    counts: np.ndarray  # by bucket: shapes first, then words
    buckets: np.ndarray


class Reader:
    def __init__(self) -> None:
        self.memo: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> Looked:
        tokens = text.split()
        n = len(tokens)
        if len(self.memo) > _MEMO_TOKENS:
            self.memo.clear()
        memo = self.memo
        try:
            ids = np.fromiter(map(memo.__getitem__, tokens), np.uint64, n)
        except KeyError:
            for t in tokens:
                if t not in memo:
                    memo[t] = _token(t)
            ids = np.fromiter(map(memo.__getitem__, tokens), np.uint64, n)
        raw = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        size, words = max(1, len(text)), max(1, n)
        upper, lower = raw[65:91].sum(), raw[97:123].sum() + raw[128:].sum()
        lines = [line for line in text.split(b"\n") if line.strip()]
        same = ids >> np.uint64(_WORD_AT)
        triples = same[:-2] * _ODD[0] + same[1:-1] * _ODD[1] + same[2:] * _ODD[2] if n > 2 else same[:0]
        stats = np.array(
            [
                (raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum() - raw[44] - raw[46] - raw[39] - raw[45]) / size,
                upper / max(1, upper + lower),
                raw[48:58].sum() / size,
                raw[124] / words,
                (raw[46] + raw[63] + raw[33]) / words,
                (ids & np.uint64(1)).sum() / words,
                1 - len(np.unique(triples)) / len(triples) if len(triples) else 0.0,
                1 - len(set(lines)) / len(lines) if lines else 0.0,
                np.log1p(n),
                raw[33] / words,
                size / words,
                max(map(len, lines), default=0) / size,
                (same[1:] == same[:-1]).sum() / words,
            ]
        )
        shapes = (ids >> np.uint64(_SHAPE_AT)) % np.uint64(SHAPES)
        named = (ids >> np.uint64(_WORD_AT)) % np.uint64(SHAPES) + np.uint64(SHAPES)
        buckets, counts = np.unique(np.concatenate((shapes, named)), return_counts=True)
        return Looked(n, stats, counts, buckets.astype(np.int64))


GOOD, BAD, ABSTAIN = 1, 0, -1


def _between(value: float, good: float, bad: float) -> int:
    """Good up to one limit, bad from the other on."""
    return GOOD if value <= good else BAD if value >= bad else ABSTAIN


def votes(d: Looked) -> tuple[int, ...]:
    """Each labeller's vote on a text that has words."""
    s = dict(zip(_STATS, d.stats.tolist(), strict=True))
    enough = d.words >= 20
    return (
        _between(s["symbols"], 0.03, 0.08),
        _between(s["upper"], 0.15, 0.4),
        _between(s["pipes"], 0.02, 0.2),
        (GOOD if 0.03 <= s["sentences"] <= 0.4 else BAD) if enough else ABSTAIN,
        (GOOD if s["stops"] >= 0.15 else BAD if s["stops"] < 0.05 else ABSTAIN) if enough else ABSTAIN,
        _between(s["repeats"], 0.15, 0.5) if enough else ABSTAIN,
        _between(s["lines"], 0.1, 0.5) if enough else ABSTAIN,
        _between(s["exclaims"], 0.03, 0.15),
        _between(s["runs"], 0.05, 0.2) if d.words >= 6 else ABSTAIN,
    )


LABELLERS = 9


@dataclass
class WeakLabels:
    """Share of good documents and, by labeller, class and vote, the probabilities.

    They are those of a vote given that there is one: a labeller that abstains says
    nothing, or short texts, on which most abstain, would make a class of their own.
    """

    prior: float
    tables: np.ndarray  # labeller, class, vote; an abstention, last, has probability 1

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        at = np.where(patterns == ABSTAIN, 2, patterns)
        logs = np.log(self.tables)
        good = np.log(self.prior) + sum(logs[j, 1, at[:, j]] for j in range(at.shape[1]))
        bad = np.log1p(-self.prior) + sum(logs[j, 0, at[:, j]] for j in range(at.shape[1]))
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> WeakLabels:
    """Estimates the model from the counts of vote patterns.

    It starts from majority votes, which also fixes which class is the good one.
    """
    good, bad = (patterns == GOOD).sum(axis=1), (patterns == BAD).sum(axis=1)
    p = np.where(bad * 3 > good, 0.1, 0.9)  # few labellers see any one defect
    for _ in range(rounds):
        prior = np.clip((counts * p).sum() / counts.sum(), 0.01, 0.99)
        tables = np.empty((patterns.shape[1], 2, 3))
        for j in range(patterns.shape[1]):
            for c, w in ((0, counts * (1 - p)), (1, counts * p)):
                seen = np.bincount(patterns[:, j] + 1, w, 3)[1:] + 0.5
                tables[j, c, :2], tables[j, c, 2] = seen / seen.sum(), 1
        model = WeakLabels(float(prior), tables)
        before, p = p, model.posterior(patterns)
        if np.abs(p - before).max() < 1e-6:
            break
    return model


def _pattern_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Vote patterns of all documents with words, and how many have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, held = Reader(), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                d = read(text)
                if d.words:
                    held[sum((v + 1) * 3**j for j, v in enumerate(votes(d)))] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["pattern", "n"]
        )

    found = bounded_batches(docs.select(utf8().alias("text"))).mapInArrow(released(run), "pattern long, n long")
    rows = sorted(found.groupBy("pattern").agg(F.sum("n").alias("n")).collect())
    codes = np.array([r.pattern for r in rows], np.int64)
    patterns = np.stack([codes // 3**j % 3 - 1 for j in range(LABELLERS)], axis=1).reshape(len(rows), LABELLERS)
    return patterns, np.array([r.n for r in rows], float)


#: Words weigh less than shapes: there are more of them, and each is rarer.
WORD_WEIGHT = 0.5
#: Features that training goes through at once.
_FEATURES = 1 << 16
_STEPS = np.array([[zlib.crc32(b"%d:%d" % (i, k)) % SHAPES for k in range(16)] for i in range(len(_STATS))])


@dataclass
class Scorer:
    """Linear in the shares of token shapes and words and in bucketed statistics."""

    weights: np.ndarray
    bias: float

    @staticmethod
    def features(d: Looked) -> tuple[np.ndarray, np.ndarray]:
        steps = [int(min(15, 20 * v)) if i != 8 else int(min(15, 2 * v)) for i, v in enumerate(d.stats.tolist())]
        fixed = [_STEPS[i, k] for i, k in enumerate(steps)]
        values = np.sqrt(d.counts / max(1, d.words)) * np.where(d.buckets < SHAPES, 1.0, WORD_WEIGHT)
        return np.concatenate((d.buckets, fixed)).astype(np.int64), np.concatenate((values, np.full(len(fixed), 0.3)))

    def score(self, d: Looked) -> float:
        if not d.words:
            return 0.0
        at, value = self.features(d)
        return float(1 / (1 + np.exp(-np.clip(self.weights[at] @ value + self.bias, -30, 30))))


def fit_scorer(at: np.ndarray, value: np.ndarray, doc: np.ndarray, target: np.ndarray, rounds: int = 120, ridge: float = 1e-4) -> Scorer:
    """Logistic regression on soft targets by Adam over the whole sample.

    at, value, doc: dimension, value and document of each feature that isn't 0, by document.
    They are gone through some _FEATURES at a time, so that nothing else of their length is
    held; a dimension's sum goes on where the last one ended, so it is the same to the last bit.
    """
    n = len(target)
    w = np.zeros(DIMENSIONS + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    ends = np.searchsorted(doc, doc[_FEATURES - 1 :: _FEATURES], "right").tolist()
    blocks = [slice(*x) for x in pairwise(sorted({0, *ends, len(at)}))]
    every = np.arange(DIMENSIONS)
    for t in range(1, rounds + 1):
        z = np.full(n, w[-1])
        for b in blocks:
            low, high = doc[b.start], doc[b.stop - 1] + 1
            z[low:high] = np.bincount(doc[b] - low, w[at[b]] * value[b]) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        g = np.zeros(DIMENSIONS)
        for b in blocks:
            g = np.bincount(np.concatenate((every, at[b])), np.concatenate((g, error[doc[b]] * value[b])))
        g = np.append(g, error.sum())
        g[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Scorer(w[:-1], float(w[-1]))


@dataclass
class Model:
    weak: WeakLabels | None
    scorer: Scorer | None


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    patterns, counts = _pattern_counts(docs)
    if not len(counts):
        return Model(None, None)
    weak = expectation_maximisation(patterns, counts)
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit(2))
    first = docs.select("doc_id").withColumn("order", order).orderBy("order").limit(rows)
    sent = docs.sparkSession.sparkContext.broadcast(weak)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            looked = [d for d in map(read, texts) if d.words]
            features = [Scorer.features(d) for d in looked]
            voted = np.array([votes(d) for d in looked], np.int64).reshape(len(looked), LABELLERS)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([xxhash.xxh3_64_intdigest(t) >> 1 for t in texts if t.split()], pa.int64()),
                    pa.array([a.astype(np.int16) for a, _ in features], pa.list_(pa.int16())),
                    pa.array([v.astype(np.float32) for _, v in features], pa.list_(pa.float32())),
                    pa.array(sent.value.posterior(voted)),
                ],
                names=["order", "at", "value", "target"],
            )

    with scratch(docs.sparkSession):
        first = materialize(first.select("doc_id").distinct(), "quality-ids")  # at most `rows` ids
        sample = docs.select("doc_id", utf8().alias("text")).join(F.broadcast(first), "doc_id")
        sample = first_rows(materialize(sample, "quality-sample"), rows, "doc_id", "text").select("text")
        found = bounded_batches(sample).mapInArrow(released(run), "order long, at array<smallint>, value array<float>, target double").toArrow()
    if not found.num_rows:
        return Model(weak, None)
    found = found.take(np.argsort(found["order"].to_numpy(), kind="stable"))  # the model doesn't depend on the order of tasks
    at, value = (found[c].combine_chunks() for c in ("at", "value"))
    target = found["target"].to_numpy()
    del found
    doc = np.repeat(np.arange(len(target), dtype=np.int32), np.diff(at.offsets.to_numpy()))
    model = Model(weak, fit_scorer(at.flatten().to_numpy(), value.flatten().to_numpy(), doc, target))
    del at, value, doc
    give_back()
    return model


def report(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, score, weak_label, kept for each row of docs.

    weak_label is the posterior of the labellers' votes, null for a text without words.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, rows))
    read = Reader()

    def run(cols: dict[str, list]) -> dict[str, list]:
        model, looked = sent.value, [read(t) for t in cols["text"]]
        scores = [model.scorer.score(d) if model.scorer else 0.0 for d in looked]
        voted = np.array([votes(d) for d in looked], np.int64).reshape(len(looked), LABELLERS)
        weak = model.weak.posterior(voted).tolist() if model.weak else [None] * len(looked)
        return {
            "doc_id": cols["doc_id"],
            "score": scores,
            "weak_label": [w if d.words else None for w, d in zip(weak, looked, strict=True)],
            "kept": [s >= KEEP_AT for s in scores],
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows_ = docs.select("doc_id", utf8().alias("text"))
    return arrow_map(rows_, run, f"doc_id {kind}, score double, weak_label double, kept boolean")


def drop_rejected(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """docs whose score reaches KEEP_AT; columns as before."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, rows))
    read = Reader()

    def keep(texts: list[bytes]) -> list[bool]:
        scorer = sent.value.scorer
        return [scorer is not None and scorer.score(read(t)) >= KEEP_AT for t in texts]

    return arrow_filter(docs, keep)
