"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of lexicon words, second-person words near them,
capitals, punctuation and obfuscation rates. The lexicon starts from a short list of
insults; word beginnings that the labelled texts prove toxic are added with the lower
confidence limit of their toxic share as weight. Toxic words of inflected languages
share a stem, hence beginnings of 3 to 8 letters and whole words.

Training reads only labelled rows whose crc32(doc_id as text) mod 5 isn't 0, at most
TRAIN_ROWS of them, the first by hash. They fall into two halves. Each half's features
use the lexicon learned from the other half, so the trees see the lexicon's strength
on texts it wasn't learned from; scoring uses the lexicon of both. A fifth of these
rows is kept from the trees to calibrate them.

Scoring is a map over all rows: one pass, no shuffle. Inputs of a score are the text
and the trained model, nothing else.

Defined results: a null text counts as empty and is scored like one. Labels that are
null or name no document are ignored; of repeated labels the largest counts. Without
any labelled row every score is 0. A null doc_id is not held out. Rows map one to one;
rows that repeat a labelled doc_id each count for training, TRAIN_ROWS rows in all.
An empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswright.llm._boosting import Isotonic, Trees, fit, isotonic
from glosswright.llm._common import arrow_map, bounded_batches, first_rows, materialize, utf8
from glosswright.sources.storage import scratch

#: Labelled rows to learn from at most.
TRAIN_ROWS = 40_000
#: Word beginnings that a task counts before it hands them on.
HELD_BEGINNINGS = 1 << 18

# Seed lexicon and second-person words.
INSULTS = (
    "idiot", "moron", "stupid", "dumb", "loser", "pathetic", "worthless", "disgusting", "trash", "scum", "clown",
    "garbage", "fool", "imbecile", "jerk", "hate", "ugly", "vermin", "freak", "bastard", "shut", "kill",
)
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "u", "ur", "tu", "te", "toi", "ton", "ta", "vous", "votre", "du", "dich",
    "dir", "dein", "deine", "ihr", "euch", "usted", "ustedes", "tus", "ti", "vosotros",
)
LEET = str.maketrans("01345@$7!", "oieasasti")

FEATURES = (
    "seed_density", "seed_count", "learned_density", "learned_max", "learned_sum", "learned_strong", "second_density",
    "second_near", "capitals", "shouted", "exclaims", "questions", "symbols", "digits", "obfuscated", "leet_hits",
    "repeats", "log_words",
)

_WORD = re.compile(r"[^\W\d_]+(?:[*@$!#013457]+[^\W\d_]+)*")
_MIXED = re.compile(r"[*@$!#013457]")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def beginnings(word: str) -> list[str]:
    """What of a word the lexicon may hold; whole words end in a blank."""
    return [word + " ", *(word[:n] for n in range(3, min(8, len(word)) + 1))]


@dataclass
class Lexicon:
    weights: dict[str, float]

    def __post_init__(self) -> None:
        self.memo: dict[str, int] = {}
        self.known: list[tuple[float, ...]] = []
        self.matrix = np.empty((0, 6))

    def look_up(self, token: str) -> tuple[float, ...]:
        """Learned weight, seed word, second person, hit through obfuscation only, shouted, obfuscated."""
        word = token.lower()
        get = self.weights.get
        weight = max(get(b, 0.0) for b in beginnings(word))
        seed, leet, mixed = int(word in INSULTS), 0, int(bool(_MIXED.search(word)))
        if mixed:
            plain = word.translate(LEET)
            letters = re.sub(r"[^\w]", "", plain)
            leet = int(not seed and (plain in INSULTS or letters in INSULTS))
        return weight, seed, int(word in SECOND_PERSON), leet, int(len(token) > 2 and token.isupper()), mixed

    def _looked(self, tokens: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > 1 << 18:
            memo.clear()
            self.known, self.matrix = [], self.matrix[:0]
        try:
            at = np.fromiter(map(memo.__getitem__, tokens), np.int64, len(tokens))
        except KeyError:
            for t in tokens:
                if t not in memo:
                    memo[t] = len(self.known)
                    self.known.append(self.look_up(t))
            at = np.fromiter(map(memo.__getitem__, tokens), np.int64, len(tokens))
        if len(self.known) > len(self.matrix):
            # grown by doubling
            more = np.zeros((max(1024, 2 * len(self.known)), 6))
            more[: len(self.known)] = self.known
            self.matrix, self.filled = more, len(self.known)
        elif self.known and self.filled < len(self.known):
            self.matrix[self.filled : len(self.known)] = self.known[self.filled :]
            self.filled = len(self.known)
        return self.matrix[at]

    def features(self, text: str) -> list[float]:
        tokens = _WORD.findall(text)
        n, chars = max(1, len(tokens)), max(1, len(text))
        raw = np.frombuffer(text.encode(), np.uint8)
        counts = np.bincount(raw, minlength=256)
        weight, seed, second, leet, shouted, mixed = self._looked(tokens).T
        hits = np.flatnonzero((weight > 0.5) | (seed > 0) | (leet > 0))
        you = np.flatnonzero(second)
        near = 0
        if len(hits) and len(you):
            at = np.searchsorted(you, hits)
            left = hits - you[np.maximum(at - 1, 0)]
            right = you[np.minimum(at, len(you) - 1)] - hits
            near = int(((np.abs(left) <= 5) | (np.abs(right) <= 5)).sum())
        upper = counts[65:91].sum()
        letters = max(1, upper + counts[97:123].sum())
        symbols = counts[[35, 36, 37, 38, 42, 64, 94, 126, 124]].sum()
        repeats = int((raw[1:] == raw[:-1]).sum()) if len(raw) > 1 else 0
        return [
            seed.sum() / n, seed.sum(), weight.sum() / n, weight.max(initial=0), weight.sum(), (weight > 0.6).sum(), len(you) / n, near / n,
            upper / letters, shouted.sum() / n, counts[33] / chars, counts[63] / chars, symbols / chars, counts[48:58].sum() / chars, mixed.sum() / n,
            leet.sum() / n, repeats / chars, float(np.log1p(len(tokens))),
        ]


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    calibration: Isotonic | None

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None or self.calibration is None:
            return np.zeros(len(texts))
        margin = self.trees.margin(np.array([self.lexicon.features(t) for t in texts]).reshape(len(texts), len(FEATURES)))
        # a trace of the margin orders what the calibration ties
        return np.clip(0.998 * self.calibration(margin) + 0.002 / (1 + np.exp(-margin)), 0, 1)


def _training_rows(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, text, toxic, part (0-9) of at most `rows` labelled documents."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64(F.col("doc_id").cast("long"), F.lit(6))
    known = known.withColumn("order", order).orderBy("order", "doc_id").limit(rows)
    known = known.select("doc_id", "toxic", F.pmod("order", F.lit(10)).cast("int").alias("part"))
    # at most `rows` rows of 16 bytes
    found = docs.select("doc_id", "text").join(F.broadcast(materialize(known, "toxicity-labels")), "doc_id")
    found = materialize(found, "toxicity-labelled")
    return materialize(first_rows(found, rows, "doc_id", "text"), "toxicity-training")


def _counts(training: DataFrame) -> DataFrame:
    """begin, n0, p0, n1, p1: texts without and with the label that hold a beginning, by half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), *(pa.array([v[i] for v in held.values()], pa.int64()) for i in range(4))],
                names=["begin", "n0", "p0", "n1", "p1"],
            )
            held.clear()
            return out

        # a task's counts are summed before they leave it, as long as they fit
        for batch in batches:
            for text, toxic, part in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                at = 2 * (part % 2) + (1 if toxic else 0)
                words = {w.lower() for w in _WORD.findall(text or "")}
                for b in {b for w in words for b in beginnings(w)}:
                    held.setdefault(b, [0, 0, 0, 0])[at] += 1
            if len(held) > HELD_BEGINNINGS:
                yield counted()
        if held:
            yield counted()

    rows = bounded_batches(training.select("text", "toxic", "part"))
    parts = rows.mapInArrow(run, "begin string, n0 long, p0 long, n1 long, p1 long")
    return parts.groupBy("begin").agg(*(F.sum(c).alias(c) for c in ("n0", "p0", "n1", "p1")))


def _lower_limit(p: Column, n: Column) -> Column:
    """Lower limit of Wilson's 90 % interval for the toxic share."""
    z2, total = 1.64**2, (p + n).cast("double")
    share = p / total
    return (share + z2 / (2 * total) - 1.64 * F.sqrt((share * (1 - share) + z2 / (4 * total)) / total)) / (1 + z2 / total)


def _lexicons(training: DataFrame) -> list[Lexicon]:
    """Learned from half 0, half 1, and both."""
    counts = materialize(_counts(training).filter("p0 + p1 > 1"), "toxicity-counts")
    out = []
    for p, n in (("p0", "n0"), ("p1", "n1"), ("p0 + p1", "n0 + n1")):
        rows = counts.select("begin", F.expr(p).alias("p"), F.expr(n).alias("n")).filter("p > 1")
        rows = rows.withColumn("weight", _lower_limit(F.col("p"), F.col("n"))).filter("weight > 0.3")
        # beginnings of the training texts, whose number is bounded
        out.append(Lexicon({r.begin: r.weight for r in rows.collect()}))
    return out


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model learned from at most `rows` labelled documents that aren't held out."""
    with scratch(docs.sparkSession):
        return _train(_training_rows(docs, labels, rows))


def _train(training: DataFrame) -> Model:
    first, second, both = _lexicons(training)
    sent = training.sparkSession.sparkContext.broadcast((first.weights, second.weights))
    names = [f"f{i}" for i in range(len(FEATURES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = [Lexicon(w) for w in sent.value]
        for batch in batches:
            texts, toxic, parts = (batch.column(i).to_pylist() for i in range(3))
            x = np.array([of[1 - p % 2].features(t or "") for t, p in zip(texts, parts, strict=True)]).reshape(len(texts), len(names))
            yield pa.RecordBatch.from_arrays(
                [pa.array(toxic, pa.int32()), pa.array(parts, pa.int32()), *(pa.array(c) for c in x.T)],
                names=["toxic", "part", *names],
            )

    schema = "toxic int, part int, " + ", ".join(f"{c} double" for c in names)
    data = bounded_batches(training.select("text", "toxic", "part")).mapInArrow(run, schema).toPandas()
    data = data.sort_values(list(data.columns)).reset_index(drop=True)  # the model doesn't depend on the order of tasks
    x, y, part = data[names].to_numpy(), data["toxic"].to_numpy() != 0, data["part"].to_numpy()
    if not len(y):
        return Model(both, None, None)
    calibrate = part >= 8 if 20 <= (y & (part >= 8)).sum() else np.ones(len(y), bool)
    learn = ~calibrate if not calibrate.all() else calibrate
    trees = fit(x[learn], y[learn].astype(float))
    return Model(both, trees, isotonic(trees.margin(x[calibrate]), y[calibrate].astype(float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast((model.lexicon.weights, model.trees, model.calibration))
    held: list[Model] = []

    def run(cols: dict[str, list]) -> dict[str, list]:
        if not held:
            weights, trees, calibration = sent.value
            held.append(Model(Lexicon(weights), trees, calibration))
        scores = held[0].score([t.decode() for t in cols["text"]])
        return {
            "doc_id": cols["doc_id"],
            "held_out": cols["held_out"],
            "score": scores.tolist(),
            "predicted": (scores >= 0.5).astype(int).tolist(),
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), utf8().alias("text"))
    return arrow_map(rows, run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def report(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    return score(docs, train(docs, labels, rows))
