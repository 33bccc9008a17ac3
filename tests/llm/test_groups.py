"""Operators that relate rows to each other, models, and the pipeline."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glosswright.llm import bpe, chat, decontaminate, exact_dedup, ngram_join, quality, toxicity
from tests.llm.helpers import EDGE, edge, empty

D = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# --- chat ---------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rows = [
        (1, 1, "assistant", "a\\<|im_end|>\\\\|<\\|x\n"),
        (1, 0, "user", None),
        (1, 2, None, "<|im_start|>user\nb"),
        (1, 2, "ro\\n\nle<|", "\U0001f600é" * 50),
        (2, 0, "assistant", ""),
        (2, 0, "assistant", "same"),
        (2, 0, "assistant", "same"),
        (None, None, "assistant", "x" * 50_000),
        (-1, 5, "user", chat.PROBE),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash"))
    got = {r.conv_id: r for r in chat.report(df).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in mine if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(mine), sha("".join(f"{r}\n{x}\n" for _, r, x in mine)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    assert chat.report(df.limit(0)).count() == 0
    probe = {r.conv_id: r for r in chat.report(chat.with_probe(df.filter("conv_id = 2"))).collect()}
    assert probe[-1].loss_sha256 == sha(chat.PROBE) and probe[-1].n_turns == 2


def test_chat_fold(spark):
    rows = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", "one"), (1, 1, 2, "delta", None, " two"),
        (1, 1, 3, "edit", None, "three"), (1, 1, 4, "delta", None, " four"), (1, 2, 9, "message", "assistant", "old"),
        (1, 2, 11, "delta", None, "w"), (1, 2, 10, "regenerate", None, "ne"), (2, 0, 5, "delta", "user", "b"), (2, 0, 4, "delta", "user", "a"),
    ]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, seq long, op string, role string, text string")
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in chat.fold_events(df).collect())
    assert got == [(1, 0, "user", "hi"), (1, 1, "assistant", "three four"), (1, 2, "assistant", "new"), (2, 0, "user", "ab")]


# --- exact copies --------------------------------------------------------------------


@pytest.mark.parametrize("counters", [2, 4096])
def test_exact_dedup(spark, counters):
    rng = random.Random(5)
    texts = ["Ab", "aB", None, "", "é", "É", *(f"t{i}" for i in range(30))]
    rows = [(i, texts[0] if rng.random() < 0.4 else rng.choice(texts)) for i in range(300)] + [(None, "ab"), (None, "only null")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)).repartition(5)
    groups: dict = {}
    for d, t in rows:
        groups.setdefault(low(t), []).append(d)
    best = {k: max((d for d in v if d is not None), default=None) for k, v in groups.items()}
    want = sorted((str(d), str(best[low(t)]), len(groups[low(t)]), d == best[low(t)], sha(low(t))) for d, t in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), *tuple(r)[2:]) for r in exact_dedup.report(df, counters).collect()) == want
    kept = exact_dedup.drop_duplicates(df, counters)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(b) for b in best.values())
    assert exact_dedup.report(empty(spark)).count() == 0


def test_exact_dedup_leaves_one_of_repeated_rows(spark):
    rows = [(1, "Ab", "x"), (2, "aB", "y"), (2, "aB", "y"), (2, "ab", "y"), (3, "c", "z"), (3, "c", "z"), (3, "d", "z"), (None, "e", "n"), (None, "e", "n"), (5, None, "q"), (5, "", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(3)
    kept = exact_dedup.drop_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(str((r.doc_id, low(r.text), r.digest)) for r in kept.collect()) == sorted(str(x) for x in [(2, "ab", "y"), (3, "c", "z"), (3, "d", "z"), (None, "e", "n"), (5, "", "q")])


def test_misra_gries_finds_what_is_frequent(spark):
    rng = random.Random(2)
    values = [b"hot"] * 400 + [b"warm"] * 150 + [str(rng.random()).encode() for _ in range(1000)]
    rng.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v binary").repartition(7)
    found = [bytes(r.v) for r in exact_dedup.misra_gries(df, "v", 20).collect()]
    assert {b"hot", b"warm"} <= set(found) and len(found) <= 20


# --- n-gram join ----------------------------------------------------------------------


def shingles(text, n):
    words = low(text).encode().split()
    k = min(n, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute_components(rows, n, percent):
    sets = {d: shingles(t, n) for d, t in rows}
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                label[q] = p
    return sorted((d, len(sets[d]), find(d)) for d in ids)


def near_corpus(seed):
    """Families of edited copies, chains, shared passages, short texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(300))
    passage = [word() for _ in range(60)]
    rows: list[str | None] = [None, "", " ", "one", "One", "one two", "one two three", "ONE two three", "a b c a b c a b c"]
    for _ in range(6):
        base = [word() for _ in range(rng.randrange(20, 160))]
        for _ in range(rng.randrange(2, 25)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy  # a chain
    for _ in range(40):
        rows.append(" ".join(passage + [word() for _ in range(rng.randrange(1, 12))]))
        rows.append(" ".join([word() for _ in range(30)] + passage))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "n", "percent", "small"), [(1, 3, 90, 8), (2, 5, 80, 8), (3, 3, 90, 1), (4, 2, 60, 2)])
def test_join_equals_all_pairs(spark, seed, n, percent, small, monkeypatch):
    if small == 1:
        monkeypatch.setattr(ngram_join, "PIVOTS", (1, 2))
    rows = near_corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(0)).repartition(3)
    got = sorted(tuple(r) for r in ngram_join.classes(df, n, percent, small_group=small).collect())
    assert got == brute_components(rows, n, percent)


def test_frequent_columns_list_a_pair_once(spark):
    # nodes 1 to 3 share columns 5 and 9; only the first of them lists their pairs
    rows = [(g, v, v) for g in (5, 9) for v in (1, 2, 3)] + [(9, 4, 4)]
    large = spark.createDataFrame(rows, "sig long, node long, label long")
    sketch = F.array(*[F.lit(1)] * ngram_join.SKETCH)
    shared = large.groupBy("node").agg(F.collect_set("sig").alias("sigs")).withColumns({"held": F.lit(ngram_join.SKETCH).cast("long"), "sketch": sketch})
    pairs, _ = ngram_join._next_pivots(large, shared, large.limit(0).select("sig", "node"), 90, 0)
    assert sorted(map(tuple, pairs.distinct().collect())) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]


def test_unlinked_members_of_a_frequent_column(spark, monkeypatch):
    """Members that share columns and no links: few rounds, and only pairs alike by counts are listed."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(14)])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    turns, listed = [], []
    following, linked = ngram_join._next_pivots, ngram_join._linked
    monkeypatch.setattr(ngram_join, "_next_pivots", lambda *a: (turns.append(a[-1]), following(*a))[1])
    monkeypatch.setattr(ngram_join, "_linked", lambda s, pairs, p: (listed.append(pairs.count()), linked(s, pairs, p))[1])
    monkeypatch.setattr(ngram_join, "PIVOTS", (1, 7))
    got = sorted(tuple(r) for r in ngram_join.classes(df, 1, 80).collect())
    assert got == brute_components(rows, 1, 80)
    assert len(turns) <= 2 + np.log2(300 / 8) + 1 and sum(listed) <= 300 * 299 / 2


def test_large_family_lists_few_pairs(spark, monkeypatch):
    """A family of near copies, many of them too far apart: the pairs listed don't grow with its square."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(500):
        words = list(base)
        for _ in range(rng.randrange(1, 7)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    listed, possible = [], ngram_join._possible
    monkeypatch.setattr(ngram_join, "_possible", lambda pairs, *a: (listed.append(pairs.count()), possible(pairs, *a))[1])
    got = sorted(tuple(r) for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect())
    assert got == brute_components(rows, 5, 80)
    assert sum(listed) <= 10 * len(rows)


def test_join_stores_no_sets_of_unpaired_documents(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(80))) for i in range(60)]
    rows += [(60 + i, rows[0][1] + f" x{i}") for i in range(2)]
    stored, write = {}, ngram_join.materialize

    def counted(df, name):
        table = write(df, name)
        if "grams" in table.columns:
            stored[name] = table.count()
        return table

    monkeypatch.setattr(ngram_join, "materialize", counted)
    got = sorted(tuple(r) for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_components(rows, 3, 90) and sum(stored.values()) <= 3


def test_odd_blocks_bound_the_difference():
    rng = np.random.default_rng(8)
    grams = rng.integers(0, 2**63, 9000).astype(np.uint64)
    for size, other, shared in ((1, 1, 0), (1, 1, 1), (3, 40, 2), (16, 17, 16), (300, 290, 270), (4000, 5000, 3900)):
        x, y = grams[:size], grams[size - shared : size - shared + other]
        found, apart = ngram_join.least_apart(ngram_join.odd_blocks(x), ngram_join.odd_blocks(y)), size + other - 2 * shared
        assert found == ngram_join.least_apart(ngram_join.odd_blocks(y), ngram_join.odd_blocks(x))
        assert 0.6 * apart - 3 <= found <= apart and found % 2 == apart % 2


def test_repeated_values_are_all_found(spark):
    from glosswright.llm._membership import among, repeated

    rng = np.random.default_rng(5)
    alone, twice = rng.integers(-(2**63), 2**63 - 1, (2, 3000))
    rows = [([int(v) for v in part],) for part in np.array_split(np.concatenate((alone, twice, twice, twice[:9])), 40)] + [([],)]
    words = repeated(spark.createDataFrame(rows, "v array<long>").repartition(4))
    assert among(words, twice).all() and among(words, alone).mean() < 0.01
    assert not repeated(spark.createDataFrame([], "v array<long>")).any()


def test_released_maps_pass_every_batch():
    import pyarrow as pa

    from glosswright.llm._common import released

    batches = [pa.RecordBatch.from_arrays([pa.array(range(n))], names=["v"]) for n in (3, 0, 5)]
    assert list(released(lambda found: (b.slice(0, 2) for b in found))(iter(batches))) == [b.slice(0, 2) for b in batches]
    assert list(released(iter)(iter([]))) == []


def test_bit_set_filters_lose_nothing(spark):
    from glosswright.llm._membership import among, bit_set, without

    rng = np.random.default_rng(3)
    values = rng.integers(-(2**63), 2**63 - 1, 5000)
    df = spark.createDataFrame([(int(v),) for v in values] + [(None,)], "v long")
    words = bit_set(df)
    assert among(words, values).all() and among(words, rng.integers(-(2**63), 2**63 - 1, 5000)).mean() < 0.01
    rows = [(1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, None), (3, None)]
    docs = spark.createDataFrame(rows, "v long, w string")
    lost = spark.createDataFrame([(1, "a"), (None, None), (9, "z")], "x long, y string")
    assert sorted(map(str, map(tuple, without(docs, lost, [F.col("v"), F.col("w")]).collect()))) == sorted(map(str, [(1, "b"), (2, "a"), (None, "a"), (3, None)]))


def pool_corpus(seed):
    """Unrelated families of near copies, all made of words of one pool."""
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(110)]
    rows = []
    for _ in range(14):
        base = rng.sample(pool, 80)
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.randrange(2, 5)):
                copy[rng.randrange(80)] = rng.choice(pool)
            rows.append(" ".join(copy))
    return list(enumerate(rows))


def test_join_of_documents_without_rare_shingles(spark):
    # one-word shingles of a small pool: every column is frequent, only pivots find the links
    rows = pool_corpus(6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in ngram_join.classes(df, 1, 90, small_group=2).collect())
    assert got == brute_components(rows, 1, 90)


def test_join_edges(spark):
    assert sorted(tuple(r) for r in ngram_join.classes(edge(spark)).collect()) == brute_components([(d, t) for d, t, _ in EDGE], 3, 90)
    assert ngram_join.classes(empty(spark)).count() == 0
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (9, "a b c d")]
    many = " ".join(f"w{i}" for i in range(60))
    repeated = [(5, many)] * 40 + [(6, many + " x")] * 30 + [(8, None)] * 30
    found = ngram_join.classes(spark.createDataFrame(repeated, "doc_id long, text string")).collect()
    assert sorted({tuple(r) for r in found}) == [(5, 58, 5), (6, 59, 5), (8, 0, 8)] and len(found) == 100
    got = sorted(str(tuple(r)) for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == ["(7, 2, 7)", "(7, 2, 7)", "(9, 2, 7)", "(None, 2, None)"]


# --- models ----------------------------------------------------------------------------


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.report(docs).join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(not r.kept for r in bad) >= 0.9 * len(bad)
    again = {r.doc_id: r.score for r in quality.report(docs.repartition(3)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in rows)
    got = {r.doc_id: r for r in quality.report(edge(spark)).collect()}
    assert len(got) == len(EDGE) and got[3].score == got[4].score == got[8].score == 0 and got[3].weak_label is None
    kept = quality.drop_rejected(edge(spark))
    assert kept.columns == edge(spark).columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.kept}
    assert quality.report(empty(spark)).count() == 0


def test_quality_equals_brute_force(spark):
    """Votes, estimates and scores against plain loops."""
    import math
    import re
    import zlib
    from collections import Counter

    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").union(edge(spark).select(F.col("doc_id") + 10**6, "text"))
    docs = docs.union(docs.limit(5))
    model = quality.train(docs)
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]

    def stats(text):
        ws = text.split()
        size, n = max(1, len(text)), max(1, len(ws))
        count = lambda f: sum(map(f, text))
        upper, lower = count(lambda c: 65 <= c <= 90), count(lambda c: 97 <= c <= 122 or c >= 128)
        symbols = count(lambda c: 33 <= c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 127) - sum(text.count(x) for x in (b",", b".", b"'", b"-"))
        lines = [x for x in text.split(b"\n") if x.strip()]
        triples = list(zip(ws, ws[1:], ws[2:], strict=False))
        stops = sum(w.lower().strip(b".,;:!?") in quality.STOP_WORDS for w in ws)
        return ws, [
            symbols / size, upper / max(1, upper + lower), count(lambda c: 48 <= c < 58) / size, text.count(b"|") / n, sum(text.count(x) for x in (b".", b"?", b"!")) / n, stops / n,
            1 - len(set(triples)) / len(triples) if triples else 0, 1 - len(set(lines)) / len(lines) if lines else 0, math.log1p(len(ws)), text.count(b"!") / n, size / n,
            max(map(len, lines), default=0) / size, sum(a == b for a, b in zip(ws, ws[1:], strict=False)) / n,
        ]

    def score(text):
        ws, st = stats(text)
        if not ws:
            return 0.0
        shape = lambda w: zlib.crc32(re.sub(rb"[a-z\x80-\xff]+|[A-Z]+|[0-9]+", lambda m: b"a" if m[0][0] >= 97 else b"A" if m[0][0] >= 65 else b"0", w)) % quality.SHAPES
        z = model.scorer.bias
        for k, c in Counter(map(shape, ws)).items():
            z += model.scorer.weights[k] * math.sqrt(c / len(ws))
        for k, c in Counter(zlib.crc32(w.lower().strip(b".,;:!?"), 7) % quality.SHAPES for w in ws).items():
            z += quality.WORD_WEIGHT * model.scorer.weights[quality.SHAPES + k] * math.sqrt(c / len(ws))
        for i, v in enumerate(st):
            z += 0.3 * model.scorer.weights[zlib.crc32(b"%d:%d" % (i, int(min(15, (2 if i == 8 else 20) * v)))) % quality.SHAPES]
        return 1 / (1 + math.exp(-max(-30, min(30, z))))

    want = sorted((d, score(t)) for d, t in rows)
    got = sorted((r.doc_id, r.score, r.kept) for r in quality.report(docs).collect())
    assert [d for d, _ in want] == [d for d, _, _ in got]
    assert all(abs(a - b) < 1e-6 and k == (b >= quality.KEEP_AT) for (_, a), (_, b, k) in zip(want, got, strict=True))

    # expectation-maximisation document by document
    read = quality.Reader()
    voted = [quality.votes(d) for d in (read(t) for _, t in rows) if d.words]
    p = [0.1 if 3 * v.count(0) > v.count(1) else 0.9 for v in voted]
    for _ in range(100):
        prior = min(0.99, max(0.01, sum(p) / len(p)))
        share = {}
        for j in range(quality.LABELLERS):
            for c in (0, 1):
                w = [sum((q if c else 1 - q) for q, v in zip(p, voted, strict=True) if v[j] == x) + 0.5 for x in (0, 1)]
                share[j, c] = [x / sum(w) for x in w]
        before = p
        odds = [math.log(1 - prior) - math.log(prior) + sum(math.log(share[j, 0][x] / share[j, 1][x]) for j, x in enumerate(v) if x >= 0) for v in voted]
        p = [1 / (1 + math.exp(max(-500, min(500, o)))) for o in odds]
        if max(abs(a - b) for a, b in zip(p, before, strict=True)) < 1e-6:
            break
    assert abs(model.weak.prior - prior) < 1e-6
    assert all(abs(model.weak.tables[j, c, x] - share[j, c][x]) < 1e-6 for j in range(quality.LABELLERS) for c in (0, 1) for x in (0, 1))


def test_training_rows_are_bounded(spark):
    from glosswright.llm._common import first_rows, materialize

    df = materialize(spark.range(3000).select(F.lit(1).alias("doc_id"), F.concat(F.lit("same text "), F.col("id") % 3).alias("text")), "bound")
    assert first_rows(df, 50, "doc_id", "text").count() == 50 and first_rows(df, 5000, "doc_id").count() == 3000 and first_rows(df.limit(0), 5, "doc_id").count() == 0
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(50)] + [(1, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity._training_rows(df.unionByName(df.withColumn("doc_id", F.lit(2))), labels, 60).count() <= 60
    assert quality.report(df, rows=50).count() == 3000


def test_trees_and_calibration_equal_brute_force():
    from glosswright.llm import _boosting

    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4))
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=400) > 0).astype(float)
    model = _boosting.fit(x, y, trees=20)

    def margin(row):
        out = model.base
        for f, t, leaf in zip(model.features, model.limits, model.leaves, strict=True):
            node = 0
            for d in range(model.depth):
                j = f[(1 << d) - 1 + node]
                node = 2 * node + (sum(e <= row[j] for e in model.edges[j]) > t[(1 << d) - 1 + node])
            out += leaf[node]
        return out

    assert np.allclose(model.margin(x), [margin(r) for r in x])
    assert ((model.margin(x) > 0) == y).mean() > 0.85
    # the best first split by a search over all of them
    p, best = y.mean(), (-1.0, None)
    p = (y.sum() + 0.5) / (len(y) + 1)
    g, h = p - y, np.full(len(y), p * (1 - p))
    for j in range(4):
        for k, e in enumerate(model.edges[j]):
            left = x[:, j] < e
            gain = sum(g[s].sum() ** 2 / (h[s].sum() + 2.0) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 2.0)
            best = max(best, (gain, (j, k)))
    assert (model.features[0][0], model.limits[0][0]) == best[1]

    margins = np.round(rng.normal(size=60), 1)
    labels = (rng.random(60) < 1 / (1 + np.exp(-2 * margins))).astype(float)
    iso = _boosting.isotonic(margins, labels)
    assert (np.diff(iso(np.sort(margins))) >= -1e-12).all() and ((iso(margins) >= 0) & (iso(margins) <= 1)).all()
    order = np.argsort(margins, kind="stable")
    pools = [[float(labels[i])] for i in order]
    while any(np.mean(a) >= np.mean(b) for a, b in zip(pools, pools[1:], strict=False)):
        i = next(i for i in range(len(pools) - 1) if np.mean(pools[i]) >= np.mean(pools[i + 1]))
        pools[i : i + 2] = [pools[i] + pools[i + 1]]
    assert len(iso.at) == len(pools)


def test_toxicity_features_equal_brute_force():
    import re

    lexicon = toxicity.Lexicon({"stu": 0.7, "stupid ": 0.9, "vile": 0.55})
    texts = ["You are STUPID, you st*pid vile! idiot", "", "Quiet words. ÉCOLE 1d10t you", "x" * 3000, "you " * 3000 + "fool"]
    for t in texts + texts:
        ws = re.findall(r"[^\W\d_]+(?:[*@$!#013457]+[^\W\d_]+)*", t)
        n, chars = max(1, len(ws)), max(1, len(t))
        known = [lexicon.look_up(w) for w in ws]
        hit = [i for i, k in enumerate(known) if k[0] > 0.5 or k[1] or k[3]]
        you = [i for i, k in enumerate(known) if k[2]]
        near = sum(any(abs(i - j) <= 5 for j in you) for i in hit)
        f = dict(zip(toxicity.FEATURES, lexicon.features(t), strict=True))
        assert f["second_near"] == near / n and f["second_density"] == len(you) / n and abs(f["learned_sum"] - sum(k[0] for k in known)) < 1e-9
        assert f["seed_count"] == sum(k[1] for k in known) and f["shouted"] == sum(len(w) > 2 and w.isupper() for w in ws) / n and f["exclaims"] == t.count("!") / chars


def test_scorer_training_holds_a_bounded_part_of_the_features():
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(3)
    n = 3000
    doc = np.repeat(np.arange(n, dtype=np.int32), rng.integers(1, 400, n))
    at, value = rng.integers(0, quality.DIMENSIONS, len(doc)).astype(np.int16), rng.random(len(doc), dtype=np.float32)
    target = rng.random(n)
    tracemalloc.start()
    got = quality.fit_scorer(at, value, doc, target, rounds=3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 * len(doc)  # one copy of the features as doubles
    # the same training over all features at once
    w = np.zeros(quality.DIMENSIONS + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, 4):
        z = np.bincount(doc, w[at] * value, n) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        g = np.append(np.bincount(at, error[doc] * value, quality.DIMENSIONS), error.sum())
        g[:-1] += 1e-4 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert (got.weights == w[:-1]).all() and got.bias == w[-1]


def test_materialize_hands_the_drivers_memory_back(spark, monkeypatch):
    from glosswright.sources import storage

    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = [b for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName()]
    counts = lambda: sum(b.getCollectionCount() for b in full)
    monkeypatch.setattr(storage, "_tidy_at", [0.0])
    before = counts()
    storage.discard(storage.materialize(spark.range(3).toDF("x"), "tidy"))
    after = counts()
    assert after > before
    for _ in range(3):  # soon after, nothing is done
        storage.tidy(spark)
    assert counts() == after
    assert storage.trim_jvm(spark) == "" or "Trim native heap" in storage.trim_jvm(spark)


def test_labeller_accuracies_are_recovered():
    import numpy as np

    rng = np.random.default_rng(0)
    truth = (rng.random(20_000) < 0.7).astype(int)
    accuracy = [0.9, 0.8, 0.7, 0.95]
    votes = np.stack([np.where(rng.random(len(truth)) < 0.3, -1, np.where(rng.random(len(truth)) < a, truth, 1 - truth)) for a in accuracy], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.expectation_maximisation(patterns, counts.astype(float))
    assert abs(model.prior - 0.7) < 0.03
    assert all(abs(model.tables[j, 1, 1] - a) < 0.05 for j, a in enumerate(accuracy))


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.report(docs, labels).join(labels, "doc_id").collect()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) >= 0.93 * len(held)
    got = {r.doc_id: r for r in toxicity.report(edge(spark), labels.limit(0)).collect()}
    assert len(got) == len(EDGE) and {r.score for r in got.values()} == {0}
    mixed = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None), (10**9, 1, 1)], labels.schema))
    assert toxicity.report(edge(spark), mixed).count() == len(EDGE)
    assert toxicity.report(empty(spark), labels).count() == 0


def test_toxicity_ignores_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = ({r.doc_id: r.score for r in toxicity.report(docs, x).collect()} for x in (labels, flipped))
    assert first == second


# --- pipeline ----------------------------------------------------------------------------


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in quality.report(docs).collect() if r.kept}
    groups: dict = {}
    for d in kept:
        groups.setdefault(low(rows[d]), []).append(d)
    kept = {max(v) for v in groups.values()}
    kept = {d for d, _, c in brute_components([(d, rows[d]) for d in kept], 5, 80) if d == c}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    from tests.llm.test_maps import brute_windows

    verdict = {d: brute_windows(rows[d], bench) for d in kept}
    kept = {d for d, (n, hit, _) in verdict.items() if not (hit and 20 * hit >= n)}
    out = corpus_pipeline.run(spark, D).collect()
    assert {r.doc_id for r in out} == kept
    assert all(r.decoded_sha256 == sha(rows[r.doc_id]) for r in out)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, edge(spark), D).columns == edge(spark).columns


def test_pipeline_of_awkward_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(20)
    nulls = docs.select("doc_id", F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars")
    spark.read.parquet(f"{D}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows, name in ((docs.limit(0), "none"), (nulls.unionByName(docs).unionByName(docs), "some")):
        rows.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        got = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
        assert len(got) == len(set(got)) and (name == "some" or not got)
