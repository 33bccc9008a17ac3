"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

A row of the incidence matrix is a document's set of distinct word shingles, hashed to
64 bits; rows are made from the texts whenever they are read, as they are larger than these. Equal sets are one row, a node.
Pairs count whose overlap reaches the size-derived bound

    100 * overlap >= percent * union,  that is  overlap >= percent/(100+percent) * (a+b).

First block of columns. All columns have one order: common ones last, otherwise by
hash. A node's first size - ceil(percent/100 * size) + 1 columns in this order are its
prefix, and two linked nodes share a column of their prefixes, whatever the order. It
only decides how many other pairs do: columns are common that turn up again and again
in windows of WINDOW entries, of which a bit set of fixed size is broadcast. The product
over this block gives the pairs and a part of their overlap. What the rest can add is
bounded by the entries behind the shorter prefix, so pairs below the bound go at once.

Sketches. Of finer blocks of columns, four to eight a shingle, those that hold an odd
number in one row and an even one in the other bound the difference from below; their
bits are joined to the pairs first, and only pairs that they leave in reach have their
sets shipped. A doc_id with several texts has several sketches, any of which may keep a pair.

Further blocks. For the pairs that are left the overlap is counted block by block over
all columns, and a pair goes when its count and what is left of either row fall below
the bound.

Frequent columns. Only columns of up to `small_group` members list their pairs. The
members of the others get new prefixes, in which those columns come last as well: two
nodes that share frequent columns alone are both among them, so they meet in a rarer
one. In columns that are frequent even then, those of large families or of documents
that are little more than a common passage, each member first meets one pivot, the smallest member of its columns; what is
of one component then needs no comparing. Where components remain apart, pivots of
them, few at first and four times as many in each round, meet the members of other
components, dealt by sub-blocks of SUB_BLOCK members: a family is mostly one component
before many of its links are listed. A sketch (odd blocks as above, but 64 * SKETCH
whatever the set's size) bounds the difference from below, and pairs out of reach
aren't listed. So a column of n members takes at most 1 + log4(1 + n / 5) rounds after
the first, lists each pair once, and only pairs that the sketch can't tell from linked
ones. The work is quadratic only in members of one column that are in different
components and look alike by sketches.

Shingles and set keys are hashes: two different shingles are taken for the same with a
probability of 2^-64, two different sets with one of 2^-128.

Defined results: null and empty texts have no words, an empty set, and are linked with
nothing, not even each other. A row whose doc_id is null is linked with nothing and has
a null component. doc_id names a vertex: rows that repeat one with other text link it
by either text. An empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswright.llm._common import SLICE_ROWS, bounded_batches, materialize, released, utf8
from glosswright.llm._components import components
from glosswright.llm._membership import among, bit_set, mix, repeated, without
from glosswright.sources.storage import Scratch, scratch

#: Columns up to this many members list their pairs.
SMALL_GROUP = 16
#: Members of a frequent column that meet all others in the first round: of its largest and of its smallest components.
PIVOTS = (2, 14)
#: Members of a frequent column that one key deals out.
SUB_BLOCK = 4096
#: Words of 64 column blocks in a sketch, which bounds the difference before a pair is listed.
SKETCH = 32
#: Column blocks of a pair's exact count.
BLOCKS = 8
#: Entries of a window, and entries in windows that make a column common.
WINDOW, COMMON = 1 << 20, 4

_MEMO_WORDS = 1 << 16
_ODD = np.random.default_rng(4).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Shingler:
    """Sorted arrays of the distinct hashed shingles of texts given as bytes."""

    def __init__(self, n: int):
        self.n = n
        self.memo: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        # bytes.lower() and bytes.split() know ASCII only, as wanted
        words = text.lower().split()
        if not words:
            return np.empty(0, np.uint64)
        memo = self.memo
        try:
            ids = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(memo) > _MEMO_WORDS:
                memo.clear()
            for w in words:
                if w not in memo:
                    memo[w] = xxhash.xxh3_64_intdigest(w)
            ids = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(ids))
        out = np.full(len(ids) - n + 1, n, np.uint64)
        for i in range(n):
            out += ids[i : len(ids) - n + 1 + i] * _ODD[i]
        out = np.sort(mix(out))
        return out[np.concatenate(([True], out[1:] != out[:-1]))]


class Bounds:
    """What a threshold in per cent says about sizes and overlaps."""

    def __init__(self, percent: int):
        self.percent = percent

    def prefix(self, size: int) -> int:
        """Columns of which two linked nodes share one; 0 if only an equal set can be linked."""
        least = -(-size * self.percent // 100)  # overlap with any linked set
        unequal = least < size or size * 100 // self.percent > size
        return size - least + 1 if size and unequal else 0

    def needed(self, a: int, b: int) -> int:
        """The least overlap of a linked pair of these sizes."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def overlap(self, p: np.ndarray, q: np.ndarray) -> int | None:
        """The overlap of two sorted rows counted by column blocks, None once out of reach."""
        need = max(1, self.needed(len(p), len(q)))
        if min(len(p), len(q)) < need:
            return None
        limits = np.arange(1, BLOCKS, dtype=np.uint64) * np.uint64(2**64 // BLOCKS)
        ends_p = [0, *np.searchsorted(p, limits).tolist(), len(p)]
        ends_q = [0, *np.searchsorted(q, limits).tolist(), len(q)]
        count = 0
        for i in range(BLOCKS):
            x, y = p[ends_p[i] : ends_p[i + 1]], q[ends_q[i] : ends_q[i + 1]]
            if len(x) and len(y):
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                count += int((y[at] == x).sum())
            if count + min(len(p) - ends_p[i + 1], len(q) - ends_q[i + 1]) < need:
                return None
        return count

    def reach(self, count: Column, a: str, b: str) -> Column:
        """Whether a pair of sizes a and b with this overlap of prefixes can be linked.

        Behind the prefix that ends first there are at most ceil(percent * size) - 1 entries.
        """
        rest = F.expr(f"(greatest({a}, {b}) * {self.percent} + 99) div 100 - 1")
        return count + rest >= F.expr(f"({self.percent} * ({a} + {b}) + {99 + self.percent}) div {100 + self.percent}")


def _texts(docs: DataFrame) -> DataFrame:
    return bounded_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")))


def _keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of each set's key."""
    keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64)
    return keys[::2], keys[1::2]


def _rows(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, k1, k2 of each row; besides, gram and n of columns that a window of entries holds again and again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, held, size = Shingler(n), [], 0
        names = ["doc_id", "n_shingles", "k1", "k2", "gram", "n"]

        def repeated() -> pa.RecordBatch:
            grams, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            again = counts > 1
            columns = [pa.array(grams[again].view(np.int64)), pa.array(counts[again])]
            return pa.RecordBatch.from_arrays([pa.nulls(len(columns[0]), pa.int64())] * 4 + columns, names=names)

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                sets = [shingle(t) for t in part.column(1).to_pylist()]
                k1, k2 = _keys(sets)
                sizes = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), sizes, pa.array(k1), pa.array(k2), *[pa.nulls(len(sets), pa.int64())] * 2], names=names
                )
                for known, grams in zip(part.column(0).is_valid().to_pylist(), sets, strict=True):
                    if known and len(grams):
                        held.append(grams)
                        size += len(grams)
                        if size >= WINDOW:
                            yield repeated()
                            size = 0
        if held:
            yield repeated()

    return _texts(docs).mapInArrow(released(run), "doc_id long, n_shingles long, k1 long, k2 long, gram long, n long")


def _wanted(docs: DataFrame, n: int, only: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, list[np.ndarray]]]]:
    """Reads batches of _texts() as doc_ids and sets that aren't empty; only: a bit set that may hold the doc_ids that are wanted.

    Sets are twice as large as the texts, so they are made from them each time and not stored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(only)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        shingle = Shingler(n)
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            if sent.value is not None:
                batch = batch.filter(pa.array(among(sent.value, batch.column(0).to_numpy()), pa.bool_()))
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                sets = [shingle(t) for t in part.column(1).to_pylist()]
                full = np.array([len(s) > 0 for s in sets], bool)
                yield part.column(0).to_numpy()[full], [s for s in sets if len(s)]

    return read


def _prefixes(docs: DataFrame, n: int, common: np.ndarray, copies: np.ndarray, only: np.ndarray | None, percent: int) -> DataFrame:
    """node, k1, k2, size, prefix of sets that can have links; copy: may be a copy or a repeated row.

    only: a bit set that may hold the nodes that are wanted.
    """
    sc = docs.sparkSession.sparkContext
    sent_common, sent_copies, read, bounds = sc.broadcast(common), sc.broadcast(copies), _wanted(docs, n, only), Bounds(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in read(batches):
            wanted = [bounds.prefix(len(s)) for s in sets]
            prefixes = []
            for grams, most in zip(sets, wanted, strict=True):
                grams = grams.view(np.int64)[: None if most else 0]
                last = among(sent_common.value, grams)
                prefixes.append(np.concatenate((grams[~last][:most], grams[last]))[:most])
            k1, k2 = _keys(sets)
            copy = pa.array(among(sent_copies.value, ids ^ k1), pa.bool_())
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            out = pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(k1), pa.array(k2), sizes, copy, lists], names=["node", "k1", "k2", "size", "copy", "prefix"]
            )
            yield out.filter(pa.array([most > 0 for most in wanted], pa.bool_()))

    return _texts(docs).mapInArrow(released(run), "node long, k1 long, k2 long, size long, copy boolean, prefix array<long>")


def _postings(nodes: DataFrame, columns: np.ndarray) -> DataFrame:
    """gram, node, size of the prefix entries that columns may hold."""
    sent = nodes.sparkSession.sparkContext.broadcast(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            held = among(sent.value, flat)
            node, size = (batch.column(i).to_numpy()[row[held]] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(flat[held]), pa.array(node), pa.array(size)], names=["gram", "node", "size"])

    return bounded_batches(nodes.select("node", "size", "prefix")).mapInArrow(released(run), "gram long, node long, size long")


def _node_sets(docs: DataFrame, n: int, nodes: DataFrame) -> DataFrame:
    """The rows (node, grams) of the nodes, and of a few others that the bit set lets through."""
    read = _wanted(docs, n, bit_set(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in read(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "grams"])

    return _texts(docs).mapInArrow(released(run), "node long, grams binary")


def _sets_of(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows (node, grams) of the nodes, and of a few others that the bit set lets through, as they lie."""
    sent = sets.sparkSession.sparkContext.broadcast(bit_set(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(among(sent.value, batch.column(0).to_numpy())))

    return bounded_batches(sets.select("node", "grams")).mapInArrow(released(run), "node long, grams binary")


def _linked(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full rows reach the bound. Rows that stand in no pair aren't shuffled."""
    bounds = Bounds(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [
                bounds.overlap(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) is not None
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            yield batch.filter(pa.array(kept, pa.bool_())).select([0, 1])

    left = _sets_of(sets, pairs.select("a")).toDF("a", "left")
    right = _sets_of(sets, pairs.select("b")).toDF("b", "right")
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right")
    return materialize(bounded_batches(both).mapInArrow(released(run), "a long, b long"), "join-links")


def _product(held: DataFrame, large: DataFrame, percent: int, last: bool) -> DataFrame:
    """Pairs (a, b) of small columns whose overlap there leaves the bound within reach.

    Where both nodes have frequent columns, too, the last block adds as many as the
    node with fewer of them has, and an earlier block leaves the pair to the next.
    """
    left = held.select("gram", F.col("node").alias("a"), F.col("size").alias("size_a"))
    right = held.select("gram", F.col("node").alias("b"), F.col("size").alias("size_b"))
    sizes = F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent
    both = left.join(right, "gram").filter((F.col("a") < F.col("b")) & sizes)
    counts = both.groupBy("a", "b", "size_a", "size_b").agg(F.count(F.lit(1)).alias("overlap"))
    more = large.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.join(more.select(F.col("node").alias("a"), F.col("n").alias("more_a")), "a", "left")
    counts = counts.join(more.select(F.col("node").alias("b"), F.col("n").alias("more_b")), "b", "left")
    frequent = F.least(F.coalesce("more_a", F.lit(0)), F.coalesce("more_b", F.lit(0)))
    if not last:
        counts, frequent = counts.filter(frequent == 0), F.lit(0)
    return counts.filter(Bounds(percent).reach(F.col("overlap") + frequent, "size_a", "size_b")).select("a", "b")


def classes(docs: DataFrame, n: int = 3, percent: int = 90, small_group: int = SMALL_GROUP) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs, which is read four times and must stay the same."""
    with scratch(docs.sparkSession) as tables:
        seen = materialize(_rows(docs, n), "join-rows")
        rows = seen.filter("gram is null").select("doc_id", "n_shingles", "k1", "k2")
        again = seen.filter("gram is not null").groupBy("gram").agg(F.sum("n").alias("n"))
        common = bit_set(again.filter(F.col("n") >= COMMON).select("gram"))
        known = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
        firsts = materialize(rows.filter(known).groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("size")), "join-firsts")
        copies = _copies(rows.filter(known), firsts)
        labels = _labels(tables, docs, n, common, copies, percent, small_group)
        found = firsts.join(labels, "node", "left").select("k1", "k2", F.coalesce("label", "node").alias("component_id"))
        own = F.when(known, F.col("component_id")).otherwise(F.col("doc_id"))
        out = rows.join(found, ["k1", "k2"], "left").select("doc_id", "n_shingles", own.alias("component_id"))
        return tables.keep(materialize(out, "join-components"))


def _copies(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """Rows (doc_id, k1, k2, node) that aren't their node's only one: copies, and a node's repeated rows."""
    held = rows.select("doc_id", "k1", "k2").join(firsts.filter("size > 1").drop("size"), ["k1", "k2"])
    held = held.groupBy("doc_id", "k1", "k2", "node").agg(F.count(F.lit(1)).alias("n")).filter("doc_id <> node or n > 1")
    return materialize(held, "join-copies")


def _labels(tables: Scratch, docs: DataFrame, n: int, common: np.ndarray, copies: DataFrame, percent: int, small_group: int) -> DataFrame:
    """(node, label) of the nodes that have links."""
    again = bit_set(copies.select(F.col("doc_id").bitwiseXOR(F.col("k1"))))

    def block(common: np.ndarray, only: np.ndarray | None) -> tuple[DataFrame, DataFrame]:
        """The entries (gram, node, size) of the prefixes in small and in frequent columns."""
        prefixes = materialize(_prefixes(docs, n, common, again, only, percent), "join-prefixes")
        really = copies.filter("doc_id <> node").select(F.col("doc_id").alias("node"), "k1", "k2")
        others = prefixes.filter("copy").join(really, ["node", "k1", "k2"], "left_anti").dropDuplicates(["node", "k1", "k2"])
        nodes = prefixes.filter("not copy").unionByName(others.select(prefixes.columns))
        met = materialize(_postings(nodes, repeated(nodes.select("prefix"))), "join-met")
        tables.drop(prefixes)
        columns = met.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        held = materialize(met.join(columns, "gram"), "join-postings")
        tables.drop(met)
        return held.filter(F.col("n") <= small_group).drop("n"), held.filter(F.col("n") > small_group).drop("n")

    small, large = block(common, None)
    pairs = _product(small, large, percent, last=False)
    # pairs with frequent columns only have both ends here: these meet in other columns,
    # once the frequent ones come last
    common = common | bit_set(large.select("gram").distinct())
    small, large = block(common, bit_set(large.select("node").distinct()))
    pairs = materialize(pairs.unionByName(_product(small, large, percent, last=True)).distinct(), "join-pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(large.select("node")).distinct()
    node_sets = materialize(_node_sets(docs, n, ends), "join-node-sets")
    sketches = materialize(_sketches(node_sets).distinct(), "join-sketches")
    pairs = materialize(_possible(pairs, sketches, percent), "join-possible")
    labels = components(_linked(node_sets, pairs, percent))
    members = materialize(large.select(F.col("gram").alias("sig"), "node"), "join-members")
    return _join_large(tables, members, node_sets, sketches, labels, percent)


def _join_large(tables: Scratch, members: DataFrame, sets: DataFrame, sketches: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """The labels once the members (sig, node) of frequent columns are compared, too."""
    pivots = members.groupBy("sig").agg(F.min("node").alias("pivot"))
    star = _apart(members, labels).join(pivots, "sig").groupBy("node").agg(F.min("pivot").alias("pivot"))
    star = star.select(F.col("pivot").alias("a"), F.col("node").alias("b")).filter("a <> b")
    labels = _more(tables, sets, sketches, star, labels, percent)
    large = materialize(_apart(members, labels).select("sig", "node"), "join-apart")
    if large.isEmpty():
        return labels
    # by its columns a pair is listed in the first of them only
    own = large.groupBy("node").agg(F.collect_set("sig").alias("sigs"))
    shared = materialize(own.join(sketches.drop("odd"), "node"), "join-shared")
    used = large.limit(0)
    for turn in range(64):
        pairs, pivots = _next_pivots(_labelled(large, labels), shared, used, percent, turn)
        if pivots.isEmpty():
            break
        labels = _more(tables, sets, sketches, pairs, labels, percent)
        used = materialize(used.unionByName(pivots), "join-used")
    return labels


def _more(tables: Scratch, sets: DataFrame, sketches: DataFrame, pairs: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """labels, after the pairs that they don't join are compared.

    What is linked already is one vertex, so only new links between components are
    followed, whatever the number of links inside them.
    """

    def labelled(rows: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            rows = rows.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}")), end, "left")
        return rows.select("a", "b", F.coalesce("label_a", "a").alias("label_a"), F.coalesce("label_b", "b").alias("label_b"))

    listed = materialize(labelled(pairs).filter("label_a <> label_b").select("a", "b").distinct(), "join-pairs")
    pairs = materialize(_possible(listed, sketches, percent), "join-possible")
    tables.drop(listed)
    found = None if pairs.isEmpty() else _linked(sets, pairs, percent)
    tables.drop(pairs)
    if found is None or found.isEmpty():
        return labels
    moved = components(labelled(found).select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct())
    moved = moved.select(F.col("node").alias("old"), F.col("label").alias("new"))
    # a vertex without a label so far was alone
    every = labels.unionByName(moved.select(F.col("old").alias("node"), F.col("old").alias("label"))).distinct()
    out = every.join(moved, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label"))
    return materialize(out, "join-labels")


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members, with labels, of columns that hold more than one component."""
    labelled = _labelled(members, labels)
    mixed = labelled.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    return labelled.join(mixed.select("sig"), "sig")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members with labels; one without links is its own."""
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _sketches(sets: DataFrame) -> DataFrame:
    """node, held, sketch, odd: a set's size, and whether column blocks hold an odd number, 64 * SKETCH blocks and as many as fit the size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [np.frombuffer(g, np.uint64) for g in batch.column(1).to_pylist()]
            words = [np.frombuffer(_odd(g, 64 * SKETCH), np.int64) for g in grams]
            odd = pa.array(map(odd_blocks, grams), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(g) for g in grams], pa.int64()), pa.array(words, pa.list_(pa.int64())), odd],
                names=["node", "held", "sketch", "odd"],
            )

    return bounded_batches(sets).mapInArrow(released(run), "node long, held long, sketch array<long>, odd binary")


def odd_blocks(grams: np.ndarray) -> bytes:
    """Bits that tell which column blocks hold an odd number of a set's shingles; four to eight blocks a shingle."""
    return _odd(grams, 1 << max(6, (4 * len(grams) - 1).bit_length()))


def _odd(grams: np.ndarray, blocks: int) -> bytes:
    """The bits for a power of two of blocks."""
    at = (grams & np.uint64(blocks - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=blocks) & 1).astype(bool), bitorder="little").tobytes()


def least_apart(x: bytes, y: bytes) -> int:
    """At least so many shingles are in one of two sets only, by their odd blocks: each block that differs holds one."""
    if len(x) < len(y):
        x, y = y, x
    p, q = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    for i in range((len(x) // len(y)).bit_length() - 1):
        half = 8 * len(x) >> (i + 1)
        p = (p >> half) ^ (p & ((1 << half) - 1))
    return (p ^ q).bit_count()


def _can_link(percent: int, a: Column, b: Column) -> Column:
    """Whether the sketches of a and b leave the bound within reach.

    Each block that is odd in one of the sets only holds a shingle by which they differ.
    """
    apart = F.aggregate(F.zip_with(a["sketch"], b["sketch"], lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    apart = F.greatest(apart, F.abs(a["held"] - b["held"]))
    return apart * (100 + percent) <= (100 - percent) * (a["held"] + b["held"])


def _possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose odd blocks leave the bound within reach, so that only their sets are shipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(i).to_pylist() for i in range(2, 6))
            kept = [
                max(abs(m - n), least_apart(p, q)) * (100 + percent) <= (100 - percent) * (m + n) for m, n, p, q in zip(a, b, x, y, strict=True)
            ]
            yield batch.filter(pa.array(kept, pa.bool_())).select([0, 1])

    x, y = (sketches.select(F.col("node").alias(end), F.col("held").alias(f"held_{end}"), F.col("odd").alias(f"odd_{end}")) for end in "ab")
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "held_a", "held_b", "odd_a", "odd_b")
    return bounded_batches(both).mapInArrow(released(run), "a long, b long").distinct()


def _next_pivots(members: DataFrame, shared: DataFrame, used: DataFrame, percent: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """The pairs of each column's next pivots, and the pivots as (sig, node).

    The next pivots are members of the column's largest components, which are the
    likeliest to reach the rest, and of its smallest, which are the rest; each turn
    takes four times as many. Members that were pivots have met everyone; a column is done
    when the others are one component.
    """
    members = materialize(members.join(used, ["sig", "node"], "left_anti").select("sig", "node", "label"), "join-unmet")
    mixed = members.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size"))
    blocks = F.ceil(F.col("size") / SUB_BLOCK).cast("int").alias("blocks")
    members = members.join(mixed.filter("low < high").select("sig", blocks), "sig")
    members = materialize(members.select("sig", "node", "label", "blocks"), "join-open")
    sizes = members.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("mates"))
    ranked = members.join(sizes, ["sig", "label"])

    def first(mates: Column, n: int) -> DataFrame:
        # Spark cuts this ranking to the wanted rows of a group before its shuffle
        place = F.row_number().over(Window.partitionBy("sig").orderBy(mates, "node"))
        return ranked.withColumn("place", place).filter(F.col("place") <= n).select("sig", "node", "label", "blocks")

    best = first(F.desc("mates"), PIVOTS[0] << 2 * turn).unionByName(first(F.asc("mates"), PIVOTS[1] << 2 * turn))
    best = materialize(best.dropDuplicates(["sig", "node"]), "join-pivots")
    dealt = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    a = best.select("sig", "node", "label", dealt).join(shared, "node").alias("a")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    b = members.select("sig", "node", "label", block).join(shared, "node").alias("b")
    once = F.array_min(F.array_intersect("a.sigs", "b.sigs")) == F.col("a.sig")
    same = (F.col("a.sig") == F.col("b.sig")) & (F.col("a.block") == F.col("b.block"))
    pairs = a.join(b, same & (F.col("a.label") != F.col("b.label")) & once & _can_link(percent, *(F.struct(f"{x}.held", f"{x}.sketch") for x in "ab")))
    pairs = pairs.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"))
    return pairs, best.select("sig", "node")


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with the smallest doc_id of each component; columns as before.

    Documents that are linked with nothing stay. Texts of those that stay aren't
    shuffled, see without().
    """
    with scratch(docs.sparkSession) as tables:
        found = classes(docs, n, percent).filter("component_id <> doc_id").select("doc_id").distinct()
        lost = tables.keep(materialize(found, "join-dropped"))
    return without(docs, lost, [F.col("doc_id").cast("long")])


ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(3, len(w)) - 1], ' ') AS g
  FROM w, LATERAL unnest(range(1, len(w) - least(3, len(w)) + 2)) AS t(i) WHERE len(w) > 0
), s AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM g GROUP BY doc_id
), c AS (
  SELECT k, min(doc_id) AS node, any_value(n) AS n FROM s GROUP BY k
), p AS (
  SELECT node, n, g, row_number() OVER (PARTITION BY node ORDER BY df, g) AS r
  FROM c JOIN g ON g.doc_id = c.node JOIN (SELECT g, count(*) AS df FROM g JOIN c ON g.doc_id = c.node GROUP BY g) USING (g)
), q AS (
  SELECT * FROM p WHERE r <= n - CAST(ceil(0.9 * n) AS BIGINT) + 1
), e AS (
  SELECT DISTINCT x.node AS a, y.node AS b, x.n AS na, y.n AS nb FROM q AS x JOIN q AS y ON x.g = y.g AND x.node < y.node
  WHERE 10 * x.n >= 9 * y.n AND 10 * y.n >= 9 * x.n
), l AS (
  SELECT a, b FROM e JOIN g AS x ON x.doc_id = a JOIN g AS y ON y.doc_id = b AND y.g = x.g
  GROUP BY a, b, na, nb HAVING 100 * count(*) >= 90 * (na + nb - count(*))
), u AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach(a, b) AS (
  SELECT a, b FROM u UNION SELECT reach.a, u.b FROM reach JOIN u ON u.a = reach.b
), m AS (
  SELECT a AS node, min(b) AS low FROM reach GROUP BY a
)
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, least(coalesce(c.node, w.doc_id), coalesce(m.low, c.node, w.doc_id)) AS component_id
FROM w LEFT JOIN s ON s.doc_id = w.doc_id LEFT JOIN c ON c.k = s.k LEFT JOIN m ON m.node = c.node
"""
