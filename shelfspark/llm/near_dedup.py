"""MinHash near-dedup with an LSH forest: neighbours in several sorted signature orders.

Where an order is too crowded to compare all rows that share a prefix, the rows are joined
again by the rare shingles of their whole sets, so no link depends on the order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.cells import FILTER_BITS, pages, probe
from shelfspark.llm.common import map_batches, texts_of
from shelfspark.llm.components import components
from shelfspark.llm.shingles import shingle_set
from shelfspark.session import stored

FUNCTIONS = 128
TREES = 32
#: A tree's label: 4 functions of its own, then 8 that other trees own, in an order of its own.
#: 0.8 similar sets share the first 4 in a tree with probability 0.41, in none of 32 with 5e-8.
MIN_DEPTH, DEPTH = FUNCTIONS // TREES, 12
#: Up to so many rows a region's pairs are all candidates; a larger one is looked into deeper.
REGION = 32
NEIGHBOURS = 3
#: Sets of 0.8 agree in 0.85 of their 2-bit values; fewer than this are 5 deviations off.
LEAST_AGREEING = round(0.69 * FUNCTIONS)

#: Rows whose shingles are counted to tell rare from common, the cells they are counted in
#: and the tasks that count. Any order of the shingles gives the same pairs; a good one gives them sooner.
ORDER_SAMPLE, ORDER_BITS, ORDER_TASKS = 16384, 21, 4

_rng = np.random.default_rng(20240608)
MULTIPLIERS = (_rng.integers(0, 2**32, FUNCTIONS, np.uint64) | np.uint64(1)).astype(np.uint32)
MASKS = _rng.integers(0, 2**32, FUNCTIONS, np.uint64).astype(np.uint32)


def _orders() -> np.ndarray:
    out = []
    for t in range(TREES):
        own = np.arange(MIN_DEPTH * t, MIN_DEPTH * (t + 1))
        rest = _rng.permutation(np.setdiff1d(np.arange(FUNCTIONS), own))
        out.append(np.concatenate([own, rest[:DEPTH - MIN_DEPTH]]))
    return np.array(out)


ORDERS = _orders()


def signature(shingles: np.ndarray) -> np.ndarray:
    """The top 16 bits of the smallest value of each hash function."""
    low = (shingles >> np.uint64(17)).astype(np.uint32)
    least = np.full(FUNCTIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        part = low[at:at + 512]
        np.minimum(least, ((part[None, :] ^ MASKS[:, None]) * MULTIPLIERS[:, None]).min(axis=1), out=least)
    # the least of n values is about 2^32 / n, so its low bits are mixed in before the cut
    least = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (least >> np.uint32(16)).astype(np.uint16)


def _binaries(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of bytes."""
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_key (a 128-bit hash of the whole set), signature: one row per row."""
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, keys, rows = [], [], []
        for text in texts_of(batch):
            own = shingle_set(text, k)
            sizes.append(len(own))
            keys.append(xxhash.xxh3_128_digest(own.tobytes()))
            rows.append(signature(own) if len(own) else np.zeros(FUNCTIONS, np.uint16))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), _binaries(np.stack(rows).view(np.uint8))],
            ["doc_id", "n_shingles", "set_key", "signature"])
    return map_batches(docs, each, "doc_id long, n_shingles long, set_key binary, signature binary")


TREE_ROW = "tree int, label binary, sketch binary, id long"


def forest(classes: DataFrame) -> DataFrame:
    """A row for each class and tree: its label in the tree and 2 bits of each function."""
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        sig = _matrix(batch.column("signature"), "<u2", FUNCTIONS)
        two = (sig & 3).astype(np.uint8).reshape(-1, FUNCTIONS // 4, 4)
        sketch = (two << np.array([0, 2, 4, 6], np.uint8)).sum(axis=2, dtype=np.uint8)
        labels = np.ascontiguousarray(np.concatenate([sig[:, order] for order in ORDERS]).astype(">u2"))
        n = len(sig)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(TREES, dtype=np.int32), n)), _binaries(labels.view(np.uint8).reshape(n * TREES, -1)),
             _binaries(np.tile(sketch, (TREES, 1))), pa.array(np.tile(batch.column("id").to_numpy(), TREES))],
            ["tree", "label", "sketch", "id"])
    return map_batches(classes.select("id", "signature"), each, TREE_ROW)


def _medoid(sketch: np.ndarray) -> int:
    """The row that agrees most with what most rows of a region have at each function."""
    two = np.stack([(sketch.view(np.uint8) >> s) & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(sketch), FUNCTIONS)
    counts = np.stack([(two == v).sum(axis=0) for v in range(4)])
    return int((two == counts.argmax(axis=0)).sum(axis=1).argmax())


def candidate_rows(depths: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of row numbers to compare, of rows in sorted order, and the hubs among them.

    ``depths[i]`` is the common prefix of rows i - 1 and i (-1 at the first). A region is a
    run of rows that share a prefix. Its pairs are all candidates if they are few. In a
    larger one, rows are compared with their next neighbours, whose common prefixes are the
    longest, and with the region's hub, the row most like all others; then each sub-region,
    one level deeper, is a region of its own. So the depth follows how crowded a place is,
    and the pairs of a region stay in proportion to its rows.
    """
    n = len(depths)
    rows, left, right, hubs = np.arange(n), [], [], []
    closed = np.zeros(n, bool)  # rows whose region has all its pairs
    before = np.zeros(n, np.int64)
    for depth in range(MIN_DEPTH, DEPTH + 1):
        first = np.flatnonzero(depths < depth)
        if not len(first):
            break
        sizes = np.diff(np.append(first, n))
        size_of, last = np.repeat(sizes, sizes), np.repeat(first + sizes, sizes)
        fresh = ~closed & (size_of <= REGION)
        for step in range(1, REGION):
            at = np.flatnonzero(fresh & (rows + step < last))
            left.append(at)
            right.append(at + step)
            if not len(at):
                break
        closed |= fresh
        if depth == MIN_DEPTH:
            for step in range(1, NEIGHBOURS + 1):
                at = np.flatnonzero(~closed & (rows + step < last))
                left.append(at)
                right.append(at + step)
        for start, size in zip(first, sizes, strict=True):
            if size > REGION and size != before[start]:
                hub = start + _medoid(sketch[start:start + size])
                hubs.append(hub)
                others = np.delete(np.arange(start, start + size), hub - start)
                left.append(others)
                right.append(np.full(size - 1, hub))
        before = size_of
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none), np.array(hubs, np.int64)


def _depths(tree: np.ndarray, labels: np.ndarray) -> np.ndarray:
    same = (labels[1:] == labels[:-1]) & (tree[1:] == tree[:-1])[:, None]
    return np.concatenate([[-1], np.cumprod(same, axis=1).sum(axis=1)]) if len(tree) else np.zeros(0, np.int64)


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    return FUNCTIONS - np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1)


def _pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs that the sketches don't rule out, the common prefixes and the hubs."""
    tree, ids = table["tree"].to_numpy(), table["id"].to_numpy()
    labels = _matrix(table["label"], ">u2", DEPTH)
    sketch = _matrix(table["sketch"], "<u8", FUNCTIONS // 32)
    depths = _depths(tree, labels)
    a, b, hubs = candidate_rows(depths, sketch)
    if len(a):
        a, b = np.divmod(np.unique(np.minimum(a, b) * len(ids) + np.maximum(a, b)), len(ids))
        keep = np.concatenate([_agreeing(sketch[a[i:i + 100_000]], sketch[b[i:i + 100_000]]) >= LEAST_AGREEING for i in range(0, len(a), 100_000)])
        a, b = a[keep], b[keep]
    return ids[a], ids[b], depths, hubs


def _border(depths: np.ndarray, hubs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the first and of the last region that stand for it across a border."""
    n = len(depths)
    stop = np.flatnonzero(depths[1:] < MIN_DEPTH) + 1
    to, since = (stop[0], stop[-1]) if len(stop) else (n, 0)
    return (np.unique(np.concatenate([np.arange(min(to, REGION)), hubs[hubs < to][:REGION]])),
            np.unique(np.concatenate([np.arange(max(since, n - REGION), n), hubs[hubs >= since][:REGION]])))


def _crowded(depths: np.ndarray) -> np.ndarray:
    """Whether a row's region is too large for all its pairs, or may go on in another task."""
    first = np.flatnonzero(depths < MIN_DEPTH)
    sizes = np.diff(np.append(first, len(depths)))
    crowded = sizes > REGION
    crowded[[0, -1]] = True
    return np.repeat(crowded, sizes)


PAIR_ROW = "pid int, border int, tree int, label binary, sketch binary, a long, b long"


def candidates(trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a < b: distinct pairs of classes that are near in some tree; id: classes with more in some tree than was compared.

    The orders are range-partitioned by tree, label and id, so a label that many classes
    share spreads over tasks. Regions cut by a border are joined again: each task hands on
    some rows at its ends, and those of two adjoining tasks are compared. That finds most
    pairs of a crowded or cut region early; ``crowded_pairs`` finds all.
    """
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        pid = TaskContext.get().partitionId()
        left, right, depths, hubs = _pairs(table)
        n = len(left)
        nothing = pa.nulls
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, pid, np.int32)), pa.array(np.full(n, -1, np.int32)), nothing(n, pa.int32()), nothing(n, pa.binary()), nothing(n, pa.binary()),
             pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right))], NAMES)
        crowd = np.unique(table["id"].to_numpy()[_crowded(depths)])
        m = len(crowd)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(m, pid, np.int32)), pa.array(np.full(m, -2, np.int32)), nothing(m, pa.int32()), nothing(m, pa.binary()), nothing(m, pa.binary()),
             pa.array(crowd), nothing(m, pa.int64())], NAMES)
        for side, rows in enumerate(_border(depths, hubs)):
            part, m = table.take(pa.array(rows)), len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, pid, np.int32)), pa.array(np.full(m, side, np.int32)), part["tree"].combine_chunks(), part["label"].combine_chunks(),
                 part["sketch"].combine_chunks(), part["id"].combine_chunks(), nothing(m, pa.int64())], NAMES)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        group = table["meet"].to_numpy()
        for rows in np.split(np.arange(len(group)), np.flatnonzero(np.diff(group)) + 1):
            left, right, _, _ = _pairs(table.slice(rows[0], len(rows)))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right))], ["a", "b"])

    sorted_rows = trees.repartitionByRange("tree", "label", "id").sortWithinPartitions("tree", "label", "id")
    made = stored(sorted_rows.mapInArrow(each, PAIR_ROW))
    # each task's end meets the start of the next task that has rows (a window over task numbers)
    following = made.where("border = 0").select("pid").distinct().withColumn("next", F.lead("pid").over(Window.orderBy("pid")))
    ends = made.where("border = 1").join(following, "pid").where("next IS NOT NULL").withColumn("meet", F.col("next"))
    starts = made.where("border = 0").withColumn("meet", F.col("pid"))
    columns = ["meet", "tree", "label", F.col("a").alias("id"), "sketch"]
    meeting = starts.select(*columns).unionByName(ends.select(*columns)).dropDuplicates(["meet", "tree", "id"])
    over = meeting.repartition("meet").sortWithinPartitions("meet", "tree", "label", "id").mapInArrow(join, "a long, b long")
    return (made.where("border = -1").select("a", "b").unionByName(over).where("a < b").distinct(),
            made.where("border = -2").select(F.col("a").alias("id")).distinct())


NAMES = ["pid", "border", "tree", "label", "sketch", "a", "b"]


def _among(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, text of the ids wanted and of some others: a filter of fixed size keeps most out."""
    cell = F.xxhash64("doc_id").bitwiseAND(F.lit(FILTER_BITS - 1))
    return probe(docs.withColumn("cell", cell), stored(pages(cell, wanted)), "cell", "hit").where("hit").select("doc_id", "text")


def _shingle_counts(docs: DataFrame, crowd: DataFrame, k: int) -> DataFrame:
    """cells, counts: the shingles of some rows of the crowd by cell, a row from each of few tasks."""
    every = max(1, crowd.count() // ORDER_SAMPLE)
    some = stored(crowd.select("doc_id").where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(every)) == 0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << ORDER_BITS, np.int64)
        for batch in batches:
            for text in texts_of(batch):
                np.add.at(total, (shingle_set(text, k) >> np.uint64(64 - ORDER_BITS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([total[at].astype("<i4").tobytes()], pa.binary())], ["cells", "counts"])

    sampled = _among(docs, some).join(some, "doc_id", "left_semi").select("text").repartition(ORDER_TASKS)
    return sampled.mapInArrow(count, "cells binary, counts binary")


def _rarity(docs: DataFrame, crowd: DataFrame, k: int) -> np.ndarray:
    """By cell: how common its shingles are in some rows of the crowd, as a rank from 0 to 255."""
    total = np.zeros(1 << ORDER_BITS, np.int64)
    for cells, counts in zip(*_shingle_counts(docs, crowd, k).toArrow().to_pydict().values(), strict=True):
        total[np.frombuffer(cells, "<i4")] += np.frombuffer(counts, "<i4")
    at = np.flatnonzero(total)
    ranks = np.zeros(1 << ORDER_BITS, np.uint8)
    ranks[at] = np.minimum(255, np.log2(1 + total[at]) * 12)
    return ranks


def crowded_pairs(crowd: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """a < b: pairs of different components among ``crowd`` (doc_id, comp) that may be similar enough; none that is, is missing.

    An exact set join. With all sets in one order, rare shingles first, the first shingle
    that two similar sets share is among the first of both: they share no more than what
    follows it. So only those few first shingles of a set meet, the shorter set's fewer
    still, and a pair must have enough left behind the place where it meets. Shingles of one
    component alone are dropped; in the others, rows of the commonest component meet the
    rows of other components only, so a large group costs its size and not its square.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_rarity(docs, crowd, k))

    def first(batch: pa.RecordBatch) -> pa.RecordBatch:
        ranks, sizes, heads = sent.value, [], []
        for text in texts_of(batch):
            own = shingle_set(text, k)
            n = len(own)
            own = own[np.lexsort((own, ranks[(own >> np.uint64(64 - ORDER_BITS)).astype(np.int64)]))]
            sizes.append(n)
            heads.append(own[:n - -(-percent * n // 100) + 1].view(np.int64))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(heads, pa.list_(pa.int64()))], ["doc_id", "n", "head"])

    heads = map_batches(_among(docs, crowd), first, "doc_id long, n long, head array<long>").where("n > 0")
    rows = stored(heads.join(crowd, "doc_id").select("doc_id", "comp", "n", F.posexplode("head").alias("place", "shingle")))
    met = rows.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("shingle").agg(
        F.max_by("comp", F.struct("m", "comp")).alias("most"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    rows = stored(rows.join(met, "shingle").select("shingle", "doc_id", "comp", "n", "place", (F.col("comp") != F.col("most")).alias("other")))
    # place < n - 2pn / (100 + p) + 1, in whole numbers: what the shorter set of a pair can have before the first it shares
    short = rows.where(f"(n - place) * {100 + percent} >= {2 * percent} * n")
    enough = F.expr(f"least(x.n - x.place, y.n - y.place) * {100 + percent} >= {percent} * (x.n + y.n)")
    order = F.expr(f"(y.n < x.n OR y.n = x.n AND y.doc_id < x.doc_id) AND 100 * y.n >= {percent} * x.n AND x.comp <> y.comp")

    def join(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.alias("x").join(y.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & order & enough).select(
            F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b"))

    return join(rows.where("other"), short).unionByName(join(rows.where("NOT other"), short.where("other"))).distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b, shared, n_union of the pairs whose whole sets are similar enough.

    Only documents in some pair are read again; their sets, 8 bytes a shingle, meet by id.
    """
    pairs = stored(pairs)
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([shingle_set(t, k).tobytes() for t in texts_of(batch)], pa.binary())], ["id", "own"])

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        shared, union = [], []
        left, right = batch.column("left"), batch.column("right")
        for i in range(batch.num_rows):  # views: the sets are not copied out of the batch
            p, q = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
            both = np.concatenate([p, q])
            both.sort(kind="stable")
            n = int((both[1:] == both[:-1]).sum())
            shared.append(n)
            union.append(len(both) - n)
        ok = pa.array([100 * s >= percent * u for s, u in zip(shared, union, strict=True)])
        return pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(shared, pa.int64()), pa.array(union, pa.int64())], ["a", "b", "shared", "n_union"]).filter(ok)

    wanted = stored(wanted)
    own = stored(map_batches(_among(docs, wanted).join(wanted, "doc_id", "left_semi"), sets, "id long, own binary").where(F.octet_length("own") > 0))
    met = pairs.join(own.select(F.col("id").alias("a"), F.col("own").alias("left")), "a").join(
        own.select(F.col("id").alias("b"), F.col("own").alias("right")), "b")
    return map_batches(met, compare, "a long, b long, shared long, n_union long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    A document's set holds its distinct runs of ``k`` words (A-Z lower-cased; all words if
    there are fewer). Documents are linked when the shared part of their sets is ``percent``
    per cent of the union or more, counted on the whole sets; component_id is the smallest
    doc_id reachable, and that document is kept. Equal sets are one class from the start, so
    exact copies make no pairs. Null and blank texts have an empty set and are linked with
    nothing. Rows that repeat a doc_id are one document: they share its component. A row of
    null doc_id takes part in nothing and is kept. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(signatures(docs, k))
    some = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(some.groupBy("set_key").agg(F.min(F.struct("doc_id", "signature")).alias("x")).select(
        "set_key", F.col("x.doc_id").alias("id"), F.col("x.signature").alias("signature")))
    # a document of several texts, if ids repeat, ties their classes together
    texts_of_one = some.groupBy("doc_id").agg(F.min("set_key").alias("p"), F.max("set_key").alias("q"), F.count(F.lit(1)).alias("n")).where("p <> q")
    repeated = some.join(texts_of_one.select("doc_id"), "doc_id", "left_semi").join(classes.select("set_key", "id"), "set_key")
    ties = repeated.select(F.greatest("doc_id", "id").alias("a"), F.least("doc_id", "id").alias("b")).where("a <> b")
    near, crowd = candidates(forest(classes))
    links = confirmed(near, docs, k, percent).select("a", "b").unionByName(ties)
    roots = components(links).withColumnRenamed("node", "id")
    crowd = stored(crowd.join(roots, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("root", "id").alias("comp")))
    more = confirmed(crowded_pairs(crowd, docs, k, percent), docs, k, percent)
    # the components that the crowd's links tie together, by their roots alone
    pairs = more.select("a", "b").join(crowd.select(F.col("doc_id").alias("a"), F.col("comp").alias("u")), "a").join(crowd.select(F.col("doc_id").alias("b"), F.col("comp").alias("v")), "b")
    tops = components(pairs.select(F.col("u").alias("a"), F.col("v").alias("b")).distinct()).select(F.col("node").alias("comp"), F.col("root").alias("top"))
    named = classes.select("set_key", "id").join(roots, "id", "left").select("set_key", F.coalesce("root", "id").alias("comp")).join(tops, "comp", "left").select(
        "set_key", F.coalesce("top", "comp").alias("component_id"))
    linked = some.join(stored(named), "set_key").select("doc_id", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
