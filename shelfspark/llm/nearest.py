"""Approximate nearest neighbours by cosine, over randomly rotated one-bit codes.

A vector is made a unit u and its residual u - c to the nearest of some centres is turned by
a random rotation into more dimensions; a code keeps one bit of each. For a query q,
``<u, q> = <c, q> + <u - c, q>``, and the last term is estimated from the packed bits (by
popcounts against bit planes of the turned query) and two numbers of the row that undo
what the code lost. The rotation is random, so the estimate's error has a known spread; rows whose
upper bound reaches what the k-th best row has for certain are compared once more on the
original vectors, in double precision.

Every row is coded, and every query meets every row: queries are written in blocks, which each
task reads one after the other beside the codes it holds. Nothing is shuffled but the few
best rows of each task and query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import map_batches, shared_files
from shelfspark.session import stored

#: Bits of a code at least; vectors of more dimensions get one for each, rounded up to whole words.
LEAST_BITS = 256
#: Spreads of the estimate's error that a bound allows for: a row is missed once in about 30,000 times.
SPREADS = 4.0
#: Centres per number of dimensions, and the rows (about as many) that all centres are fitted on.
CENTRES, SAMPLE, ROUNDS = 32, 4096, 8
SEED = 20_251
PLANES = 4  # bits of a query's turned components
#: Numbers of vectors that a task holds at a time, and those of a block of queries.
HELD, QUERY_BLOCK = 1 << 21, 1 << 17


@lru_cache(maxsize=8)
def rotation(dims: int) -> np.ndarray:
    """``bits`` x ``dims``: orthonormal columns in random directions, the same in every task."""
    bits = max(LEAST_BITS, -(-dims // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng([SEED, dims]).standard_normal((bits, dims)))
    return q * np.sign(np.diag(r))


def _units(vectors: np.ndarray) -> np.ndarray:
    scaled = _scaled(vectors)
    return scaled / np.linalg.norm(scaled, axis=1)[:, None]


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Times a power of two, so that squares neither overflow nor vanish; cosines stay the same to the last bit."""
    most = np.abs(vectors).max(axis=1)
    return np.ldexp(vectors.astype(np.float64), -np.frexp(most)[1][:, None])


def _ordered_sum(products: np.ndarray) -> np.ndarray:
    """Sums along rows from left to right, so that equal vectors get equal scores in every task."""
    return np.add.accumulate(products, axis=1)[:, -1]


def _centres(units: np.ndarray) -> np.ndarray:
    """Lloyd rounds from rows of the sample that are far apart."""
    first = [0]
    near = ((units - units[0]) ** 2).sum(axis=1)
    while len(first) < CENTRES and near.max() > 1e-12:
        first.append(int(near.argmax()))
        near = np.minimum(near, ((units - units[first[-1]]) ** 2).sum(axis=1))
    centres = units[first]
    for _ in range(ROUNDS):
        own = _cells(units, centres)
        total = np.zeros_like(centres)
        np.add.at(total, own, units)
        n = np.bincount(own, minlength=len(centres))
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def _cells(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (2 * units @ centres.T - (centres ** 2).sum(axis=1)).argmax(axis=1)


def usable(vector: str) -> Column:
    """Not null, not zero, without null or non-finite components."""
    return (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))) & F.exists(
        vector, lambda x: x != 0)


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


@dataclass
class CodedVectors:
    """``table``: vec_id, dims, cell, code, base, scale, spread, vector. ``centres``: by number of dimensions."""

    table: DataFrame
    centres: dict[int, np.ndarray]


def _plain(vectors: DataFrame) -> DataFrame:
    """vec_id, vector, dims of the rows that take part."""
    of = vectors.schema["embedding"].dataType.simpleString()
    vector = F.col("embedding") if of in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", vector.alias("vector")).where(F.col("vec_id").isNotNull() & usable("vector"))
    return rows.withColumn("dims", F.size("vector"))


def code_vectors(vectors: DataFrame) -> CodedVectors:
    """Code every usable row of (vec_id, embedding) and write the codes to the shared folder.

    Centres are fitted on about ``SAMPLE`` distinct rows, chosen by a hash; a number of
    dimensions that the sample has not met gets the origin as its centre. Rows without vec_id and
    those whose vector is null, empty, zero or holds null or non-finite components are left
    out. Other columns are ignored; an empty table gives an empty index.
    """
    rows = _plain(vectors)
    n = max(1, rows.count())
    place = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1 << 40))
    chosen = rows.where(place < F.lit(min(1.0, SAMPLE / n) * (1 << 40)).cast("long")).select("dims", "vector").distinct().collect()
    by_dims: dict[int, list] = {}
    for r in chosen:
        by_dims.setdefault(r["dims"], []).append(r["vector"])
    centres = {d: _centres(_units(np.array(sorted(v)))) for d, v in by_dims.items()}

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        sizes = batch.column("dims").to_numpy()
        for d in np.unique(sizes).tolist():
            own = batch.filter(pa.array(sizes == d))
            out.append(_coded(own, d, centres.get(d)))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = map_batches(rows, each, f"vec_id {kinds['vec_id']}, dims int, cell int, code binary, base double, scale double, spread double, vector {kinds['vector']}")
    return CodedVectors(stored(coded), centres)


def _coded(own: pa.RecordBatch, dims: int, centres: np.ndarray | None) -> pa.RecordBatch:
    turn, centres = rotation(dims), np.zeros((1, dims)) if centres is None else centres
    bits = len(turn)
    units = _units(_matrix(own.column("vector"), dims))
    cell = _cells(units, centres)
    rest = units - centres[cell]
    size = np.linalg.norm(rest, axis=1)
    turned = (rest / np.maximum(size, 1e-300)[:, None]) @ turn.T
    up = turned > 0
    kept = np.maximum(np.abs(turned).sum(axis=1) / np.sqrt(bits), 1e-9)  # of the residual's direction, what its code has
    scale = np.where(size > 1e-12, size / kept, 0)
    code_centre = (np.where(up, 1.0, -1.0) * (centres @ turn.T)[cell]).sum(axis=1) / np.sqrt(bits)
    packed = np.packbits(up, axis=1, bitorder="little")
    return pa.RecordBatch.from_arrays([
        own.column("vec_id"), pa.array(np.full(len(cell), dims, np.int32)), pa.array(cell.astype(np.int32)),
        pa.array([x.tobytes() for x in packed], pa.binary()),
        pa.array((rest * centres[cell]).sum(axis=1) - scale * code_centre), pa.array(scale),
        pa.array(scale * np.sqrt(np.maximum(0, 1 - kept ** 2)) / np.sqrt(bits - 1)), own.column("vector"),
    ], ["vec_id", "dims", "cell", "code", "base", "scale", "spread", "vector"])


class _Held:
    """Codes and vectors of one number of dimensions that a task holds."""

    def __init__(self, rows: pa.Table, dims: int, centres: np.ndarray | None):
        rows = rows.combine_chunks()
        self.dims, self.turn = dims, rotation(dims)
        self.centres = np.zeros((1, dims)) if centres is None else centres
        self.ids = rows["vec_id"].to_numpy()
        self.cell, self.base, self.scale, self.spread = (rows[c].to_numpy() for c in ("cell", "base", "scale", "spread"))
        self.code = np.ascontiguousarray(
            np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint64).reshape(len(rows), -1).T)
        self.ones = np.bitwise_count(self.code).sum(axis=0, dtype=np.int64)
        self.vectors = _scaled(_matrix(rows["vector"].combine_chunks(), dims))
        self.squares = _ordered_sum(self.vectors ** 2)

    def exact(self, query: np.ndarray, square: float, rows: np.ndarray) -> np.ndarray:
        """Cosines in double precision, held to [-1, 1]."""
        out = [_ordered_sum(self.vectors[r] * query) / np.sqrt(square * self.squares[r])
               for r in np.array_split(rows, max(1, len(rows) * self.dims // HELD + 1))]
        return np.clip(np.concatenate(out), -1, 1)

    def nearest(self, ids: np.ndarray, queries: np.ndarray, k: int, own_id: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place of the query, rows, scores): its k best rows here, ties to smaller ids."""
        scaled = _scaled(queries)
        square = _ordered_sum(scaled ** 2)
        units = _units(queries)
        to_centres = units @ self.centres.T
        off = np.sqrt(np.maximum(0, 1 + (self.centres ** 2).sum(axis=1) - 2 * to_centres))
        turned = units @ self.turn.T
        bits = turned.shape[1]
        low = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - low) / (2 ** PLANES - 1), 1e-300)
        level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
        rounded = low[:, None] + step[:, None] * level
        lost = np.linalg.norm(turned - rounded, axis=1) / np.sqrt(bits)
        planes = [np.packbits(level >> p & 1, axis=1, bitorder="little").view(np.uint64) for p in range(PLANES)]
        for i in range(len(ids)):
            met = np.zeros(len(self.ids), np.int64)
            for p, plane in enumerate(planes):
                counts = np.zeros(len(self.ids), np.int64)
                for word, of_query in zip(self.code, plane[i], strict=True):
                    counts += np.bitwise_count(word & of_query)
                met += counts << p
            # the sum of the query's components under the set bits, less that under the others
            product = (2 * (low[i] * self.ones + step[i] * met) - rounded[i].sum()) / np.sqrt(bits)
            guess = to_centres[i][self.cell] + self.base + self.scale * product
            high = guess + SPREADS * (self.spread * off[i][self.cell] + self.scale * lost[i]) + 1e-9
            if own_id:
                mine = self.ids == ids[i]
                guess[mine] = high[mine] = -np.inf
            first = np.argpartition(-guess, k)[:k] if len(guess) > k else np.arange(len(guess))
            first = first[np.isfinite(guess[first])]
            scores = self.exact(scaled[i], square[i], first)
            if len(first) == k:
                more = high >= scores.min()
                more[first] = False
                rest = np.flatnonzero(more)
                first, scores = np.append(first, rest), np.append(scores, self.exact(scaled[i], square[i], rest))
            best = np.lexsort((self.ids[first], -scores))[:k]
            if len(best):
                yield i, first[best], scores[best]


def _blocks(files: list[str]) -> Iterator[pa.Table]:
    """Blocks of the written queries, one at a time."""
    for uri in files:
        fs, path = shared_files(uri)
        with fs.open_input_file(path) as source:
            file = pq.ParquetFile(source)
            dims = 1
            for batch in file.iter_batches(batch_size=1024, columns=["vec_id", "dims", "vector"]):
                dims = max(1, int(batch.column("dims").to_numpy().max()))
                for at in range(0, batch.num_rows, step := max(1, QUERY_BLOCK // dims)):
                    yield pa.Table.from_batches([batch.slice(at, step)])


def search(index: CodedVectors, queries: DataFrame, k: int = 5, own_id: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of the index with the largest cosines, for each query.

    ``queries`` has (vec_id, embedding); unusable ones, and ones without vec_id, find
    nothing, and of several rows with one vec_id the smallest vector is the query. A query meets
    vectors with as many components as it has, and with ``own_id`` no row of its own vec_id.
    Fewer rows than ``k`` are all returned. Ties go to the smaller vec_id; repeated rows of the
    index count as rows of their own. No query or no row gives an empty table.
    """
    # the same number type as the index has, so that blocks look alike
    asked = _plain(queries).groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dims", F.size("vector"))
    files = sorted(stored(asked).inputFiles())
    centres = index.centres
    kind = index.table.schema["vec_id"].dataType.simpleString()

    def answers(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        sizes = rows["dims"].to_numpy()
        held = [_Held(rows.filter(pa.array(sizes == d)), d, centres.get(d)) for d in np.unique(sizes).tolist()]
        for block in _blocks(files):
            q_sizes = block["dims"].to_numpy()
            for own in held:
                asked = block.filter(pa.array(q_sizes == own.dims)).combine_chunks()
                if not len(asked):
                    continue
                ids = asked["vec_id"].to_numpy()
                found = list(own.nearest(ids, _matrix(asked["vector"].combine_chunks(), own.dims), k, own_id))
                if found:
                    at = np.repeat([i for i, _, _ in found], [len(r) for _, r, _ in found])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[at]), pa.array(own.ids[np.concatenate([r for _, r, _ in found])]),
                         pa.array(np.concatenate([s for _, _, s in found]))], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, numbers = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                kept.append(part)
                numbers += int(part.column("dims").to_numpy().astype(np.int64).sum())
                if numbers >= HELD:
                    yield from answers(pa.Table.from_batches(kept))
                    kept, numbers = [], 0
        if kept:
            yield from answers(pa.Table.from_batches(kept))

    found = index.table.mapInArrow(run, f"query_id {kind}, vec_id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
