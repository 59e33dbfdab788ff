"""Line dedup: repeated line keys live in a sharded minimal perfect hash that documents probe."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import map_batches, shared_files, texts_of
from shelfspark.session import ensure_checkpoint_dir

MIN_LENGTH, MIN_DOCUMENTS = 20, 3
#: Line keys in one shard. A task holds one shard (about 25 bytes a key) at a time.
SHARD_KEYS = 500_000
STRIP = b" \t\n\x0b\x0c\r"
SEEDS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def line_keys(line: bytes, min_length: int = MIN_LENGTH) -> bytes | None:
    """The key of a line, or None if it is too short to count."""
    key = line.strip(STRIP).lower()  # of bytes: A-Z only
    if len(key) < min_length or len(key) < 4 * min_length and len(key.decode()) < min_length:
        return None
    return key


def _digest(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return (h >> 64) - (1 << 63), (h & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def _mix(place: np.ndarray, level: int) -> np.ndarray:
    h = (place ^ np.uint64(level)) * SEEDS[level % 4]
    h ^= h >> np.uint64(29)
    h = h * SEEDS[(level + 1) % 4]
    return h ^ (h >> np.uint64(32))


class PerfectHash:
    """A minimal perfect hash: cascading bit arrays in which each key has a bit alone at some level.

    A key's number is the rank of its bit. What is not a key may get a number too, so the
    arrays it indexes hold fingerprints (64 bits beside the 64 that place the key).
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [np.concatenate([[0], np.cumsum(bits, dtype=np.int64)]) for bits in levels]
        starts = np.concatenate([[0], np.cumsum([c[-1] for c in counts])]).astype(np.int64)
        self.ranks = [c + s for c, s in zip(counts, starts, strict=False)]

    @classmethod
    def build(cls, places: np.ndarray) -> PerfectHash:
        levels, left = [], np.unique(places)
        while len(left):
            size = max(8, 2 * len(left))
            at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            once = np.bincount(at, minlength=size) == 1
            levels.append(once)
            left = left[~once[at]]
        return cls(levels)

    def find(self, places: np.ndarray) -> np.ndarray:
        """Numbers of the keys; -1 for what is surely none."""
        out, left = np.full(len(places), -1, np.int64), np.arange(len(places))
        for level, bits in enumerate(self.levels):
            if not len(left):
                break
            at = (_mix(places[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.ranks[level][at[hit]]
            left = left[~hit]
        return out


class Shard:
    """Arrays by key number: fingerprint, number of documents, the last document."""

    def __init__(self, row: dict):
        lengths = np.frombuffer(row["lengths"], np.int64)
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))
        ends = np.concatenate([[0], np.cumsum(lengths)])
        self.hash = PerfectHash([bits[a:b].astype(bool) for a, b in zip(ends[:-1], ends[1:], strict=True)])
        self.prints = np.frombuffer(row["prints"], np.int64)
        self.last = np.frombuffer(row["last"], np.int64)
        self.counts = np.frombuffer(row["counts"], np.uint32)

    @staticmethod
    def pack(shard: int, places: np.ndarray, prints: np.ndarray, counts: np.ndarray, last: np.ndarray) -> list:
        made = PerfectHash.build(places)
        number = made.find(places)
        arrays = []
        for values, kind in ((prints, np.int64), (counts, np.uint32), (last, np.int64)):
            by_number = np.zeros(len(places), kind)
            by_number[number] = values
            arrays.append(by_number.tobytes())
        bits = np.packbits(np.concatenate(made.levels) if made.levels else np.zeros(0, bool))
        return [shard, np.array([len(x) for x in made.levels], np.int64).tobytes(), bits.tobytes(), *arrays]

    def probe(self, places: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Numbers of the keys that the shard holds; -1 for the others."""
        number = self.hash.find(places)
        ok = number >= 0
        ok[ok] = self.prints[number[ok]] == prints[ok]
        return np.where(ok, number, -1)


SHARD_ROW = "shard int, lengths binary, bits binary, prints binary, counts binary, last binary"


def _repeated(docs: DataFrame, min_length: int, min_documents: int) -> DataFrame:
    """hi, lo, n, last: keys that at least ``min_documents`` documents hold."""
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        his, los, ids = [], [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
            if doc_id is None:
                continue
            keys = {k for line in text.split(b"\n") if (k := line_keys(line, min_length)) is not None}
            for hi, lo in map(_digest, keys):
                his.append(hi)
                los.append(lo)
                ids.append(doc_id)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (his, los, ids)], ["hi", "lo", "doc_id"])
    lines = map_batches(docs.select(F.col("doc_id").cast("long"), "text"), each, "hi long, lo long, doc_id long")
    return lines.groupBy("hi", "lo").agg(
        F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"), F.min("doc_id").alias("first")).where(
        F.col("n") >= min_documents)


def build_index(docs: DataFrame, min_length: int, min_documents: int, shard_keys: int) -> tuple[str, int]:
    """Write the shards to the shared folder; the folder and their number."""
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}"
    _repeated(docs, min_length, min_documents).write.parquet(f"{folder}/keys")
    keys = spark.read.parquet(f"{folder}/keys")
    shards = max(1, -(-keys.count() // shard_keys))

    def pack(key, table):  # no hints: Spark would read them
        col = lambda n: table[n].to_numpy()
        row = Shard.pack(key[0].as_py(), col("hi").view(np.uint64), col("lo"), col("n"), col("last"))
        return pa.table([pa.array([v], t) for v, t in zip(row, [pa.int32()] + [pa.binary()] * 5, strict=True)], ["shard", "lengths", "bits", "prints", "counts", "last"])

    sharded = keys.withColumn("shard", F.pmod(F.col("hi"), F.lit(shards)).cast("int"))
    sharded.groupBy("shard").applyInArrow(pack, SHARD_ROW).write.partitionBy("shard").parquet(f"{folder}/shards")
    return f"{folder}/shards", shards


def dedup_lines(docs: DataFrame, min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text, kept_sha256: one row per row of ``docs``.

    A line's key is the line stripped of white space at both ends with A-Z lower-cased. Keys
    of at least ``min_length`` code points in at least ``min_documents`` documents lose all
    their lines but those of the largest doc_id that holds the key. Kept lines are joined by
    newlines as they were. A null or empty text is one empty line. Rows that repeat a doc_id
    count as further documents and share its fate; rows of null doc_id neither count nor
    lose lines.
    """
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    folder, shards = build_index(counted, min_length, min_documents, shard_keys)
    held: dict[int, Shard | None] = {}

    def shard(k: int) -> Shard | None:
        if k not in held:
            held.clear()
            fs, path = shared_files(f"{folder}/shard={k}")
            row = None
            if fs.get_file_info(path).type != 0:
                row = next(iter(ds.dataset(path, filesystem=fs, format="parquet").to_table().to_pylist()), None)
            held[k] = Shard(row) if row else None
        return held[k]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [None if x is None else x for x in batch.column("doc_id").to_pylist()]
        lines = [t.split(b"\n") for t in texts_of(batch)]
        where, his, los = [], [], []
        for i, own in enumerate(lines):
            if ids[i] is None:
                continue
            for j, line in enumerate(own):
                if (key := line_keys(line, min_length)) is not None:
                    hi, lo = _digest(key)
                    where.append((i, j))
                    his.append(hi)
                    los.append(lo)
        hi, lo = np.array(his, np.int64), np.array(los, np.int64)
        of = np.mod(hi, shards)
        drop: list[set[int]] = [set() for _ in lines]
        for k in np.unique(of):
            if (own := shard(int(k))) is None:
                continue
            some = np.flatnonzero(of == k)
            number = own.probe(hi[some].view(np.uint64), lo[some])
            for n, at in zip(number[number >= 0], some[number >= 0], strict=True):
                i, j = where[at]
                if own.last[n] != ids[i]:
                    drop[i].add(j)
        kept = [b"\n".join(x for j, x in enumerate(own) if j not in gone) for own, gone in zip(lines, drop, strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(x) for x in lines], pa.int64()), pa.array([len(x) for x in drop], pa.int64()),
             pa.array([x.decode() for x in kept], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())],
            ["doc_id", "n_lines", "n_dropped", "kept_text", "kept_sha256"])

    return map_batches(counted, each, "doc_id long, n_lines long, n_dropped long, kept_text string, kept_sha256 string")
