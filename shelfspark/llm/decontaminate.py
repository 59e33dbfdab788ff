"""Benchmark decontamination: scan every document for word windows of benchmark items."""

from __future__ import annotations

import hashlib
import io
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import map_batches, shared_files, texts_of
from shelfspark.session import ensure_checkpoint_dir

WINDOW = 10
#: Windows that one broadcast holds. A larger benchmark is laid out in slices of this size.
MAX_WINDOWS = 200_000
#: Texts whose words a task holds at a time.
TEXTS = 500
#: What is no word character becomes a space, A-Z become a-z; bytes from 0x80 belong to words.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def _item_windows(items: DataFrame, window: int) -> DataFrame:
    """item (its id as text), words (one window): distinct."""
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, out = batch.column("item_id").cast(pa.string()).to_pylist(), ([], [])
        for item, text in zip(ids, texts_of(batch), strict=True):
            words = words_of(text)
            n = min(window, len(words))
            for w in {b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)} if n else ():
                out[0].append(item or "")
                out[1].append(w)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary())], ["item", "words"])
    return map_batches(items.select("item_id", "text"), each, "item string, words binary").distinct()


class WindowIndex:
    """Windows as number sequences over their own words, found by a rolling hash and then compared."""

    def __init__(self, items: list[str], windows: list[bytes]):
        self.words: dict[bytes, int] = {}
        by_length: dict[int, dict[bytes, list[str]]] = {}
        for item, window in zip(items, windows, strict=True):
            ids = np.array([self.words.setdefault(w, len(self.words) + 1) for w in window.split(b" ")], np.int64)
            by_length.setdefault(len(ids), {}).setdefault(ids.tobytes(), []).append(item)
        self.by_length = {n: (np.unique(self.hashes(np.stack([np.frombuffer(k, np.int64) for k in found]))), found)
                          for n, found in by_length.items()}

    @staticmethod
    def hashes(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for j in range(rows.shape[1]):
            h = h * np.uint64(0x9E3779B97F4A7C15) + rows[:, j].astype(np.uint64)
        return h

    def scan(self, words: list[bytes]) -> list[tuple[int, int, list[str]]]:
        """(start, length, items) of each window that occurs."""
        get, out = self.words.get, []
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        missing = np.concatenate([[0], np.cumsum(ids == 0)])
        for n, (hashes, found) in self.by_length.items():
            if len(ids) < n:
                continue
            starts = np.flatnonzero(missing[n:] == missing[:-n])  # no word that no item has
            if not len(starts):
                continue
            rows = ids[starts[:, None] + np.arange(n)]
            own = self.hashes(rows)
            near = hashes[np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)] == own
            for k in np.flatnonzero(near):
                if (items := found.get(rows[k].tobytes())) is not None:
                    out.append((int(starts[k]), n, items))
        return out


def _slices(windows: DataFrame, limit: int) -> list:
    """Loaders of window indexes, each of about ``limit`` windows at most.

    One slice is broadcast. More are files in the shared folder, of which a task holds one
    at a time, so memory stays bounded whatever the benchmark's size.
    """
    spark = windows.sparkSession
    windows = windows.cache()
    n = -(-windows.count() // limit)
    if n <= 1:
        found = windows.collect()
        sent = spark.sparkContext.broadcast(pickle.dumps(([r["item"] for r in found], [bytes(r["words"]) for r in found])))
        windows.unpersist()
        return [lambda: pickle.loads(sent.value)]
    folder = f"{ensure_checkpoint_dir(spark)}/windows-{windows.semanticHash() & 0xFFFFFFFF:x}-{n}"
    windows.withColumn("slice", F.pmod(F.xxhash64("words"), F.lit(n))).repartition(n, "slice").write.mode("overwrite").partitionBy("slice").parquet(folder)
    windows.unpersist()

    def load(k: int):
        import pyarrow.dataset as ds
        fs, path = shared_files(f"{folder}/slice={k}")
        if fs.get_file_info(path).type == 0:
            return [], []
        table = ds.dataset(path, filesystem=fs, format="parquet").to_table(columns=["item", "words"])
        return table["item"].to_pylist(), table["words"].to_pylist()
    return [lambda k=k: load(k) for k in range(n)]


def _scanner(items: DataFrame, window: int, max_windows: int):
    """A function that gives each text's words and its (start, length, items) hits, in order."""
    loaders = _slices(_item_windows(items, window), max_windows)
    held: dict[int, WindowIndex] = {}

    def index(k: int) -> WindowIndex:
        if k not in held:
            held.clear()
            held[k] = WindowIndex(*loaders[k]())
        return held[k]

    def scan(texts: list[bytes]) -> Iterator[tuple[list[bytes], list]]:
        for at in range(0, len(texts), TEXTS):
            split = [words_of(t) for t in texts[at:at + TEXTS]]
            hits: list[list] = [[] for _ in split]
            for k in range(len(loaders)):
                own = index(k)
                for words, into in zip(split, hits, strict=True):
                    into += own.scan(words)
            yield from zip(split, hits, strict=True)

    return scan


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Rows of ``docs`` that hold no window of an item, with all their columns."""
    scan = _scanner(items, window, max_windows)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([not hits for _, hits in scan(texts_of(batch))], pa.bool_()))

    return map_batches(docs, each, docs.schema)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, clean_text: one row per row of ``docs``.

    A window is ``window`` consecutive words of an item, or all words of a shorter one. A
    document's words inside any occurrence of a window are hit; ``spans`` lists the hit
    runs as (first word, number of words) and ``clean_text`` is the text without them, each
    run from its first to its last character. Null and empty texts have no words and hit
    nothing, as do items without words; equal items count by their ids, equal (id, text)
    rows once. Other columns are ignored.
    """
    scan = _scanner(items, window, max_windows)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch)
        cols: list[list] = [[] for _ in range(7)]
        for text, (words, found) in zip(texts, scan(texts), strict=True):
            names = sorted({i for _, _, ids in found for i in ids})
            hit = np.zeros(len(words) + 1, np.int64)
            for start, n, _ in found:
                hit[start:start + n] = 1
            edges = np.flatnonzero(np.diff(hit, prepend=0))
            spans = [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
            cols[0].append(len(words))
            cols[1].append(int(hit.sum()))
            cols[2].append(len(names))
            cols[3].append(hashlib.sha256(",".join(names).encode()).hexdigest())
            cols[4].append(bool(found))
            cols[5].append([{"start": a, "n": n} for a, n in spans])
            cols[6].append((_without(text, words, spans) if spans else text).decode())
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), SPANS, pa.string()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id")] + [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "clean_text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), each, (
        f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
        "spans array<struct<start: long, n: long>>, clean_text string"))


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())]))


def _without(text: bytes, words: list[bytes], spans: list[tuple[int, int]]) -> bytes:
    """The text without the hit runs of words."""
    folded, at, places = text.translate(FOLD), 0, []
    for w in words:
        at = folded.index(w, at)
        places.append((at, at := at + len(w)))
    out, last = io.BytesIO(), 0
    for start, n in spans:
        out.write(text[last:places[start][0]])
        last = places[start + n - 1][1]
    out.write(text[last:])
    return out.getvalue()
