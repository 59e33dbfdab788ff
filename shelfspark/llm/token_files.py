"""Token-ID output: Arrow files of equal-length sequences and masks, readable at any place.

A written folder holds, for each part, two Arrow IPC files. ``*.ids.arrow`` has record
batches of two fixed-size-list columns, ``ids`` (the narrowest unsigned integer that holds
the vocabulary) and ``mask`` (false behind a part's last id). ``*.docs.arrow`` has doc_id,
start (in the part) and n_tokens. Parts are in ascending order of doc_id, so the corpus is
one run of ids that a reader maps into memory without copying.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import compress, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import in_arrow, release, shared_files
from shelfspark.session import ensure_checkpoint_dir, stored

END_ID = 0
SEQUENCE = 2048
#: Sequences in a record batch, so that a task buffers 8 MB of ids and a reader can skip.
BATCH_SEQUENCES = 1024
#: Words a task remembers the ids of, and those its worker keeps for the next task (the first
#: met, so the common ones); the rest is encoded again.
CACHE_WORDS, KEPT_WORDS = 700_000, 350_000

#: Bytes of rows that a task encodes at a time.
GROUP_BYTES = 12 << 20

#: A single space between two other characters: the tokenizer always cuts before it.
CUT = re.compile(r"(?<=\S) (?=\S)")

#: What stands for a space in byte-level vocabularies.
SPACE_LETTER = "Ġ"

_encoders: dict[str, Encoder] = {}


def _odd(pieces: pa.Array, texts: list[str]) -> np.ndarray:
    """Which pieces are empty or have white space at an end; only ends that are not visible ASCII are looked at one by one."""
    data = pieces.buffers()[2]
    letters = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    bounds = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1, 8 * pieces.offset)
    filled = bounds[1:] > bounds[:-1]
    ends = [letters[np.where(filled, x, 0)] for x in (bounds[:-1], bounds[1:] - 1)]
    odd = ~filled
    for i in np.flatnonzero(filled & ~((ends[0] > 32) & (ends[0] < 127) & (ends[1] > 32) & (ends[1] < 127))).tolist():
        x = texts[i]
        odd[i] = x[0].isspace() or x[-1].isspace()
    return odd


class Encoder:
    """Ids of whole texts as bytes of unsigned 16- or 32-bit integers.

    The library encodes each distinct piece between single spaces once; what it gives for
    a text is the pieces' ids in order, as the cut before such a space is one that the
    byte-level pattern always makes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self.model.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.known: dict[str, bytes] = {}
        names = self.model.get_vocab()
        self.spaced = np.zeros(max(names.values()) + 1, bool)  # ids that begin with a space
        self.spaced[[i for name, i in names.items() if name.startswith(SPACE_LETTER)]] = True

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def shrink(self) -> None:
        if len(self.known) > KEPT_WORDS:
            self.known = dict(islice(self.known.items(), KEPT_WORDS))

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        letter = "H" if self.kind.itemsize == array("H").itemsize else "I"
        for i in range(0, len(texts), 20_000):
            for x in self.model.encode_batch_fast(texts[i:i + 20_000], add_special_tokens=False):
                yield array(letter, x.ids).tobytes()  # for a few ids a fifth of what numpy takes

    def _encode_words(self, words: list[str]) -> Iterator[bytes]:
        """Ids of a space and a word, for each: many are read as one text, which is cut where ids begin with a space."""
        for i in range(0, len(words), 2000):
            part = words[i:i + 2000]
            ids = np.array(self.model.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids)
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) != len(part):  # not that kind of vocabulary
                yield from self._encode([" " + w for w in part])
                continue
            run, cuts = ids.astype(self.kind).tobytes(), (np.append(starts, len(ids)) * self.kind.itemsize).tolist()
            yield from (run[a:b] for a, b in zip(cuts, cuts[1:], strict=False))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Arrow splits the texts and strings the pieces' ids together; Python meets distinct pieces only."""
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        bounds = split.offsets.to_numpy()
        first, last = bounds[:-1], bounds[1:]
        coded = split.values.dictionary_encode()
        pieces, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        inner = np.ones(len(at), bool)
        inner[first] = False
        # a piece that is empty or has white space at an end lies at no such cut
        odd = _odd(coded.dictionary, pieces)
        plain = np.zeros(len(pieces), bool)
        plain[at[inner]] = True
        plain &= ~odd
        wanted = list(compress(pieces, plain.tolist()))
        runs = list(map(self.known.get, wanted))
        missing = [i for i, run in enumerate(runs) if run is None]
        new = [wanted[i] for i in missing]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.shrink()
        for i, word, run in zip(missing, new, self._encode_words(new), strict=True):
            runs[i] = self.known[word] = run
        runs.append(b"")
        place = np.full(len(pieces), len(wanted))
        place[plain] = np.arange(len(wanted))
        strung = pa.array(runs, pa.large_binary()).take(pa.array(place[at]))  # ids in the order of the texts, one buffer
        ends = np.frombuffer(strung.buffers()[1], np.int64, len(strung) + 1, 8 * strung.offset)
        ids = strung.buffers()[2]
        ids = memoryview(ids) if ids is not None else memoryview(b"")
        heads = [pieces[i] for i in at[first].tolist()]
        own = list(set(heads))
        start = dict(zip(own, self._encode(own), strict=True))
        cut_badly = np.add.reduceat(odd[at] & inner, first) > 0
        out = []
        for text, head, bad, a, b in zip(texts, heads, cut_badly.tolist(), first.tolist(), last.tolist(), strict=True):
            if bad or b - a > 1 and (not head or head[-1].isspace()):  # cut only where it is safe
                safe = CUT.split(text)
                out.append(b"".join(self._encode([safe[0], *(" " + x for x in safe[1:])])))
            else:
                out.append(start[head] + ids[ends[a + 1]:ends[b]])
        return out


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about GROUP_BYTES, since a distinct word is looked up once in each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(x.nbytes for x in held) >= GROUP_BYTES:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


class _PartWriter:
    """Fills fixed-size lists with a run of ids."""

    def __init__(self, stem: str, kind: np.dtype, length: int, doc_kind: pa.DataType):
        self.length, self.kind, self.n = length, kind, 0
        item = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.doc_schema = pa.schema([("doc_id", doc_kind), ("start", pa.int64()), ("n_tokens", pa.int64())])
        fs, path = shared_files(stem)
        self.files = [fs.open_output_stream(f"{path}.{x}.arrow") for x in ("ids", "docs")]
        self.ids = pa.ipc.new_file(self.files[0], self.schema)
        self.docs = pa.ipc.new_file(self.files[1], self.doc_schema)
        self.held: list[bytes] = []
        self.held_ids = 0

    def add(self, doc_ids: pa.Array, runs: list[bytes]) -> None:
        sizes = np.array([len(x) for x in runs], np.int64) // self.kind.itemsize
        starts = self.n + np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.docs.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(sizes)], schema=self.doc_schema))
        self.n += int(sizes.sum())
        for run, size in zip(runs, sizes, strict=True):
            self.held.append(run)
            self.held_ids += int(size)
            if self.held_ids >= self.length * BATCH_SEQUENCES:
                self._flush(last=False)

    def _flush(self, last: bool) -> None:
        run = np.frombuffer(b"".join(self.held), self.kind)
        per = self.length * BATCH_SEQUENCES  # all batches but the last are full, so a place tells its batch
        whole = -(-len(run) // self.length) if last else len(run) // per * BATCH_SEQUENCES
        for at in range(0, whole, BATCH_SEQUENCES):
            rows = min(BATCH_SEQUENCES, whole - at)
            part = run[at * self.length:(at + rows) * self.length]
            pad = rows * self.length - len(part)
            ids = pa.array(np.concatenate([part, np.zeros(pad, self.kind)]))
            mask = pa.array(np.arange(rows * self.length) < len(part))
            self.ids.write_batch(pa.RecordBatch.from_arrays(
                [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (ids, mask)], schema=self.schema))
        rest = run[whole * self.length:]
        self.held, self.held_ids = [rest.tobytes()] if len(rest) else [], len(rest)

    def close(self) -> None:
        self._flush(last=True)
        for x in (self.ids, self.docs, *self.files):
            x.close()


class TokenFile:
    """A part, opened for reading; local files are mapped, so slices copy nothing."""

    def __init__(self, stem: str):
        fs, path = shared_files(stem)
        def source(x: str):
            name = f"{path}.{x}.arrow"
            return pa.memory_map(name) if fs.type_name == "local" else fs.open_input_file(name)
        self._sources = [source("ids"), source("docs")]
        self.reader, self.docs = (pa.ipc.open_file(x) for x in self._sources)
        self.length = self.reader.schema.field("ids").type.list_size

    def close(self) -> None:
        """Slices handed out before stay valid only where the file was read, not mapped."""
        for x in self._sources:
            x.close()

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """The i-th sequence: its ids (a view) and its mask (a slice)."""
        batch = self.reader.get_batch(i // BATCH_SEQUENCES)
        ids, mask = batch.column(0), batch.column(1)
        at = i % BATCH_SEQUENCES
        return ids.values.slice(at * self.length, self.length).to_numpy(), mask.values.slice(at * self.length, self.length)

    def run(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Views of the ids from ``start`` on, by record batch."""
        per = self.length * BATCH_SEQUENCES
        while n:
            if self._batch_at != start // per:
                self._batch_at = start // per
                self._batch_ids = self.reader.get_batch(self._batch_at).column(0).values.to_numpy()
            piece = self._batch_ids[start % per:start % per + n]
            if not len(piece):
                raise EOFError(f"the part ends before id {start}")
            yield piece
            start, n = start + len(piece), n - len(piece)

    _batch_at = -1
    _batch_ids = np.zeros(0, np.uint16)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, length: int = SEQUENCE) -> DataFrame:
    """Encode every whole text and write the files; one row per part: stem, n_docs, n_ids, base.

    Null text is empty: its run is the end id alone. Rows go in ascending order of doc_id,
    ties (repeated rows too) by text, a null doc_id last. ``base`` counts the ids of all
    parts before. A task writes under a name of its own and only what finished tasks report
    counts, so a repeated task does no harm. No rows, no files.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        n_docs, first = 0, None
        stem = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}"
        for batch in _together(batches):
            encoder = Encoder.of(tokenizer)
            if writer is None:
                fs, path = shared_files(folder)
                fs.create_dir(path, recursive=True)
                writer = _PartWriter(stem, encoder.kind, length, batch.column("doc_id").type)
                first = batch.column("doc_id")[0]
            end = np.array([end_id], encoder.kind).tobytes()
            runs = encoder.encode([x or "" for x in batch.column("text").to_pylist()])
            writer.add(batch.column("doc_id"), [r + end for r in runs])
            n_docs += batch.num_rows
        if writer is not None:
            writer.close()
            encoder.shrink()
            yield pa.RecordBatch.from_arrays(
                [pa.array([stem]), pa.array([first.as_py()], first.type), pa.array([n_docs], pa.int64()), pa.array([writer.n], pa.int64())],
                ["stem", "first_id", "n_docs", "n_ids"])

    order = F.col("doc_id").asc_nulls_last()
    ordered = docs.select("doc_id", F.col("text").cast("string").alias("text")).repartitionByRange(order).sortWithinPartitions(order, F.col("text").asc_nulls_first())
    parts = stored(in_arrow(ordered, write, f"stem string, first_id {kind}, n_docs long, n_ids long"))
    before = Window.orderBy(F.col("first_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    return parts.select("stem", "n_docs", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long").alias("base"), "first_id")


def read_tokens(parts: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    kind = parts.schema["first_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _encoders.clear()  # of a pass that wrote in this worker
        release()
        for batch in batches:
            for stem, base in zip(batch.column("stem").to_pylist(), batch.column("base").to_pylist(), strict=True):
                file = TokenFile(stem)
                for k in range(file.docs.num_record_batches):
                    own = file.docs.get_batch(k)
                    crcs = []
                    for start, n in zip(own.column("start").to_pylist(), own.column("n_tokens").to_pylist(), strict=True):
                        crc = 0
                        for piece in file.run(start, n):
                            crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                        crcs.append(crc)
                    yield pa.RecordBatch.from_arrays(
                        [own.column("doc_id"), pa.array(own.column("start").to_numpy() + base), own.column("n_tokens"), pa.array(crcs, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])
                file.close()

    parts = stored(parts)
    return in_arrow(parts.repartition(max(1, parts.count())), read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def token_folder(docs: DataFrame) -> str:
    """A new folder below the shared one."""
    return f"{ensure_checkpoint_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
