"""Language-model scoring by online logistic mixing of hashed-context bit predictors.

A text is its words (A-Z lower-cased) and an end. Each word is a run of bits: its Huffman
code in a codebook of the commonest training words, or an escape and then the codes of its
bytes. Three predictors guess every bit from counts gathered over all training texts: by the
place in the code, by that and the symbol before, by that and two symbols before. The last
two are hashed into tables of fixed size. Their guesses are mixed in the logistic domain by
weights that a gate chooses (how often the contexts were seen), and the weights are refined
while a text is read. The bits' probabilities multiply to the probability of the text.
"""

from __future__ import annotations

import heapq
import uuid
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import in_arrow, release, remainder, shared_files, texts_of
from shelfspark.llm.suffix_groups import ranges
from shelfspark.session import stored

#: Words that have a code of their own; all others are spelled, so none is out of reach.
CODEBOOK = 1 << 18
TABLE_BITS = 21  # cells of a hashed table: 16 MB in a worker for each of two
CHUNK_BITS = 14  # cells of a table in one row of the gathered counts
END, ESCAPE = 0, 1  # symbols before the words
#: Bits after which the weights start anew, and bits between two refinements.
RUN, STEP = 4096, 64
RATE, SMOOTH = 0.02, 0.4
#: Weight that a context's predictor takes from the ones before it, by how often it was seen: never, up to 2 times, up to 30, more.
SHARES = (0.0, 0.1, 0.3, 0.5)
LEVELS = len(SHARES)
TEXT_BYTES = 200_000  # of text that a task counts or scores at a time: 32 MB of arrays
HASH = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
HASH32 = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77)]


def _huffman(counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per symbol where its path starts and how long it is; the inner nodes and bits of all paths."""
    heap = [(c, i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    n = len(counts)
    parent, side = array("i", [-1]) * (2 * n), bytearray(2 * n)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for bit, x in enumerate((a, b)):
            parent[x[2]], side[x[2]] = n, bit
        heapq.heappush(heap, (a[0] + b[0], n, n))
        n += 1
    offsets, lengths, nodes, bits = array("q"), array("q"), array("i"), bytearray()
    for i in range(len(counts)):
        path = []
        while parent[i] >= 0:
            path.append((parent[i] - len(counts), side[i]))
            i = parent[i]
        offsets.append(len(nodes))
        lengths.append(len(path))
        for node, bit in reversed(path):
            nodes.append(node)
            bits.append(bit)
    return np.array(offsets, np.int64), np.array(lengths, np.int64), np.array(nodes, np.int32), np.frombuffer(bytes(bits), np.int8)


class Code:
    """Turns texts into bits with their contexts."""

    def __init__(self, words: list[bytes], counts: list[int], end: int, other: int, total: int, distinct: int):
        self.uid = uuid.uuid4().hex
        self.words, self.counts = words, np.array([end, 0, *counts], np.int64)
        self.total, self.distinct = total, distinct
        self.paths = _huffman([end + 1, other + 1, *counts])
        letters = Counter(chain.from_iterable(words))
        self.spelling = _huffman([letters[b] + 1 for b in range(256)])
        self.nodes = len(self.counts)  # spelling nodes come behind the words'

    def symbols(self) -> dict[bytes, int]:
        held = _held.get(self.uid)
        if held is None:
            _evict(self)
            held = _held[self.uid] = {w: i for i, w in enumerate(self.words, 2)}
        return held

    def _bits(self, symbols: np.ndarray, paths: tuple, first_node: int, before: np.ndarray, before2: np.ndarray, of: np.ndarray, kind: int):
        offsets, lengths, nodes, bits = paths
        sizes = lengths[symbols]
        at = ranges(offsets[symbols], sizes)
        node = nodes.take(at)
        node += np.int32(first_node)
        node = node.view(np.uint32)
        one = (before.astype(np.uint64) + np.uint64(1)) * HASH[0]
        two = one * HASH[1] ^ (before2.astype(np.uint64) + np.uint64(2)) * HASH[2]
        cells, mixed = [node], node * HASH32[0]
        for h in (one, two):
            cell = np.repeat((h >> np.uint64(32)).astype(np.uint32), sizes)
            cell ^= mixed
            cell ^= cell >> np.uint32(15)
            cell *= HASH32[1]
            cell >>= np.uint32(32 - TABLE_BITS)
            cells.append(cell)
        return cells, bits.take(at), np.repeat(of.astype(np.int32), sizes), np.full(len(at), kind, np.int8)

    def word_bits(self, split: list[list[bytes]]):
        """(cells, bits, text numbers, kinds) of the words and ends; symbols, their texts, spelled words, their texts."""
        get = self.symbols().get
        ends = np.cumsum([len(w) + 1 for w in split])
        flat = list(chain.from_iterable(chain(w, (b"",)) for w in split))
        ids = np.fromiter(map(get, flat, repeat(ESCAPE)), np.int64, len(flat))
        ids[ends - 1] = END
        of = np.repeat(np.arange(len(split)), np.diff(ends, prepend=0))
        escaped = np.flatnonzero(ids == ESCAPE)
        spelled = [flat[i] for i in escaped]
        own = ids.copy()
        own[escaped] = [zlib.crc32(w) + (1 << 32) for w in spelled]  # as a context a spelled word is itself
        return self._bits(ids, self.paths, 0, _before(own, of, 1), _before(own, of, 2), of, 0), ids, of, spelled, of[escaped]

    def spelling_bits(self, spelled: list[bytes]):
        """(cells, bits, word numbers, kinds) of the bytes of words; a word has no space, so a space ends it."""
        letters = np.frombuffer(b" ".join(spelled) + b" ", np.uint8).astype(np.int64)
        word = np.concatenate([[0], np.cumsum(letters == 32)[:-1]])
        one, two, three = (_before(letters, word, k) for k in (1, 2, 3))
        return self._bits(letters, self.spelling, self.nodes, one + (two << 8) + (1 << 40), three, word, 1)

    def encode(self, split: list[list[bytes]]):
        """cells, bits, text numbers and kinds of all bits; symbols, their texts, spelled words, their texts."""
        parts, ids, of, spelled, spelled_of = self.word_bits(split)
        if spelled:
            cells, bits, word, kinds = self.spelling_bits(spelled)
            parts = [[np.concatenate(x) for x in zip(parts[0], cells, strict=True)],
                     *(np.concatenate(x) for x in zip(parts[1:], (bits, spelled_of[word], kinds), strict=True))]
        return *parts, ids, of, spelled, spelled_of


def _before(x: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """The value ``k`` places before, 0 outside the group."""
    out = np.zeros(len(x), np.int64)
    out[k:] = np.where(group[:-k] == group[k:], x[:-k], 0)
    return out


_held: dict[str, object] = {}


def _evict(code: Code) -> None:
    """Drop what the worker holds of other codes, before it loads anything of this one."""
    for old in [k for k in _held if not k.startswith(code.uid)]:
        del _held[old]
    release()


def _sizes(code: Code) -> tuple[int, int, int]:
    """Cells of each predictor."""
    return code.nodes + 256, 1 << TABLE_BITS, 1 << TABLE_BITS


def _tables(code: Code) -> list[np.ndarray]:
    """Zero counts (zeros, ones) by cell for each predictor."""
    return [np.zeros((n, 2), np.uint32) for n in _sizes(code)]


def _words(texts: list[bytes]) -> Iterator[list[list[bytes]]]:
    """The words of texts, some texts at a time."""
    held, size = [], 0
    for text in texts:
        held.append(text.lower().split())
        size += len(text)
        if size >= TEXT_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def count_words(texts: DataFrame) -> DataFrame:
    """word, n: every word of the texts; an empty word counts the ends."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for words in chain.from_iterable(_words(texts_of(batch))):
                held.update(words)
            held[b""] += batch.num_rows
            if len(held) > 300_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
                held = Counter()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
    return in_arrow(texts.select("text"), count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def make_code(words: DataFrame, codebook: int = CODEBOOK) -> Code:
    """A code from counted words; the driver gets ``codebook`` words at most, and how many words have each count."""
    total, distinct, end = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.octet_length("word") == 0, F.col("n"))), F.lit(0))).first()
    plain = words.where(F.octet_length("word") > 0)
    of_count = plain.groupBy("n").agg(F.count(F.lit(1)).alias("m")).toArrow().sort_by([("n", "descending")])
    enough = np.flatnonzero(np.cumsum(of_count["m"].to_numpy()) >= codebook)  # rarer words are not sent to be sorted
    least = int(of_count["n"][int(enough[0])].as_py()) if len(enough) else 0
    top = plain.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(codebook).toArrow()
    counts = top["n"].to_pylist()
    return Code(top["word"].to_pylist(), counts, end, total - end - sum(counts), total, distinct)


CELL_ROW = "predictor int, chunk int, counts binary"


def gather_counts(texts: DataFrame, words: DataFrame, code: Code, sent: Broadcast) -> DataFrame:
    """predictor, chunk, counts: what each predictor saw of every bit, by cell.

    The bits of words and escapes come from all texts, those of spellings from all distinct
    words, which new words resemble more than running text does. A task adds up all it
    reads and sends its tables in compressed chunks; a chunk's rows meet sorted and are
    added one by one, so memory does not depend on the number of tasks. ``sent`` is the code
    as tasks get it.
    """
    sizes = _sizes(code)

    def count(streams: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        tables = None
        for cells, bits in streams:
            tables = tables or _tables(sent.value)
            for table, cell in zip(tables, cells, strict=True):
                seen, flat = cell.astype(np.intp), table.reshape(-1)
                seen <<= 1
                seen += bits
                if len(seen) > len(flat):
                    flat += np.bincount(seen, minlength=len(flat)).astype(np.uint32)
                else:
                    np.add.at(flat, seen, np.uint32(1))
        for k, table in enumerate(tables or ()):
            for at in range(0, len(table), 1 << CHUNK_BITS):
                part = table[at:at + (1 << CHUNK_BITS)]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at >> CHUNK_BITS], pa.int32()), pa.array([pa.Codec("zstd", 1).compress(part.astype("<u4").tobytes(), asbytes=True)])], ["predictor", "chunk", "counts"])

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return count(sent.value.word_bits(split)[0][:2] for batch in batches for split in _words(texts_of(batch)))

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return count(sent.value.spelling_bits(own)[:2] for batch in batches if (own := [w for w in texts_of(batch, "word") if w]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([total.astype("<f4").tobytes()])], ["predictor", "chunk", "counts"])
        for batch in batches:
            for k, c, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = np.frombuffer(pa.Codec("zstd", 1).decompress(counts, 8 * min(1 << CHUNK_BITS, sizes[k] - (c << CHUNK_BITS)), asbytes=True), "<u4").astype(np.float64)
                if (k, c) == key:
                    total += own
                else:
                    if key:
                        yield row()
                    key, total = (k, c), own
        if key:
            yield row()

    parts = in_arrow(texts.select("text"), of_texts, CELL_ROW).unionByName(in_arrow(words.select("word"), of_words, CELL_ROW))
    return stored(in_arrow(parts.repartition("predictor", "chunk").sortWithinPartitions("predictor", "chunk"), add, CELL_ROW))


def load_predictors(files: list[str], code: Code) -> list[tuple[np.ndarray, np.ndarray]]:
    """The predictors' tables, read from the shared folder once per worker, some chunks at a time."""
    name = f"{code.uid}-counts"
    if name not in _held:
        _evict(code)
        tables = [(np.zeros(n, np.float32), np.zeros(n, np.uint8)) for n in _sizes(code)]
        for uri in files:
            fs, path = shared_files(uri)
            for batch in ds.dataset(path, filesystem=fs, format="parquet").to_batches(batch_size=8, use_threads=False):
                for k, chunk, counts in zip(*(batch.column(c) for c in ("predictor", "chunk", "counts")), strict=True):
                    own = predictors([np.frombuffer(counts.as_buffer(), "<f4").reshape(-1, 2)])[0]
                    for table, part in zip(tables[k.as_py()], own, strict=True):
                        table[chunk.as_py() << CHUNK_BITS:][:len(part)] = part
        _held[name] = tables
        release()
    return _held[name]


def predictors(tables: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """By cell: the logit of a one, 0 where nothing was seen, and the level of how much was."""
    out = []
    for table in tables:
        n = table.sum(axis=1)
        logit = np.log((table[:, 1] + np.float32(SMOOTH)) / (table[:, 0] + np.float32(SMOOTH))).astype(np.float32)
        out.append((logit, (n > 0).astype(np.uint8) + (n > 2) + (n > 30)))
    return out


def start_weights() -> list[np.ndarray]:
    """By gate (level of the second predictor, of the third, kind): a predictor weighs by what it saw."""
    two, three, _ = (x.ravel() for x in np.meshgrid(np.arange(LEVELS), np.arange(LEVELS), np.arange(2), indexing="ij"))
    share = np.array(SHARES, np.float32)
    return [(1 - share[two]) * (1 - share[three]), share[two] * (1 - share[three]), share[three]]


def _stretches(of: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the bits of a kind and text start, and how many they are; kinds ascend, and texts in each."""
    starts = []
    cuts = [0, *np.searchsorted(kinds, [1, 2]).tolist()]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            part = of[a:b]
            met = np.searchsorted(part, np.arange(part[0], part[-1] + 2, dtype=of.dtype))
            starts.append(a + met[:-1][np.diff(met) > 0])
    starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(of)))


def log_probabilities(cells: list[np.ndarray], tables: list[tuple[np.ndarray, np.ndarray]], bits: np.ndarray, of: np.ndarray, kinds: np.ndarray, texts: int) -> np.ndarray:
    """Natural log probability of each text's bits under the mix.

    Bits lie together by kind and text, and are cut into runs. Each run starts with the same
    weights and refines them every few bits by the gradient of what it has read, whatever is
    scored beside it.
    """
    n = len(bits)
    held = [np.zeros(n + STEP - 1, t) for t in (np.float32, np.float32, np.float32, np.uint8, np.float32)]
    for (table, level), cell, out in zip(tables, cells, held, strict=False):
        cell = cell.astype(np.intp)
        table.take(cell, out=out[:n], mode="clip")
        if out is not held[0]:
            held[3][:n] *= np.uint8(LEVELS)
            held[3][:n] += level.take(cell)
    held[3][:n] *= np.uint8(2)
    held[3][:n] += kinds.view(np.uint8)
    np.subtract(bits * np.int8(2), np.int8(1), out=held[4][:n])
    *logits, gate, sign = [sliding_window_view(x, STEP) for x in held]  # by place, the STEP values from there
    starts, sizes = _stretches(of, kinds)
    pieces = -(-sizes // RUN)
    run_start = ranges(np.zeros(len(sizes), np.int64), pieces) * RUN + np.repeat(starts, pieces)
    run_size = np.minimum(RUN, np.repeat(starts + sizes, pieces) - run_start)
    by = np.argsort(-run_size, kind="stable")
    run_start, run_size = run_start[by], run_size[by]
    first = start_weights()
    gates = len(first[0])
    weights = [np.tile(w.astype(np.float32), len(run_start)) for w in first]
    total = np.zeros(len(run_start))
    for at in range(0, int(run_size.max()) if len(run_size) else 0, STEP):
        live = int(np.searchsorted(-run_size, -at, side="left"))
        width, place = run_size[:live] - at, run_start[:live] + at
        slot = (gate[place] + np.arange(0, live * gates, gates)[:, None]).ravel()
        own = [x[place].ravel() for x in logits]
        mixed = own[0] * weights[0].take(slot)
        for k in (1, 2):
            mixed += own[k] * weights[k].take(slot)
        turned = sign[place].ravel()
        odds = np.exp(-np.clip(mixed * turned, -12, 12))  # against the bit that came
        full = int(np.searchsorted(-width, -STEP, side="right"))
        own_bit = (np.arange(STEP) < width[full:, None]).ravel()  # what lies behind a run's end is none of its bits
        odds[full * STEP:] *= own_bit
        logs = np.log1p(odds)
        if full < live:
            logs = np.concatenate([logs[:full * STEP], logs[full * STEP:][own_bit]])
        width = np.minimum(STEP, width)
        total[:live] -= np.add.reduceat(logs, np.cumsum(width) - width)
        error = turned * odds / (1 + odds) * np.float32(RATE)
        for k in range(3):
            weights[k][:live * gates] += np.bincount(slot, error * own[k], live * gates)
    return np.bincount(of[run_start], total, texts) if len(run_start) else np.zeros(texts)


def score_texts(docs: DataFrame, held_out: Column, codebook: int = CODEBOOK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte: one row per row.

    Rows for which the column ``held_out`` is false are learned from: all their words and
    bits. ``base_score`` is the log10 probability of the tokens by smoothed single counts,
    ``score`` that of the mixed model, ``bits_per_byte`` the latter over the text's bytes
    (null for an empty text). Null and empty texts are their end alone. With nothing to
    learn from, every guess is even. Repeated rows and null ids are scored as any row. Other
    columns are ignored.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    train = rows.where("NOT held_out")
    words = stored(count_words(train))
    code = make_code(words, codebook)
    sent = docs.sparkSession.sparkContext.broadcast(code)
    files = gather_counts(train, words, code, sent).inputFiles()
    bottom = code.total + 0.5 * (code.distinct + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, row = sent.value, TaskContext.get().partitionId() << 33
        head = np.log10((code.counts + 0.5) / bottom)
        for batch in batches:
            if not batch.num_rows:
                continue
            tables = load_predictors(files, code)
            at = 0
            for split in _words(texts_of(batch)):
                cells, bits, of, kinds, ids, owner, spelled, spelled_of = code.encode(split)
                logs = log_probabilities(cells, tables, bits, of, kinds, len(split))
                del cells, bits, of, kinds
                plain = ids != ESCAPE
                n = np.bincount(owner, minlength=len(split))
                known = np.bincount(owner[plain & (code.counts[ids] > 0)], minlength=len(split))
                base = np.bincount(owner[plain], head[ids[plain]], len(split))
                tails: list[dict] = [{} for _ in split]
                for w, i in zip(spelled, spelled_of.tolist(), strict=True):
                    tails[i][w] = tails[i].get(w, 0) + 1
                part = batch.slice(at, len(split))
                size = pc.fill_null(pc.binary_length(part.column("text").cast(pa.large_binary())), 0)
                ends = pa.array(np.cumsum([0, *map(len, tails)]), pa.int32())
                words = pa.array(list(chain.from_iterable(tails)), pa.binary())
                times = pa.array(list(chain.from_iterable(t.values() for t in tails)), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(np.arange(row, row + len(split))), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)),
                     pa.array(base), pa.array(logs / np.log(10)), size.cast(pa.int64()), pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, times)],
                    ["doc_id", "held_out", "row", "n_tokens", "known", "base", "score", "bytes", "tail", "tail_n"])
                at += len(split)
                row += len(split)

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = stored(in_arrow(rows, score, f"doc_id {kind}, held_out boolean, row long, n_tokens long, known long, base double, score double, bytes long, tail array<binary>, tail_n array<long>"))
    # words outside the codebook: their counts come by a join, whatever the size of the vocabulary
    tail = scored.select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.tail_n").alias("m"))
    least = int(code.counts[-1]) if len(code.words) == codebook else 0
    met = tail.join(words.where((F.octet_length("word") > 0) & (F.col("n") <= least)), "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("more"),
        F.sum(F.col("m") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(bottom))).alias("rest"))
    return scored.drop("tail", "tail_n").join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(code.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score",
        F.when(F.col("bytes") > 0, -F.col("score") * float(np.log2(10)) / F.col("bytes")).alias("bits_per_byte"))


def held_out_fifth() -> Column:
    """Rows that nothing is learned from."""
    return remainder("doc_id", 5) == 1
