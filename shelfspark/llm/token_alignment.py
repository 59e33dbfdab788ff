"""Alignment of two tokenizers' ids over a corpus, with counts from inverted pair bitmaps.

A (byte-level BPE) reads a space and the text, B (sentencepiece) the text, which it puts a
space before. Byte offsets where tokens of both end cut them into groups, and the two tokens that
end at a cut are linked. For each pair of linked ids there is, per container of up to 65,536
documents, a bitmap of the documents that hold it and bitmaps for the binary digits of how
often more than once: sorted 16-bit places where that is shorter, plain bits otherwise. Containers
hold different documents, so a pair's document count is the sum of its bitmaps' popcounts and its
link count that of all planes, each by its weight. The postings then carry a pair's count back to
its documents, a container at a time.

Both tokenizers cut before a single space between two other characters, so a word's alignment
is made once and reused.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import texts_of
from shelfspark.session import stored

#: Documents a container can number, and links that close it earlier (a longer text closes its own).
PLACES, LINKS = 1 << 16, 1 << 20
#: Bytes of texts that are aligned together.
PART_BYTES = 1 << 20
#: Bytes of remembered words' results after which all are forgotten.
KNOWN_BYTES = 96 << 20

CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space where a text is not cut at every space.
ODD = re.compile(r" \s|\s |\A\s|\s\Z")
A_SHIFT, B_SHIFT = np.uint64(40), np.uint64(16)  # 24 bits an id, 16 a place


class _Words:
    """Results of words: tokens, groups, their text and links. ``sizes`` has n_a, n_b, n_groups and 1, or zeros
    where B changes the word's bytes; a word's links are ``count`` of ``links`` from ``start`` on."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        vocabulary, n_b = self.a.get_vocab(), self.b.get_piece_size()
        n_a = max(vocabulary.values()) + 1
        self.a_bytes = np.zeros(n_a, np.int64)
        for token, i in vocabulary.items():
            self.a_bytes[i] = len(token)  # the byte-level alphabet has a letter for each byte
        self.pieces = []
        for i in range(n_b):
            piece = self.b.id_to_piece(i)
            self.pieces.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.b_bytes = np.array([len(x) for x in self.pieces], np.int64)
        # an id as text, inside and at the end of a group's half
        self.a_text = [np.array([f"{i}{x}" for i in range(n_a)], object) for x in ",|"]
        self.b_text = [np.array([f"{i}{x}" for i in range(n_b)], object) for x in ",;"]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.texts: list[str] = []
        self.sizes = np.zeros((0, 4), np.int64)
        self.links, self.start, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held = 0

    def learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            self._learn(words[at:at + 20_000])

    def _learn(self, words: list[str]) -> None:
        in_a = [x.ids for x in self.a.encode_batch_fast([f" {w}" for w in words], add_special_tokens=False)]
        in_b = self.b.encode(words, num_threads=1)
        get = self.pieces.__getitem__
        good = np.array([b"".join(map(get, b)) == f" {w}".encode() for w, b in zip(words, in_b, strict=True)], bool)
        in_a, in_b = ([x if ok else [] for x, ok in zip(own, good.tolist(), strict=True)] for own in (in_a, in_b))
        n_a, n_b = (np.array([len(x) for x in own], np.int64) for own in (in_a, in_b))
        a, b = (np.array(list(chain.from_iterable(own)), np.int64) for own in (in_a, in_b))
        # offsets count on from word to word: words end at cuts in both
        end_a, end_b = np.cumsum(self.a_bytes[a]), np.cumsum(self.b_bytes[b])
        cut_a, cut_b = (np.isin(x, y, assume_unique=True) for x, y in ((end_a, end_b), (end_b, end_a)))
        group_a, group_b = (np.cumsum(cut) - cut for cut in (cut_a, cut_b))  # the group of each token
        of_a, of_b = (np.bincount(g, minlength=int(cut_a.sum())) for g in (group_a, group_b))
        merged = np.empty(len(a) + len(b), object)  # each group's A tokens, then its B tokens
        merged[np.arange(len(a)) + (np.cumsum(of_b) - of_b)[group_a]] = np.where(cut_a, self.a_text[1][a], self.a_text[0][a])
        merged[np.arange(len(b)) + np.cumsum(of_a)[group_b]] = np.where(cut_b, self.b_text[1][b], self.b_text[0][b])
        ends, parts = np.cumsum(n_a + n_b).tolist(), merged.tolist()
        texts = ["".join(parts[x:y])[:-1] for x, y in zip([0, *ends], ends, strict=False)]
        groups = np.bincount(np.repeat(np.arange(len(words)), n_a)[cut_a], minlength=len(words))
        self.number.update(zip(words, range(len(self.texts), len(self.texts) + len(words)), strict=True))
        self.texts += texts
        self.sizes = np.concatenate([self.sizes, np.stack([n_a, n_b, groups, good], axis=1)])
        self.start = np.concatenate([self.start, len(self.links) + np.cumsum(groups) - groups])
        self.count = np.concatenate([self.count, groups])
        self.links = np.concatenate([self.links, (a[cut_a].astype(np.uint64) << A_SHIFT) | (b[cut_b].astype(np.uint64) << B_SHIFT)])
        self.held += sum(map(len, texts)) + 2 * sum(map(len, words)) + 250 * len(words) + 8 * int(groups.sum())

    def links_of(self, numbers: np.ndarray) -> np.ndarray:
        """The links of a sequence of words."""
        count = self.count[numbers]
        before = np.cumsum(count) - count
        return self.links[np.repeat(self.start[numbers] - before, count) + np.arange(int(count.sum()))]


def words_of(text: str) -> list[str]:
    """Stretches that both tokenizers read on their own; each but the first follows a space."""
    return CUT.split(text) if ODD.search(text) else text.split(" ")


class _Containers:
    """Gathers the links of numbered documents and turns them into postings."""

    def __init__(self, task: int, doc_kind: pa.DataType):
        self.next, self.doc_kind = task << 32, doc_kind
        self.open()

    def open(self) -> None:
        self.id, self.next = self.next, self.next + 1
        self.docs, self.links, self.keys = 0, 0, []

    def add(self, docs: int, doc: np.ndarray, links: np.ndarray) -> None:
        """``docs`` more documents; ``links`` of the ``doc``-th of them."""
        self.keys.append(links | (doc + self.docs).astype(np.uint64))
        self.docs, self.links = self.docs + docs, self.links + len(links)

    def postings(self) -> Iterator[pa.RecordBatch]:
        """Rows (container, a, b, plane, dense, bits): plane -1 has the documents of a pair, plane i
        those where bit i of the number of further links is set."""
        keys, times = np.unique(np.concatenate(self.keys), return_counts=True)
        self.keys = []
        yield from self._plane(keys, -1)
        further, plane = times - 1, 0
        while (further >> plane).any():
            yield from self._plane(keys[further >> plane & 1 == 1], plane)
            plane += 1

    def _plane(self, keys: np.ndarray, plane: int) -> Iterator[pa.RecordBatch]:
        if not len(keys):
            return
        pair, place = keys >> B_SHIFT, (keys & np.uint64(PLACES - 1)).astype("<u2")
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        count = np.diff(np.append(first, len(pair)))
        width = -(-self.docs // 8)
        few = 2 * count <= width
        yield self._rows(pair[first[few]], plane, False, place[np.repeat(few, count)], 2 * count[few])
        at, size = first[~few], count[~few]
        for k in range(0, len(at), 128):
            some = at[k:k + 128]
            bits = np.zeros((len(some), 8 * width), bool)
            for row, x, n in zip(bits, some.tolist(), size[k:k + 128].tolist(), strict=True):
                row[place[x:x + n]] = True
            yield self._rows(pair[some], plane, True, np.packbits(bits, axis=1, bitorder="little"), np.full(len(bits), width))

    def _rows(self, pair: np.ndarray, plane: int, dense: bool, content: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        n = len(pair)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        bits = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(content))])
        ids = ((pair >> (A_SHIFT - B_SHIFT)).astype(np.int32), (pair & np.uint64((1 << 24) - 1)).astype(np.int32))
        return _batch(n, container=pa.array(np.full(n, self.id)), doc_id=pa.nulls(n, self.doc_kind), a=pa.array(ids[0]), b=pa.array(ids[1]),
                      plane=pa.array(np.full(n, plane, np.int32)), dense=pa.array(np.full(n, dense)), bits=bits)


#: What the pass over the texts writes: rows of documents (with a place) and of postings (with ids); doc_id is as given.
FIELDS = {"container": pa.int64(), "place": pa.int32(), "doc_id": pa.null(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(),
          "groups_sha256": pa.string(), "groups": pa.string(), "a": pa.int32(), "b": pa.int32(), "plane": pa.int32(), "dense": pa.bool_(), "bits": pa.binary()}


def _batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
    """All fields in order; those not given are null."""
    return pa.RecordBatch.from_arrays([columns.get(f, pa.nulls(n, kind)) for f, kind in FIELDS.items()], list(FIELDS))


def _text(raw: bytes) -> str:
    """A text that is no UTF-8 counts as one that B changes."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return "▁"


class _Aligner:
    def __init__(self, a_path: str, b_path: str, groups: bool):
        self.words, self.with_groups = _Words(a_path, b_path), groups

    def part(self, ids: pa.Array, texts: list[bytes], into: _Containers) -> pa.RecordBatch:
        """Rows of some documents; their links go to the container."""
        known = self.words
        if known.held > KNOWN_BYTES:
            known.forget()
        split = [words_of(_text(t)) if t else [] for t in texts]
        known.learn([w for w in {w for words in split for w in words} if w not in known.number])
        found = [[known.number[w] for w in words] for words in split]
        flat = np.array([i for own in found for i in own], np.int64)
        doc = np.repeat(np.arange(len(texts)), [len(own) for own in found])
        sizes = known.sizes[flat]
        good = np.array([len(own) > 0 for own in found])
        good[doc[sizes[:, 3] == 0]] = False
        sums = np.zeros((len(texts), 3), np.int64)
        for c in range(3):
            sums[:, c] = np.where(good, np.bincount(doc, sizes[:, c], len(texts)), 0)
        flat, doc = flat[good[doc]], doc[good[doc]]
        lines = [";".join([known.texts[i] for i in own]) if ok else "" for own, ok in zip(found, good.tolist(), strict=True)]
        place = np.arange(len(texts)) + into.docs
        into.add(len(texts), np.repeat(doc, known.count[flat]), known.links_of(flat))
        return _batch(len(texts), container=pa.array(np.full(len(texts), into.id)), place=pa.array(place.astype(np.int32)), doc_id=ids,
                      n_a=pa.array(sums[:, 0]), n_b=pa.array(sums[:, 1]), n_groups=pa.array(sums[:, 2]),
                      groups_sha256=pa.array([hashlib.sha256(x.encode()).hexdigest() if ok else "" for x, ok in zip(lines, good.tolist(), strict=True)]),
                      groups=pa.array(lines if self.with_groups else [None] * len(texts), pa.string()))


def _parts(texts: list[bytes], room: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about PART_BYTES and at most ``room`` texts."""
    begin = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= PART_BYTES or i + 1 - begin == room:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _written(docs: DataFrame, a_path: str, b_path: str, groups: bool) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, into = None, None
        for batch in batches:
            aligner = aligner or _Aligner(a_path, b_path, groups)
            into = into or _Containers(TaskContext.get().partitionId(), batch.column("doc_id").type)
            texts = texts_of(batch)
            for x, y in _parts(texts, 1000):
                yield aligner.part(batch.column("doc_id").slice(x, y - x), texts[x:y], into)
                if into.docs + 1000 > PLACES or into.links >= LINKS:
                    yield from into.postings()
                    into.open()
        if into is not None and into.docs:
            yield from into.postings()

    schema = (f"container long, place int, doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, groups string, "
              "a int, b int, plane int, dense boolean, bits binary")
    return stored(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema))


def _popcount() -> Column:
    return F.when(F.col("dense"), F.bitmap_count("bits")).otherwise(F.octet_length("bits") / 2).cast("long")


def pair_counts(postings: DataFrame) -> DataFrame:
    """a, b, n_docs, n_links, best: of all linked pairs; ``best`` marks the highest n_links of a B id, ties included."""
    weight = F.when(F.col("plane") < 0, 1).otherwise(F.expr("shiftleft(1L, plane)"))
    pairs = postings.groupBy("a", "b").agg(
        F.sum(F.when(F.col("plane") < 0, _popcount())).alias("n_docs"), F.sum(_popcount() * weight).alias("n_links"))
    pairs = stored(pairs)
    most = pairs.groupBy("b").agg(F.max("n_links").alias("_most"))
    return pairs.join(most, "b").select("a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("_most")).alias("best"))


def _returned(scored: DataFrame) -> DataFrame:
    """container, place, n_best, count_sum: what a container's postings return to its documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros((2, PLACES), np.int64)

        def close() -> pa.RecordBatch:
            place = np.flatnonzero(sums[1])
            out = pa.RecordBatch.from_arrays([pa.array(np.full(len(place), now)), pa.array(place.astype(np.int32)), pa.array(sums[0][place]), pa.array(sums[1][place])],
                                             ["container", "place", "n_best", "count_sum"])
            sums[:] = 0
            return out

        for batch in batches:
            container = batch.column("container").to_numpy()
            cuts = np.flatnonzero(np.append(True, container[1:] != container[:-1])) if len(container) else []
            for x, y in zip(cuts, np.append(cuts[1:], len(container)), strict=True):
                if now is not None and now != container[x]:
                    yield close()
                now = container[x]
                part = batch.slice(x, y - x)
                weight = np.left_shift(1, np.maximum(part.column("plane").to_numpy(), 0).astype(np.int64))
                total = weight * part.column("n_links").to_numpy()
                best = weight * part.column("best").to_numpy(zero_copy_only=False)
                dense = part.column("dense").to_numpy(zero_copy_only=False)
                few = part.column("bits").filter(pa.array(~dense)).to_pylist()
                place, times = np.frombuffer(b"".join(few), "<u2"), [len(x) // 2 for x in few]
                np.add.at(sums[0], place, np.repeat(best[~dense], times))
                np.add.at(sums[1], place, np.repeat(total[~dense], times))
                for k in np.flatnonzero(dense).tolist():
                    bits = np.unpackbits(np.frombuffer(part.column("bits")[k].as_py(), np.uint8), bitorder="little")
                    sums[0, :len(bits)] += bits * best[k]
                    sums[1, :len(bits)] += bits * total[k]
        if now is not None:
            yield close()

    dealt = scored.repartition("container").sortWithinPartitions("container")
    return dealt.mapInArrow(run, "container long, place int, n_best long, count_sum long")


def align(docs: DataFrame, a_path: str, b_path: str, groups: bool = True) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs) of the tokenizers in two files.

    documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked
    for, ``groups`` (``a1,a2|b1;a3|b2,b3``), a row per row of ``docs``, repeated rows too. n_best
    counts links whose pair is its B id's most frequent in the corpus, ties included; count_sum
    adds up the pairs' link counts. Null and empty texts, and texts whose bytes a tokenizer
    changes (a literal U+2581, say), have zeros and '' and link nothing. Strings of special
    tokens are plain text. A null doc_id stays. Very long texts are aligned whole. Other columns
    are ignored; an empty table gives empty ones. pairs: as ``pair_counts``.
    """
    rows = _written(docs, a_path, b_path, groups)
    postings = rows.where("a IS NOT NULL").select("container", "a", "b", "plane", "dense", "bits")
    pairs = stored(pair_counts(postings))
    scored = postings.join(pairs.select("a", "b", "n_links", "best"), ["a", "b"])
    documents = rows.where("place IS NOT NULL").join(_returned(scored), ["container", "place"], "left")
    names = ["doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), *(
        F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")), "groups_sha256"]
    return documents.select(*names, *(["groups"] if groups else [])), pairs
