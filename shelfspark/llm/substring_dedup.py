"""Removal of repeated byte strings, decided by suffix arrays over the places that may repeat.

Anchors bring equal strings together: in each string of ``length`` bytes, the ``gram`` bytes
of the smallest hash. Equal strings have the same anchor at the same distance. A context is
the stretch of a text around an anchor that all its strings lie in. A batch of texts sends
its different contexts, packed by parts of their keys, and a part answers with the smallest
doc_id of each; where an anchor has several different contexts, their suffixes are sorted, as
far as their strings may meet, and neighbours in the order that share ``length`` bytes are
equal strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.cells import FILTER_BITS, PAGE_BITS, CellFilter, pages, probe
from shelfspark.llm.common import drop_shuffles, in_arrow, lean_batches, texts_of, whole_text
from shelfspark.llm.suffix_groups import ranges, sort_suffixes
from shelfspark.session import stored

LENGTH, GRAM = 50, 24
ANCHOR_BITS = 1 << 28  # 32 MB in a worker
#: Contexts of one anchor that are sorted together; an anchor with more is dealt over several
#: blocks and the smallest doc_ids of its strings are put together by their hashes.
BLOCK = 256
HELD_BYTES, SORT_BYTES = 2_500_000, 1_000_000  # of contexts that a task compares, of their pieces that it sorts at a time
PIECE, JOINED = 1 << 21, 1 << 17
PARTS, PACKED = 1024, 1 << 20  # parts of the cells of a filter; hashes that a task sends at a time
RUNS, RUNS_SQL = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), "array<struct<a: int, b: int>>"
MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _slide(x: np.ndarray, width: int, least) -> np.ndarray:
    """The least (or most) of each window, by doubling."""
    step = 1
    while step * 2 <= width:
        x, step = least(x[:-step], x[step:]), step * 2
    rest = width - step
    return least(x[:len(x) - rest], x[rest:]) if rest else x


def _words(text: bytes) -> np.ndarray:
    """The eight bytes from each place on."""
    n = max(0, len(text) - 7)
    return np.ndarray((n,), "<u8", text, 0, (1,)).copy() if n else np.empty(0, np.uint64)


def _gram_hashes(text: bytes) -> np.ndarray:
    words = _words(text)
    n = max(0, len(text) - GRAM + 1)
    h = words[:n] * MULTIPLIERS[0]
    for j in (1, 2):
        h ^= h >> np.uint64(29)
        h += words[8 * j:n + 8 * j]
        h *= MULTIPLIERS[j]
    h ^= h >> np.uint64(32)
    return h


def _stretch_keys(grams: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: int) -> np.ndarray:
    """A hash of the bytes between each ``lo`` and ``hi`` (GRAM to ``most`` apart), of the grams that cover them."""
    key = (hi - lo).astype(np.uint64)
    for j, step in enumerate(range(0, most, GRAM)):
        key ^= key >> np.uint64(29)
        key += grams[np.minimum(lo + step, hi - GRAM)]
        key *= MULTIPLIERS[j % 3]
    return key ^ (key >> np.uint64(32))


class Anchors(NamedTuple):
    """The anchors of joined texts: their hashes, their texts' numbers, and where their contexts start and end."""

    text: bytes
    grams: np.ndarray  # the hash of the gram at each place
    hashes: np.ndarray
    number: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    at: np.ndarray  # the gram's place
    shift: np.ndarray  # what added to a place gives that in the anchor's own text

    def where(self, keep: np.ndarray) -> Anchors:
        return self._replace(**{c: getattr(self, c)[keep] for c in ("hashes", "number", "lo", "hi", "at", "shift")})

    def keys(self, length: int) -> np.ndarray:
        return _stretch_keys(self.grams, self.lo, self.hi, 2 * length - GRAM)


def _stretches(texts: list[bytes], length: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(text's number, start, first and last own place, bytes): long texts come in pieces that hold the contexts of their own places."""
    for i, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, PIECE):
            ends = at + PIECE > len(text) - length
            start = max(0, at - length + GRAM)  # earlier strings decide about the first grams too
            yield i, start, at, len(text) if ends else at + PIECE, text[start:None if ends else at + PIECE + length]
            if ends:
                break


def _joined_anchors(held: list[tuple[int, int, int, int, bytes]], length: int) -> Anchors:
    number, start, first, last = np.array([x[:4] for x in held], np.int64).T
    text, sizes = b"".join(x[4] for x in held), np.array([len(x[4]) for x in held])
    ends = np.cumsum(sizes)
    span, shift = length - GRAM + 1, start - (ends - sizes)
    h = _gram_hashes(text)
    least = _slide(h, span, np.minimum)
    least[(ends[:-1, None] - np.arange(1, length)).ravel()] = 0  # no string goes from one text into the next
    edge = np.zeros(span - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), span, np.maximum) == h)
    own = np.searchsorted(ends, at, side="right")
    place = at + shift[own]
    keep = (at + GRAM <= ends[own]) & (place >= first[own]) & (place < last[own])
    at, own = at[keep], own[keep]
    return Anchors(text, h, h[at], number[own], np.maximum(at - span + 1, (ends - sizes)[own]), np.minimum(at + length, ends[own]), at, shift[own])


def batch_anchors(texts: list[bytes], length: int = LENGTH) -> Iterator[Anchors]:
    """The anchors of all strings of ``length`` bytes of each text, of many texts at a time."""
    held, size = [], 0
    for x in _stretches(texts, length):
        held.append(x)
        size += len(x[4])
        if size >= JOINED:
            yield _joined_anchors(held, length)
            held, size = [], 0
    if held:
        yield _joined_anchors(held, length)


def anchors(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all strings of ``length`` bytes of a text, in order."""
    found = list(batch_anchors([text], length))
    return (np.concatenate([x.at + x.shift for x in found]), np.concatenate([x.hashes for x in found])) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _text_key(text: bytes) -> int:
    """What the engine's xxhash64 gives for a text."""
    return _signed(xxhash.xxh64_intdigest(text, 42))


def _linked(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` owners of keys, the smallest that it is linked with by equal keys, over others too."""
    _, group = np.unique(keys, return_inverse=True)
    label = np.arange(n)
    while True:
        least = np.full(len(keys), n)
        np.minimum.at(least, group, label[owner])
        new = label.copy()
        np.minimum.at(new, owner, least[group])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _least(body: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray, block: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string of each context, one after another, the smallest doc_id of the context's block holding it, and a hash of the string.

    Of a context only the stretches of strings whose hashes its block has again are looked at,
    and equal stretches are one; the suffixes of different stretches that such strings link
    are then sorted.
    """
    grams = _gram_hashes(body.tobytes())
    n = sizes - length + 1
    at, owner = ranges(starts, n), np.repeat(np.arange(len(n)), n)
    keys = _stretch_keys(grams, at, at + length, length)
    least = first[owner]
    seed = block.astype(np.uint64) * MULTIPLIERS[0]
    own = keys + seed[owner]
    order = np.argsort(own)
    again = np.flatnonzero(own[order[1:]] == own[order[:-1]])
    shared = np.zeros(len(own), bool)
    shared[order[again]] = True
    shared[order[again + 1]] = True
    marked = np.flatnonzero(shared)
    if not len(marked):
        return least, keys
    edge = np.flatnonzero((np.diff(marked, prepend=-2) != 1) | (np.diff(owner[marked], prepend=-1) != 0))
    begin, end = marked[edge], marked[np.append(edge[1:], len(marked)) - 1] + 1  # in strings
    ctx, lo, hi = owner[begin], at[begin], at[end - 1] + length
    # equal stretches of a block
    longest = int((hi - lo).max())
    _, rep, piece = np.unique(_stretch_keys(grams, lo, hi, longest) + seed[ctx], return_index=True, return_inverse=True)
    twin, size = rep[piece], hi - lo
    alike = (size == size[twin]) & (block[ctx] == block[ctx[twin]])
    both = np.flatnonzero(alike)
    differs = body[ranges(lo[both], size[both])] != body[ranges(lo[twin[both]], size[both])]
    alike[np.repeat(both, size[both])[differs]] = False
    odd = np.flatnonzero(~alike)  # of equal hash only
    piece[odd] = len(rep) + np.arange(len(odd))
    rep = np.append(rep, odd)
    smallest = np.full(len(rep), np.iinfo(np.int64).max)
    np.minimum.at(smallest, piece, first[ctx])
    found = np.repeat(smallest, size[rep] - length + 1)  # of the strings of each different stretch
    place = np.append(0, np.cumsum(size[rep] - length + 1))
    of = _linked(own[ranges(begin[rep], (end - begin)[rep])], np.repeat(np.arange(len(rep)), (end - begin)[rep]), len(rep))
    by = np.argsort(of, kind="stable")
    cut = np.append(np.flatnonzero(np.diff(of[by], prepend=-1)), len(by))
    held, weight = [], 0
    several = sorted((by[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True) if b > a + 1), key=lambda x: -int(size[rep[x]].sum()))
    for i, pieces in enumerate(several):  # those of like size together, as a batch takes as many steps as its largest
        held.append(pieces)
        weight += int(size[rep[pieces]].sum())
        if weight >= SORT_BYTES or i == len(several) - 1:
            blocks = [[(body[lo[rep[p]]:hi[rep[p]]].tobytes(), int(smallest[p])) for p in x.tolist()] for x in held]
            for x, own in zip(held, _sort_blocks(blocks, length), strict=True):
                for p, v in zip(x.tolist(), own, strict=True):
                    found[place[p]:place[p + 1]] = v
            held, weight = [], 0
    least[ranges(begin, end - begin)] = found[ranges(place[piece], end - begin)]
    return least, keys


def _least_ids(blocks: list[list[tuple[bytes, int]]], hashes: list[int], length: int) -> list[np.ndarray]:
    """``_least`` of contexts in lists, by context; ``hashes``: their anchors."""
    contexts, first = [c for b in blocks for c, _ in b], np.array([d for b in blocks for _, d in b], np.int64)
    sizes, block = np.array([len(c) for c in contexts]), np.repeat(np.arange(len(blocks)), [len(b) for b in blocks])
    least, _ = _least(np.frombuffer(b"".join(contexts), np.uint8), np.cumsum(sizes) - sizes, sizes, first, block, length)
    return np.split(least, np.cumsum(sizes - length + 1)[:-1])


def _sort_blocks(blocks: list[list[tuple[bytes, int]]], length: int) -> list[list[np.ndarray]]:
    """For each context of each block, the smallest doc_id holding each of its strings, by their order."""
    parts, bounds, at = [], [0], 0
    for block in blocks:
        body = b"\x00".join(c for c, _ in block)
        # bytes become 2 to 257, a context ends in 1, a block in 0
        symbols = np.frombuffer(body, np.uint8).astype(np.int16) + np.int16(2)
        ends = np.cumsum([len(c) + 1 for c, _ in block])
        symbols = np.append(symbols, np.int16(0))
        symbols[ends[:-1] - 1] = 1
        parts.append(symbols)
        at += len(symbols)
        bounds.append(at)
    symbols, bounds = np.concatenate(parts), np.array(bounds)
    contexts = [c for block in blocks for c in block]
    sizes = np.array([len(c) for c, _ in contexts])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    owner = np.repeat(np.arange(len(contexts), dtype=np.int32), sizes + 1)
    order = sort_suffixes(symbols, bounds)
    ctx = owner[order]
    whole = order - starts[ctx] <= sizes[ctx] - length  # a string starts there and ends in its context
    order, ctx = order[whole], ctx[whole]
    block = np.repeat(np.arange(len(blocks), dtype=np.int32), np.diff(bounds))[order]
    words = _words(np.maximum(symbols - 2, 0).astype(np.uint8).tobytes())
    same = block[1:] == block[:-1]
    for at in (*range(0, length - 8, 8), length - 8):  # eight bytes at a time
        left = np.flatnonzero(same)
        own = words[order + at]
        same[left] = own[1:][left] == own[:-1][left]
    same = np.concatenate([[False], same])
    first = np.array([d for _, d in contexts], np.int64)[ctx]
    runs = np.flatnonzero(~same)
    least = np.empty(len(symbols), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(first, runs), np.diff(np.append(runs, len(order))))
    flat = [least[s:s + n - length + 1] for s, n in zip(starts, sizes, strict=True)]
    out, i = [], 0
    for b in blocks:
        out.append(flat[i:i + len(b)])
        i += len(b)
    return out


def _runs(covered: np.ndarray, owner: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, pa.Array]:
    """Who has marked strings, and the stretches of bytes of these; ``place``: of a string among those of its owner, in order."""
    at = np.flatnonzero(covered)
    own, i = owner[at], place[at]
    fresh = np.append(True, (own[1:] != own[:-1]) | (i[1:] != i[:-1] + 1))[:len(at)]
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], len(at))[:len(begin)] - 1
    whose = own[begin]
    first = np.flatnonzero(np.diff(whose, prepend=-1))
    stretches = pa.StructArray.from_arrays([pa.array(i[begin], pa.int32()), pa.array(i[end] + length, pa.int32())], ["a", "b"])
    return whose[first], pa.ListArray.from_arrays(pa.array(np.append(first, len(whose)), pa.int32()), stretches)


def _blobs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The values, or rows of values, between neighbouring bounds, as a binary each."""
    size = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a column of binaries, and where each starts in them and how many it has."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    body = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0]:bounds[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return body, bounds[:-1] - bounds[0], np.diff(bounds)


def repeated_cells(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> CellFilter:
    """A filter of the hashes that occur more than once among all that the batches give.

    A task sends its different hashes packed, a row for each part of the cells and PACKED
    hashes, with those it has several times marked; each part is then sorted by itself and
    has whole pages of the filter.
    """
    shift = max(PAGE_BITS, bits // PARTS).bit_length() - 1
    cells = np.uint64(bits - 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held: list[np.ndarray]) -> pa.RecordBatch:
            h = np.sort(np.concatenate(held))
            fresh = np.append(True, h[1:] != h[:-1])[:len(h)]
            many = np.append(~fresh[1:], False)[fresh]
            h = h[fresh]
            part = ((h & cells) >> np.uint64(shift)).astype(np.uint16)
            order = np.argsort(part, kind="stable")
            h, many, part = h[order], many[order], part[order]
            at = np.flatnonzero(np.diff(part.astype(np.int32), prepend=-1))
            bounds = np.append(at, len(h))
            return pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), _blobs(h, bounds), _blobs(many, bounds)], ["part", "hashes", "many"])

        held, size = [], 0
        for batch in batches:
            for h in hashes(batch) if batch.num_rows else ():
                held.append(h)
                size += len(h)
                if size >= PACKED:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, hashes, many in _grouped(batches):
            h, twice = _table(hashes, np.uint64), _table(many, bool)
            every = np.sort(h)
            again = np.concatenate([h[twice], every[1:][every[1:] == every[:-1]]])
            marked = np.zeros(1 << shift, bool)
            marked[(again & cells & np.uint64((1 << shift) - 1)).astype(np.int64)] = True
            marked = marked.reshape(-1, min(PAGE_BITS, 1 << shift))
            own = np.flatnonzero(marked.any(axis=1))
            packed = np.packbits(marked[own], axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays([pa.array(own + part[0] * len(marked)), pa.array([x.tobytes() for x in packed], pa.binary())], ["page", "bitmap"])

    packed = in_arrow(rows, pack, "part int, hashes binary, many binary").repartition("part").sortWithinPartitions("part")
    return CellFilter(in_arrow(packed, bitmaps, "page long, bitmap binary"), bits)


def _merged(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The texts that have spans, and these: what overlaps or touches as one."""
    order = np.lexsort((a, text))
    text, a, b = text[order], a[order], b[order]
    fresh = np.diff(text, prepend=-1) != 0
    reach = (np.cumsum(fresh) << 40) + b
    reach = np.maximum.accumulate(reach) - (np.cumsum(fresh) << 40)
    first = np.flatnonzero(fresh | np.append(True, a[1:] > reach[:-1])[:len(a)])
    spans = pa.StructArray.from_arrays([pa.array(a[first]), pa.array(reach[np.append(first[1:], len(a))[:len(first)] - 1])], ["a", "b"])
    at = np.flatnonzero(fresh[first])
    return text[first[at]], pa.ListArray.from_arrays(pa.array(np.append(at, len(first)), pa.int32()), spans)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of equal first column, which stand together, as columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if held and row[0] != held[0][0]:
                yield list(zip(*held, strict=True))
                held = []
            held.append(row)
    if held:
        yield list(zip(*held, strict=True))


def _table(blobs: tuple[bytes | None, ...], kind: type, width: int = 1) -> np.ndarray:
    """Rows of ``width`` numbers that were packed as binaries."""
    found = np.frombuffer(b"".join(x for x in blobs if x is not None), kind)
    return found.reshape(-1, width) if width > 1 else found


def _parts_of(ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of keys in order: the parts that occur, and the bounds of each."""
    part = (ctx >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int64)
    at = np.flatnonzero(np.diff(part, prepend=-1))
    return part[at], np.append(at, len(part))


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor_bits: int = ANCHOR_BITS, block: int = BLOCK) -> DataFrame:
    """doc_id, text_key, spans: the stretches of bytes whose strings also start in a smaller doc_id, of the texts that have any."""
    def once(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for found in batch_anchors(texts_of(batch), length):
            # what a text has twice side by side in this order counts once
            order = np.argsort(found.hashes)
            h, number = found.hashes[order], found.number[order]
            yield h[np.append(True, (h[1:] != h[:-1]) | (number[1:] != number[:-1]))[:len(h)]]

    repeated = repeated_cells(docs.select("text"), once, anchor_bits)

    def occur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for count, batch in enumerate(batches):
            texts, cols = texts_of(batch), [[] for _ in range(5)]
            for found in batch_anchors(texts, length):
                found = found.where(repeated.has(found.hashes))
                for x, v in zip(cols, (found.hashes, found.keys(length), found.number, found.lo + found.shift, found.hi - found.lo), strict=True):
                    x.append(v)
            if not sum(map(len, cols[0])):
                continue
            h, ctx, number, lo, n = map(np.concatenate, cols)
            ids, keys = batch.column("doc_id").to_numpy(), np.array([_text_key(t) for t in texts], np.int64)
            order = np.lexsort((h, ctx))
            h, ctx, number, lo, n = (x[order] for x in (h, ctx, number, lo, n))
            fresh = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])))
            own = [h[fresh].view(np.int64), ctx[fresh].view(np.int64), *(f.reduceat(ids[number], fresh) for f in (np.minimum, np.maximum))]
            part, bounds = _parts_of(ctx[fresh])
            places = np.stack([number, lo, n], axis=1).astype(np.int32)
            counts = np.diff(np.append(fresh, len(h))).astype(np.int32)
            load, empty = (TaskContext.get().partitionId() << 32) + count, pa.nulls(len(part), pa.binary())
            whole = [pa.array([x.tobytes()], pa.binary()) for x in (np.stack([ids, keys], axis=1), places, counts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(part) + 1, load))] +
                [pa.concat_arrays([pa.nulls(1, x.type), x]) for x in (pa.array(part.astype(np.int32)), pa.array(bounds[:-1].astype(np.int32)), _blobs(np.stack(own, axis=1), bounds))] +
                [pa.concat_arrays([x, empty]) for x in whole], ["load", "part", "base", "own", "ids", "places", "counts"])

    # a load is what a batch of texts holds: its different contexts, dealt to parts by their keys, and for itself its places in their order
    loads = stored(in_arrow(docs, occur, "load long, part int, base int, own binary, ids binary, places binary, counts binary"))
    dealt_loads = loads.where("part IS NOT NULL").select("part", "load", "base", "own")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in _grouped(batches):
            h, ctx, first, _ = _table(own, np.int64, 4).T
            order = np.lexsort((ctx, h))
            h, ctx, first = h[order], ctx[order], first[order]
            fresh = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])))
            found = np.stack([h[fresh], ctx[fresh], np.minimum.reduceat(first, fresh)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], ["own"])

    contexts = stored(in_arrow(dealt_loads.select("part", "own").repartition("part").sortWithinPartitions("part"), settle, "own binary"))

    def hashes_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield _table(batch.column("own").to_pylist(), np.int64, 3)[:, 0].view(np.uint64)

    mixed = repeated_cells(contexts, hashes_of, anchor_bits)  # anchors of several contexts

    def of_mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in batch.column("own").to_pylist():
                found = _table((own,), np.int64, 3)
                found = found[mixed.has(found[:, 0].view(np.uint64))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.ascontiguousarray(found.T)], ["h", "ctx", "first"])

    crowd = stored(in_arrow(contexts, of_mixed, "h long, ctx long, first long"))
    several = crowd.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1")

    def texts(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        doc_id, cols = batch.column("doc_id").to_numpy(), [[] for _ in range(5)]
        for found in batch_anchors(texts_of(batch), length):
            found = found.where(mixed.has(found.hashes))
            size = found.hi - found.lo
            body = np.frombuffer(found.text, np.uint8)[ranges(found.lo, size)]
            for x, v in zip(cols, (found.hashes, found.keys(length), doc_id[found.number], size, body), strict=True):
                x.append(v)
        if not cols[0]:
            return None
        h, ctx, own, size, body = map(np.concatenate, cols)
        order = np.lexsort((own, ctx, h))
        order = order[np.append(True, (np.diff(h[order]) != 0) | (np.diff(ctx[order]) != 0))[:len(h)]]
        body, size = body[ranges((np.cumsum(size) - size)[order], size[order])], size[order]
        return pa.RecordBatch.from_arrays(
            [pa.array(h[order].view(np.int64)), pa.array(ctx[order].view(np.int64)), pa.array(own[order]), _blobs(body, np.append(0, np.cumsum(size)))], ["h", "ctx", "doc_id", "context"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def starts(t: pa.Table | pa.RecordBatch, *names: str) -> np.ndarray:
            cols = [t.column(c).to_numpy() for c in names]
            return np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in cols], axis=0)))

        def made(t: pa.RecordBatch) -> pa.RecordBatch:
            t = t.take(pa.array(starts(t, "h", "part", "ctx")))  # a context comes from several texts of its first id
            edge = starts(t, "h", "part")
            number = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(t))))
            h, ctx, first, split = (*(t.column(c).to_numpy() for c in ("h", "ctx", "first")), t.column("m").to_numpy() > block)
            body, start, size = _bytes_of(t.column("context"))
            least, keys = _least(body, start, size, first, number, length)
            n = size - length + 1
            owner, string = np.repeat(np.arange(len(n)), n), ranges(np.zeros(len(n), np.int64), n)
            plain = ~split[owner]
            whose, runs = _runs(plain & (least < first[owner]), owner, string, length)
            parts = np.flatnonzero(split)
            bounds = np.append(0, np.cumsum(n[parts]))
            rows = np.append(whose, parts)
            return pa.RecordBatch.from_arrays(
                [pa.array(x[rows]) for x in (h, ctx, first)] +
                [pa.concat_arrays([runs.cast(RUNS), pa.nulls(len(parts), RUNS)])] +
                [pa.concat_arrays([pa.nulls(len(whose), pa.binary()), _blobs(x[~plain], bounds)]) for x in (least, keys)],
                ["h", "ctx", "first", "runs", "least", "keys"])

        CellFilter.forget()
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size > HELD_BYTES:
                t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                last = starts(t, "h", "part")[-1]
                if last:
                    yield made(t.slice(0, last))
                held = [t.slice(last)]
                size = held[0].nbytes
        if held:
            yield made(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    crowds = crowd.join(several, "h").select("h", "ctx", "first", "m")
    own = lean_batches(docs.select("doc_id", "text"), texts, "h long, ctx long, doc_id long, context binary")
    dealt = own.join(crowds, ["h", "ctx"]).where("doc_id = first").withColumn("part", F.pmod("ctx", F.ceil(F.col("m") / block)).cast("long"))
    sorted_blocks = stored(in_arrow(dealt.select("h", "part", "m", "ctx", "context", "first").repartition("h", "part").sortWithinPartitions(F.desc("m"), "h", "part", "ctx"), sort,
                                    f"h long, ctx long, first long, runs {RUNS_SQL}, least binary, keys binary"))

    # anchors of several blocks: the smallest of what the blocks found for equal strings
    def strings(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        body, _, size = _bytes_of(batch.column("keys"))
        n = size // 8
        owner = np.repeat(np.arange(len(n)), n)
        return np.frombuffer(body.tobytes(), np.uint64), owner, ranges(np.zeros(len(n), np.int64), n)

    def own_strings(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        keys, owner, _ = strings(batch)
        yield mixed_keys(keys, batch, owner)

    def mixed_keys(keys: np.ndarray, batch: pa.RecordBatch, owner: np.ndarray) -> np.ndarray:
        return (keys ^ (keys >> np.uint64(31))) * MULTIPLIERS[1] + batch.column("h").to_numpy().view(np.uint64)[owner]

    def unpack(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, owner, string = strings(batch)
        least = np.frombuffer(_bytes_of(batch.column("least"))[0].tobytes(), np.int64)
        keep = np.flatnonzero(met.has(mixed_keys(keys, batch, owner)))
        return pa.RecordBatch.from_arrays(
            [pa.array(batch.column(c).to_numpy()[owner[keep]]) for c in ("h", "ctx", "first")] +
            [pa.array(string[keep].astype(np.int32)), pa.array(keys[keep].view(np.int64)), pa.array(least[keep])], ["h", "ctx", "first", "i", "k", "least"])

    def joined_runs(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(x) for x in batch.column("at").to_pylist()]
        n = np.array([len(x) for x in found])
        _, runs = _runs(np.ones(n.sum(), bool), np.repeat(np.arange(len(n)), n), np.concatenate(found), length)
        return pa.RecordBatch.from_arrays([batch.column("h"), batch.column("ctx"), runs.cast(RUNS)], ["h", "ctx", "runs"])

    crowded = sorted_blocks.where("keys IS NOT NULL").select("h", "ctx", "first", "least", "keys")
    met = repeated_cells(crowded.select("h", "keys"), own_strings, anchor_bits)
    split = stored(lean_batches(crowded, unpack, "h long, ctx long, first long, i int, k long, least long"))
    joined = split.drop("least").join(stored(split.groupBy("h", "k").agg(F.min("least").alias("least"))), ["h", "k"])
    over = stored(lean_batches(  # kept for itself, so that its shuffles are gone when all places are joined
        joined.where("least < first").groupBy("h", "ctx").agg(F.collect_list("i").alias("at")), joined_runs, f"h long, ctx long, runs {RUNS_SQL}"))
    runs = sorted_blocks.where("keys IS NULL").select("h", "ctx", "runs").unionByName(over)

    def pack_runs(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, ctx = (batch.column(c).to_numpy() for c in ("h", "ctx"))
        n = batch.column("runs").value_lengths().to_numpy().astype(np.int64)
        a, b = (x.to_numpy() for x in batch.column("runs").flatten().flatten())
        order = np.argsort(ctx.view(np.uint64))
        at = ranges((np.cumsum(n) - n)[order], n[order])
        spans, n = np.stack([a[at], b[at]], axis=1).astype(np.int32), n[order]
        part, bounds = _parts_of(ctx[order].view(np.uint64))
        return pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), _blobs(np.stack([h[order], ctx[order], n], axis=1), bounds), _blobs(spans, np.append(0, np.cumsum(n))[bounds])], ["part", "changed", "spans"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a load needs to know of its contexts: the first id and the runs of those that lose bytes anywhere."""
        for _, load, base, own, changed, spans in _grouped(batches):
            sent = [(*x,) for x in zip(load, base, own, strict=True) if x[2] is not None]
            if not sent:
                continue
            loads, base, own = zip(*sent, strict=True)
            size = np.array([len(x) // 32 for x in own])
            own, changed, spans = _table(own, np.int64, 4), _table(changed, np.int64, 3), _table(spans, np.int32, 2)
            keys = np.concatenate([own[:, :2], changed[:, :2]])
            order = np.lexsort((keys[:, 1], keys[:, 0]))
            fresh = np.append(True, np.any(keys[order[1:]] != keys[order[:-1]], axis=1))
            group = np.empty(len(keys), np.int64)
            group[order] = np.cumsum(fresh) - 1
            first = np.full(fresh.sum(), np.iinfo(np.int64).max)
            np.minimum.at(first, group[:len(own)], own[:, 2])
            n, begin = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
            n[group[len(own):]] = changed[:, 2]
            begin[group[len(own):]] = np.cumsum(changed[:, 2]) - changed[:, 2]
            group = group[:len(own)]
            kept = np.flatnonzero((first[group] < own[:, 3]) | (n[group] > 0))
            at = np.cumsum(size) - size
            row = np.repeat(np.arange(len(size)), size)
            bounds = np.searchsorted(kept, np.append(at, len(own)))
            group, e = group[kept], (kept - at[row[kept]] + np.array(base)[row[kept]]).astype(np.int32)
            found = np.stack([e, n[group]], axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(loads, pa.int64()), _blobs(found, bounds), _blobs(first[group], bounds), _blobs(spans[ranges(begin[group], n[group])], np.append(0, np.cumsum(n[group]))[bounds])],
                ["load", "known", "first", "spans"])

    def lose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, text_key, spans of the texts of a load.

        Later ids lose a whole context; its first loses the strings that other contexts hold
        for a smaller id.
        """
        for _, known, firsts, spans, ids, places, counts in _grouped(batches):
            known, firsts, spans, ids = _table(known, np.int32, 2), _table(firsts, np.int64), _table(spans, np.int32, 2), _table(ids, np.int64, 2)
            places, counts = _table(places, np.int32, 3).astype(np.int64), _table(counts, np.int32)
            first, n, begin = np.full(len(counts), np.iinfo(np.int64).max), np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
            first[known[:, 0]], n[known[:, 0]], begin[known[:, 0]] = firsts, known[:, 1], np.cumsum(known[:, 1]) - known[:, 1]
            context = np.repeat(np.arange(len(counts)), counts)
            text, lo, size = places.T
            whole = first[context] < ids[text, 0]
            rest = np.flatnonzero(~whole & (n[context] > 0))
            some, own = np.repeat(rest, n[context[rest]]), spans[ranges(begin[context[rest]], n[context[rest]])]
            text, lists = _merged(np.append(text[whole], text[some]), np.append(lo[whole], lo[some] + own[:, 0]), np.append((lo + size)[whole], lo[some] + own[:, 1]))
            if len(text):
                yield pa.RecordBatch.from_arrays([pa.array(ids[text, 0]), pa.array(ids[text, 1]), lists], ["doc_id", "text_key", "spans"])

    def both(left: DataFrame, right: DataFrame, by: str, names: list[str]) -> DataFrame:
        rows = left.unionByName(right, allowMissingColumns=True).select(by, *names)
        return rows.repartition(by).sortWithinPartitions(by)

    packed = lean_batches(runs, pack_runs, "part int, changed binary, spans binary")
    answers = stored(in_arrow(both(dealt_loads, packed, "part", ["load", "base", "own", "changed", "spans"]), answer, "load long, known binary, first binary, spans binary"))
    placed = loads.where("part IS NULL").select("load", "ids", "places", "counts")
    return in_arrow(both(answers, placed, "load", ["known", "first", "spans", "ids", "places", "counts"]), lose,
                    "doc_id long, text_key long, spans array<struct<a: long, b: long>>")


def dedup_substrings(docs: DataFrame, length: int = LENGTH, anchor_bits: int = ANCHOR_BITS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256: one row per row of ``docs``.

    Each byte goes that lies in a string of ``length`` bytes which also starts in a document
    of a smaller doc_id, judged on the texts as given; ``n_spans`` counts the maximal removed
    runs and ``kept`` is what is left (bytes: a run may cut a character). Null and empty
    texts have no bytes. Rows that repeat a doc_id don't count against each other; rows of
    null doc_id neither lose bytes nor count. Only documents that lose bytes are shuffled.
    Other columns are ignored. ``length`` is 31 at least.
    """
    drop_shuffles(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    keyed = rows.withColumn("text_key", F.xxhash64("text"))
    spans = repeated_spans(rows.where("doc_id IS NOT NULL"), length, anchor_bits, block)
    by_text = stored(spans.groupBy("doc_id", "text_key").agg(F.first("spans").alias("spans")))  # the same for all copies of a row
    cell = F.col("text_key").bitwiseAND(F.lit(FILTER_BITS - 1))
    marked = probe(keyed.withColumn("cell", cell), stored(pages(cell, by_text)), "cell", "hit").drop("cell")
    plain = marked.where("NOT hit").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.col("text").cast("binary").alias("kept"), F.sha2("text", 256).alias("kept_sha256"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(5)]
        for text, own in zip(texts_of(batch), batch.column("spans").to_pylist(), strict=True):
            spans = [(s["a"], s["b"]) for s in own or ()]
            ends = [0, *(x for s in spans for x in s), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
            for c, v in zip(cols, (len(text), len(text) - len(kept), len(spans), kept, hashlib.sha256(kept).hexdigest()), strict=True):
                c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                                          ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    touched = marked.where("hit").join(by_text, ["doc_id", "text_key"], "left").select("doc_id", "text", "spans")
    return plain.unionByName(lean_batches(touched, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"))
