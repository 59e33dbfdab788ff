"""Periodic runs of words, found by catching squares over dyadic blocks.

Every completed block of 2^k words gets a catcher. While words are appended behind it, the
catcher compares the block with the suffix of as many words that ends at the newest one; a
match q words behind the block, 2^k <= q < 2^(k+1), is a square of period q. A fingerprint
of the suffix rolls on by one word, so a comparison is one equality of two numbers, and one
array operation advances all catchers of a level over all words appended to a group of
texts: n comparisons a level, n log n in all. Squares of one period in neighbouring blocks
merge into a run, whose ends are found by halving steps and confirmed on the words.

A run that repeats its period three times holds an aligned block and its copy, so none of
the runs asked for (three repetitions or more) can pass a level unseen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import map_batches, texts_of

FEWEST, TIMES = 6, 4
#: Bytes of texts whose words are appended together. A longer text goes alone.
PART_BYTES = 1 << 20
#: Odd bases of the fingerprints; the next one is tried should words not confirm a run.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class _Fingerprints:
    """Fingerprints (mod 2^64) of all stretches of a sequence of word numbers."""

    def __init__(self, words: np.ndarray, base: int):
        x = words.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(base)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        self.n = len(words)
        self.power = self._powers(base)
        self.back = self._powers(pow(base, -1, 1 << 64))
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(x * self.power[:self.n], out=self.sums[1:])

    def _powers(self, base: int) -> np.ndarray:
        out = np.full(self.n + 1, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def of_length(self, m: int) -> np.ndarray:
        """Of the ``m`` words from each place on: the suffix as it rolls over the words."""
        return (self.sums[m:] - self.sums[:-m]) * self.back[:self.n - m + 1]

    def same(self, at: np.ndarray, period: np.ndarray, m: int) -> np.ndarray:
        """Whether ``m`` words from ``at`` on recur ``period`` words later; False beyond either end."""
        inside = (at >= 0) & (at + period + m <= self.n)
        x, y = np.where(inside, at, 0), np.where(inside, at + period, 0)
        end = np.where(inside, m, 0)
        one, two = self.sums[x + end] - self.sums[x], self.sums[y + end] - self.sums[y]
        return inside & (one * self.power[np.where(inside, period, 0)] == two)


def _squares(marks: _Fingerprints, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the squares that catchers of blocks of ``m`` words report."""
    suffix = marks.of_length(m)
    blocks = (marks.n - m) // m  # those with a whole suffix behind them
    behind = suffix[m:m + blocks * m]
    whole = len(behind) // m
    held = suffix[:blocks * m:m]
    block, place = np.nonzero(behind[:whole * m].reshape(whole, m) == held[:whole, None])
    if whole < blocks:  # the last catcher has not met all its suffixes yet
        rest = np.flatnonzero(behind[whole * m:] == held[whole])
        block, place = np.concatenate([block, np.full(len(rest), whole)]), np.concatenate([place, rest])
    return block * m, place + m


def _merged(marks: _Fingerprints, m: int, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """start, length, period of the runs that squares of one level belong to."""
    order = np.lexsort((start, period))
    start, period = start[order], period[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (period[1:] != period[:-1]) | (start[1:] != start[:-1] + m)
    first = np.flatnonzero(fresh)
    left, q = start[first], period[first]
    right = start[np.append(first[1:], len(start)) - 1] + m  # words from left to right recur q later
    step = m // 2
    while step:
        left = np.where(marks.same(left - step, q, step), left - step, left)
        right = np.where(marks.same(right, q, step), right + step, right)
        step //= 2
    return np.stack([left, right - left + q, q])


def find_runs(words: np.ndarray, fewest: int = FEWEST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) by start, then period: maximal stretches of at least
    ``fewest`` words that repeat their smallest period at least ``times`` times (3 or more)."""
    if times < 3:
        raise ValueError("catchers see every run from three repetitions on")
    words = np.asarray(words, np.int64)
    if len(words) < max(fewest, times):
        return np.zeros((0, 3), np.int64)
    for base in BASES:
        marks = _Fingerprints(words, base)
        found, m = [np.zeros((3, 0), np.int64)], 1
        while m * times <= len(words):
            start, period = _squares(marks, m)
            if len(start):
                runs = _merged(marks, m, start, period)
                found.append(runs[:, runs[1] >= np.maximum(fewest, times * runs[2])])
            m *= 2
        start, length, period = np.concatenate(found, axis=1)
        order = np.lexsort((period, length, start))
        start, length, period = start[order], length[order], period[order]
        # a stretch found with a multiple of its period has the same ends
        own = np.ones(len(start), bool)
        own[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
        rows = np.stack([start[own], length[own], period[own]], axis=1)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
        if all(_confirmed(words, *r) for r in rows.tolist()):
            return rows
    raise ArithmeticError("no base gave fingerprints that hold")


def _confirmed(words: np.ndarray, start: int, length: int, period: int) -> bool:
    end = start + length
    return (np.array_equal(words[start:end - period], words[start + period:end])
            and (start == 0 or words[start - 1] != words[start - 1 + period])
            and (end == len(words) or words[end] != words[end - period]))


def _runs_by_text(texts: list[list[bytes]], fewest: int, times: int) -> Iterator[np.ndarray]:
    """Runs of each text: all are one sequence, with a word of its own between two texts."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(sizes)
    seen = pa.array([w for t in texts for w in t], pa.large_binary()).dictionary_encode()
    words = np.zeros(int(ends[-1]), np.int64)
    inner = np.ones(len(words), bool)
    inner[ends - 1] = False
    words[inner] = seen.indices.to_numpy()
    words[ends - 1] = -1 - np.arange(len(texts))
    rows = find_runs(words, fewest, times)
    cuts = np.searchsorted(rows[:, 0], ends)
    for begin, a, b in zip(ends - sizes, np.append(0, cuts[:-1]), cuts, strict=True):
        rows[a:b, 0] -= begin
        yield rows[a:b]


def _collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """Words that lie in no run behind its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [w for w, covered in zip(words, np.cumsum(edge)[:-1].tolist(), strict=True) if not covered]


def _parts(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about PART_BYTES."""
    begin = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= PART_BYTES:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def periodic_runs(docs: DataFrame, fewest: int = FEWEST, times: int = TIMES, rewrite: Rewrite | None = None, texts: bool = True) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256; with ``texts`` also runs, collapsed.

    One row per row of ``docs``, repeated rows too. Words are ``[^\\x20\\x09-\\x0D]+``, numbered
    from 0; ``rewrite(doc_id, words)`` may change a text's words first. A run is a stretch of
    words with smallest period q (words q apart are identical) and at least ``fewest`` words
    and ``times`` periods that neither neighbour extends. start, length, period and
    exponent_milli are of the longest run (ties: smallest start, then period), null without
    one; ``runs_sha256`` is of the lines ``start,length,period`` of all runs by start, then
    period; ``collapsed`` joins by one space the words that lie in no run behind its first
    period. Null and empty texts have no words: no runs and the digests of an empty string.
    A null doc_id stays. Words are compared as bytes. Very long texts are taken whole, alone.
    Other columns are ignored; an empty table gives an empty one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    schema = f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    types = [pa.int64()] * 5 + [pa.string()] * 2
    if texts:
        names, types = [*names, "runs", "collapsed"], [*types, RUNS, pa.string()]
        schema += ", runs array<struct<start: long, length: long, period: long>>, collapsed string"

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        given, ids = texts_of(batch), batch.column("doc_id").to_pylist()
        cols: list[list] = [[] for _ in types]
        for a, b in _parts(given):
            words = [t.split() for t in given[a:b]]  # bytes split at just the white space of the rule
            if rewrite is not None:
                words = [rewrite(i, w) for i, w in zip(ids[a:b], words, strict=True)]
            for own, runs in zip(words, _runs_by_text(words, fewest, times), strict=True):
                rows = runs.tolist()
                start, length, period = max(rows, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
                kept = b" ".join(_collapsed(own, runs) if rows else own)
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in rows)
                values = [len(rows), start, length, period, 1000 * length // period if rows else None,
                          hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()]
                if texts:
                    values += [[{"start": s, "length": n, "period": q} for s, n, q in rows], kept.decode(errors="replace")]
                for col, v in zip(cols, values, strict=True):
                    col.append(v)
        return pa.RecordBatch.from_arrays([batch.column("doc_id")] + [pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), each, schema)
