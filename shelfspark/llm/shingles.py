"""Word hashes and shingle sets of whole texts, vectorised."""

from __future__ import annotations

import numpy as np

PIECE = 1 << 21
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(20240607)
BYTE_VALUES = _rng.integers(0, 2**64, 256, np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * M1
    h = (h ^ (h >> np.uint64(33))) * M2
    return h ^ (h >> np.uint64(33))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each run of non-space bytes, in order."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):  # cut at white space; a longer word is taken whole
            cut = max(text.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut < 0:
                found = [x for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (x := text.find(c, end)) >= 0]
                cut = min(found) if found else len(text) - 1
            end = cut + 1
        out.append(_hash_piece(np.frombuffer(text, np.uint8, end - at, at)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _hash_piece(b: np.ndarray) -> np.ndarray:
    word = ~IS_SPACE[b]
    edge = np.diff(word, prepend=False)
    starts = np.flatnonzero(edge & word)
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.flatnonzero(word)
    begins = edge[at] & word[at]
    first = np.flatnonzero(begins)
    lengths = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    powers = np.full(int(lengths.max()), STEP)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    return mixed(np.add.reduceat(BYTE_VALUES[b[at]] * powers[place], first) + lengths.astype(np.uint64))


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``k`` words; of all words if there are fewer.

    A-Z are lower-cased first. Without words the set is empty.
    """
    words = word_hashes(text.lower())
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    h = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        h = mixed(h * STEP + words[j:n - width + 1 + j])
    return np.unique(h)
