"""Suffix sorting by Lyndon-prefix groups, for many small texts at once.

Each text is sorted in linear time in two phases. First its suffixes, grouped by their
first symbol, are refined group by group in descending order: every suffix of the group in
hand points to the nearest suffix before it that lies in a lower group (its previous
smaller one), and the suffixes pointed to move, by how often they are, to new groups right
above their old ones. At the end a group holds the suffixes of one Lyndon prefix. Then the
order is emitted: going through it from the smallest suffix on, the suffix before each and
those its pointers lead to take the next places of their groups. Nothing is renamed and
sorted again. The texts don't depend on each other, so one step of all of them is done
together with array operations.
"""

from __future__ import annotations

import numpy as np


#: Places in a batch of texts, which is far below 2^31 symbols.
PLACE = np.int32


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, … of each range, one after another."""
    ends = np.cumsum(sizes, dtype=starts.dtype)
    return np.arange(ends[-1] if len(ends) else 0, dtype=starts.dtype) + np.repeat(starts - (ends - sizes), sizes)


def _first_groups(symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in order of (text, symbol), and where each position's group starts in it."""
    values = int(symbols.max()) + 1
    key = owner.astype(PLACE if (int(owner[-1]) + 1) * values < 1 << 31 else np.int64) * values + symbols
    order = np.argsort(key, kind="stable").astype(PLACE)
    fresh = np.flatnonzero(np.diff(key[order], prepend=-1)).astype(PLACE)
    start = np.zeros(len(key), PLACE)
    start[order] = np.repeat(fresh, np.diff(np.append(fresh, len(key))))
    return order, start


def sort_suffixes(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The suffix array of each text, as places in ``symbols``.

    Text t is ``symbols[bounds[t]:bounds[t + 1]]`` and ends in a symbol smaller than all its
    others. The result has the same bounds.
    """
    n, texts = len(symbols), len(bounds) - 1
    base, limit = bounds[:-1].astype(PLACE), bounds[1:].astype(PLACE)
    owner = np.repeat(np.arange(texts, dtype=PLACE), limit - base)
    order, start = _first_groups(symbols, owner)
    place = np.empty(n, PLACE)
    place[order] = np.arange(n, dtype=PLACE)
    ends = np.zeros(n + 1, PLACE)  # where a group starts and ends, by its other bound
    begins = np.zeros(n + 1, PLACE)
    first = np.unique(start)
    ends[first] = np.append(first[1:], PLACE(n))
    begins[ends[first]] = first
    pointer = np.arange(-1, n - 1, dtype=PLACE)
    pointer[base] = -1
    done = np.zeros(n, bool)
    moved_mark = np.zeros(n, bool)
    top = limit.copy()
    active = np.flatnonzero(top > base)
    while len(active):
        low = begins[top[active]]
        group = order[ranges(low, top[active] - low)]
        done[group] = True
        before = pointer[group]
        while True:
            skip = np.flatnonzero(before >= 0)
            skip = skip[done[before[skip]]]
            if not len(skip):
                break
            before[skip] = pointer[before[skip]]
        pointer[group] = before
        top[active] = low
        active = active[low > base[active]]
        hit = before[before >= 0]
        if not len(hit):
            continue
        moved, times = np.unique(hit, return_counts=True)
        by = np.lexsort((times, start[moved]))
        moved, times = moved[by], times[by]
        old = start[moved]
        new_group = np.flatnonzero(np.diff(old, prepend=-1))
        counts = np.diff(np.append(new_group, len(old))).astype(PLACE)
        last = ends[old[new_group]]
        target = ranges(last - counts, counts)  # the top places of each old group, fewest pointers first
        # who stands there and stays gives way to the places the moved ones leave
        moved_mark[moved] = True
        there = order[target]
        stays = there[~moved_mark[there]]
        leaves = place[moved][place[moved] < np.repeat(last - counts, counts)]
        order[leaves] = stays
        place[stays] = leaves
        order[target] = moved
        place[moved] = target
        moved_mark[moved] = False
        run = np.flatnonzero((np.diff(old, prepend=-1) != 0) | (np.diff(times, prepend=-1) != 0))
        run_start = target[run]
        run_size = np.diff(np.append(run, len(old))).astype(PLACE)
        start[moved] = np.repeat(run_start, run_size)
        rest = (last - counts) > old[new_group]
        kept = old[new_group][rest]
        ends[kept] = (last - counts)[rest]
        begins[ends[kept]] = kept
        ends[run_start] = run_start + run_size
        begins[run_start + run_size] = run_start
    out = np.full(n, -1, PLACE)
    out[base] = limit - 1  # the end symbol is the smallest suffix
    placed = np.zeros(n, bool)
    placed[limit - 1] = True
    following = np.arange(n, dtype=PLACE)  # by group start: the next place in it
    following[start[limit - 1]] += 1
    sizes = limit - base
    by_size = np.argsort(-sizes, kind="stable")
    for i in range(int(sizes.max()) if texts else 0):
        live = by_size[:np.searchsorted(-sizes[by_size], -i, side="left")]
        at = out[base[live] + i] - 1
        at = at[at >= base[live]]
        at = at[~placed[at]]
        while len(at):
            group = start[at]
            out[following[group]] = at
            following[group] += 1
            placed[at] = True
            at = pointer[at]
            at = at[at >= 0]
            at = at[~placed[at]]
    return out
