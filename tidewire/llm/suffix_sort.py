"""Suffix arrays of many short strings at once, by linear grouping.

Suffixes are grouped by their Lyndon prefixes. Groups are taken in descending order; each
member looks up its previous smaller suffix, and those suffixes are split off their own
groups by how often the member's prefix extends theirs. When all groups have been taken
they are in order, and one scan emits the suffixes of each group in theirs; nothing is
renamed or sorted again. All strings advance together, one group each per step, so a step
is a few array operations however many strings there are.
"""

from __future__ import annotations

import numpy as np


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for ``sizes[0]`` numbers, then the same for the next."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _split_off(moved: np.ndarray, order: np.ndarray, place: np.ndarray, start: np.ndarray, end: np.ndarray, mark: np.ndarray) -> None:
    """Makes of the ``moved`` suffixes of each group a group of their own, right behind it."""
    moved = moved[np.argsort(start[moved], kind="stable")]
    begin, first, n = np.unique(start[moved], return_index=True, return_counts=True)
    close = end[begin]
    tail = close - n
    new = np.repeat(tail, n)
    mark[moved] = True
    slots = _ranges(tail, n)
    held = order[slots]
    foreign = ~mark[held]
    mark[moved] = False
    outside = place[moved] < new
    incoming, vacated, free, leaving = moved[outside], place[moved[outside]], slots[foreign], held[foreign]
    order[free], place[incoming] = incoming, free
    order[vacated], place[leaving] = leaving, vacated
    end[begin] = tail
    end[tail] = close
    start[moved] = new


def suffix_arrays(text: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    """The positions of each lane's suffixes in order, lane after lane.

    ``text`` holds the lanes one after another, ``lanes`` where each begins. The last symbol
    of a lane is smaller than all others in it.
    """
    n = len(text)
    bounds = np.append(lanes, n)
    lane = np.repeat(np.arange(len(lanes)), np.diff(bounds))
    # First groups: by symbol.
    order = np.lexsort((text, lane))
    fresh = np.ones(n, bool)
    fresh[1:] = (text[order[1:]] != text[order[:-1]]) | (lane[order[1:]] != lane[order[:-1]])
    begins = np.flatnonzero(fresh)
    start = np.empty(n, "int64")
    start[order] = np.repeat(begins, np.diff(np.append(begins, n)))
    end = np.zeros(n + 1, "int64")
    end[begins] = np.append(begins[1:], n)
    place = np.empty(n, "int64")
    place[order] = np.arange(n)
    smaller = np.arange(n) - 1  # the previous smaller suffix, or a step on the way to it
    length = np.ones(n, "int64")
    mark = np.zeros(n, bool)
    low, cursor = bounds[:-1].copy(), bounds[1:].copy()
    while len(low):
        begin = start[order[cursor - 1]]
        size = cursor - begin
        member = order[_ranges(begin, size)]
        floor, group = np.repeat(low, size), np.repeat(begin, size)
        at = smaller[member]
        on = np.flatnonzero((at >= floor) & (start[at] >= group))
        while len(on):
            at[on] = smaller[at[on]]
            on = on[(at[on] >= floor[on]) & (start[at[on]] >= group[on])]
        smaller[member] = at
        inside = at >= floor
        target, own, times = np.unique(at[inside], return_index=True, return_counts=True)
        length[target] += times * length[member[inside][own]]
        for k in np.unique(times)[::-1]:
            _split_off(target[times == k], order, place, start, end, mark)
        cursor = begin
        more = cursor > low
        low, cursor = low[more], cursor[more]
    # Suffix j is its Lyndon prefix and the suffix behind that: within a group the order is that of the latter.
    out = np.empty(n, "int64")
    out[bounds[:-1]] = bounds[1:] - 1
    fill = np.arange(n)  # per group, at the number of its first slot, the next free one
    low, high, at = bounds[:-1], bounds[1:], bounds[:-1].copy()
    while len(at):
        i = out[at]
        j, floor = i - 1, low
        on = j >= floor
        i, j, floor = i[on], j[on], floor[on]
        while len(j):
            on = j + length[j] == i
            i, j, floor = i[on], j[on], floor[on]
            g = start[j]
            out[fill[g]] = j
            fill[g] += 1
            j = smaller[j]
            on = j >= floor
            i, j, floor = i[on], j[on], floor[on]
        at = at + 1
        more = at < high
        low, high, at = low[more], high[more], at[more]
    return out
