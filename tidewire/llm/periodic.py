"""Runs of repeated words in a text, found by uniting suffix classes by decreasing common prefix.

A run of period q and length n begins at a position s whose suffix shares its first n - q
words with the suffix at s + q. With n three times q or more no position between the two
shares as much, so when classes of suffixes are united in descending order of the common
prefix, s and s + q become neighbours in the ordered positions of their class: every pair of
new neighbours no further apart than the common prefix seeds a run.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewire.llm.chunks import column, small_batches
from tidewire.llm.common import text_or_empty

COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string"


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts one after another, and where each text begins and the last one ends."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for words in texts for w in words), "int64")
    return ids, np.append(0, np.cumsum([len(words) for words in texts], dtype="int64"))


def with_repeats(ids: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the texts in which a window of ``width`` words, a power of two, may stand twice."""
    r = np.random.default_rng(0)
    h = r.integers(1, 1 << 63, int(ids.max(initial=0)) + 1, dtype="u8")[ids]
    k = 1
    while k < width:
        h = h[:-k] * r.integers(1, 1 << 63, dtype="u8") + (h[k:] ^ h[k:] >> np.uint64(29)) if len(h) > k else h[:0]
        k *= 2
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(h)]
    whole = np.arange(len(h)) + width <= bounds[text + 1]
    h, text = h[whole] + text[whole].astype("u8") * np.uint64(0x9E3779B97F4A7C15), text[whole]
    order = np.argsort(h)
    return np.unique(text[order[1:]][h[order[1:]] == h[order[:-1]]])


class Suffixes:
    """Suffix order of several texts, each within itself, by doubling; keeps the classes of every doubling for common prefixes."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray):
        n = len(ids)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.ends = bounds[1:][text]
        # A class is named by the number of suffixes before it.
        key = text * (int(ids.max(initial=0)) + 1) + ids
        _, member, size = np.unique(key, return_inverse=True, return_counts=True)
        rank = (np.cumsum(size) - size)[member]
        self.levels, width = [rank.astype("int32")], 1
        while True:
            open_ = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
            if not len(open_):
                break
            ahead = open_ + width
            inside = ahead < self.ends[open_]
            second = np.where(inside, rank[np.where(inside, ahead, 0)] + 1, 0)
            key = rank[open_] * (n + 1) + second
            order = np.argsort(key, kind="stable")
            key, at = key[order], open_[order]
            old = rank[at]
            place = np.arange(len(at))
            begins = lambda x: np.maximum.accumulate(np.where(np.append(True, x[1:] != x[:-1]), place, 0))  # noqa: E731, B023
            rank = rank.copy()
            rank[at] = old + begins(key) - begins(old)
            self.levels.append(rank.astype("int32"))
            width *= 2
        self.order = np.empty(n, "int64")
        self.order[rank] = np.arange(n)
        self.text = text

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of suffixes of the same texts, a and b different."""
        length = np.zeros(len(a), "int64")
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = a + length, b + length
            inside = (x < self.ends[a]) & (y < self.ends[b])
            level = self.levels[k]
            same = inside & (level[np.where(inside, x, 0)] == level[np.where(inside, y, 0)])
            length += same.astype("int64") << k
        return length


def seeds(left: list[int], right: list[int], common: list[int]) -> list[tuple[int, int]]:
    """(position, distance) of pairs that become neighbours at a common prefix no shorter than their distance.

    ``left`` and ``right`` are neighbours in suffix order, by descending common prefix. A class
    is the list of its positions in order; the smaller one is inserted into the larger.
    """
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}

    def find(i: int) -> int:
        while (up := parent.setdefault(i, i)) != i:
            parent[i] = i = parent.setdefault(up, up)
        return i

    found = []
    for i, j, most in zip(left, right, common, strict=True):
        a, b = find(i), find(j)
        large, small = members.pop(a, None) or [a], members.pop(b, None) or [b]
        if len(large) < len(small):
            large, small = small, large
        for x in small:
            at = bisect_left(large, x)
            if at and x - large[at - 1] <= most:
                found.append((large[at - 1], x - large[at - 1]))
            if at < len(large) and large[at] - x <= most:
                found.append((x, large[at] - x))
            large.insert(at, x)
        parent[b] = a
        members[a] = large
    return found


def runs_of(ids: np.ndarray, bounds: np.ndarray, least: int, times: int) -> np.ndarray:
    """(start, length, period) of all runs of the texts, by start in all the words, then period."""
    reach = min(max(least - q, (times - 1) * q) for q in range(1, least + 1))
    some = with_repeats(ids, bounds, 1 << (reach.bit_length() - 1))
    if not len(some):
        return np.empty((0, 3), "int64")
    size = np.diff(bounds)[some]
    inner = np.append(0, np.cumsum(size))
    back = np.repeat(bounds[some] - inner[:-1], size)
    words = ids[np.arange(inner[-1]) + back]
    s = Suffixes(words, inner)
    a, b = s.order[:-1], s.order[1:]
    one_text = s.text[a] == s.text[b]
    a, b = a[one_text], b[one_text]
    common = s.common(a, b)
    far = np.flatnonzero(common >= reach)
    far = far[np.argsort(-common[far], kind="stable")]
    found = np.array(seeds(a[far].tolist(), b[far].tolist(), common[far].tolist()), "int64").reshape(-1, 2)
    start, period = np.unique(found, axis=0).T if len(found) else found.T
    # A run's own seed is the one that cannot be moved to the left.
    whole = (start == inner[s.text[start]]) | (words[start - 1] != words[start - 1 + period])
    start, period = start[whole], period[whole]
    length = period + s.common(start, start + period)
    long = length >= np.maximum(least, times * period)
    start, period, length = start[long], period[long], length[long]
    order = np.lexsort((period, length, start))
    start, period, length = start[order], period[order], length[order]
    # Multiples of a period give the same stretch; the smallest names it.
    smallest = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])) if len(start) else np.empty(0, bool)
    start, period, length = start[smallest], period[smallest], length[smallest]
    order = np.lexsort((period, start))
    return np.stack([start + back[start], length, period], axis=1)[order]


def summary(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """Values of COLUMNS for a text with ``runs`` (start, length, period) by start, then period."""
    if not runs:
        text = b" ".join(words)
        return 0, None, None, None, None, hashlib.sha256(b"").hexdigest(), hashlib.sha256(text).hexdigest(), text.decode()
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    change = np.zeros(len(words) + 1, "int64")
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    text = b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return len(runs), *best, 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest(), text.decode()


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3, words_of: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, collapsed.

    A run is a stretch of words with smallest period q and at least ``least`` and ``times`` * q
    (``times`` 3 or more) words that no word beside it extends. start, length and period are
    those of the run with the greatest length / period, of equals the first, then the one of
    the smaller period; null without runs. ``collapsed`` has the words, one space apart, that
    no run holds beyond its first q. ``words_of`` (doc_id, words) may change a text's words first.

    Words are what white space ([\\x20\\x09-\\x0D]) separates. Null text counts as empty. Null
    doc_ids and repeated rows come through one by one. An empty table gives no rows. Other
    columns are ignored. A text is one task's work, whatever its length: n log n steps of it.
    """
    if times < 3:
        raise ValueError("times must be 3 or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(batches):
            ids = column(part, "doc_id")
            texts = [t.encode().split() for t in column(part, "text").to_pylist()]
            if words_of:
                texts = [words_of(i, words) for i, words in zip(ids.to_pylist(), texts, strict=True)]
            numbers, bounds = numbered(texts)
            own: list[list] = [[] for _ in texts]
            for start, length, period in runs_of(numbers, bounds, least, times).tolist():
                at = int(np.searchsorted(bounds, start, "right")) - 1
                own[at].append((start - int(bounds[at]), length, period))
            rows = [summary(words, found) for words, found in zip(texts, own, strict=True)]
            kinds = [pa.int64()] * 5 + [pa.string()] * 3
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", *(c.split()[0] for c in COLUMNS.split(", "))])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {COLUMNS}")
