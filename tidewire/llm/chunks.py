"""Texts cut into chunks that a byte-level tokenizer encodes independently of each other.

The usual pattern never lets a piece run over a single space or line break into the word
behind it, so a text falls apart before each of those that a word follows. Words recur: a
column of texts is split and numbered by Arrow, each worker encodes a chunk once, and the ids
of whole texts are gathered by chunk numbers.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: White space, then a space that more white space or the end follows: here a piece may run over the space.
RUN_OVER = re.compile(r"\s (?=\s|\Z)")
#: Letters before this one are letters in every version of Unicode that a tokenizer may know.
SETTLED = "Ԁ"


def gather(starts: np.ndarray, sizes: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """Positions of the runs (start, size) that ``picks`` numbers, one after another."""
    n = sizes[picks]
    ends = np.cumsum(n)
    return np.repeat(starts[picks] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


class ChunkTable:
    """Ids of chunks as bytes (little-endian unsigned 32-bit), computed by ``encode`` for many new chunks at once.

    ``most`` bounds the chunks held; the table starts afresh when it is full.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], pattern: str, most: int = 1_100_000):
        self.encode, self.whole, self.most = encode, regex.compile(pattern), most
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def _learn(self, table: dict[str, bytes], chunks: list[str], lead: str) -> list[bytes]:
        """The values of different chunks; those in ``later`` lack the space they begin with, unless it is a line break."""
        new = [c for c in chunks if c not in table]
        if len(table) + len(new) > self.most:
            table.clear()
            new = chunks
        # A full stop or comma behind letters is a piece of its own.
        stems = {c: c[:-1] for c in new if c[-1:] in (".", ",") and c[:-1].isalpha() and max(c) < SETTLED}
        asked = list({s for s in stems.values() if s not in table}.union(c for c in new if c not in stems))
        table.update(zip(asked, self.encode([c if c[:1] == "\n" else lead + c for c in asked]), strict=True))
        if stems:
            mark = dict(zip(".,", self.encode([".", ","]), strict=True))
            table.update({c: table[s] + mark[c[-1]] for c, s in stems.items()})
        return [table[c] for c in chunks]

    def _plainly(self, texts: list[str]) -> list[bytes]:
        """Whole texts in which white space meets white space: cut before spaces only, or by the pattern."""
        cut = [split(t, self.whole) for t in texts]
        chunks = list({c for parts in cut for c in parts})
        values = dict(zip(chunks, self._learn(self.first, chunks, ""), strict=True))
        return [b"".join([values[c] for c in parts]) for parts in cut]

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (strings without nulls) in one array, and where each text begins in it, with the end."""
        if not len(texts):
            return np.empty(0, "<u4"), np.zeros(1, "int64")
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        heads = lists.offsets.to_numpy()[:-1].astype("int64")
        numbered = lists.values.dictionary_encode()
        codes, chunks = numbered.indices.to_numpy().astype("int64"), numbered.dictionary.to_pylist()
        # Few chunks begin or end with white space: only those are looked at one by one.
        empty, opens, closes, broken = np.zeros((4, len(chunks)), bool)
        for i, c in enumerate(chunks):
            if not c:
                empty[i] = True
            elif c[0] <= " " or c[-1] <= " " or not c.isascii():
                opens[i], closes[i], broken[i] = c[0].isspace(), c[-1].isspace(), c[0] == "\n" and (len(c) == 1 or c[1].isspace())
        is_head = np.zeros(len(codes), bool)
        is_head[heads] = True
        # White space on both sides of a space or line break.
        meets = broken[codes]
        meets[1:] |= (closes[codes[:-1]] | (empty[codes[:-1]] & ~is_head[:-1])) & (opens[codes[1:]] | empty[codes[1:]]) & ~is_head[1:]
        text_of = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(codes))))
        odd = np.zeros(len(heads), bool)
        odd[text_of[meets]] = True
        values = self._learn(self.later, chunks, " ")
        first = [chunks[c] for c in codes[heads]]
        distinct = list(set(first))
        known = dict(zip(distinct, self._learn(self.first, distinct, ""), strict=True))
        whole = iter(self._plainly([texts[i].as_py() for i in np.flatnonzero(odd)]))
        values += [next(whole) if o else known[f] for f, o in zip(first, odd.tolist(), strict=True)]
        codes[heads] = len(chunks) + np.arange(len(heads))
        used = ~odd[text_of] | is_head
        codes, text_of = codes[used], text_of[used]
        sizes = np.fromiter(map(len, values), "int64", len(values)) // 4
        ids = np.frombuffer(b"".join(values), "<u4")[gather(np.cumsum(sizes) - sizes, sizes, codes)]
        ends = np.cumsum(np.bincount(text_of, sizes[codes], len(heads)).astype("int64"))
        return ids, np.append(0, ends)


def split(text: str, pattern: regex.Pattern) -> list[str]:
    """Chunks of one text that encode alone: before single spaces, or by the pattern where white space meets white space."""
    if RUN_OVER.search(text):
        return pattern.findall(text)
    head, space, rest = text.partition(" ")
    return [head, *(" " + r for r in rest.split(" "))] if space else [head]


def small_batches(batches, most_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with about ``most_bytes`` of the column text each, so that memory follows neither rows nor long texts."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(batch.schema.get_field_index("text"))).to_numpy().astype("int64")
        group = (lengths.cumsum() - lengths) // most_bytes
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(group, group[at], "right"))
            yield batch.slice(at, end - at)
            at = end


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
