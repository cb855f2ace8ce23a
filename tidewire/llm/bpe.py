"""Byte-level BPE by merge replay over a corpus of words.

The distinct words of a block of texts are laid out as one run of byte symbols. An inverted
index holds, per rank, the positions of the pairs that the rank joins. Merges are replayed
over all words at once in rank order; each touches only the neighbours of the pairs it
joins and posts the pairs that arise. Blocks are bounded in size and independent.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from array import array
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.chunks import ChunkTable, column, gather, small_batches
from tidewire.llm.common import text_or_empty


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    """Ids of words under ``ranks``, the bytes of every token with its id, which is also its merge rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)])
        #: Every pair of tokens that make a token together, as left << 32 | right.
        self.pairs = {ranks[b[:k]] << 32 | ranks[b[k:]]: i for b, i in ranks.items() for k in range(1, len(b)) if b[:k] in ranks and b[k:] in ranks}
        self.of_bytes = np.array([[self.pairs.get(int(x) << 32 | int(y), -1) for y in self.byte_ids] for x in self.byte_ids])

    def _first_postings(self, data: np.ndarray, lasts: np.ndarray) -> dict[int, list[int]]:
        """Positions of the pairs of bytes that some rank joins, by rank; no pair begins at the last byte of a word."""
        rank = self.of_bytes[data[:-1], data[1:]]
        rank[lasts[:-1]] = -1
        places = np.flatnonzero(rank >= 0)
        places = places[np.argsort(rank[places], kind="stable")]
        found, starts = np.unique(rank[places], return_index=True)
        return {r: p.tolist() for r, p in zip(found.tolist(), np.split(places, starts[1:]), strict=False)}

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each word."""
        ranks, rank_of = self.ranks, self.pairs.get
        out: list = [None] * len(words)
        split: list[int] = []
        for n, w in enumerate(words):
            if (whole := ranks.get(w)) is not None or not w:
                out[n] = array("I", [whole] if w else []).tobytes()
            else:
                split.append(n)
        if not split:
            return out
        data = np.frombuffer(b"".join([words[n] for n in split]), "uint8")
        ends = np.cumsum([len(words[n]) for n in split])
        starts = np.append(0, ends[:-1])
        heads = zip(split, starts.tolist(), strict=True)
        place = np.arange(len(data))
        after, before = place + 1, place - 1
        after[ends - 1], before[starts] = -1, -1
        symbols, after, before = self.byte_ids[data].tolist(), after.tolist(), before.tolist()
        postings = self._first_postings(data, ends - 1)
        queue = sorted(postings)
        while queue:
            rank = heappop(queue)
            places = postings.pop(rank, None)
            if places is None:
                continue
            places.sort()
            for done, i in enumerate(places, 1):
                left = symbols[i]
                j = after[i]
                if left < 0 or j < 0 or rank_of(left << 32 | symbols[j], -1) != rank:
                    continue  # a neighbour has been joined to another since
                k = after[j]
                symbols[i], symbols[j], after[i] = rank, -1, k
                lowest = rank
                if k >= 0:
                    before[k] = i
                    if (r := rank_of(rank << 32 | symbols[k], -1)) >= 0:
                        if r not in postings:
                            postings[r] = []
                            heappush(queue, r)
                        postings[r].append(i)
                        lowest = min(lowest, r)
                if (h := before[i]) >= 0 and (r := rank_of(symbols[h] << 32 | rank, -1)) >= 0:
                    if r not in postings:
                        postings[r] = []
                        heappush(queue, r)
                    postings[r].append(h)
                    lowest = min(lowest, r)
                if lowest < rank:  # the new pair comes first; the other places wait
                    if done < len(places):
                        if rank not in postings:
                            postings[rank] = []
                            heappush(queue, rank)
                        postings[rank].extend(places[done:])
                    break
        for n, i in heads:
            ids = array("I")
            while i >= 0:
                ids.append(symbols[i])
                i = after[i]
            out[n] = ids.tobytes()
        return out


class Codec:
    """Chunks of texts to ids and back; the ids of words are kept between calls, ``most`` of them at a time."""

    def __init__(self, path: str, pattern: str, most: int = 700_000):
        self.replay = MergeReplay(load_ranks(path))
        self.pattern, self.most = regex.compile(pattern), most
        self.words: dict[str, bytes] = {}
        self.table = ChunkTable(self._chunks, pattern, most)
        tokens = [self.replay.tokens.get(i, b"") for i in range(max(self.replay.tokens) + 1)]
        self.spelling = np.frombuffer(b"".join(tokens), "uint8")
        self.sizes = np.array([len(t) for t in tokens])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        cut = [self.pattern.findall(c) for c in chunks]
        new = [w for w in {w for c in cut for w in c} if w not in self.words]
        if len(self.words) + len(new) > self.most:
            self.words.clear()
            new = list({w for c in cut for w in c})
        self.words.update(zip(new, self.replay.encode([w.encode() for w in new]), strict=True))
        return [b"".join([self.words[w] for w in c]) for c in cut]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of texts whose ids are ids[bounds[i]:bounds[i + 1]]."""
        raw = self.spelling[gather(self.starts, self.sizes, ids)].tobytes()
        at = np.append(0, np.cumsum(self.sizes[ids]))[bounds].tolist()
        return [raw[a:b] for a, b in itertools.pairwise(at)]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, ids): every whole text as an array of token ids.

    ``ranks`` is the place of a rank file that driver and executors can open. Null text counts
    as empty and has no ids. Repeated rows and null doc_ids come through one by one. An empty
    table gives no rows. Other columns are ignored.
    """

    def run(batches):
        c = codec(ranks, pattern)
        for part in small_batches(batches):
            ids, bounds = c.table.encoded(column(part, "text"))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype("int32")))
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), lists], ["doc_id", "ids"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, bytes): the bytes that the ids of ``encode`` stand for. Null ids count as none."""

    def run(batches):
        c = codec(ranks, pattern)
        for batch in batches:
            lists = column(batch, "ids")
            offsets = lists.offsets.to_numpy().astype("int64")
            ids = lists.values.to_numpy()[offsets[0] : offsets[-1]].astype("int64")
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(c.decode(ids, offsets - offsets[0]), pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, bytes binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text: encoded, then its ids decoded, in one pass over the text."""

    def run(batches):
        c, digest = codec(ranks, pattern), lambda parts: pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())
        for part in small_batches(batches):
            ids, bounds = c.table.encoded(column(part, "text"))
            raw = memoryview(ids.tobytes())
            of_ids = digest(raw[4 * a : 4 * b] for a, b in itertools.pairwise(bounds.tolist()))
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(np.diff(bounds)), of_ids, digest(c.decode(ids, bounds))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema)
