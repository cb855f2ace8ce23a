"""Best-fit packing of documents into sequences by minimum bin slack.

A histogram of piece lengths, of at most ``capacity`` entries however many documents there
are, is all the search needs: for each bin a bitset subset-sum finds the fullest feasible
combination of the lengths that are left, which is then removed as many times as the counts
allow. The plan that results says which ranks of each length go where; pieces are ranked and
placed by Spark.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.chunks import ChunkTable, column, small_batches
from tidewire.llm.common import cut, join_small, text_or_empty

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ChunkEncoder:
    """Ids of many chunks as bytes, little-endian unsigned 32-bit.

    Chunks that begin with a space and hold no other are encoded as one running text: they
    stay independent there, and each begins at a token that begins with a space.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True  # how byte-level vocabularies write a space

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, chunks: list[str], run: int = 500) -> list[bytes]:
        plain = [c[:1] == " " and len(c) > 1 and not c[1].isspace() and not c[-1].isspace() for c in chunks]
        joined = [c for c, p in zip(chunks, plain, strict=True) if p]
        slices = [joined[i : i + run] for i in range(0, len(joined), run)]
        found: list[bytes] = []
        for part, ids in zip(slices, self._ids(["".join(p) for p in slices]), strict=True):
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) == len(part):
                raw, ends = ids.tobytes(), [*(4 * starts[1:]).tolist(), 4 * len(ids)]
                found += [raw[a:b] for a, b in zip((4 * starts).tolist(), ends, strict=True)]
            else:
                found += [i.tobytes() for i in self._ids(part)]
        rest = iter(self._ids([c for c, p in zip(chunks, plain, strict=True) if not p]))
        running = iter(found)
        return [next(running) if p else next(rest).tobytes() for p in plain]


@lru_cache(maxsize=2)
def chunk_table(tokenizer: str) -> ChunkTable:
    return ChunkTable(ChunkEncoder(tokenizer), PATTERN)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids with ``end_id`` behind them, cut only if longer than ``capacity``.

    The first piece of a cut document takes the remainder, the others are full.
    """

    def cut_up(batches):
        table, schema = chunk_table(tokenizer), pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for part in small_batches(batches):
            ids, bounds = table.encoded(column(part, "text"))
            # Room for the last id of each text, then where its pieces begin and end.
            ids = np.insert(ids, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
            n = np.diff(bounds)
            first = np.where(n <= capacity, n, (n - 1) % capacity + 1)
            pieces = 1 + (n - first) // capacity
            text = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.where(piece == 0, 0, first[text] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[text], capacity)
            begin, raw = 4 * (bounds[text] + start), memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[a : a + b]) for a, b in zip(begin.tolist(), (4 * length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([column(part, "doc_id").take(pa.array(text)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(cut_up, PIECES)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """A combination of the available lengths that fills ``room`` as far as any can.

    Bit s of a bitset says that the lengths seen so far can sum to s. Lengths are added from
    the longest down, with multiplicities in doubling steps, until the room is filled.
    """
    reach, steps, limit = 1, [], (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left, times = min(counts[length], room // length), 1
        while left:
            times = min(times, left)
            grown = reach | (reach << (length * times)) & limit
            if grown != reach:
                steps.append((length, times, reach))
                reach = grown
            left, times = left - times, times * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + times
            total -= length * times
    return used


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, times per sequence, first sequence, offset) of the packing.

    Each bin takes the longest length left, which no later bin could place better, and the
    combination that fills the rest of it fullest.
    """
    left = {n: c for n, c in histogram.items() if c}
    taken: dict[int, int] = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        pattern = fullest({n: c for n, c in rest.items() if c}, capacity - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        repeats, offset = min(left[n] // k for n, k in pattern.items()), 0
        for n, k in sorted(pattern.items(), reverse=True):
            rows.append((n, taken[n], taken[n] + k * repeats, k, sequence, offset))
            taken[n] += k * repeats
            left[n] -= k * repeats
            offset += n * k
            if not left[n]:
                del left[n]
        sequence += repeats
    return rows


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (a written table with length) with sequence_id and offset.

    Full pieces are sequences of their own, with negative numbers. The others are ranked
    within their length: by salt, so a common length is ranked by many tasks, then shifted by
    the counts of the salts before. The histogram holds at most ``capacity`` rows; a pattern
    uses up the multiple of at least one length, which bounds the plan alike, so it is
    broadcast. The shifts, ``capacity`` rows per salt, are if they prove small.
    """
    salts = max(64, pieces.count() // 2_000_000)
    full = pieces.filter(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    salted = pieces.filter(F.col("length") < capacity).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = cut(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    spark = pieces.sparkSession
    placed = "of_length long, first long, beyond long, times long, sequence long, at long"
    steps = spark.createDataFrame(plan(histogram, capacity), placed)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = cut(counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    ranked = join_small(salted.withColumn("own", rank), shifts, ["length", "salt"], row_bytes=24).withColumn("rank", F.col("own") + F.col("shift"))
    here = (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("beyond"))
    rest = ranked.join(F.broadcast(steps), here).withColumns({"sequence_id": F.expr("sequence + (rank - first) div times"), "offset": F.expr("at + (rank - first) % times * length")})
    columns = [*pieces.columns, "sequence_id", "offset"]
    return full.select(columns).unionByName(rest.select(columns))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty and is one piece, the ``end_id`` alone. Repeated rows are packed
    one by one; a null doc_id is carried along. Ties between pieces of one length are broken
    by doc_id and piece within a salt. An empty table gives no rows. Other columns are ignored.
    """
    return place(cut(token_pieces(docs, tokenizer, capacity, end_id)), capacity)
