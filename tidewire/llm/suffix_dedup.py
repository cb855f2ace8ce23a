"""Repeated substrings across documents, by suffix arrays of what they may share.

A string of ``width`` bytes is a window. Each window has an anchor, the ``core`` bytes in it
with the smallest hash, so equal windows have equal anchors. Anchors go by their hash to
tasks that tell which of them several documents hold; for those the bytes of their windows
are fetched, equal ones are collapsed to the smallest doc_id, and the different contexts of
one anchor are concatenated and suffix-sorted. In the suffix array equal windows are
neighbours, and the smallest doc_id among them decides what goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import cut, join_small, release, text_or_empty
from tidewire.llm.minhash import mix, restored, squeezed
from tidewire.llm.suffix_sort import suffix_arrays

CORE = 24
#: Bits of a position inside a step; the rest of a word are bits of the hash.
PLACE_BITS = 20
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
#: doc_id of rows without one: behind all others.
LAST = np.iinfo("int64").max


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, "uint64")
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype="uint64")


def _least(a: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values that follow each other."""
    span = 1
    while span < width:
        step = min(span, width - span)
        a = np.minimum(a[:-step], a[step:])
        span += step
    return a


def anchors(data: np.ndarray, bounds: np.ndarray, width: int, core: int, step: int = 1 << PLACE_BITS) -> tuple[np.ndarray, ...]:
    """(hash, text, first window, windows, anchor) of runs of windows with one anchor.

    Text i is data[bounds[i]:bounds[i + 1]]; positions count from its start. Windows are taken
    ``step`` at a time, so a very long text needs no more memory than many short ones. A step
    holds no position beyond PLACE_BITS: of equal cores in a window the leftmost is the anchor.
    """
    step = min(step, (1 << PLACE_BITS) - width)
    found = [_anchors(data[lo : lo + step + width - 1], bounds - lo, width, core) for lo in range(0, max(len(data), 1), step)]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _anchors(data: np.ndarray, bounds: np.ndarray, width: int, core: int) -> tuple[np.ndarray, ...]:
    """Anchors of the windows that lie in ``data``, of texts whose bounds may lie outside it."""
    none = np.empty(0, "int64")
    n = len(data)
    if n < width:
        return none.astype("uint64"), none, none, none, none
    powers = _powers(_BASE, n)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, "uint64")
        np.cumsum((data.astype("uint64") + np.uint64(1)) * powers, out=sums[1:])
        hashes = mix((sums[core:] - sums[:-core]) * _powers(_BACK, n - core + 1))
    low = np.uint64((1 << PLACE_BITS) - 1)
    packed = (hashes & ~low) | (np.arange(len(hashes), dtype="uint64") & low)
    best = _least(packed, width - core + 1)
    here = np.clip(bounds, 0, n)
    whole = np.zeros(len(best), bool)  # windows that lie in one text
    for a, b in zip(here[:-1], here[1:], strict=True):
        if b - a >= width:
            whole[a : b - width + 1] = True
    fresh = whole.copy()
    fresh[1:] &= (best[1:] != best[:-1]) | ~whole[:-1]
    first = np.flatnonzero(fresh)
    if not len(first):
        return none.astype("uint64"), none, none, none, none
    total = np.cumsum(np.append(0, whole))
    run = total[np.append(first[1:], len(whole))] - total[first]
    at = first + ((best[first] - first.astype("uint64")) & low).astype("int64")
    text = np.searchsorted(here, first, "right") - 1
    return hashes[at], text, first - bounds[text], run, at - bounds[text]


#: A run of windows as it travels: hash, text in its part, first window, windows, bytes from there to the anchor.
RUN = np.dtype([("hash", "<u4"), ("text", "<u2"), ("first", "<u4"), ("run", "u1"), ("lead", "u1")])


def runs_packed(runs: np.ndarray) -> bytes:
    """Runs with each field's bytes together, compressed."""
    return squeezed(np.ascontiguousarray(runs).view([("all", f"V{RUN.itemsize}")])["all"])


def runs_unpacked(body: bytes) -> np.ndarray:
    return restored(body, f"V{RUN.itemsize}").view(RUN)


def byte_parts(batches, most: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``most`` bytes of text (column ``text``, binary) each, their bytes and bounds."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        sizes = np.fromiter((len(x.as_buffer()) for x in column), "int64", batch.num_rows)
        group = np.maximum((sizes.cumsum() - sizes) // most, np.arange(batch.num_rows) // 60_000)
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(group, group[at], "right"))
            data = np.frombuffer(b"".join(x.as_py() for x in column[at:end]), "uint8")
            yield batch.slice(at, end - at), data, np.append(0, sizes[at:end].cumsum())
            at = end


def _part_name(nodes: list[bytes]) -> bytes:
    return hashlib.md5(b"".join(nodes)).digest()


def shared_runs(texts: DataFrame, buckets: int, width: int, core: int) -> DataFrame:
    """(bucket, part, body, kind): runs of windows whose anchors several texts hold, and which texts a part has.

    ``texts`` is (node, text). A part is a bounded slice of a task's rows; anchors of a part
    travel in one piece per bucket, each anchor at most once if several texts of the part hold
    it, so one that every document holds is as rare in its bucket as parts are.
    """
    schema = pa.schema([("bucket", pa.int64()), ("part", pa.binary()), ("body", pa.binary()), ("kind", pa.string())])

    def find(batches):
        for batch, data, bounds in byte_parts(batches):
            nodes = batch.column(batch.schema.get_field_index("node")).to_pylist()
            name = _part_name(nodes)
            h, text, first, run, at = anchors(data, bounds, width, core)
            bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype("int64")
            out = np.empty(len(h), RUN)
            out["hash"], out["text"], out["first"], out["run"], out["lead"] = h & np.uint64(0xFFFFFFFF), text, first, run, at - first
            order = np.lexsort((out["text"], out["hash"], bucket))
            out, bucket = out[order], bucket[order]
            # What several texts of the part hold is known to be shared; one of its runs speaks for it elsewhere.
            fresh = np.ones(len(out), bool)
            fresh[1:] = (bucket[1:] != bucket[:-1]) | (out["hash"][1:] != out["hash"][:-1])
            group = np.cumsum(fresh) - 1
            moved = ~fresh
            moved[1:] &= out["text"][1:] != out["text"][:-1]
            local = (np.bincount(group, moved) > 0)[group] if len(out) else moved
            known = squeezed(bucket[local].astype("<i4")), runs_packed(out[local])
            known = len(known[0]).to_bytes(8, "little") + known[0] + known[1]
            out, bucket = out[~local | fresh], bucket[~local | fresh]
            own, start = np.unique(bucket, return_index=True)
            ends = np.append(start[1:], len(out))
            own_key = -1 - int.from_bytes(name[:7], "little")
            rows = [(own_key, name, b"".join(nodes), "nodes"), (own_key, name, known, "known"), *((k, name, runs_packed(out[a:b]), "runs") for k, a, b in zip(own.tolist(), start, ends, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def keep_shared(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return frame
        bodies = [runs_unpacked(b) for b in frame["body"]]
        runs = np.concatenate(bodies)
        part = np.repeat(np.arange(len(bodies)), [len(b) for b in bodies])
        source = part * 65536 + runs["text"]
        order = np.lexsort((source, runs["hash"]))
        h, s = runs["hash"][order], source[order]
        group = np.cumsum(np.append(True, h[1:] != h[:-1])) - 1
        own = np.append(True, (h[1:] != h[:-1]) | (s[1:] != s[:-1]))
        several = np.bincount(group, own)[group] > 1
        keep = np.zeros(len(runs), bool)
        keep[order[several]] = True
        ends = np.cumsum([len(b) for b in bodies])
        found = [b[keep[e - len(b) : e]] for b, e in zip(bodies, ends, strict=True)]
        return pd.DataFrame([(key[0], p, runs_packed(f), "runs") for p, f in zip(frame["part"], found, strict=True) if len(f)], columns=schema.names)

    sent = texts.mapInArrow(find, "bucket long, part binary, body binary, kind string")
    return cut(sent.groupBy("bucket").applyInPandas(keep_shared, "bucket long, part binary, body binary, kind string"))


def runs_by_text(shared: DataFrame) -> DataFrame:
    """(node, buckets, runs): the shared runs of each text that has some; a part's pieces are put together."""

    def regroup(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        names = frame.loc[frame["kind"] == "nodes", "body"].iloc[0]
        known = frame.loc[frame["kind"] == "known", "body"].iloc[0]
        split = 8 + int.from_bytes(known[:8], "little")
        pieces = frame[frame["kind"] == "runs"]
        bodies = [runs_unpacked(b) for b in pieces["body"]]
        runs = np.concatenate([runs_unpacked(known[split:]), *bodies])
        bucket = np.concatenate([restored(known[8:split], "<i4"), np.repeat(pieces["bucket"].to_numpy("int64"), [len(b) for b in bodies])])
        if not len(runs):
            return pd.DataFrame(columns=["node", "buckets", "runs"])
        order = np.argsort(runs["text"], kind="stable")
        runs, bucket = runs[order], bucket[order]
        own, start = np.unique(runs["text"], return_index=True)
        ends = np.append(start[1:], len(runs))
        rows = [(names[16 * t : 16 * t + 16], bucket[a:b].astype("<i4").tobytes(), runs[a:b].tobytes()) for t, a, b in zip(own.tolist(), start, ends, strict=True)]
        return pd.DataFrame(rows, columns=["node", "buckets", "runs"])

    # Rows that repeat a text may lie in several parts; one of them speaks for all.
    return shared.groupBy("part").applyInPandas(regroup, "node binary, buckets binary, runs binary").dropDuplicates(["node"])


def contexts(texts: DataFrame, runs: DataFrame, width: int) -> DataFrame:
    """(anchor, context, lead, node, place, position): the bytes of each shared run of windows."""

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), 2000):
                out: list[tuple] = []
                for node, place, text, buckets, body in frame.iloc[lo : lo + 2000][["node", "place", "text", "buckets", "runs"]].itertuples(index=False):
                    run = np.frombuffer(body, RUN)
                    anchor = np.frombuffer(buckets, "<i4").astype("int64") << 32 | run["hash"].astype("int64")
                    first = run["first"].tolist()
                    out.extend((a, text[f : f + r + width - 1], l, node, place, f) for a, f, r, l in zip(anchor.tolist(), first, run["run"].tolist(), run["lead"].tolist(), strict=True))
                yield pd.DataFrame(out, columns=["anchor", "context", "lead", "node", "place", "position"])

    joined = texts.join(runs, "node")
    return joined.mapInPandas(fetch, "anchor long, context binary, lead int, node binary, place long, position long")


def _equal_windows(jobs: list[tuple[list[bytes], np.ndarray]], width: int) -> list[np.ndarray]:
    """Per job (contexts, least place of each) the least place of any equal window, for all its windows in order."""
    lanes, starts, places, at = [], [], [], 0
    offsets = []
    for texts, place in jobs:
        lanes.append(at)
        for t, p in zip(texts, place, strict=True):
            starts.append(at)
            offsets.append(len(t) - width + 1)
            at += len(t) + 1
        places.append(place)
    raw = b"".join(b"\x00".join(texts) + b"\x00" for texts, _ in jobs)
    symbols = np.frombuffer(raw, "uint8").astype("int16") + 2
    starts, runs = np.array(starts), np.array(offsets)
    ends = starts + runs + width - 1
    symbols[ends] = 1  # between contexts
    symbols[np.append(np.array(lanes[1:], "int64"), at) - 1] = 0  # behind a lane
    order = suffix_arrays(symbols, np.array(lanes))
    window = np.full(at, LAST)
    is_window = np.zeros(at, bool)
    number = np.repeat(starts - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
    is_window[number] = True
    window[number] = np.repeat(np.concatenate(places), runs)
    order = order[is_window[order]]
    same = np.zeros(len(order), bool)
    lane = np.searchsorted(np.array(lanes), order, "right")
    span = np.arange(width)
    for lo in range(1, len(order), 200_000):
        a, b = order[lo : lo + 200_000], order[lo - 1 : lo - 1 + len(order[lo : lo + 200_000])]
        same[lo : lo + len(a)] = (symbols[a[:, None] + span] == symbols[b[:, None] + span]).all(1)
    same[1:] &= lane[1:] == lane[:-1]
    begin = np.flatnonzero(~same)
    best = np.minimum.reduceat(window[order], begin)
    window[order] = np.repeat(best, np.diff(np.append(begin, len(order))))
    values = window[number]
    per_job = np.cumsum([sum(len(t) - width + 1 for t in texts) for texts, _ in jobs])
    return np.split(values, per_job[:-1])


#: Bytes of one anchor's contexts that are sorted as one string; more are told apart by longer cores first.
LANE = 2048


def _jobs(texts: list[bytes], leads: list[int], width: int):
    """Splits the windows of one anchor's contexts until each piece is short.

    Yields lists of (context, first window, windows). Windows are told apart by how many
    bytes precede the anchor; those of one half share a longer core, by which their contexts
    are grouped. Contexts whose core is theirs alone share no window and are left out.
    """
    stack = [([(i, max(leads[i] - (len(t) - width), 0), leads[i]) for i, t in enumerate(texts)], 0, max(leads), 0)]
    while stack:
        items, low, high, depth = stack.pop()  # windows with low..high bytes before the anchor
        if depth >= 2 and (low >= high or sum(b - a + width for _, a, b in items) <= LANE):
            yield [(i, leads[i] - b, b - a + 1) for i, a, b in items]
            continue
        half = (low + high) // 2
        for lo, hi in ((low, half), (half + 1, high)):
            groups: dict[bytes, list] = {}
            for i, a, b in items:
                a, b = max(a, lo), min(b, hi)
                if a <= b:
                    groups.setdefault(_core(texts[i], leads[i], lo, hi, width), []).append((i, a, b))
            stack.extend((g, lo, hi, depth + 1) for g in groups.values() if len(g) > 1)


def _core(text: bytes, lead: int, low: int, high: int, width: int) -> bytes:
    """What all windows with low..high bytes before the anchor share."""
    return text[max(lead - low, 0) : lead + width - high]


#: An anchor with more different contexts than this has its windows told apart by Spark instead of in one task.
CROWD = 20_000


def first_places(distinct: DataFrame, width: int) -> DataFrame:
    """(anchor, digest, lead, spans): for runs of a context's windows the least place that holds them.

    A context is named by a digest, which only has to tell those of one anchor apart.
    ``distinct`` is (anchor, context, lead, place) with one row per anchor, context and lead.
    """
    crowded = cut(distinct.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("anchor"))
    alone = sorted_places(join_small(distinct, crowded, "anchor", "left_anti", row_bytes=24), width)
    return alone.unionByName(grouped_places(join_small(distinct, crowded, "anchor", "left_semi", row_bytes=24), width))


def grouped_places(distinct: DataFrame, width: int) -> DataFrame:
    """What first_places returns, window by window: for anchors with a crowd of contexts."""
    windows = F.transform(F.sequence(F.lit(0), F.octet_length("context") - width), lambda i: F.substring(F.col("context"), i + 1, F.lit(width)))
    each = distinct.select("anchor", F.xxhash64("context").alias("digest"), "lead", F.col("place"), F.posexplode(windows).alias("begin", "window"))
    best = each.groupBy("window").agg(F.min("place").alias("best"))
    span = F.struct(F.col("begin"), (F.col("begin") + 1).alias("end"), F.col("best").alias("place"))
    return each.join(best, "window").groupBy("anchor", "digest", "lead").agg(F.collect_list(span).alias("spans"))


def sorted_places(distinct: DataFrame, width: int) -> DataFrame:
    """What first_places returns, by suffix arrays of each anchor's contexts."""

    def solve(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("anchor", kind="stable").reset_index(drop=True)
        texts, leads, place = frame["context"].tolist(), frame["lead"].tolist(), frame["place"].to_numpy("int64")
        result: dict[int, np.ndarray] = {}  # of contexts that share some window
        anchor = frame["anchor"].to_numpy()
        bounds = np.append(np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])), len(frame))
        waiting: list[dict[bytes, list[tuple]]] = []

        def flush() -> None:
            if not waiting:
                return
            waiting.sort(key=lambda w: sum(map(len, w)))  # strings of a size are sorted together
            jobs = [(list(w), np.array([min(place[i] for i, _, _ in m) for m in w.values()])) for w in waiting]
            for w, values in zip(waiting, _equal_windows(jobs, width), strict=True):
                at = 0
                for members in w.values():
                    r = members[0][2]
                    for i, f, _ in members:
                        if i not in result:
                            result[i] = np.full(len(texts[i]) - width + 1, place[i])
                        result[i][f : f + r] = values[at : at + r]
                    at += r
            waiting.clear()

        size = 0
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            for job in _jobs(texts[a:b], leads[a:b], width):
                pieces: dict[bytes, list[tuple]] = {}
                for i, f, r in job:
                    pieces.setdefault(texts[a + i][f : f + r + width - 1], []).append((a + i, f, r))
                waiting.append(pieces)
                size += sum(map(len, pieces))
            if size > 4_000_000:
                flush()
                size = 0
        flush()
        spans = [[(0, len(t) - width + 1, p)] for t, p in zip(texts, place.tolist(), strict=True)]
        for i, values in result.items():
            begin = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist()]
            spans[i] = list(zip(begin, [*begin[1:], len(values)], values[begin].tolist(), strict=True))
        return pd.DataFrame({"anchor": anchor, "digest": frame["digest"], "lead": leads, "spans": spans})

    grouped = distinct.withColumn("digest", F.xxhash64("context")).withColumn("task", F.pmod(F.xxhash64("anchor"), F.lit(_tasks(distinct))))
    return grouped.groupBy("task").applyInPandas(solve, "anchor long, digest long, lead int, spans array<struct<begin:int,end:int,place:long>>")


def _tasks(df: DataFrame) -> int:
    """Groups of anchors that are solved together: about 20,000 contexts each."""
    return max(8, df.count() // 20_000)


def removed_spans(texts: DataFrame, n_bytes: int, width: int, core: int) -> DataFrame:
    """(node, spans): the spans (begin, end) of a text's windows that a text of a smaller place holds too.

    ``texts`` is (node, place, text), one row per node.
    """
    buckets = max(16, int(n_bytes * 0.08 * RUN.itemsize) // 4_000_000)
    shared = shared_runs(texts.select("node", "text"), buckets, width, core)
    occurrences = cut(contexts(texts, runs_by_text(shared), width))
    release(shared)
    distinct = cut(occurrences.groupBy("anchor", "context", "lead").agg(F.min("place").alias("place")))
    solved = cut(first_places(distinct, width))
    release(distinct)
    later = F.filter("spans", lambda s: s["place"] < F.col("place"))
    named = occurrences.select("anchor", F.xxhash64("context").alias("digest"), "lead", "node", "place", "position")
    found = named.join(solved, ["anchor", "digest", "lead"]).select("node", F.explode(F.transform(later, lambda s: F.struct((F.col("position") + s["begin"]).alias("begin"), (F.col("position") + s["end"] - 1 + width).alias("end")))).alias("span"))
    spans = cut(found.groupBy("node").agg(F.array_sort(F.collect_set("span")).alias("spans")))
    release(occurrences, solved)
    return spans


def substring_dedup(docs: DataFrame, width: int = 50, core: int = CORE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept: one row per row of ``docs``.

    Each byte goes that is covered by a string of ``width`` bytes that also starts in a
    document with a smaller doc_id. Strings lie within a document and are judged on the
    input; what is left may be cut inside a character, so ``kept`` is binary.

    Null text counts as empty; texts of fewer than ``width`` bytes lose nothing. A null doc_id
    is larger than any other. Rows with equal doc_ids take nothing from each other, repeated
    rows included. An empty table gives no rows. Other columns are ignored.
    """
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST)))
    base = docs.select("doc_id", place.alias("place"), F.encode(text_or_empty(), "UTF-8").alias("text")).withColumn("node", F.unhex(F.md5("text")))
    nodes = cut(base.groupBy("node").agg(F.min("place").alias("first"), F.count("*").alias("n"), F.first(F.octet_length("text")).alias("n_bytes")))
    repeated = cut(nodes.filter("n > 1").select("node", "first"))
    marked = join_small(base, repeated, "node", "left", row_bytes=64)
    # Later copies are not indexed: the first one holds all they hold. Rows that repeat it are one text.
    first = marked.filter((F.col("first").isNull() | (F.col("place") == F.col("first"))) & (F.octet_length("text") >= width)).select("node", "place", "text")
    n_bytes = nodes.agg(F.sum("n_bytes")).first()[0] or 0
    spans = removed_spans(first, n_bytes, width, core)

    def take_out(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, text, copy, gone in zip(frame["doc_id"], frame["text"], frame["copy"], frame["spans"], strict=True):
                merged: list[list[int]] = []
                if copy and len(text) >= width:
                    merged = [[0, len(text)]]
                elif gone is not None:
                    for s in gone:
                        if merged and s["begin"] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], s["end"])
                        else:
                            merged.append([s["begin"], s["end"]])
                edges = [0, *(x for m in merged for x in m), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((doc_id, len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    copy = F.coalesce(F.col("first") < F.col("place"), F.lit(False))
    width_of = spans.agg(F.sum(F.size("spans"))).first()[0] or 0
    joined = join_small(marked.withColumn("copy", copy), spans, "node", "left", row_bytes=64 + 40 * width_of // max(spans.count(), 1))
    kind = dict(docs.dtypes)["doc_id"]
    return joined.select("doc_id", "text", "copy", "spans").mapInPandas(take_out, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
