"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

Documents with equal words form one node. A node's features are its five-word shingles,
one feature per repetition, weighted by inverse document frequency. Weighted samples of the
features are banded; nodes that share a band meet in a bucket, are compared there by exact
weighted Jaccard similarity, and each bucket returns no more links than hold its members
together. Classes are the connected components.

The document frequency of every shingle is counted exactly: parts of the corpus send their
distinct shingles to ranges of hashes, which add up and send the frequencies back in the same
order, so a part needs no more than its own. A shingle is named by as many bits of its hash as
number the corpus's words, and 20 more, so that one in a million shares its name.
"""

from __future__ import annotations

import ctypes
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import SPACE_CLASS, cut, join_small, partitions, release, text_or_empty

WIDTH = 5
#: Shingles that this many documents hold, the fewest there can be, have the full weight.
LEAST_COMMON = 1
#: Bits of a shingle's name beyond those that number the words of the corpus.
SPARE_BITS = 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 one)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parts_of_text() -> Column:
    return F.filter(F.split(text_or_empty(), SPACE_CLASS + "+", -1), lambda w: w != "")


def node_of(parts: Column) -> Column:
    return F.unhex(F.md5(F.array_join(parts, " ")))


def words(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, node, words): the digest of a document's words and their 32-bit hashes.

    Two given words share a hash once in 2**32, and a shingle mixes five of them into 64 bits.
    """
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"), parts_of_text().alias("parts"))
    return split.select("doc_id", "text_hash", node_of(F.col("parts")).alias("node"), F.transform("parts", lambda w: F.hash(w)).alias("words"))


def shingles(flat: np.ndarray, offsets: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes, less their last ``shift`` bits, of documents whose word hashes are flat[offsets[i]:offsets[i + 1]], and each one's document.

    A document of fewer than five words has one shingle of them all, one without words none.
    """
    w = flat.astype("uint32").astype("uint64")
    sizes = np.diff(offsets)
    n = np.where(sizes >= WIDTH, sizes - WIDTH + 1, (sizes > 0).astype(sizes.dtype))
    doc = np.repeat(np.arange(len(sizes)), n)
    start = np.repeat(offsets[:-1] - (n.cumsum() - n), n) + np.arange(len(doc))
    h = np.zeros(len(doc), "uint64")
    short = np.flatnonzero(sizes[doc] < WIDTH)
    with np.errstate(over="ignore"):
        for j in range(WIDTH):
            there = w[np.minimum(start + j, len(w) - 1)] if len(w) else w
            there[short] = np.where(j < sizes[doc[short]], there[short], np.uint64(j))
            h = h * _ODD + there
    return mix(h) >> np.uint64(shift), doc


def counted(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(found, rank, doc, times): the distinct hashes in order, and per distinct (document, hash), in that order, the hash's number and its repetitions."""
    found, rank = np.unique(h, return_inverse=True)
    pairs, times = np.unique(doc * max(len(found), 1) + rank, return_counts=True)
    doc, rank = np.divmod(pairs, max(len(found), 1))
    return found, rank, doc, times


def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column(batch.schema.get_field_index("words"))
    offsets = lists.offsets.to_numpy().astype("int64")
    return lists.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(batches, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` words each."""
    for batch in batches:
        _, offsets = columns(batch)
        group = offsets[:-1] // most
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(group, group[at], "right"))
            yield batch.slice(at, end - at)
            at = end


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[list]:
    """The rows of a batch one by one, as each may have megabytes; memory that is free afterwards goes back to the system."""
    taken = [batch.column(batch.schema.get_field_index(c)) for c in names]
    for i in range(batch.num_rows):
        yield [c[i].as_py() for c in taken]
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def squeezed(x: np.ndarray) -> bytes:
    """Whole numbers with their first bytes together, then their second ones, and so on, compressed."""
    planes = np.ascontiguousarray(x.view("u1").reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def restored(body: bytes, kind: str) -> np.ndarray:
    n, size = int.from_bytes(body[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(body[8:], n * size, codec="zstd", asbytes=True), "u1").reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


ROWS = "array<struct<doc_id:bigint,text_hash:bigint,node:binary>>"
PART = "sizes binary, known binary, codes binary"


def packed_parts(docs: DataFrame) -> DataFrame:
    """(part, rows, n_words, sizes, known, codes): slices of about a million words as one row each, numbered for good.

    ``known`` are the slice's different words, ``codes`` says which of them stands where.
    """
    fields = [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.binary())]
    schema = pa.schema([("rows", pa.list_(pa.struct(fields))), ("n_words", pa.int64()), *((c, pa.binary()) for c in ("sizes", "known", "codes"))])

    def pack(batches):
        for b in parts(batches):
            flat, offsets = columns(b)
            known, codes = np.unique(flat, return_inverse=True)
            rows = pa.StructArray.from_arrays([b.column(c).cast(t) for c, t in fields], [c for c, _ in fields])
            one = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), rows)
            bodies = [squeezed(x.astype(kind)) for x, kind in ((np.diff(offsets), "<i4"), (known, "<i4"), (codes, "<u4"))]
            yield pa.RecordBatch.from_arrays([one, pa.array([len(flat)], pa.int64()), *(pa.array([x], pa.binary()) for x in bodies)], schema=schema)

    packed = words(docs).mapInArrow(pack, f"rows {ROWS}, n_words long, {PART}")
    return cut(packed.select(F.monotonically_increasing_id().alias("part"), "rows", "n_words", "sizes", "known", "codes"))


def unpacked(sizes: bytes, known: bytes, codes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A slice's words and where each document's begin."""
    return restored(known, "<i4")[restored(codes, "<u4")], np.append(0, restored(sizes, "<i4").astype("int64").cumsum())


def as_steps(rising: np.ndarray) -> bytes:
    """Rising numbers as the first one and the steps between them."""
    steps = np.diff(rising)
    small = not len(steps) or int(steps.max()) < 1 << 32
    return rising[:1].tobytes() + (b"4" if small else b"8") + squeezed(steps.astype("<u4" if small else "<u8"))


def from_steps(body: bytes) -> np.ndarray:
    steps = restored(body[9:], "<u" + chr(body[8]))
    return np.cumsum(np.append(np.frombuffer(body, "<u8", 1), steps), dtype="uint64")


def document_frequencies(packed: DataFrame, ranges: int, shift: int) -> DataFrame:
    """(part, found): the frequencies over all documents of each part's distinct shingles, in order of hashes.

    ``found`` is an array of (range, counts), the counts of a range as squeezed 32-bit integers.
    """
    schema = pa.schema([("range", pa.int32()), ("part", pa.int64()), ("body", pa.binary()), ("counts", pa.binary())])
    edges = np.array([(k << (64 - shift)) // ranges for k in range(1, ranges)], "uint64")

    def send(batches):
        for b in batches:
            for part, *body in rows_of(b, "part", "sizes", "known", "codes"):
                found, rank, _, _ = counted(*shingles(*unpacked(*body), shift))
                n = np.bincount(rank, minlength=len(found)).astype("<u4")
                at = [0, *np.searchsorted(found, edges).tolist(), len(found)]
                pieces = [(k, part, as_steps(found[i:j]), squeezed(n[i:j])) for k, (i, j) in enumerate(itertools.pairwise(at)) if i < j]
                if pieces:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pieces, strict=True), schema, strict=True)], schema=schema)

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        counts = [restored(x, "<u4") for x in frame["counts"]]
        _, place = np.unique(np.concatenate([from_steps(x) for x in frame["body"]]), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts)).astype("<u4")[place]
        back = [squeezed(x) for x in np.split(total, np.cumsum([len(x) for x in counts])[:-1])]
        return pd.DataFrame({"range": frame["range"], "part": frame["part"], "counts": back})

    sent = packed.select("part", "sizes", "known", "codes").mapInArrow(send, "range int, part long, body binary, counts binary")
    back = sent.groupBy("range").applyInPandas(add, "range int, part long, counts binary")
    return back.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("range", "counts"))).alias("found"))


def idf(counts: np.ndarray, n_docs: int) -> np.ndarray:
    """Inverse document frequency as a share of the largest."""
    return np.log1p(n_docs / counts) / np.log1p(n_docs / LEAST_COMMON)


class Sampler:
    """Consistent weighted samples: ``size`` of them, each a hash of the sampled feature and its quantised weight.

    For a feature and a sample, r and c follow Gamma(2, 1) and b is uniform, all drawn from
    tables by bits of a hash of both; the feature with the least ln c - r (t - b + 1) wins,
    where t = floor(ln w / r + b).
    """

    def __init__(self, size: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        gamma = lambda: draw.gamma(2.0, 1.0, 1 << 16).astype("float32")
        self.r, self.log_c, self.b = gamma(), np.log(gamma()), draw.random(1 << 16, "float32")
        self.seeds = draw.integers(1, 1 << 63, size, "uint64") * np.uint64(2) + np.uint64(1)

    def __call__(self, h: np.ndarray, weight: np.ndarray, starts: np.ndarray, block: int = 1 << 15) -> np.ndarray:
        """(samples, documents) uint64; document i has the features from starts[i] to the next, one at least.

        Documents are taken in blocks of features that fit a processor's cache.
        """
        out = np.empty((len(self.seeds), len(starts)), "uint64")
        bounds = np.append(starts, len(h))
        at = 0
        while at < len(starts):
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + block, "right")) - 1)
            own = slice(bounds[at], bounds[end])
            out[:, at:end] = self._block(h[own], np.log(weight[own]).astype("float32"), bounds[at:end] - bounds[at])
            at = end
        return out

    def _block(self, h: np.ndarray, log_w: np.ndarray, starts: np.ndarray) -> np.ndarray:
        low = np.uint64(0xFFFF)
        sizes = np.diff(np.append(starts, len(h)))
        out = np.empty((len(self.seeds), len(starts)), "uint64")
        for k, seed in enumerate(self.seeds):
            with np.errstate(over="ignore"):
                x = h * seed
                x ^= x >> np.uint64(32)
                x *= _ODD
            r = self.r[x >> np.uint64(48)]
            b = self.b[(x >> np.uint64(32)) & low]
            t = np.floor(log_w / r + b)
            a = self.log_c[(x >> np.uint64(16)) & low] - r * (t - b + np.float32(1))
            hit = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), sizes))
            hit = hit[np.searchsorted(hit, starts)]  # the first of equals
            out[k] = mix(h[hit] + t[hit].astype("int64").view("uint64"))
        return out


def band_keys(samples: np.ndarray, rows: int) -> np.ndarray:
    """(bands, documents): a hash of each ``rows`` samples that follow each other."""
    out = []
    with np.errstate(over="ignore"):
        for k in range(0, len(samples), rows):
            h = np.full(samples.shape[1], k, "uint64")
            for s in samples[k : k + rows]:
                h = mix(h * _ODD + s)
            out.append(h)
    return np.array(out)


def signatures(packed: DataFrame, frequencies: DataFrame, firsts: DataFrame, n_docs: int, shift: int, bands: int, rows: int) -> DataFrame:
    """(node, n_features, keys, words, counts) of each node that has words, from the document that stands for it.

    ``firsts`` is (part, place, node). ``counts`` are the document frequencies of a node's
    distinct shingles, in order of hashes.
    """
    sampler = Sampler(bands * rows)

    def run(batches):
        for b in batches:
            for docs, pieces, places, *body in rows_of(b, "rows", "found", "places", "sizes", "known", "codes"):
                w, offsets = unpacked(*body)
                found, rank, doc, times = counted(*shingles(w, offsets, shift))
                known = np.concatenate([restored(p["counts"], "<u4") for p in pieces]) if pieces else np.empty(0, "<u4")
                asked = np.zeros(len(docs), bool)
                asked[places] = True
                asked = asked[doc]
                rank, doc, times = rank[asked], doc[asked], times[asked]
                own, starts = np.unique(doc, return_index=True)
                if not len(own):
                    continue
                counts = known[rank]
                keys = band_keys(sampler(found[rank], idf(counts, n_docs) * times, starts), rows)
                flat_keys = pa.array(np.ascontiguousarray(keys.T).view("int64").ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * bands, pa.int32()), flat_keys)
                as_lists = lambda flat, ends: pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat.astype("int32")))
                texts = as_lists(np.concatenate([w[offsets[i] : offsets[i + 1]] for i in own.tolist()]), np.cumsum(np.diff(offsets)[own]))
                names = [docs[i]["node"] for i in own.tolist()]
                yield pa.RecordBatch.from_pydict({"node": pa.array(names, pa.binary()), "n_features": pa.array(np.add.reduceat(times, starts), pa.int64()), "keys": lists, "words": texts, "counts": as_lists(counts, np.append(starts[1:], len(counts)))})

    asked = firsts.groupBy("part").agg(F.collect_list("place").alias("places"))
    given = packed.join(frequencies, "part").join(asked, "part").select("rows", "found", "places", "sizes", "known", "codes")
    return given.mapInArrow(run, "node binary, n_features long, keys array<long>, words array<int>, counts array<int>")


def buckets(signed: DataFrame) -> DataFrame:
    """(node, bucket, n_features) of buckets with two nodes or more; of buckets with the same nodes one is taken."""
    members = cut(signed.select("node", "n_features", F.posexplode("keys").alias("band", "key")).select("node", "n_features", F.xxhash64("band", "key").alias("bucket")))
    # The sum and xor of two hashes of its members stand for a bucket's set of nodes.
    as_set = [F.sum(F.shiftright(F.xxhash64("node"), 20)).alias("set_sum"), F.bit_xor(F.xxhash64(F.lit("set"), "node")).alias("set_xor")]
    full = members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_features").alias("features"), *as_set).filter("n > 1")
    chosen = full.groupBy("n", "set_sum", "set_xor").agg(F.min("bucket").alias("bucket"), F.first("features").alias("features")).select("bucket", "features")
    return members.join(chosen, "bucket")


def similar_links(nodes: list[bytes], texts: list[np.ndarray], counts: list[np.ndarray], sides: tuple[np.ndarray, np.ndarray], n_docs: int, shift: int, least: float) -> list[tuple[bytes, bytes]]:
    """Links of ``least`` or more that connect the nodes as all such links do.

    Each node of the first side (numbers of nodes) is compared with each of the second, by
    products of feature matrices in slices of columns. The n-th repetition of a shingle is a
    feature.
    """
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    found, rank, owner, times = counted(*shingles(np.concatenate(texts), offsets, shift))
    w = idf(np.concatenate(counts).astype("u4"), n_docs)
    total = np.bincount(owner, w * times, len(nodes))
    begin = np.repeat(np.cumsum(times) - times, times)
    rank, owner, w = (np.repeat(x, times) for x in (rank, owner, w))
    column = rank + (np.arange(len(rank)) - begin) * len(found)
    _, column, held = np.unique(column, return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    order = order[held[column[order]] > 1]
    shared = np.cumsum(held > 1) - 1
    owner, column, w = owner[order], shared[column[order]], np.sqrt(w[order]).astype("float32")
    left, right = sides
    step = max(64, 4_000_000 // len(nodes))
    common = np.zeros((len(left), len(right)), "float32")
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        i, j = np.searchsorted(column, [lo, lo + step])
        m = np.zeros((len(nodes), min(step, int(column[-1]) + 1 - lo)), "float32")
        m[owner[i:j], column[i:j] - lo] = w[i:j]
        common += m[left] @ m[right].T
    root = list(range(len(nodes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    links = []
    for i, row in zip(left.tolist(), common, strict=True):
        similarity = row / (total[i] + total[right] - row)
        for j in right[similarity >= least - 1e-5].tolist():
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                links.append((nodes[i], nodes[j]))
    return links


def verified_links(signed: DataFrame, members: DataFrame, n_docs: int, shift: int, least: float, most_features: int = 1_000_000, most_nodes: int = 256) -> DataFrame:
    """(a, b): links within buckets.

    In a bucket of no more features and nodes than given every pair is compared. A larger one
    is cut into blocks by a hash of the node. Each block is compared with one node of the
    bucket, its pivot: what is linked to that needs no other link among its like. Only the
    nodes that are left over are then compared with every block, again in parts.
    """
    size = F.greatest(F.ceil(F.sum("n_features") / most_features), F.ceil(F.count("*") / most_nodes)).cast("int")
    large = cut(members.groupBy("bucket").agg(size.alias("blocks"), F.min("node").alias("pivot")).filter("blocks > 1"))
    tagged = join_small(members.select("node", "bucket"), large, "bucket", "left", row_bytes=64)
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    wanted = cut(members.select("node").distinct())
    vectors = cut(join_small(signed.select("node", "words", "counts"), wanted, "node", "left_semi", row_bytes=48))

    def gathered(dealt: DataFrame) -> DataFrame:
        """``dealt`` is (node, bucket, i, j, side): the nodes that meet in a task; sides are 0, 1 or, for both, 2."""
        return dealt.join(vectors, "node").groupBy("bucket", "i", "j").applyInPandas(compare, "a binary, b binary")

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        nodes = [bytes(x) for x in frame["node"]]
        side = frame["side"].to_numpy()
        sides = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        return pd.DataFrame(similar_links(nodes, list(frame["words"]), list(frame["counts"]), sides, n_docs, shift, least), columns=["a", "b"])

    none = F.lit(0)
    whole = tagged.filter("blocks is null").select("node", "bucket", none.alias("i"), none.alias("j"), F.lit(2).alias("side"))
    crowd = tagged.filter("blocks is not null")
    in_blocks = crowd.select("node", "bucket", none.alias("i"), block.alias("j"), F.lit(1).alias("side"))
    pivots = large.select(F.col("pivot").alias("node"), "bucket", none.alias("i"), F.explode(F.sequence(none, F.col("blocks") - 1)).alias("j"), none.alias("side"))
    first = cut(gathered(whole.unionByName(in_blocks).unionByName(pivots)))
    if large.isEmpty():
        release(wanted, vectors)
        return first
    # What has a link to the pivot of its bucket is in that one's component.
    hung = first.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select(F.col("x.a").alias("node"), F.col("x.b").alias("pivot")).distinct()
    left_over = cut(crowd.filter("node != pivot").join(hung, ["node", "pivot"], "left_anti").select("node", "bucket"))
    rest = left_over.groupBy("bucket").agg(F.ceil(F.count("*") / most_nodes).cast("int").alias("slices"))
    sliced = crowd.join(rest, "bucket")
    slice_of = F.pmod(F.xxhash64(F.lit("slice"), "node"), F.col("slices")).cast("int")
    one = left_over.join(crowd.select("node", "bucket", "blocks"), ["node", "bucket"]).join(rest, "bucket")
    one = one.select("node", "bucket", slice_of.alias("i"), F.explode(F.sequence(none, F.col("blocks") - 1)).alias("j"), none.alias("side"))
    other = sliced.select("node", "bucket", F.explode(F.sequence(none, F.col("slices") - 1)).alias("i"), block.alias("j"), F.lit(1).alias("side"))
    links = cut(first.unionByName(gathered(one.unionByName(other))))
    release(wanted, vectors, first, left_over)
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; ``links`` is (a, b).

    Alternates large and small stars: neighbours are hung on the smallest node that any of
    them sees, until every node hangs on the root of its component. A round's links are
    written before the next one reads them; their number does not grow.
    """
    edges = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    state = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a < b").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("a", "b"), 24)), F.bit_xor(F.xxhash64("b", "a"))).first()
        if now == state:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a"), F.col("a")).distinct())
        state = now


def classified(docs: DataFrame, least: float = 0.8, bands: int = 12, rows: int = 3) -> DataFrame:
    """What near_duplicates returns, with each row's text_hash."""
    packed = packed_parts(docs)
    placed = packed.select("part", F.posexplode("rows").alias("place", "row")).select("part", "place", "row.*")
    n_docs, n_words = packed.agg(F.coalesce(F.sum(F.size("rows")), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    shift = max(0, 64 - SPARE_BITS - n_words.bit_length())
    # Null comes last; of rows that repeat a doc_id one stands for them.
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "part", "place")
    firsts = cut(placed.groupBy("node").agg(F.min(row).alias("first"), F.count("*").alias("n")))
    frequencies = document_frequencies(packed, max(partitions(docs), n_words // 2_000_000), shift)
    signed = cut(signatures(packed, frequencies, firsts.select("node", "first.part", "first.place"), n_docs, shift, bands, rows))
    members = cut(buckets(signed))
    links = verified_links(signed, members, n_docs, shift, least)
    release(signed, members)
    roots = components(links)
    rooted = firsts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = rooted.groupBy("root").agg(F.min("first").alias("one"), F.sum("n").alias("class_size"))
    of_node = rooted.select("node", "root").join(classes, "root").select("node", "one", "class_size")
    kept = (F.col("part") == F.col("one.part")) & (F.col("place") == F.col("one.place"))
    return placed.join(of_node, "node").select("doc_id", "text_hash", F.col("one.doc_id").alias("class_id"), "class_size", kept.alias("kept"))


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """doc_id, class_id, class_size, kept: one row per row of ``docs``.

    Documents are linked if the weighted Jaccard similarity of their five-word shingles is
    ``least`` or more; classes are the connected components, class_id the smallest doc_id in
    one, and the row with that doc_id is kept. A pair at similarity s shares a band with
    probability 1 - (1 - s**rows)**bands, 0.9998 at 0.8 by default.

    Words are what white space separates. Null text counts as empty; texts without words
    equal each other, and so do texts of the same words. A text of fewer than five words has
    one shingle. A null doc_id is larger than any other. Of rows that repeat a doc_id in a
    class one is kept at most. An empty table gives no rows. Other columns are ignored.
    Parameters are those of classified.
    """
    return classified(docs, **how).drop("text_hash")


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that near_duplicates keeps, with all their columns.

    Nulls, empty and short texts are judged as there. Of rows that repeat a doc_id and its
    text one stays, whichever Spark meets first. Columns may have any names. An empty table
    gives no rows.
    """
    key = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null"))
    keyed = [key.alias("key"), F.col("text_hash").alias("hash")]
    judged = classified(docs, **how).groupBy(*keyed).agg(F.count_if("kept").alias("n_kept"), F.count("*").alias("n"))
    changed = cut(judged.filter("n_kept < n").select("key", "hash", (F.col("n_kept") > 0).alias("one_stays")))
    frame = docs.select(F.struct("*").alias("row"), key.alias("key"), F.xxhash64(text_or_empty()).alias("hash"))
    joined = join_small(frame, changed, ["key", "hash"], "left", row_bytes=72)
    out = joined.filter("one_stays is null").select("row")
    if not changed.filter("one_stays").isEmpty():
        out = out.union(joined.filter("one_stays").groupBy("key", "hash").agg(F.first("row").alias("row")).select("row"))
    return out.select("row.*")
