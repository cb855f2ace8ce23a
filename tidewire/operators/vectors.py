"""Vector search in cells: exact joins in blocks, an index with measured recall, ordered leaders.

Queries and vectors are both tables (id, vector). They meet by cell in blocks of bounded
size, as a join of keys (cell, block of queries, block of vectors); no vector passes through
the driver but a bounded sample from which centres of cells are fitted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.relational import first_per
from tidewire.operators.steps import freed, written

#: Queries and vectors that meet in one task at most, about.
BLOCK = (8_000, 8_000)
#: Rows that a task gives out, and scores that it holds, at once.
ROWS, SCORES = 10_000, 1_000_000
#: Vectors that are searched first for an earlier neighbour.
BAND = 16_000
#: Cells at most: their centres go to every task.
MOST_CELLS = 4_096
#: Vectors that cells are fitted on and probes measured on, at most.
SAMPLE = 20_000


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def angles(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units(vectors) @ centres.T, -1, 1))


def usable(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("id").cast("long").alias("id"), "vector").filter("id is not null and vector is not null")


def block(n: Column) -> Column:
    return F.pmod(F.xxhash64("id"), n).cast("int")


def meet(asked: DataFrame, held: DataFrame, least: float | None = None, k: int | None = None, most: tuple[int, int] = BLOCK) -> DataFrame:
    """(query_id, id, score) of what meets in cells; both sides are (cell, id, vector), of at most MOST_CELLS cells.

    Per block the best ``k`` of each query, or all pairs of ``least`` or more. A cell is cut into as many
    blocks as its size asks for, on both sides, so that a task has no more than ``most``.
    """

    def sizes(side: DataFrame, name: str, of: int) -> DataFrame:
        return side.groupBy("cell").agg(F.ceil(F.count("*") / of).cast("int").alias(name))

    blocks = F.broadcast(sizes(asked, "q_blocks", most[0]).join(sizes(held, "v_blocks", most[1]), "cell"))  # a row per cell
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(blocks, "cell").select("cell", block(F.col("q_blocks")).alias("i"), upto("v_blocks").alias("j"), "id", "vector", F.lit(True).alias("asks"))
    right = held.join(blocks, "cell").select("cell", upto("q_blocks").alias("i"), block(F.col("v_blocks")).alias("j"), "id", "vector", F.lit(False).alias("asks"))

    def score(table: pa.Table) -> pa.Table:
        found = []
        asks = table.column("asks").to_numpy()
        both, rows = table.column("id").to_numpy(), matrix(table.column("vector"))
        all_ids, all_q, ids, v = both[asks], rows[asks], both[~asks], rows[~asks]
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], v[order]
        step, norm = max(1, SCORES // max(1, len(ids))), np.linalg.norm(v, axis=1)
        for lo in range(0, len(all_ids) if len(ids) else 0, step):
            q_ids, q = all_ids[lo : lo + step], all_q[lo : lo + step]
            s = q @ v.T
            s /= np.linalg.norm(q, axis=1)[:, None] * norm[None, :] + 1e-9
            if least is not None:
                i, j = np.nonzero((s >= least) & (q_ids[:, None] != ids[None, :]))
            else:
                s[q_ids[:, None] == ids[None, :]] = -np.inf
                i, j = best_places(s, k)
            found.append((q_ids[i], ids[j], s[i, j]))
        parts = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0)] * 3
        return pa.table({"query_id": pa.array(parts[0], pa.int64()), "id": pa.array(parts[1], pa.int64()), "score": pa.array(parts[2], pa.float64())})

    return left.unionByName(right).groupBy("cell", "i", "j").applyInArrow(score, "query_id long, id long, score double")


def best_places(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's ``k`` best finite scores, of equal ones (to nine digits) the first.

    Only what reaches a row's k-th score is sorted, not the row.
    """
    k = min(k, s.shape[1])
    s = np.where(np.isfinite(s), s, -np.inf)
    kth = np.partition(s, -k, axis=1)[:, -k]
    # What is equal to the k-th when rounded may lie a little below it.
    i, j = np.nonzero((s >= (kth - 2e-9)[:, None]) & (s > -np.inf))
    order = np.lexsort((j, -np.round(s[i, j], 9), i))
    i, j = i[order], j[order]
    first = np.searchsorted(i, np.arange(len(s)))
    taken = np.arange(len(i)) - first[i] < k
    return i[taken], j[taken]


def best_of(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query's scores, equal ones by id."""
    return first_per(scores, k, ["query_id"], F.desc(F.round("score", 9)), F.col("id"))


def vector_scores(queries: DataFrame, vectors: DataFrame, least: float | None = None, k: int | None = None, most: tuple[int, int] = BLOCK) -> DataFrame:
    """(query_id, id, score): cosine of every query with every vector, exact; the best ``k`` of each, or those of ``least`` and more."""
    one = F.lit(0).alias("cell")
    found = meet(usable(queries).select(one, "*"), usable(vectors).select(one, "*"), least, k, most=most)
    return found if k is None else best_of(found, k)


# ---- cells


def fitted(vectors: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Centres of cells by spherical k-means over at most ``sample`` vectors (those of the smallest hashes), and that sample."""
    taken = usable(vectors).orderBy(F.xxhash64("id"), "id").limit(min(sample, SAMPLE)).toArrow()
    points = units(matrix(taken.column("vector")))
    centres = points[: min(cells, MOST_CELLS)].copy()
    for _ in range(rounds if len(points) else 0):
        nearest = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        held = np.bincount(nearest, minlength=len(centres)) > 0
        centres[held] = units(sums[held])
    return centres, points


def probes_for(centres: np.ndarray, points: np.ndarray, recall: float, k: int, queries: int = 500) -> int:
    """The fewest cells to probe so that of each query's ``k`` nearest points ``recall`` are found, measured on the sample."""
    if len(points) < 2:
        return 1
    cell = (points @ centres.T).argmax(axis=1)
    asked = points[:queries]
    s = asked @ points.T
    s[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = np.argsort(-s, axis=1)[:, : min(k, len(points) - 1)]
    rank = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)
    needed = np.sort(rank[np.arange(len(asked))[:, None], cell[near]].ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def in_cells(vectors: DataFrame, centres: np.ndarray, probes: int | None = None) -> DataFrame:
    """(cell, id, vector, angle): each vector with its nearest cell, or with its ``probes`` nearest."""

    # A vector may come out in many cells, so what is given out and the angles, not what is read, bound a step.
    out = min(probes or 1, len(centres))
    step = max(1, min(ROWS // max(1, out), SCORES // max(1, len(centres))))

    def assign(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                a = angles(matrix(batch.column(1)), centres)
                if probes is None:
                    row, cell = np.arange(len(a)), a.argmin(axis=1)
                else:
                    n = min(probes, a.shape[1])
                    row, cell = np.repeat(np.arange(len(a)), n), np.argsort(a, axis=1, kind="stable")[:, :n].ravel()
                picked = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), picked.column(0), picked.column(1), pa.array(a[row, cell])], ["cell", "id", "vector", "angle"])

    frame = usable(vectors)
    return frame.mapInArrow(assign, f"cell int, id long, vector {dict(frame.dtypes)['vector']}, angle double")


@dataclass
class CellIndex:
    """Vectors written by cell in a folder that driver and executors share."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    probes: int

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None, recall: float = 0.95, k: int = 10) -> CellIndex:
        """Fits centres (the root of the number of vectors by default) and probes on a sample of at most SAMPLE vectors, and writes every vector."""
        centres, points = fitted(vectors, cells or max(1, round(vectors.count() ** 0.5)))
        probes = probes_for(centres, points, recall, k)
        spark = vectors.sparkSession
        rows = [(i, c.tolist(), probes) for i, c in enumerate(centres)]
        spark.createDataFrame(rows, "cell int, centre array<double>, probes int").coalesce(1).write.parquet(f"{path}/centres")
        index = cls(spark, path, centres, probes)
        index.append(vectors)
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> CellIndex:
        """An index that was built before."""
        rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
        return cls(spark, path, np.array([r["centre"] for r in rows]), rows[0]["probes"] if rows else 1)

    def append(self, vectors: DataFrame) -> None:
        """More vectors for the cells that are there; a cell's rows come in as many files as their number asks for."""
        placed = in_cells(vectors, self.centres).drop("angle")
        placed.repartition("cell", block(F.lit(8))).write.mode("append").partitionBy("cell").parquet(f"{self.path}/vectors")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors").select("cell", "id", "vector")

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        """(query_id, id, score): the best ``k`` of the cells nearest to each query. With as many probes as cells the result is exact.

        Where every cell is probed the cells' rows meet the queries in blocks, as a copy of each
        query per cell would grow with the number of cells.
        """
        if (probes or self.probes) >= len(self.centres):
            return vector_scores(queries, self.rows(), k=k)
        asked = in_cells(queries, self.centres, probes or self.probes).drop("angle")
        return best_of(meet(asked, self.rows(), k=k), k)


# ---- ordered leaders


def packed(rows: DataFrame, blocks: int) -> DataFrame:
    """(low, high, ids, vectors): rows (cell, id, vector) as about so many blocks, a row each, of near cells; ids from low to high."""
    kind = "f4" if dict(rows.dtypes)["vector"] == "array<float>" else "f8"

    def pack(batches):
        found = [b for b in batches if b.num_rows]
        table = pa.Table.from_batches(found) if found else None
        for lo in range(0, table.num_rows if found else 0, BLOCK[0]):
            part = table.slice(lo, BLOCK[0]).sort_by("id")
            ids = part.column("id").to_numpy()
            packs = [ids[0], ids[-1], ids.tobytes(), matrix(part.column("vector")).astype(kind).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in packs], ["low", "high", "ids", "vectors"])

    return rows.repartitionByRange(blocks, "cell", "id").select("id", "vector").mapInArrow(pack, "low long, high long, ids binary, vectors binary")


def _first_in_blocks(asked: DataFrame, held: DataFrame, n_asked: int, n_held: int, least: float) -> DataFrame:
    """(query_id, id): the first of ``held`` at ``least`` or more that is earlier, for those of ``asked`` that have one.

    Every block meets every block as they lie in their files, so nothing is shuffled but the
    vectors once. Two blocks that lie further apart than the angle of ``least`` are passed over.
    """
    kind = "f4" if dict(asked.dtypes)["vector"] == "array<float>" else "f8"
    width = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = written(packed(asked, max(-(-n_asked // BLOCK[0]), min(width, -(-n_asked // 1_000)))))
    right = written(packed(held, -(-n_held // BLOCK[1]))).toDF("v_low", "v_high", "v_ids", "v_vectors")
    pairs = left.hint("shuffle_replicate_nl").join(right, F.col("v_low") < F.col("high")).select("ids", "vectors", "v_ids", "v_vectors")

    def search(batches):
        for batch in batches:
            for q_ids, q, ids, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q_ids, ids = np.frombuffer(q_ids, "i8"), np.frombuffer(ids, "i8")
                q, v = (np.frombuffer(x, kind).reshape(len(n), -1).astype("f8") for x, n in ((q, q_ids), (v, ids)))
                i, j = _first_near(q_ids, q, ids, v, least)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(ids[j])], ["query_id", "id"])

    return pairs.mapInArrow(search, "query_id long, id long").groupBy("query_id").agg(F.min("id").alias("id"))


def _first_near(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of queries and of the first earlier vector at a cosine of ``least`` or more; both sides are in order of id.

    Single precision picks what may reach ``least``, by more than its error, and the cosine in
    double precision decides.
    """
    nothing = np.empty(0, "int64"), np.empty(0, "int64")
    q_unit, v_unit = units(q), units(v)
    middle, other = (units(u.mean(axis=0, keepdims=True)) for u in (q_unit, v_unit))
    reach = sum(angles(u, m).max() for u, m in ((q_unit, middle), (v_unit, other)))
    if angles(middle, other)[0, 0] > reach + np.arccos(min(1.0, least)) + 1e-6:
        return nothing
    q_norm, v_norm = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
    q_unit, v_unit = q_unit.astype("f4"), np.ascontiguousarray(v_unit.astype("f4").T)
    margin = 1e-5 + q.shape[1] * 2.0**-22
    before = np.searchsorted(ids, q_ids)
    found = [nothing]
    step = max(1, SCORES // max(1, len(ids)))
    for lo in range(0, len(q_ids), step):
        most = before[min(lo + step, len(q_ids)) - 1]
        if not most:
            continue
        near = q_unit[lo : lo + step] @ v_unit[:, :most] >= np.float32(least - margin)
        i = np.arange(len(near))
        while len(i):
            j = near[i].argmax(axis=1)
            i, j = (x[near[i, j] & (j < before[lo + i])] for x in (i, j))
            s = np.einsum("ij,ij->i", q[lo + i], v[j]) / (q_norm[lo + i] * v_norm[j] + 1e-9)
            found.append((lo + i[s >= least], j[s >= least]))
            i, j = i[s < least], j[s < least]
            near[i, j] = False
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def first_earlier(asked: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """(query_id, id): the first earlier neighbour in ``held``; both sides are (cell, id, vector).

    The first BAND vectors are searched first, then as many as all before; what has found its neighbour asks no more.
    """
    freed(held.sparkSession)
    n, share, shares = held.count(), None, []
    while (share := 2 * share if share else BAND / max(1, n)) < 1:
        shares.append(share)
    cuts = sorted({int(c) for c in held.approxQuantile("id", shares, 0.001)}) if shares else []
    out = None
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        band = held if lo is None else held.filter(F.col("id") >= lo)
        band = band if hi is None else band.filter(F.col("id") < hi)
        asked = asked if lo is None else asked.filter(F.col("id") > lo)
        n_asked, n_held = asked.count(), band.count()
        if not n_asked:
            break
        found = written(_first_in_blocks(asked, band, n_asked, max(1, n_held), least))
        out = found if out is None else out.unionByName(found)
        if hi is not None:
            asked = written(asked.join(found.select(F.col("query_id").alias("id")), "id", "left_anti").select(asked.columns))
    return asked.select(F.col("id").alias("query_id"), "id").limit(0) if out is None else out


def leaders(vectors: DataFrame, least: float = 0.85, cells: int | None = None, few: int = 20_000) -> DataFrame:
    """(id, leader): each vector in order of id leads unless an earlier leader is at a cosine of ``least`` or more; it then belongs to the first.

    The result is that of going through the vectors one by one. In a round, vectors without an
    undecided earlier neighbour lead and their neighbours are decided. When ``few`` or fewer
    are undecided, one task goes through them, so that long chains end. Equal vectors count as
    one. Vectors of near cells share a block, and blocks meet unless they lie too far apart.
    """
    if least <= 0:
        raise ValueError("least must be positive")
    distinct = written(usable(vectors).groupBy("vector").agg(F.min("id").alias("id")).select("id", "vector"))
    centres, _ = fitted(distinct, cells or min(MOST_CELLS, max(1, round(distinct.count() ** 0.5))))
    placed = written(in_cells(distinct, centres).drop("angle"))
    undecided, leading = placed, None
    while undecided.count() > few:
        behind = first_earlier(undecided, undecided, least).select(F.col("query_id").alias("id"))
        new = written(undecided.join(behind, "id", "left_anti").select(placed.columns))
        leading = new if leading is None else leading.unionByName(new)
        rest = written(undecided.join(new.select("id"), "id", "left_anti").select(placed.columns))
        near = first_earlier(rest, new, least).select(F.col("query_id").alias("id"))
        undecided = written(rest.join(near, "id", "left_anti").select(placed.columns))
    last = undecided.repartition(1).mapInArrow(_greedy(least), undecided.schema)
    leading = written(last if leading is None else leading.unionByName(last))
    # A leader has no leader before it within reach, so only the others ask.
    led = written(placed.join(leading.select("id"), "id", "left_anti").select(placed.columns))
    of = first_earlier(led, leading, least).select(F.col("query_id").alias("own"), F.col("id").alias("leader"))
    leads = leading.select("id", F.lit(True).alias("leads"))
    labelled = written(distinct.join(of, F.col("id") == F.col("own"), "left").join(leads, "id", "left").select("id", "vector", F.when(F.col("leads"), F.col("id")).otherwise(F.col("leader")).alias("leader")))
    # A vector that many rows repeat is one row here; its copies are dealt out by the join as they come.
    copies = usable(vectors).join(labelled.withColumnRenamed("id", "first"), "vector").filter("id != first").select("id", "leader")
    return labelled.select("id", "leader").unionByName(copies)


def _greedy(least: float):
    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches).sort_by("id").combine_chunks()
        v = matrix(table.column("vector"))
        norm = np.linalg.norm(v, axis=1)
        free, chosen = np.ones(len(v), bool), []
        for i in range(len(v)):
            if free[i]:
                chosen.append(i)
                free[i:] &= v[i:] @ v[i] / (norm[i:] * norm[i] + 1e-9) < least
        yield from table.take(pa.array(chosen)).to_batches()

    return run
