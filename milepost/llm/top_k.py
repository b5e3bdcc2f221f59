"""Exact top-k by inner product with a pivot-distance index.

Components become integers, floor(256 x). Equal vectors form one class that keeps its k + 1
smallest ids; no result can need more of them. A further coordinate, sqrt(M^2 - |x|^2) with M the
largest norm (0 for queries), turns the largest inner product into the smallest distance. Every
class is keyed by its nearest pivot and by its distance to it, in rings of one width; adjacent rings
of a pivot form annuli of about `BLOCK` classes, and an annulus of more is dealt in blocks by hash.

By the triangle inequality an annulus [lo, hi) of pivot p holds nothing nearer to q than
max(lo - d(q, p), d(q, p) - hi). A query first visits the `FIRST` annuli with the smallest bounds;
its k-th best score there draws the bound of the rest, and annuli that still may hold something
better are visited then, the others never. Queries of one pivot travel together, `GROUP` at a time,
so a visit is one row for a block and a group, and scored by one matrix product in exact integers.

How much the bounds spare depends on the data: of vectors without clusters, such as random ones of
64 dimensions, hardly anything, as the distances to a pivot hardly differ.

Defined cases: vectors that are null, hold null or non-finite components or components so large that
an inner product could leave the range of a long, or have another length than most (ties: the
longer) take no part, as query or as candidate; repeated rows count once; rows without id take no
part; rows that share an id but not their vector are queries and candidates of their own; equal
scores: the smaller id first; fewer than k candidates give as many rows; no candidates give none;
other columns, of whatever name, are left out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bound_batches, materialise

PIVOTS, SAMPLE = 64, 1_024
#: Rings between no distance and twice the largest norm; classes in a block, about; queries that travel together; annuli searched first.
RINGS, BLOCK, GROUP, FIRST = 96, 1_024, 256, 2


def whole(vec: Column) -> Column:
    return F.transform(vec, lambda x: F.floor(F.lit(256.0) * x.cast("double")))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows; by floats where these hold every sum exactly."""
    most = max(1, int(np.abs(a).max(initial=0))) * max(1, int(np.abs(b).max(initial=0))) * a.shape[1]
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 2**53 else a @ b.T


def _distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray, pivot_extra: np.ndarray) -> np.ndarray:
    a, b = x.astype(np.float64), pivots.astype(np.float64)
    d = (a * a).sum(1)[:, None] + (extra**2)[:, None] + (b * b).sum(1)[None] + (pivot_extra**2)[None] - 2 * (a @ b.T + extra[:, None] * pivot_extra[None])
    return np.sqrt(np.maximum(d, 0))


def spread(sample: np.ndarray, extra: np.ndarray, n: int) -> np.ndarray:
    """Numbers of up to n sample rows, each far from those before it."""
    chosen, near = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        near = np.minimum(near, _distances(sample, extra, sample[chosen[-1:]], extra[chosen[-1:]])[:, 0])
        if near.max() <= 0:
            break
        chosen.append(int(np.argmax(near)))
    return np.array(chosen)


class Index:
    """What every task needs to key a vector: pivots, largest norm, ring width; and, from the rings' counts, the annuli.

    annuli: pivot, first ring, last ring, blocks of each; of: the number of the annulus of each pivot and ring."""

    def __init__(self, sample: np.ndarray, norm2: int, classes: int):
        extra = np.sqrt(np.maximum(norm2 - (sample.astype(np.float64) ** 2).sum(1), 0))
        at = spread(sample, extra, min(PIVOTS, max(4, classes // 256)))
        self.norm2, self.pivots, self.extra = norm2, sample[at], extra[at]
        self.width = max(2 * np.sqrt(float(norm2)) / RINGS, 1e-9)
        self.slack = 1e-6 * (1 + np.sqrt(float(norm2)))  # far above rounding, far below what separates integers' distances
        self.annuli, self.of = np.zeros((0, 4), np.int64), np.zeros((len(at), 0), np.int64)

    def arrange(self, counts: dict[tuple[int, int], int]) -> None:
        """counts: classes of each pivot and ring, PIVOTS * (RINGS + 1) entries at most."""
        last = max((r for _, r in counts), default=0)
        self.of = np.zeros((len(self.pivots), last + 1), np.int64)
        annuli, open_pivot = [], -1
        for (p, r), n in sorted(counts.items()):
            if p != open_pivot or annuli[-1][3] + n > BLOCK:
                annuli.append([p, r, r, 0])
                open_pivot = p
            annuli[-1][2] = r
            annuli[-1][3] += n
            self.of[p, r] = len(annuli) - 1
        self.annuli = np.array([[p, a, b, -(-n // (2 * BLOCK))] for p, a, b, n in annuli], np.int64).reshape(-1, 4)

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm2 - (x.astype(np.float64) ** 2).sum(1), 0))
        return _distances(x, extra, self.pivots, self.extra)

    def key(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pivot and ring of each class."""
        d = self.distances(x, False)
        pivot = np.argmin(d, axis=1) if len(x) else np.zeros(0, int)
        return pivot, (d[np.arange(len(x)), pivot] / self.width).astype(np.int64)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The least distance of each query to anything in each annulus."""
        d = self.distances(q, True)[:, self.annuli[:, 0]]
        return np.maximum(0, np.maximum(self.annuli[:, 1] * self.width - d, d - (self.annuli[:, 2] + 1) * self.width))


def _rings(batches: Iterator[pa.RecordBatch], index: Index, dims: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pivot, ring = index.key(_matrix(batch.column("v"), dims))
        yield pa.RecordBatch.from_arrays([pa.array(pivot, pa.int32()), pa.array(ring, pa.int32())], names=["pivot", "ring"])


def _cells(batches: Iterator[pa.RecordBatch], index: Index, dims: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch.column("v"), dims)
        annulus = index.of[index.key(x)] if len(x) else np.zeros(0, np.int64)
        block = np.mod(batch.column("h").to_numpy(), index.annuli[annulus, 3]) if len(x) else annulus
        yield pa.RecordBatch.from_arrays([pa.array(annulus, pa.int32()), pa.array(block, pa.int32()), pa.array([r.tobytes() for r in x], pa.binary()), batch.column("ids")], names=["annulus", "block", "vec", "ids"])


def _visits(batches: Iterator[pa.RecordBatch], index: Index, dims: int, later: bool) -> Iterator[pa.RecordBatch]:
    """For each annulus the queries that visit it, packed: those it is among the nearest for, or later those its bound reaches."""
    names = ["annulus", "block", "keys", "ids", "vecs"]
    for batch in batches:
        q = _matrix(batch.column("v"), dims)
        if not len(q):
            continue
        least = index.bounds(q)
        order = np.argsort(least, axis=1, kind="stable")[:, :FIRST]
        visit = np.zeros(least.shape, bool)
        np.put_along_axis(visit, order, True, axis=1)
        if later:
            kth = batch.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)  # null: nan
            limit = np.sqrt(np.maximum(0, (q.astype(np.float64) ** 2).sum(1) + float(index.norm2) - 2 * kth))
            visit = ~visit & ~(least > limit[:, None] + index.slack)
        near = np.argmin(index.distances(q, True), axis=1)
        keys, ids = batch.column("qk").to_numpy(), batch.column("query_id").to_numpy()
        for a in np.flatnonzero(visit.any(axis=0)).tolist():
            who = np.flatnonzero(visit[:, a])
            who = who[np.argsort(near[who], kind="stable")]
            rows = [[a, b, keys[w].tobytes(), ids[w].tobytes(), q[w].tobytes()] for w in np.array_split(who, -(-len(who) // GROUP)) for b in range(int(index.annuli[a, 3]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=names)


def _searched(batches: Iterator[pa.RecordBatch], k: int, dims: int) -> Iterator[pa.RecordBatch]:
    """The k best candidates of one block for each query of a group."""
    for batch in batches:
        for row in range(batch.num_rows):
            cell = {c: batch.column(c)[row] for c in batch.schema.names}
            keys, qids, q = (np.frombuffer(cell[c].as_py(), np.int64) for c in ("keys", "ids", "vecs"))
            members = cell["members"].values
            ids = members.field("ids")
            v = np.frombuffer(b"".join(members.field("vec").to_pylist()), np.int64).reshape(-1, dims)
            id_at, flat = ids.offsets.to_numpy() - ids.offsets[0].as_py(), ids.flatten().to_numpy()
            low = np.minimum.reduceat(flat, id_at[:-1])
            order = np.argsort(low, kind="stable")
            s = _product(q.reshape(-1, dims), v[order])
            out: list[list] = [[], [], [], []]
            if s.shape[1] > 4 * (k + 1):  # what can't be among the k + 1 best stays out of the sort
                floor = np.partition(s, s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1]
            else:
                floor = np.full(len(s), np.iinfo(np.int64).min)
            for scores, key, qid, f in zip(s, keys.tolist(), qids.tolist(), floor):
                can = np.flatnonzero(scores >= f)
                best = can[np.argsort(-scores[can], kind="stable")[: k + 1]]
                found = sorted((-int(scores[j]), x) for j in best for x in flat[id_at[order[j]] : id_at[order[j] + 1]].tolist() if x != qid)[:k]
                out[0] += [key] * len(found)
                out[1] += [qid] * len(found)
                out[2] += [x for _, x in found]
                out[3] += [-x for x, _ in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["qk", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score. is_query: over the columns of vectors."""
    spark = vectors.sparkSession
    bound_batches(spark)
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(256.0 * x.cast("double")) < F.sqrt(F.lit(2.0**62) / F.size(vec)))
    sound = F.col(vec).isNotNull() & F.col(vec_id).isNotNull() & F.coalesce(F.forall(vec, fits), F.lit(False)) & (F.size(vec) > 0)
    rows = vectors.where(sound).select(F.col(vec_id).cast("bigint").alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"), whole(F.col(vec)).alias("v"))
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    if not most:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    dims = most[0]["n"]
    rows = rows.where(F.size("v") == dims).dropDuplicates(["id", "v"])
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    classes = rows.select("id", "v").withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("v").agg(F.collect_list("id").alias("ids"))
    classes = materialise(classes.withColumn("h", F.xxhash64("v")), "vector-classes")
    norm2 = F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x * x)
    size = classes.agg(F.max(norm2).alias("m"), F.count(F.lit(1)).alias("n")).collect()[0]
    sample = np.array([r["v"] for r in classes.select("v", "h").orderBy("h", "v").limit(SAMPLE).collect()], np.int64)
    index = Index(sample, size["m"], size["n"])
    counts = classes.mapInArrow(lambda b: _rings(b, index, dims), "pivot int, ring int").groupBy("pivot", "ring").count().collect()
    index.arrange({(r["pivot"], r["ring"]): r["count"] for r in counts})
    cells = classes.mapInArrow(lambda b: _cells(b, index, dims), "annulus int, block int, vec binary, ids array<bigint>")
    # a block is one row; it holds about BLOCK classes, as many as rings and hash allow
    cells = materialise(cells.groupBy("annulus", "block").agg(F.collect_list(F.struct("vec", "ids")).alias("members")), "vector-cells")
    queries = rows.where("q").select(F.col("id").alias("query_id"), F.xxhash64("id", "v").alias("qk"), "v")
    packed = "annulus int, block int, keys binary, ids binary, vecs binary"
    order = Window.partitionBy("query_id", "qk").orderBy(F.desc("score"), "vec_id")

    def searched(visits: DataFrame) -> DataFrame:
        met = cells.join(visits, ["annulus", "block"])
        return met.mapInArrow(lambda b: _searched(b, k, dims), "qk bigint, query_id bigint, vec_id bigint, score bigint")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = materialise(best(searched(queries.mapInArrow(lambda b: _visits(b, index, dims, False), packed))), "vector-first")
    known = first.where(F.col("rank") == k).select("query_id", "qk", F.col("score").alias("kth"))
    later = queries.join(known, ["query_id", "qk"], "left").select("query_id", "qk", "v", "kth").mapInArrow(lambda b: _visits(b, index, dims, True), packed)
    found = best(first.drop("rank").unionByName(searched(later)))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
