"""Hard-negative mining with Fagin's threshold algorithm.

Components become integers, floor(256 x); a score is an integer inner product with the anchor; higher
scores come first, ties by smaller id. An anchor's positives are its first rows of the same label. Each
positive opens a window of scores, from `LOW` % of its own score to its own score; the window's
hard negatives are the first rows of other labels inside it.

Candidates lie in blocks of about `BLOCK` rows, by hash. A block carries one list per dimension with its
rows sorted by that component. For an anchor the lists are read from the end that its component's sign
favours, `DEPTH` entries at first and twice as many each time; every row met for the first time is scored
by random access. The threshold, the anchor's product with the last entries read, bounds all rows not met.
An anchor is done with a block once the threshold is strictly below what each of its windows still needs:
the window's kth score so far, or its lower end while fewer are known. (Strictly, as a tie may have a
smaller id.)

Anchors travel in groups of up to `GROUP`. They first visit `FIRST` blocks each; the kth scores found
there are what later visits start from, so that these stop early and return only rows which can still be
among the first. Rows for positives lie in blocks of one label; labels of any size are dealt by hash.

How early the threshold stops depends on the data: for directions without structure in 64 dimensions it
falls slowly, and most rows of a block are met.

Defined cases: rows with a null id, label or vector, with null or non-finite components, with components so
large that a score could leave the range of a long, or with another length than most (ties: the longer) take
no part; repeated rows (same id, label and vector) count once; rows that share an id but not label and
vector are rows of their own, only the anchor's own row is not a candidate (positives that share id and
score are one); an anchor without positives,
and a window without rows (as below score zero, where it is empty), give no rows; an empty table gives
none; other columns, of whatever name, are left out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bound_batches, discard, materialise
from .top_k import whole

K, LOW = 5, 80
#: Rows in a block, about; anchors that travel together, at most; blocks visited first; entries of each list read first.
BLOCK, GROUP, FIRST, DEPTH = 2_048, 1_024, 2, 32
_LEAST = np.iinfo(np.int64).min
CELL = "ids binary, keys binary, labels binary, vecs binary, lists binary"
#: What an anchor looks for: its row in the group, the positive's id and score, the least and the highest score.
WANTED = np.dtype([("anchor", np.int64), ("positive", np.int64), ("score", np.int64), ("least", np.int64), ("most", np.int64)])


def _dense(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _packed(table: pa.Table, dims: int) -> list[bytes]:
    """ids, keys, labels, vectors and sorted lists of a block; numbers as narrow as they fit."""
    table = table.combine_chunks()
    v = _dense(table["v"].combine_chunks(), dims)
    lists = np.argsort(v, axis=0, kind="stable").T.astype(np.int32)
    return [table["id"].to_numpy().tobytes(), table["h"].to_numpy().tobytes(), table["l"].to_numpy().tobytes(), v.tobytes(), np.ascontiguousarray(lists).tobytes()]


def _block(key: tuple, table: pa.Table, by: list[str], dims: int) -> pa.Table:
    cell = [*(pa.array([k.as_py()], k.type) for k in key), *(pa.array([x], pa.binary()) for x in _packed(table, dims))]
    return pa.Table.from_arrays(cell, names=[*by, "ids", "keys", "labels", "vecs", "lists"])


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The first k rows by score, ties by id."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        can = np.flatnonzero(scores >= floor)
        return can[np.lexsort((ids[can], -scores[can]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def searched(q: np.ndarray, of_window: list[np.ndarray], windows: np.ndarray, allowed: np.ndarray, v: np.ndarray, ids: np.ndarray, lists: np.ndarray, k: int) -> tuple[list[tuple[int, int, int]], int]:
    """Threshold algorithm for all anchors of a group over one block. of_window: numbers of each anchor's windows; allowed: rows of the
    block that an anchor may take. Returns window, row, score of the first k rows of each window that can matter, and how many rows were met."""
    anchors, rows = len(q), len(v)
    exact = max(1, int(np.abs(q).max(initial=0))) * max(1, int(np.abs(v).max(initial=0))) * v.shape[1] < 2**53
    vf, qf = (v.astype(np.float64), q.astype(np.float64)) if exact else (v, q)
    met = np.zeros((anchors, rows), bool)
    known_rows: list[list[np.ndarray]] = [[] for _ in range(anchors)]
    known_scores: list[list[np.ndarray]] = [[] for _ in range(anchors)]
    need = np.full(anchors, np.iinfo(np.int64).max)
    for a in range(anchors):
        need[a] = min((int(windows["least"][w]) for w in of_window[a]), default=np.iinfo(np.int64).max)
    # before any access nothing is bounded better than by the best entry of each list
    best = np.where(q >= 0, v[lists[:, -1], np.arange(v.shape[1])], v[lists[:, 0], np.arange(v.shape[1])])
    active = np.flatnonzero((need < np.iinfo(np.int64).max) & (_dot(q, best) >= need))
    at, depth = 0, min(DEPTH, rows)
    while len(active):
        new = np.zeros((len(active), rows), bool)
        threshold = np.zeros(len(active), np.int64)
        for d in range(v.shape[1]):
            up = q[active, d] >= 0
            for side, entries, last in ((up, lists[d, rows - depth : rows - at], lists[d, rows - depth]), (~up, lists[d, at:depth], lists[d, depth - 1])):
                who = np.flatnonzero(side)
                if len(who):
                    new[np.ix_(who, entries)] = True
                    threshold[who] += q[active[who], d] * v[last, d]
        new &= ~met[active]
        met[active] |= new
        going = []
        for n, a in enumerate(active.tolist()):
            fresh = np.flatnonzero(new[n] & allowed[a])
            if len(fresh):
                known_rows[a].append(fresh)
                known_scores[a].append((vf[fresh] @ qf[a]).astype(np.int64))
            if depth < rows:
                s = np.sort(np.concatenate(known_scores[a])) if known_scores[a] else np.zeros(0, np.int64)
                least = []
                for w in of_window[a]:
                    end = int(np.searchsorted(s, windows["most"][w], "right"))
                    kth = int(s[end - k]) if end >= k else _LEAST
                    least.append(max(kth, int(windows["least"][w])))
                if threshold[n] >= min(least):
                    going.append(a)
        active = np.array(going, np.int64)
        at, depth = depth, min(2 * depth, rows)
    out = []
    for a in range(anchors):
        if not known_rows[a]:
            continue
        r, s = np.concatenate(known_rows[a]), np.concatenate(known_scores[a])
        for w in of_window[a]:
            inside = np.flatnonzero((s >= windows["least"][w]) & (s <= windows["most"][w]))
            for x in inside[_best(s[inside], ids[r[inside]], k)].tolist():
                out.append((int(w), int(r[x]), int(s[x])))
    return out, int(met.sum())


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=1)


def _visited(batches: Iterator[pa.RecordBatch], same_label: bool, k: int, dims: int) -> Iterator[pa.RecordBatch]:
    """The first rows of each window in each block that its group visits."""
    for batch in batches:
        for n in range(batch.num_rows):
            cell = {c: batch.column(c)[n].as_py() for c in batch.schema.names if c in ("ids", "keys", "labels", "vecs", "lists", "a_keys", "a_ids", "a_labels", "a_vecs", "windows")}
            number = {c: np.frombuffer(x, WANTED if c == "windows" else np.int32 if c == "lists" else np.int64) for c, x in cell.items()}
            v, q, w = number["vecs"].reshape(-1, dims), number["a_vecs"].reshape(-1, dims), number["windows"]
            allowed = (number["a_labels"][:, None] == number["labels"][None]) == same_label
            if same_label:
                allowed &= (number["a_keys"][:, None] != number["keys"][None]) | (number["a_ids"][:, None] != number["ids"][None])
            order = np.argsort(w["anchor"], kind="stable")
            of_window = np.split(order, np.searchsorted(w["anchor"][order], np.arange(1, len(q))))
            found, _ = searched(q, of_window, w, allowed, v, number["ids"], number["lists"].reshape(dims, -1), k)
            f = np.array(found, np.int64).reshape(-1, 3)
            a = w["anchor"][f[:, 0]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (number["a_keys"][a], number["a_ids"][a], w["positive"][f[:, 0]], w["score"][f[:, 0]], number["ids"][f[:, 1]], f[:, 2])], names=["ak", "anchor_id", "positive_id", "positive_score", "id", "score"])


FOUND = "ak bigint, anchor_id bigint, positive_id bigint, positive_score bigint, id bigint, score bigint"


def _grouped(key: tuple, table: pa.Table, by: list[str], dims: int) -> pa.Table:
    """One row for a group of anchors (w: their windows)."""
    table = table.combine_chunks()
    windows = table["w"].to_pylist()
    packed = np.array([(n, x["positive_id"], x["positive_score"], x["least"], x["most"]) for n, ws in enumerate(windows) for x in ws], WANTED)
    cells = [table["h"].to_numpy().tobytes(), table["id"].to_numpy().tobytes(), table["l"].to_numpy().tobytes(), _dense(table["v"].combine_chunks(), dims).tobytes(), packed.tobytes()]
    return pa.Table.from_arrays([*(pa.array([k.as_py()], k.type) for k in key), *(pa.array([x], pa.binary()) for x in cells)], names=[*by, "a_keys", "a_ids", "a_labels", "a_vecs", "windows"])


GROUPED = "a_keys binary, a_ids binary, a_labels binary, a_vecs binary, windows binary"
WINDOW = "array<struct<positive_id:bigint,positive_score:bigint,least:bigint,most:bigint>>"


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, k: int = K, low: int = LOW, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank (from 1, in the window), negative_id, positive_score, negative_score. is_anchor, label: over the columns of vectors."""
    spark = vectors.sparkSession
    bound_batches(spark)
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(256.0 * x.cast("double")) < F.sqrt(F.lit(2.0**55) / F.size(vec)))  # noqa: E731  100 scores fit into a long
    sound = F.col(vec).isNotNull() & F.col(vec_id).isNotNull() & label.isNotNull() & F.coalesce(F.forall(vec, fits), F.lit(False)) & (F.size(vec) > 0)
    rows = vectors.where(sound).select(F.col(vec_id).cast("bigint").alias("id"), label.cast("bigint").alias("l"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), whole(F.col(vec)).alias("v"))
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    if not most:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    dims = most[0]["n"]
    rows = rows.where(F.size("v") == dims).dropDuplicates(["id", "l", "v"]).withColumn("h", F.xxhash64("id", "l", "v"))
    sizes = rows.groupBy("l").agg(F.count(F.lit(1)).alias("m"), F.count_if("is_anchor").alias("anchors"))
    sizes = materialise(sizes.select("l", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("anchors") / GROUP).cast("int").alias("groups"), "m"), "label-sizes")
    rows = materialise(rows.join(sizes.hint("merge"), "l").select("id", "l", "v", "h", "is_anchor", "blocks", "groups"), "vectors")
    n_blocks = max(1, -(-(sizes.agg(F.sum("m")).first()[0] or 0) // BLOCK))
    anchors = rows.where("is_anchor")
    n_groups = max(1, -(-anchors.count() // GROUP))
    spread = lambda salt, n: F.pmod(F.xxhash64("h", F.lit(salt)), n).cast("int")

    def blocks(of: DataFrame, *by: str) -> DataFrame:
        kinds = ", ".join(f"{c} {t}" for c, t in of.select(*by).dtypes)
        return materialise(of.groupBy(*by).applyInArrow(lambda key, t: _block(key, t, list(by), dims), f"{kinds}, {CELL}"), "vector-blocks")

    def groups(of: DataFrame, *by: str) -> DataFrame:
        kinds = ", ".join(f"{c} {t}" for c, t in of.select(*by).dtypes)
        return of.groupBy(*by).applyInArrow(lambda key, t: _grouped(key, t, list(by), dims), f"{kinds}, {GROUPED}")

    def visited(cells: DataFrame, visits: DataFrame, on: list[str], same_label: bool) -> DataFrame:
        return cells.join(visits.hint("merge"), on).mapInArrow(lambda b: _visited(b, same_label, k, dims), FOUND)

    # positives: every group of a label's anchors visits every block of that label, with one window open at both ends
    own = blocks(rows.where("groups > 0").select("id", "l", "v", "h", F.col("l").alias("label"), spread(3, F.col("blocks")).alias("block")), "label", "block")
    everything = F.array(F.struct(F.lit(0).cast("bigint").alias("positive_id"), F.lit(0).cast("bigint").alias("positive_score"), F.lit(-(2**62)).cast("bigint").alias("least"), F.lit(2**62).cast("bigint").alias("most"))).cast(WINDOW)
    seekers = groups(anchors.select("id", "l", "v", "h", everything.alias("w"), F.col("l").alias("label"), spread(5, F.col("groups")).alias("group"), "blocks"), "label", "group", "blocks")
    seekers = seekers.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    order = Window.partitionBy("ak", "anchor_id").orderBy(F.desc("score"), "id")
    met = visited(own, seekers, ["label", "block"], True).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    positives = met.select("ak", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).distinct()
    windows = F.struct("positive_id", "positive_score", F.ceil(low * F.col("positive_score") / 100).cast("bigint").alias("least"), F.col("positive_score").alias("most"))
    wanted = materialise(positives.where("positive_score >= 0").groupBy("ak", "anchor_id").agg(F.collect_list(windows).cast(WINDOW).alias("w")), "windows")
    discard(own)

    # negatives: blocks of all labels; a few of them first, the rest with what these have shown
    mixed = blocks(rows.select("id", "l", "v", "h", spread(7, F.lit(n_blocks)).alias("block")), "block")
    here = anchors.select("id", "l", "v", "h").join(wanted.hint("merge"), (F.col("h") == F.col("ak")) & (F.col("id") == F.col("anchor_id"))).select("id", "l", "v", "h", "w", spread(9, F.lit(n_groups)).alias("group"))
    here = materialise(here, "anchors")
    begin = F.pmod(F.xxhash64("group"), F.lit(n_blocks)).cast("int")
    place = lambda steps: F.pmod(begin + steps, F.lit(n_blocks)).cast("int")
    early = groups(here, "group").withColumn("block", F.explode(F.transform(F.sequence(F.lit(0), F.lit(min(FIRST, n_blocks) - 1)), place)))
    in_window = ["ak", "anchor_id", "positive_id", "positive_score"]

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy(*in_window).orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = materialise(best(visited(mixed, early, ["block"], False)), "first-negatives")
    if n_blocks > FIRST:
        known = first.where(F.col("rank") == k).select(F.col("ak").alias("h"), F.col("anchor_id").alias("id"), "positive_id", "positive_score", F.col("score").alias("kth"))
        open_now = here.select("h", "id", F.inline("w")).join(known.hint("merge"), ["h", "id", "positive_id", "positive_score"], "left")
        raised = F.struct("positive_id", "positive_score", F.greatest("least", F.coalesce("kth", "least")).alias("least"), "most")
        again = here.drop("w").join(open_now.groupBy("h", "id").agg(F.collect_list(raised).cast(WINDOW).alias("w")).hint("merge"), ["h", "id"])
        rest = groups(again, "group").withColumn("block", F.explode(F.transform(F.sequence(F.lit(FIRST), F.lit(n_blocks - 1)), place)))
        first = best(first.drop("rank").unionByName(visited(mixed, rest, ["block"], False)))
    return first.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
