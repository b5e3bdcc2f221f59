"""N-gram Jaccard join with Bayesian candidate pruning.

Shingles are runs of 5 words (a text of 1 to 4 words is one shingle). Texts with equal shingle
sets form a class. Candidates are classes that share a bucket of a MinHash band. In each bucket
all pairs are walked inside a task, sizes first, then MinHash values a few at a time: with m of n
values equal the similarity has the posterior Beta(m + 1, n - m + 1), and a pair is dropped as soon
as the chance that it reaches the threshold falls below `TOLERANCE`. No pairs are listed: a task
returns, for each class that is left with a partner, one link to the smallest of its part. Of
buckets with equal members one is walked, and buckets of more than `MOST` classes are dealt in
blocks, every two of which meet in a task.

The links' components hold classes that are likely to be similar, so texts move only here: blocks
of a component meet, pairs are pruned again, and what is left is compared exactly. Tasks return,
for each class, how many documents it is linked to and one link to the block's part of its group.

With 30 bands of 5 values a pair at similarity 0.8 shares no bucket with chance 7e-6.

Defined cases: null and wordless texts have no shingles, no links and stand alone; repeated rows
and equal texts are one class and linked to each other; a null doc_id is an id like others, but
only counts as smallest if there is no other; very long texts are one class like others, read in
one piece; an empty table gives no rows; other columns, of whatever name, are left alone or, by
near_duplicates, not returned."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Words, bound_batches, discard, likely, materialise, mixed, slices, text_key, whole_groups

SHINGLE, THRESHOLD = 5, 0.8
BANDS, PER_BAND = 30, 5
HASHES, STEP, TOLERANCE = BANDS * PER_BAND, 15, 1e-6
#: Classes in a block: at least, and at most.
BLOCK, MOST = 96, 1_024
#: Rows and pairs that a task walks together.
ROWS, PAIRS = 4_096, 1 << 17

_rng = np.random.default_rng(20240101)
_MULTIPLY = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_FLIP = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """For each text its distinct shingles as sorted 64-bit hashes."""
    words = Words(column)
    grams, whole = words.grams(SHINGLE)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for x in words.hashes[a:b]:
                h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + x)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES MinHash values."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(low), 4096):
        part = (low[None, i : i + 4096] ^ _FLIP[:, None]) * _MULTIPLY[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def fewest_matches(threshold: float) -> list[int]:
    """For 15, 30, ... values compared, the fewest equal ones that keep a pair alive."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        # P(similarity >= t | m of n) is the chance of at most m successes in n + 1 trials at t
        total, m = 0.0, 0
        while m <= n:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= TOLERANCE:
                break
            m += 1
        out.append(m)
    return out


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            sets = shingle_sets(batch.column("text"))
            names, sigs, sizes = [], [], np.array([len(s) for s in sets], np.int64)
            for s in sets:
                if len(s):
                    a, b = mixed(s), mixed(s + np.uint64(0x632BE59BD9B4E019))
                    names.append(np.array([a.sum(dtype=np.uint64), np.bitwise_xor.reduce(b) + np.uint64(len(s))], np.uint64).tobytes())
                    sigs.append(signature(s).tobytes())
                else:
                    names.append(None)
                    sigs.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tk"), pa.array(names, pa.binary()), pa.array(sizes), pa.array(sigs, pa.binary())], names=["id", "tk", "c", "n", "sig"])


def _pairs(block: np.ndarray, own: np.ndarray, first: np.ndarray, n: np.ndarray, both: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers a < b of the pairs to walk in each group (rows first .. first + n), about PAIRS at a time: all pairs, or where
    both, those of two blocks."""
    a = np.arange(len(block))
    later = first[own] + n[own] - a - 1
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(np.cumsum(later[at:]), PAIRS)) + at)
        rows, k = a[at:to], later[at:to]
        left = np.repeat(rows, k)
        right = left + 1 + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        meet = ~both[own[left]] | (block[left] != block[right])
        yield left[meet], right[meet]
        at = to


def pruned(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, sigs: np.ndarray, threshold: float, fewest: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that may reach the threshold, by sizes and then by MinHash values, STEP of them at a time."""
    fit = np.minimum(sizes[left], sizes[right]) >= threshold * np.maximum(sizes[left], sizes[right]) - 1e-9
    left, right = left[fit], right[fit]
    equal = np.zeros(len(left), np.int64)
    for step, least in enumerate(fewest):
        if not len(left):
            break
        part = slice(step * STEP, (step + 1) * STEP)
        equal = equal + (sigs[left, part] == sigs[right, part]).sum(axis=1)
        on = equal >= least
        left, right, equal = left[on], right[on], equal[on]
    return left, right


def _likely(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links between the classes of each bucket that pruning leaves: one for each class, to the smallest of its part."""
    fewest = fewest_matches(threshold)
    for rows in whole_groups(batches, "g", ROWS):
        g, k, block, sizes = (rows.column(c).to_numpy() for c in ("g", "k", "block", "n"))
        sigs = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        n = np.diff(np.append(first, len(g)))
        own = np.repeat(np.arange(len(first)), n)
        both = rows.column("both").to_numpy(zero_copy_only=False)[first]
        label = np.arange(len(g))

        def root(x: int) -> int:
            while label[x] != x:
                label[x] = label[label[x]]
                x = label[x]
            return x

        for left, right in _pairs(block, own, first, n, both):
            for a, b in zip(*(x.tolist() for x in pruned(left, right, sizes, sigs, threshold, fewest))):
                a, b = root(a), root(b)
                if a != b:
                    label[max(a, b)] = min(a, b)
        to = np.array([root(x) for x in range(len(g))])
        head = np.full(len(g), np.iinfo(np.int64).max)
        np.minimum.at(head, to, k)
        on = head[to] != k
        yield pa.RecordBatch.from_arrays([pa.array(k[on]), pa.array(head[to][on])], names=["a", "b"])


def likely_links(classes: DataFrame, threshold: float) -> DataFrame:
    """classes: k, n, sig. Returns a, b with a > b: links whose components hold every pair that may reach the threshold."""
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("sig", b * (4 * PER_BAND) + 1, F.lit(4 * PER_BAND)))))
    bands = classes.select("k", band.alias("g"))
    several = bands.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("k", F.lit(3))).alias("x"), F.bit_xor(F.xxhash64("k", F.lit(5))).alias("y")).where("m > 1")
    # of buckets with equal members one is enough
    walked = materialise(several.groupBy("m", "x", "y").agg(F.min("g").alias("g")).select("g", "m"), "buckets")
    blocks = F.ceil(F.col("m") / MOST).cast("int")
    met = bands.join(walked.hint("merge"), "g").select("g", "k", blocks.alias("blocks"), F.pmod(F.xxhash64("k", F.lit(9)), blocks).cast("int").alias("block"))
    met = materialise(met, "bucket-members")
    rows = met.join(classes.hint("merge"), "k").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    rows = rows.select(F.when(F.col("blocks") > 1, F.xxhash64("g", i, j)).otherwise(F.col("g")).alias("g"), "k", "block", "n", "sig", i.alias("i"), j.alias("j")).withColumn("both", F.col("i") != F.col("j"))
    links = rows.select("g", "k", "block", "n", "sig", "both").repartition("g").sortWithinPartitions("g").mapInArrow(lambda b: _likely(b, threshold), "a bigint, b bigint")
    links = materialise(links, "likely-links")
    discard(walked, met)
    return links


def components(links: DataFrame) -> DataFrame:
    """links: a, b with a > b. Returns a, b with b the smallest member of a's component (b itself has no row)."""
    edges = materialise(links.distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        larger = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        larger = materialise(larger, "larger")
        least = materialise(larger.groupBy("a").agg(F.min("b").alias("m")), "least")
        smaller = larger.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        before, edges = edges, materialise(smaller.distinct(), "links")
        discard(before, low, larger, least)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if now == state:
            return edges
        state = now


def _met(key: tuple, table: pa.Table, threshold: float) -> pa.Table:
    """All pairs of two blocks (or within one): links of each class and its part of the group."""
    i, j = key[1].as_py(), key[2].as_py()
    table = table.combine_chunks()
    names, sizes, block = table["c"].to_pylist(), table["docs"].to_numpy(), table["block"].to_numpy()
    sets = []
    for chunk in table.to_batches(max_chunksize=256):
        for part in slices(chunk, "text"):
            sets += shingle_sets(part.column(part.schema.get_field_index("text")))
    n = np.array([len(s) for s in sets])
    sigs = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(-1, HASHES)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int64)
    at = np.concatenate([[0], np.cumsum(n)])
    mark = np.zeros(int(flat.max(initial=0)) + 1, bool)
    fewest = fewest_matches(threshold)
    label = np.arange(len(n))
    classes, docs = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    rows = np.flatnonzero(block == i)
    for k, a in enumerate(rows):
        others = rows[k + 1 :] if i == j else np.flatnonzero(block == j)
        others = pruned(np.full(len(others), a), others, n, sigs, threshold, fewest)[1]
        if not len(others):
            continue
        mark[flat[at[a] : at[a + 1]]] = True
        ends = np.cumsum(n[others])
        own = np.arange(ends[-1]) + np.repeat(at[others] - (ends - n[others]), n[others])
        shared = np.add.reduceat(mark[flat[own]].astype(np.int64), ends - n[others])
        mark[flat[at[a] : at[a + 1]]] = False
        linked = others[shared / (n[a] + n[others] - shared) >= threshold]
        if len(linked):
            classes[a] += len(linked)
            docs[a] += sizes[linked].sum()
            classes[linked] += 1
            docs[linked] += sizes[a]
            joined = np.unique(np.append(label[linked], label[a]))
            label[np.isin(label, joined)] = joined[0]
    on = np.flatnonzero(classes)
    head: dict[int, bytes] = {}
    for x in on:
        head[label[x]] = min(head.get(label[x], names[x]), names[x])
    return pa.table({"c": pa.array([names[x] for x in on], pa.binary()), "to": pa.array([head[label[x]] for x in on], pa.binary()), "classes": pa.array(classes[on]), "docs": pa.array(docs[on])})


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: root (names its group), doc_id, tk (of its text), class_id (smallest doc_id linked to it, over any
    number of links), copy_id (smallest doc_id with equal shingles), n_links (other rows at threshold or more)."""
    spark = docs.sparkSession
    bound_batches(spark)
    kind = dict(docs.dtypes)[doc_id]
    mine = docs.select(F.col(doc_id).alias("id"), text_key(text).alias("tk"), F.col(text).alias("text"))
    rows = materialise(mine.mapInArrow(_described, f"id {kind}, tk bigint, c binary, n bigint, sig binary"), "shingled")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tk"))
    classes = rows.where("c is not null").groupBy("c").agg(first.alias("rep"), F.count(F.lit(1)).alias("docs"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    # 64 bits of a class's name are enough for k: should two classes share them, they are only compared more often
    classes = materialise(classes.select("c", F.xxhash64("c").alias("k"), "rep.id", "rep.tk", "docs", "n", "sig"), "shingle-classes")
    # sides that grow with the corpus meet by sort-merge at every size; AQE splits what is skewed
    links = likely_links(classes.select("k", "n", "sig"), threshold)
    groups = components(links)
    nodes = groups.select(F.col("a").alias("k"), F.col("b").alias("root")).unionByName(groups.select(F.col("b").alias("k"), F.col("b").alias("root")).distinct())
    members = materialise(classes.join(nodes, "k").drop("k", "n"), "suspects")
    size = materialise(members.groupBy("root").agg(F.count(F.lit(1)).alias("m")), "suspect-sizes")
    per = F.least(F.greatest(F.lit(BLOCK), F.ceil(F.col("m") / 16)), F.lit(MOST))
    placed = members.join(size, "root").withColumn("blocks", F.ceil(F.col("m") / per).cast("int")).withColumn("block", F.pmod(F.xxhash64("c", F.lit(1)), F.col("blocks")).cast("int"))
    placed = materialise(placed.select("c", "sig", "root", "blocks", "block", "id", "tk", "docs"), "suspects-placed")
    some = likely(mine, placed).groupBy("id", "tk").agg(F.first("text").alias("text"))  # a repeated row once
    texts = placed.alias("p").join(some.alias("m").hint("merge"), F.col("p.id").eqNullSafe(F.col("m.id")) & (F.col("p.tk") == F.col("m.tk"))).select("c", "sig", "root", "blocks", "block", "docs", "text")
    units = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "c", "sig", "docs", "block", "text")
    found = units.groupBy("root", "i", "j").applyInArrow(lambda k, t: _met(k, t, threshold), "c binary, to binary, classes bigint, docs bigint")
    found = materialise(found, "block-links")
    discard(links, groups, members, size, placed)
    linked = materialise(found.groupBy("c").agg(F.sum("docs").alias("linked")), "class-links")
    merged = components(found.where("c <> to").select(F.col("c").alias("a"), F.col("to").alias("b")))
    root = classes.join(merged, classes["c"] == merged["a"], "left").select("c", "id", "docs", F.coalesce("b", "c").alias("root"))
    root = materialise(root, "class-roots")
    smallest = materialise(root.groupBy("root").agg(F.min("id").alias("class_id")), "root-ids")
    of_class = root.join(smallest, "root").join(linked, "c", "left").select("c", "root", "class_id", F.col("id").alias("copy_id"), (F.col("docs") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    of_class = materialise(of_class, "class-results")
    discard(found, linked, merged, root, smallest, classes)
    keyed = rows.select("id", "tk", F.coalesce("c", F.concat(F.lit(b"-"), F.hex("tk").cast("binary"), F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))).alias("c"))
    return keyed.join(of_class, "c", "left").select(
        F.coalesce("root", "c").alias("root"),
        F.col("id").alias(doc_id), "tk", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("copy_id", "id").alias("copy_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row left of each group of near duplicates: that with the smallest doc_id."""
    found = materialise(near_duplicates(docs, threshold=threshold), "near-duplicates")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")).alias("first")
    keep = found.groupBy("root").agg(first).select(F.col("first.doc_id").alias("__mp_id"), F.col("first.tk").alias("__mp_tk"))
    keep = materialise(keep.withColumn("__mp_h", F.xxhash64("__mp_id", "__mp_tk")), "kept")
    keyed = docs.withColumn("__mp_k", text_key()).withColumn("__mp_h", F.xxhash64("doc_id", "__mp_k"))
    met = keyed.join(keep, "__mp_h").where(F.col("doc_id").eqNullSafe(F.col("__mp_id")) & (F.col("__mp_k") == F.col("__mp_tk")))
    once = F.row_number().over(Window.partitionBy("__mp_h").orderBy("__mp_k"))
    return met.withColumn("__mp_n", once).where("__mp_n = 1").select(*docs.columns)
