"""Exact substring dedup by bucket-pointer refinement over sampled suffixes.

A byte goes if a string of `SPAN` (100) bytes that covers it also starts earlier. Every 100 bytes
hold a smallest q-gram (24 bytes); adjacent starts with the same one form a unit, so units, not
single suffixes, are put into buckets. Units are found once and kept as a table of hashes:

1. The initial bucket of a unit is its q-gram. Buckets of one unit are finished.
2. Units of a bucket whose whole hulls (all bytes that their strings cover) are equal stand for
   each other: all but the first repeat whole, the first goes on. Buckets of one hull are finished.
3. What is left, usually a few units in a hundred, is refined by bucket pointers: the bytes of the
   units that share a q-gram meet, every offset points to the bucket of the 25 bytes there, and the
   buckets are sorted on (own bucket, bucket 25 offsets later), which gives those of depth 50. These
   new pointers are read again, by all offsets that lead into them, for depth 100 (50 offsets later).
   Offsets in a bucket of their own are finished at once, and so is what leads into them. All but
   the first start in a bucket of depth 100 repeat; their bytes are compared with the first one's.

A q-gram with more than `BUCKET` different hulls (a common phrase) doesn't meet in one task: its
units are split in two by the range of starts, each half with a new bucket, the bytes that all
strings of that half hold, until buckets are small or ranges are single starts, which Spark counts
with partial aggregation. Every bucket is thus refined exactly, whatever its size.

Hulls are named by 64 bits of XXH3 with a seed drawn for each run, besides 64 bits of the q-gram.
Texts leave their task only if they hold an unfinished unit or lose bytes. Bit maps only keep
finished rows out of later shuffles: a fuller map lets more of them through.

Order: by doc_id (null first), then, for rows that share it, by a hash of the text, then by start.
Defined cases: null is the empty text; texts under 100 bytes stay whole; rows that share doc_id and
text are one document and get equal results; other columns, of whatever name, take no part."""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, discard, likely, materialise, mixed, prefix_sums, slices, spans_hash, text_key, utf8, whole_groups

SPAN, GRAM = 100, 24
REACH = SPAN - GRAM
#: Depth of the first bucket pointers; each level doubles it, up to SPAN.
DEPTH = 25
#: Units that may meet in one bucket; units that a task refines together.
BUCKET, CHUNK = 4_096, 4_096
#: Large buckets that may be named to all tasks; if there are more, every bucket is split.
NAMED = 1 << 16
#: Bits of a map of what is unfinished, at least and at most, and of one part of it.
MAP_BITS, PART = (1 << 22, 1 << 29), 1 << 16


def _rolling(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of every n adjacent values."""
    span = 1
    while span < n:
        step = min(span, n - span)
        x = np.minimum(x[:-step], x[step:])
        span += step
    return x


class Units:
    """Adjacent starts of 100-byte strings that share their smallest q-gram (the last, if equal), of a column of texts.

    grams: the q-gram's id; a, b: the first and last start; row: of the text; offsets: where it begins."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = utf8(column)
        n = len(self.data)
        self.a = self.b = self.row = np.zeros(0, np.int64)
        self.grams = np.zeros(0, np.uint64)
        if n < SPAN:
            return
        i = np.arange(n - GRAM + 1)
        grams = spans_hash(prefix_sums(self.data), i, i + GRAM)
        least = _rolling(grams, REACH + 1)
        fits = np.zeros(len(least) + 1, np.int32)  # starts whose string stays in its text
        lo, hi = self.offsets[:-1], np.maximum(self.offsets[:-1], self.offsets[1:] - SPAN + 1)
        on = hi > lo
        np.add.at(fits, lo[on], 1)
        np.add.at(fits, np.minimum(hi[on], len(least)), -1)
        inside = np.cumsum(fits[:-1]) > 0
        edge = np.ones(len(least), bool)
        edge[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
        edge[np.minimum(lo[on], len(least) - 1)] = True
        edge |= grams[REACH:] == least  # of equal q-grams the last one counts, so a unit has one place for its own
        first = np.flatnonzero(edge)
        last = np.append(first[1:] - 1, len(least) - 1)
        good = inside[first]
        self.a, self.b = first[good], last[good]
        self.row = np.searchsorted(self.offsets, self.a, "right") - 1
        self.b = np.minimum(self.b, self.offsets[self.row + 1] - SPAN)
        self.grams = least[self.a]

    def hulls(self, seed: int) -> np.ndarray:
        raw, name = self.data.tobytes(), xxhash.xxh3_64_intdigest
        return np.fromiter((name(raw[a:b], seed) for a, b in zip(self.a.tolist(), (self.b + SPAN).tolist())), np.uint64, len(self.a))


def _units(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            u = Units(batch.column("text"))
            if len(u.a):
                at = pa.array(u.row, pa.int64())
                cols = [u.grams.view(np.int64), u.hulls(seed).view(np.int64), (u.a - u.offsets[u.row]).astype(np.int32), (u.b - u.a).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), batch.column("id").take(at), batch.column("tk").take(at)], names=["h", "deep", "pos", "more", "id", "tk"])


class Bits:
    """A bit map of 64-bit ids."""

    def __init__(self, data: np.ndarray):
        self.data = data

    def has(self, ids: np.ndarray) -> np.ndarray:
        bit = (ids % np.uint64(8 * len(self.data))).astype(np.int64)
        return (self.data[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def _parts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The bits of the ids of one task, by part; a part comes to one task only."""
    have: dict[int, np.ndarray] = {}
    for batch in batches:
        bit = np.sort((batch.column("x").to_numpy().view(np.uint64) % np.uint64(size)).astype(np.int64))
        cut = np.flatnonzero(np.diff(bit // PART)) + 1
        for own in np.split(bit, cut) if len(bit) else ():
            i = own % PART
            np.bitwise_or.at(have.setdefault(int(own[0] // PART), np.zeros(PART // 8, np.uint8)), i >> 3, np.left_shift(1, i & 7).astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()), pa.array([x.tobytes() for x in have.values()], pa.binary())], names=["part", "bits"])


def bit_map(ids: DataFrame) -> Bits:
    """The map of the ids in column x (a table that is read twice), 16 bits for each, within MAP_BITS."""
    size = min(MAP_BITS[1], max(MAP_BITS[0], 1 << (16 * ids.count()).bit_length()))
    # 2**64 is a multiple of size, so the signed remainder names the same bit
    part = F.floor(F.pmod(F.col("x"), F.lit(size)) / PART)
    bits = np.zeros(size // 8, np.uint8)
    for r in ids.select("x").repartition(part).mapInArrow(lambda b: _parts(b, size), "part int, bits binary").toLocalIterator():
        bits[r["part"] * PART // 8 : (r["part"] + 1) * PART // 8] |= np.frombuffer(r["bits"], np.uint8)
    return Bits(bits)


def _known(batches: Iterator[pa.RecordBatch], bits: Bits) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(bits.has(batch.column("h").to_numpy().view(np.uint64))))


def unfinished(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The rows whose bucket h is in column x of ids, and a few others."""
    ids = materialise(ids, "suffix-open")
    bits = bit_map(ids)
    out = materialise(rows.mapInArrow(lambda b: _known(b, bits), rows.schema), name)
    discard(ids)
    return out


def _not_first(rows: DataFrame, firsts: DataFrame, *bucket: str) -> DataFrame:
    """rows in a bucket of several that aren't its first one."""
    met = rows.join(firsts.where("n > 1").select(*bucket, "first"), list(bucket))
    return met.where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("tk") == F.col("first.tk")) & (F.col("pos") == F.col("first.pos"))))


def _firsts(rows: DataFrame, *bucket: str) -> DataFrame:
    """For each bucket its first start, how many it has, and the length of its unit."""
    return rows.groupBy(*bucket).agg(F.min(F.struct("id", "tk", "pos")).alias("first"), F.count(F.lit(1)).alias("n"), F.max("more").alias("more"))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the hulls of a text's unfinished units."""
    for batch in batches:
        raw, units = batch.column("text").to_pylist(), batch.column("units")
        flat, n = units.flatten(), units.value_lengths().to_numpy()
        at = pa.array(np.repeat(np.arange(len(n)), n))
        h, pos, more = (flat.field(i) for i in range(3))
        data = [(raw[r] or "").encode("utf-8", "surrogatepass") for r in range(len(raw))]
        hulls = [data[r][p : p + m + SPAN] for r, p, m in zip(at.to_pylist(), pos.to_pylist(), more.to_pylist())]
        whole = pa.RecordBatch.from_arrays([h, pos, more, pa.array(hulls, pa.binary()), batch.column("id").take(at), batch.column("tk").take(at)], names=["h", "pos", "more", "hull", "id", "tk"])
        for i in range(0, len(hulls), 4_096):
            yield whole.slice(i, 4_096)


def _aligned(hulls: list[bytes], more: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hulls as rows of a matrix with their q-grams in the columns from REACH on, and the column where each begins."""
    data = np.frombuffer(b"".join(hulls), np.uint8)
    n = more + SPAN
    at = np.cumsum(n) - n
    sums, place = prefix_sums(data), np.full(len(n), -1)
    for d in range(REACH, -1, -1):
        free = np.flatnonzero((place < 0) & (d >= more) & (d + GRAM <= n))
        hit = free[spans_hash(sums, at[free] + d, at[free] + d + GRAM) == grams[free]]
        place[hit] = d
    low = REACH - place
    out = np.zeros((len(n), REACH + SPAN), np.uint8)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(data)) - np.repeat(at, n) + np.repeat(low, n)] = data
    return out, low


def pointers(matrix: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each start in low..high of each row of bytes the number (row * columns + column) of the first equal
    string of SPAN bytes, in the order of rows; of other columns -1.

    bucket[p]: the bucket of the string of the current depth at p. It is sorted on (bucket[p], bucket[p + depth])."""
    rows, width = matrix.shape
    columns = np.arange(width)[None]
    flat = np.ascontiguousarray(matrix).reshape(-1)
    inside = ((columns >= low[:, None]) & (columns < (high + SPAN)[:, None])).reshape(-1)
    sums = prefix_sums(flat)
    depth = DEPTH
    alive = np.flatnonzero(inside & (np.arange(len(flat)) % width <= width - depth))
    alive = alive[inside[alive + depth - 1]]
    key = spans_hash(sums, alive, alive + depth)
    first = np.full(len(flat), -1, np.int64)
    while True:
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        size = np.bincount(number, minlength=1)
        several = size[number] > 1 if len(key) else np.zeros(0, bool)  # a bucket of one is finished
        place = alive[order][several]
        if depth == SPAN:
            head = alive[order][new][number[several]]  # the sort is stable, so each bucket begins with its first row
            first[place] = head
            break
        bucket = np.full(len(flat) + SPAN, -1, np.int64)
        bucket[place] = number[several]
        alive = np.sort(place)
        alive = alive[alive % width + 2 * depth <= width]
        alive = alive[bucket[alive + depth] >= 0]  # what leads into a finished bucket is finished
        key = (bucket[alive].astype(np.uint64) << np.uint64(32)) | bucket[alive + depth].astype(np.uint64)
        depth *= 2
    starts = ((columns >= low[:, None]) & (columns <= high[:, None])).reshape(-1)
    return np.where(starts, first, -1).reshape(rows, width)


def _checked(matrix: np.ndarray, first: np.ndarray) -> np.ndarray:
    """first where the bytes are equal; elsewhere (two strings with one hash) the first one with equal bytes."""
    width = matrix.shape[1]
    windows = np.lib.stride_tricks.sliding_window_view(np.append(matrix.reshape(-1), np.zeros(SPAN, np.uint8)), SPAN)
    own = np.flatnonzero(first.reshape(-1) >= 0)
    head = first.reshape(-1)[own]
    out = first.reshape(-1).copy()
    for i in range(0, len(own), 1 << 15):
        part = slice(i, i + (1 << 15))
        for p in own[part][(windows[own[part]] != windows[head[part]]).any(axis=1)].tolist():
            out[p] = next(int(x) for x in own[(head == out[p]) & (own <= p)].tolist() if (windows[x] == windows[p]).all())
    return out.reshape(-1, width)


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, then in order; whole buckets are refined, `CHUNK` units or one bucket at a time."""
    def done(rows: pa.RecordBatch) -> pa.RecordBatch:
        grams, more = rows.column("gram").to_numpy().view(np.uint64), rows.column("more").to_numpy().astype(np.int64)
        matrix, begin = _aligned(rows.column("hull").to_pylist(), more, grams)
        low, high = np.maximum(begin, rows.column("low").to_numpy()), np.minimum(begin + more, rows.column("high").to_numpy())
        first = _checked(matrix, pointers(matrix, low, high))
        width = matrix.shape[1]
        pos, tk = rows.column("pos").to_numpy().astype(np.int64), rows.column("tk").to_numpy()
        r, c = np.nonzero(first >= 0)
        f = first[r, c] // width
        # a row of docs that comes twice brings its units twice
        same = (f == r) | ((pos[f] == pos[r]) & (tk[f] == tk[r]) & np.array(rows.column("id").take(pa.array(f)).to_pylist(), object).__eq__(np.array(rows.column("id").take(pa.array(r)).to_pylist(), object)) if len(r) else np.zeros(0, bool))
        r, c = r[~same], c[~same]
        new = np.append(True, (r[1:] != r[:-1]) | (c[1:] != c[:-1] + 1)) if len(r) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(r)) - 1 if len(at) else at
        row, a = r[at], pos[r[at]] + c[at] - begin[r[at]]
        take = pa.array(row)
        return pa.RecordBatch.from_arrays([rows.column("id").take(take), rows.column("tk").take(take), pa.array(a.astype(np.int32)), pa.array((a + c[last] - c[at] + SPAN).astype(np.int32))], names=["id", "tk", "a", "b"])

    for rows in whole_groups(batches, "h", CHUNK):
        yield done(rows)


def _halved(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """Each row once for either half of its range of starts, in the bucket of the bytes that all strings of that half hold."""
    for batch in batches:
        if not batch.num_rows:
            continue
        more, low, high = (batch.column(c).to_numpy().astype(np.int64) for c in ("more", "low", "high"))
        matrix, begin = _aligned(batch.column("hull").to_pylist(), more, batch.column("gram").to_numpy().view(np.uint64))
        middle = (low + high) // 2
        for a, b in ((low, middle), (middle + 1, high)):
            on = np.flatnonzero((a <= b) & (a <= begin + more) & (b >= begin))
            names = np.fromiter((xxhash.xxh3_64_intdigest(matrix[i, y : x + SPAN].tobytes() + x.to_bytes(1) + y.to_bytes(1), seed) for i, x, y in zip(on.tolist(), a[on].tolist(), b[on].tolist())), np.uint64, len(on))
            out = batch.take(pa.array(on))
            new = {"h": pa.array(names.view(np.int64)), "low": pa.array(a[on].astype(np.int32)), "high": pa.array(b[on].astype(np.int32)), "start": pa.array((batch.column("pos").to_numpy()[on] + a[on] - begin[on]).astype(np.int32))}
            yield pa.RecordBatch.from_arrays([new.get(f, out.column(f) if f in out.schema.names else None) for f in (*batch.schema.names, *(() if "start" in batch.schema.names else ("start",)))], names=[*batch.schema.names, *(() if "start" in batch.schema.names else ("start",))])


def refined(units: DataFrame, kind: str, seed: int) -> DataFrame:
    """units: h (bucket), gram, pos, more, hull, id, tk. Returns id, tk, a, b: the bytes from a to b repeat."""
    cut = f"id {kind}, tk bigint, a int, b int"
    left = units.select("h", "gram", "pos", "more", "hull", "id", "tk", F.lit(0).alias("low"), F.lit(REACH).alias("high"), F.lit(0).alias("start"))
    wide, tables, out = REACH + 1, [], None
    while True:
        sizes = materialise(left.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "suffix-sizes")
        tables.append(sizes)
        big = sizes.where(F.col("n") > BUCKET)
        n = big.count()
        if n and wide > 1:
            # at most NAMED names are sent around; with more of them all buckets are split
            named = left.join(F.broadcast(big.select("h").withColumn("big", F.lit(True))), "h", "left") if n <= NAMED else left.withColumn("big", F.lit(True))
            small, rest = named.where("big is null").drop("big"), named.where("big").drop("big")
        else:
            small, rest = left, None
        if wide == 1:
            # one start a row: those of the same bytes repeat, whatever their names
            body = F.substring("hull", F.col("start") - F.col("pos") + 1, F.lit(SPAN)).alias("body")
            starts = left.select(body, "more", "id", "tk", F.col("start").alias("pos"))
            firsts = materialise(_firsts(starts, "body"), "suffix-start-buckets")
            tables.append(firsts)
            found = _not_first(starts, firsts, "body").select("id", "tk", F.col("pos").alias("a"), (F.col("pos") + SPAN).alias("b"))
        else:
            found = small.repartition("h").sortWithinPartitions("h", F.asc_nulls_first("id"), "tk", "pos").mapInArrow(_refined, cut)
        found = materialise(found, "suffix-refined")
        out = found if out is None else out.unionByName(found)
        if rest is None or wide == 1:
            discard(*tables)
            return out
        left = materialise(rest.mapInArrow(lambda b: _halved(b, seed), left.schema), "suffix-halves")
        tables.append(left)
        wide = (wide + 1) // 2


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, tk, cuts: for each text that loses bytes the sorted [a, b) pieces, which may overlap."""
    bound_batches(docs.sparkSession)
    kind, seed = dict(docs.dtypes)[doc_id], secrets.randbits(63)
    mine = docs.select(F.col(doc_id).alias("id"), text_key(text).alias("tk"), F.col(text).alias("text"))
    units = materialise(mine.mapInArrow(lambda b: _units(b, seed), f"h bigint, deep bigint, pos int, more int, id {kind}, tk bigint"), "suffix-units")
    again = units.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("h").alias("x"))
    shared = unfinished(units, again, "suffix-shared")
    discard(units)
    firsts = materialise(_firsts(shared, "h", "deep"), "suffix-hulls")
    cuts = materialise(_not_first(shared, firsts, "h", "deep").select("id", "tk", F.col("pos").alias("a"), (F.col("pos") + F.col("more") + SPAN).alias("b")), "suffix-whole")
    discard(shared)
    unlike = firsts.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("h").alias("x"))
    left = unfinished(firsts.select("h", F.col("first.pos").alias("pos"), "more", "first.id", "first.tk"), unlike, "suffix-left")
    discard(firsts)
    of_text = materialise(left.groupBy("id", "tk").agg(F.collect_list(F.struct("h", "pos", "more")).alias("units")), "suffix-left-by-text")
    met = likely(mine, of_text).alias("m").join(of_text.alias("u").hint("merge"), F.col("m.id").eqNullSafe(F.col("u.id")) & (F.col("m.tk") == F.col("u.tk")))
    contexts = met.select("m.id", "m.tk", "m.text", "u.units").mapInArrow(_contexts, f"h bigint, pos int, more int, hull binary, id {kind}, tk bigint")
    contexts = materialise(contexts, "suffix-contexts")
    discard(left, of_text)
    found = refined(contexts.withColumn("gram", F.col("h")), kind, seed)
    out = materialise(cuts.unionByName(found).groupBy("id", "tk").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("cuts")), "suffix-cuts")
    discard(contexts, cuts, found)
    return out


def _cut(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cuts = batch.column("cuts")
        flat, ends = cuts.flatten(), np.cumsum(cuts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        a, b = (flat.field(i).to_numpy() for i in range(2))
        sizes, gone, spans, names, rests = [], [], [], [], []
        for t, end, before in zip(batch.column("text").to_pylist(), ends.tolist(), [0, *ends[:-1].tolist()]):
            raw = (t or "").encode("utf-8", "surrogatepass")
            if end > before:
                x, y = a[before:end], np.maximum.accumulate(b[before:end])
                head = np.append(True, x[1:] > y[:-1])
                x, y = x[head], y[np.append(np.flatnonzero(head)[1:], len(head)) - 1]
                rest = b"".join(raw[i:j] for i, j in zip([0, *y.tolist()], [*x.tolist(), len(raw)]))
                n = len(x)
            else:
                rest, n = raw, 0
            sizes.append(len(raw)), gone.append(len(raw) - len(rest)), spans.append(n), names.append(sha256(rest).hexdigest())
            if keep:
                rests.append(rest)
        cols = [batch.column("id"), *(pa.array(c, pa.int64()) for c in (sizes, gone, spans)), pa.array(names, pa.string())]
        yield pa.RecordBatch.from_arrays([*cols, *([pa.array(rests, pa.binary())] if keep else [])], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep else [])])


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """For each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep, kept (bytes)."""
    kind = dict(docs.dtypes)[doc_id]
    cuts = repeats(docs, doc_id, text)
    keyed = docs.select(F.col(doc_id).alias("id"), text_key(text).alias("tk"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    some, others = likely(keyed, cuts), likely(keyed, cuts, False)  # only texts that may lose bytes move
    met = some.alias("k").join(cuts.alias("c").hint("merge"), F.col("k.id").eqNullSafe(F.col("c.id")) & (F.col("k.tk") == F.col("c.tk")), "left").select("k.id", "k.text", "c.cuts")
    lost = met.mapInArrow(lambda b: _cut(b, keep), f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string{', kept binary' if keep else ''}")
    raw, none = F.col("text").cast("binary"), F.lit(0).cast("bigint")
    whole = others.select("id", F.octet_length(raw).cast("bigint").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"), *([raw.alias("kept")] if keep else []))
    return whole.unionByName(lost).withColumnRenamed("id", doc_id)
