"""SimHash near-duplicates with Golay-code fuzzy hashing.

A document's shingles are runs of 4 words (fewer words: all of them), repeats included, each hashed
by XXH64 with seed 42; a bit of the fingerprint is 1 if it is set in over half of the hashes. Two
documents are linked if their fingerprints differ in `RADIUS` = 4 bits or fewer, and belong together
over any number of links.

Candidates come from the perfect binary Golay code (23 bits, 4,096 codewords, every word within 3
bits of exactly one). A fingerprint is four segments of 16 bits, each the end of a 23-bit word. Of 4
errors some two segments hold at most one each: were there three segments with two or more, there
would be six. Words x and y at most one bit apart meet at both nearest codewords: c(x) is within
3 of x, so within 4 of y. Codewords within 4 bits are one for words within 2 bits of the code, and
six for all others. So a fingerprint gets, for each of the six pairs of segments (i, j), as "left"
keys its nearest codeword for i with each near codeword for j, and as "right" keys each near one for
i with the nearest one for j; x's left key (c(x_i), c(y_j)) is a right key of y. Of about 64 keys
none has to be compared but left with right ones, which is one pair in 100,000 for unrelated texts.

Only distinct fingerprints are keyed. The members of a key meet in a task, those of keys with more than
`MOST` members dealt in blocks; differing bits are counted for all left and right ones, and a task
returns one link for each linked fingerprint, to the smallest of its part. Components of these links
are classes.

Defined cases: null, empty and wordless texts have fingerprint zero and are linked like others;
repeated rows and equal texts share a fingerprint; every row of the input gets a row; a null doc_id is
an id like others, but is the class id only if there is no other; texts are hashed in stretches, so very
long ones need no more than their bytes and word borders; an empty table gives no rows; other columns,
of whatever name, are left out."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_duplicates import components
from .shared import LOWER, bound_batches, discard, materialise, slices, utf8, whole_groups

SHINGLE, SEED, RADIUS = 4, 42, 4
SEGMENTS, SEGMENT = 4, 16
#: Members of a key that meet in one task; rows that a task takes together; shingles hashed and pairs compared at a time.
MOST, ROWS, STRETCH, PAIRS = 4_096, 1 << 15, 1 << 15, 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def fingerprints(column: pa.Array) -> np.ndarray:
    """The fingerprint of each text."""
    data, at = utf8(column)
    rows, n = len(at) - 1, len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    here, before = inside[1:], inside[:-1]
    starts, ends = np.flatnonzero(here & (~before | edge)), np.flatnonzero(before & (~here | edge))
    first = np.searchsorted(starts, at, "left")
    # words with one space behind each, wherever the text had any
    keep = here[:-1] | (before[:-1] & ~edge[:-1])
    moved = np.concatenate([[0], np.cumsum(keep)])
    text = memoryview(np.where(_SPACE[data[keep]], 0x20, LOWER[data[keep]]).astype(np.uint8).tobytes())
    starts, ends = moved[starts], moved[ends]
    words = np.diff(first)
    shingles = np.where(words >= SHINGLE, words - SHINGLE + 1, np.minimum(words, 1))
    row = np.repeat(np.arange(rows), shingles)
    head = first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = head + np.minimum(SHINGLE, words[row]) - 1
    counts = np.zeros((rows, 64), np.int64)
    for i in range(0, len(row), STRETCH):
        part = slice(i, i + STRETCH)
        h = np.array([xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in zip(starts[head[part]].tolist(), ends[last[part]].tolist())], np.uint64)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        mine = row[part]
        cut = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
        counts[mine[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > shingles[:, None], axis=1).view(">u8")[:, 0].astype(np.uint64)


def golay() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2,048 syndromes the errors that lead to codewords within 4 bits, nearest first, and their number (1 or 6)."""
    errors, count = np.zeros((2_048, 6), np.int64), np.zeros(2_048, np.int64)
    for weight in range(5):
        for places in combinations(range(23), weight):
            error = sum(1 << p for p in places)
            s = int(syndrome(np.array([error]))[0])
            errors[s, count[s]] = error
            count[s] += 1
    return errors, count


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which generates the code."""
    out = words.astype(np.int64)
    for bit in range(22, 10, -1):
        out = out ^ (((out >> bit) & 1) * (0b110001110101 << (bit - 11)))
    return out


_tables: list = []


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each fingerprint all keys: its number, the key, and whether it is a left one."""
    if not _tables:
        _tables.extend(golay())
    errors, many = _tables
    near, count = [], []
    for k in range(SEGMENTS):
        word = ((prints >> np.uint64(SEGMENT * k)) & np.uint64((1 << SEGMENT) - 1)).astype(np.int64)
        s = syndrome(word)
        near.append((word[:, None] ^ errors[s]) >> 11)  # a codeword is known by its upper 12 bits
        count.append(many[s])
    who, key, left = [], [], []
    for number, (i, j) in enumerate(combinations(range(SEGMENTS), 2)):
        for is_left, fuzzy in ((True, j), (False, i)):
            own = np.repeat(np.arange(len(prints)), count[fuzzy])
            nth = np.arange(len(own)) - np.repeat(np.cumsum(count[fuzzy]) - count[fuzzy], count[fuzzy])
            a, b = (near[i][own, 0], near[j][own, nth]) if is_left else (near[i][own, nth], near[j][own, 0])
            who.append(own)
            key.append((np.int64(number) << 24) | (a << 12) | b)
            left.append(np.full(len(own), is_left))
    return np.concatenate(who), np.concatenate(key), np.concatenate(left)


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fingerprints(batch.column("text")).view(np.int64))], names=["id", "fp"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy()
        who, key, left = keys(fp.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[who]), pa.array(left)], names=["key", "fp", "is_left"])


def _united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (of each node the smallest of its part) after the links a - b."""
    while True:
        p, q = label[a], label[b]
        apart = p != q
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(p[apart], q[apart]), np.minimum(p[apart], q[apart]))
        while (label != label[label]).any():
            label = label[label]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each key: one for each linked fingerprint, to the smallest of its part."""
    for rows in whole_groups(batches, "g", ROWS):
        g, fp, is_left = rows.column("g").to_numpy(), rows.column("fp").to_numpy(), rows.column("is_left").to_numpy(zero_copy_only=False)
        names, node = np.unique(fp, return_inverse=True)
        at = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        end = np.append(at[1:], len(g))
        lefts = np.add.reduceat(is_left.astype(np.int64), at)
        order = np.lexsort((~is_left, g))  # of a key the left ones first
        node = node[order]
        rights = end - at - lefts
        label = np.arange(len(names))
        own = np.repeat(np.arange(len(at)), lefts)
        a_row = at[own] + np.arange(len(own)) - np.repeat(np.cumsum(lefts) - lefts, lefts)
        todo = np.cumsum(rights[own])
        done = 0
        while done < len(own):
            to = max(done + 1, int(np.searchsorted(todo, (todo[done - 1] if done else 0) + PAIRS, "right")))
            some = own[done:to]
            width = rights[some]
            a = np.repeat(node[a_row[done:to]], width)
            b = node[np.repeat(at[some] + lefts[some], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)]
            x = (names[a] ^ names[b]).view(np.uint64)
            on = (np.bitwise_count(x) <= RADIUS) & (a != b)
            label = _united(label, a[on], b[on])
            done = to
        on = label != np.arange(len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names[on]), pa.array(names[label[on]])], names=["a", "b"])


def links(prints: DataFrame) -> DataFrame:
    """prints: fp, each once. Returns a, b with a > b, whose components are those of all pairs at most RADIUS bits apart."""
    keyed = materialise(prints.mapInArrow(_keyed, "key bigint, fp bigint, is_left boolean"), "print-keys")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.count_if("is_left").alias("l"), F.min("fp").alias("p"), F.max("fp").alias("q")).where("l > 0 and p <> q").select("key", "m")
    blocks = F.ceil(F.col("m") / MOST).cast("int")
    met = keyed.join(sizes.hint("merge"), "key").withColumn("blocks", blocks).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
    # a block of left ones meets every block of right ones
    i, j = F.when(F.col("is_left"), mine).otherwise(F.col("other")), F.when(F.col("is_left"), F.col("other")).otherwise(mine)
    rows = met.select(F.xxhash64("key", i, j).alias("g"), "fp", "is_left")
    found = rows.repartition("g").sortWithinPartitions("g").mapInArrow(_linked, "a bigint, b bigint")
    found = materialise(found, "print-links")
    discard(keyed)
    return found


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, fp (the fingerprint as a signed long), component_id (smallest doc_id reachable)."""
    spark = docs.sparkSession
    bound_batches(spark)
    kind = dict(docs.dtypes)[doc_id]
    rows = materialise(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(_printed, f"id {kind}, fp bigint"), "fingerprints")
    prints = materialise(rows.groupBy("fp").agg(F.min("id").alias("id")), "distinct-fingerprints")
    found = links(prints.select("fp"))
    merged = components(found)
    rooted = materialise(prints.join(merged.withColumnsRenamed({"a": "fp", "b": "root"}).hint("merge"), "fp", "left").select("fp", "id", F.coalesce("root", "fp").alias("root")), "fingerprint-roots")
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    of_print = materialise(rooted.join(least.hint("merge"), "root").select("fp", "component_id"), "fingerprint-classes")
    discard(found, merged, rooted, prints)
    return rows.join(of_print.hint("merge"), "fp").select(F.col("id").alias(doc_id), "fp", "component_id")
