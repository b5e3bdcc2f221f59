"""Line dedup with two Bloom filters.

First reading: every task keeps a filter of the line hashes seen once and one of those seen twice;
the tasks' filters are merged part by part (seen twice: in either twice-filter, or in both
once-filters). Second reading: only lines that the twice-filter knows leave their task; their full
keys are counted exactly over distinct doc_ids, and the largest doc_id is kept. Third: documents
lose the confirmed lines.

A key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased; keys under `least`
code points are never dropped.

Defined cases: null or empty text is one empty line and keeps the empty text; rows that share a
doc_id count as one document, each loses the lines that its doc_id doesn't keep; a null doc_id
counts as one document, smaller than any other; a line repeated within the keeping document stays;
an empty table gives no rows; other columns, of whatever name but those that begin with __mp_, are
left alone."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import bound_batches, materialise, no_nulls, text_key

#: Bits of each Bloom filter, at least and at most, the bits that a key sets, and bits of one part. A fuller filter
#: only lets more lines through to the exact count.
LEAST_BITS, MOST_BITS, PROBES, PART = 1 << 20, 1 << 28, 3, 1 << 16
LEAST, DOCS = 40, 5


def line_key(line: bytes) -> bytes:
    return line.strip().lower()  # of bytes: the six ASCII blanks, A-Z only


def _long(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def keys_of(text: str, least: int) -> list[bytes]:
    """The distinct keys of a text that are long enough."""
    return [k for k in {line_key(x) for x in text.encode("utf-8", "surrogatepass").split(b"\n")} if _long(k, least)]


def filter_bits(text_bytes: int) -> int:
    """About one bit for every 16 bytes of text: a line that counts is longer than two of them, and most lines are far longer."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (text_bytes // 16).bit_length()))


def _bits(keys: np.ndarray, size: int) -> np.ndarray:
    """The bits of each key in a filter of size bits, one row for each."""
    step = (keys >> np.uint64(32)) | np.uint64(1)
    return np.stack([(keys + np.uint64(i) * step) % np.uint64(size) for i in range(PROBES)], axis=1).astype(np.int64)


def _set(bits: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def _known(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def _hashes(column: pa.Array, least: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(k) for t in no_nulls(column).to_pylist() for k in keys_of(t, least)], np.uint64)


def _filters(batches: Iterator[pa.RecordBatch], least: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The filters of one task, as compressed parts that hold a bit."""
    once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    for batch in batches:
        keys, n = np.unique(_hashes(batch.column("text"), least), return_counts=True)
        if len(keys):
            at = _bits(keys, bits)
            _set(twice, at[(n > 1) | _known(once, at)].ravel())
            _set(once, at.ravel())
    size = PART // 8
    parts = np.flatnonzero(once.reshape(-1, size).any(axis=1))
    for i in range(0, len(parts), 64):
        some = parts[i : i + 64]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array([zlib.compress(x[p * size : (p + 1) * size], 1) for p in some.tolist()], pa.binary()) for x in (once, twice))], names=["part", "once", "twice"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the parts that meet in this task; each part number comes to one task only."""
    have: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for p, o, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
            o, t = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, t))
            if p in have:
                mine, both = have[p]
                both |= t | (mine & o)
                mine |= o
            else:
                have[p] = [o.copy(), t.copy()]
    out = [(p, t.tobytes()) for p, (_, t) in have.items() if t.any()]
    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([t for _, t in out], pa.binary())], names=["part", "twice"])


def twice_seen(docs: DataFrame, text: str = "text", least: int = LEAST) -> np.ndarray:
    """The merged filter of hashes that may come twice, MOST_BITS / 8 bytes at most."""
    size = filter_bits(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    parts = docs.select(F.col(text).alias("text")).mapInArrow(lambda b: _filters(b, least, size), "part int, once binary, twice binary")
    twice = np.zeros(size // 8, np.uint8)
    for r in parts.repartition("part").mapInArrow(_merged, "part int, twice binary").toLocalIterator():
        twice[r["part"] * PART // 8 : (r["part"] + 1) * PART // 8] = np.frombuffer(r["twice"], np.uint8)
    return twice


def _suspects(batches: Iterator[pa.RecordBatch], twice: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, keys = [], []
        for i, t in enumerate(no_nulls(batch.column("text")).to_pylist()):
            mine = keys_of(t, least)
            rows += [i] * len(mine)
            keys += mine
        if keys:
            on = np.flatnonzero(_known(twice, _bits(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64), 8 * len(twice))))
            rows, keys = [rows[i] for i in on], [keys[i] for i in on]
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), batch.column("tk").take(pa.array(rows, pa.int64())), pa.array([k.decode("utf-8", "replace") for k in keys], pa.string())], names=["id", "tk", "key"])


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, in_docs: int = DOCS) -> DataFrame:
    """__mp_id, __mp_of, __mp_drop: for each text that loses lines the 128-bit digests of their keys."""
    bound_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[doc_id]
    twice = twice_seen(docs, text, least)
    mine = docs.select(F.col(doc_id).alias("id"), text_key(text).alias("tk"), F.col(text).alias("text"))
    found = mine.mapInArrow(lambda b: _suspects(b, twice, least), f"id {kind}, tk bigint, key string")
    # the full keys are told apart by 128 bits of SHA-256 from here on
    found = materialise(found.select("id", "tk", F.substring(F.unhex(F.sha2("key", 256)), 1, 16).alias("key")), "line-suspects")
    held = found.select("key", "id").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("keeper")).where(F.col("docs") >= in_docs)
    held = materialise(held, "line-keepers")
    lost = found.join(held, "key").where(~F.col("id").eqNullSafe(F.col("keeper")))
    return materialise(lost.groupBy(F.col("id").alias("__mp_id"), F.col("tk").alias("__mp_of")).agg(F.collect_set("key").alias("__mp_drop")), "lines-lost")


def _kept(batches: Iterator[pa.RecordBatch], text: str, schema: pa.Schema, count: bool) -> Iterator[pa.RecordBatch]:
    from hashlib import sha256

    for batch in batches:
        out, lines, dropped = [], [], []
        for t, drop in zip(batch.column(text).to_pylist(), batch.column("__mp_drop").to_pylist()):
            n = lost = 0
            if drop or count:
                parts = (t or "").encode("utf-8", "surrogatepass").split(b"\n")
                n = len(parts)
                if drop:
                    gone = set(drop)
                    parts = [x for x in parts if sha256(line_key(x).decode("utf-8", "replace").encode()).digest()[:16] not in gone]
                    lost = n - len(parts)
                    t = b"\n".join(parts).decode("utf-8", "replace") if lost else t
            out.append(t)
            lines.append(n)
            dropped.append(lost)
        cols = [pa.array(out, f.type) if f.name == text else batch.column(f.name) for f in schema if f.name not in ("__mp_lines", "__mp_dropped")]
        yield pa.RecordBatch.from_arrays([*cols, *([pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())] if count else [])], names=[f.name for f in schema])


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, in_docs: int = DOCS, count: bool = False) -> DataFrame:
    """docs with the repeated lines gone from text; with count also __mp_lines (before) and __mp_dropped."""
    from pyspark.sql.pandas.types import to_arrow_schema

    lost = repeated_lines(docs, doc_id, text, least, in_docs)
    keyed = docs.withColumn("__mp_tk", text_key(text))
    all_of = keyed.join(lost, keyed[doc_id].eqNullSafe(lost["__mp_id"]) & (keyed["__mp_tk"] == lost["__mp_of"]), "left").select(*[keyed[c] for c in docs.columns], "__mp_drop")
    schema = docs.schema
    if count:
        schema = StructType([*schema.fields, StructField("__mp_lines", LongType()), StructField("__mp_dropped", LongType())])
    arrow = to_arrow_schema(schema)
    return all_of.mapInArrow(lambda b: _kept(b, text, arrow, count), schema)
