"""What the operators share: the folder that all executors see, Arrow batch bounds, text buffers."""

from __future__ import annotations

import atexit
import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch may hold on its way to Python.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
_made: list[tuple[SparkSession, str]] = []


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that long texts don't add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/milepost-{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clear)
    _made.append((spark, path))
    return path


def _clear() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session is gone
            return


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark would read it by, so that every task means the same file."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more, and let Spark drop the shuffle files of finished plans."""
    for table in tables:
        spark = table.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if "/milepost-" in path:
                p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if tables:
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()  # shuffle files go with the plans that made them


#: Words of 64 bits in the map of `likely`, at most: 8 MB.
LIKELY_WORDS = 1 << 19


def likely(rows: DataFrame, keys: DataFrame, found: bool = True) -> DataFrame:
    """The rows whose tk is in keys, and a few others; or (found=False) only rows whose tk is not.

    keys (a table that is read twice) become a bit map of 16 bits for each, at most LIKELY_WORDS words, whatever
    the input, so it may be broadcast. A fuller map only lets more rows through."""
    words = min(LIKELY_WORDS, max(1 << 10, 1 << (keys.count() // 4).bit_length()))
    bit = F.pmod("tk", F.lit(64 * words))
    of_map = keys.select(F.floor(bit / 64).alias("__mp_w"), (bit % 64).cast("int").alias("i")).groupBy("__mp_w").agg(F.expr("bit_or(shiftleft(1L, i))").alias("__mp_v"))
    met = rows.withColumn("__mp_w", F.floor(bit / 64)).withColumn("__mp_i", (bit % 64).cast("int")).join(F.broadcast(of_map), "__mp_w", "left")
    hit = F.coalesce(F.expr("shiftrightunsigned(__mp_v, __mp_i) & 1L") == 1, F.lit(False))
    return met.where(hit if found else ~hit).select(*rows.columns)


def text_key(col: str = "text") -> Column:
    """Tells apart texts that share a doc_id, so that every row gets its own verdict."""
    return F.xxhash64(F.coalesce(F.col(col), F.lit("")))


def same(left: DataFrame, right: DataFrame, *cols: str) -> Column:
    """Null-safe equality on cols."""
    on = F.lit(True)
    for c in cols:
        on = on & left[c].eqNullSafe(right[c])
    return on


def no_nulls(column: pa.Array) -> pa.Array:
    """Strings with null as the empty string."""
    return pc.fill_null(column, "") if column.null_count else column


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings of a column, and len + 1 offsets into them."""
    column = no_nulls(column)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, by: str, most: int = 2 << 20):
    """Cut a batch into runs of rows with about `most` text bytes (a longer text is a run of its own)."""
    _, at = utf8(batch.column(by))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = min(j, n)


def whole_groups(batches, key: str, least: int):
    """Of rows sorted by key, batches of whole groups: at least so many rows, or one group."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < least:
            continue
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        k = rows.column(key).to_numpy()
        cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0  # the last group may go on
        if cut:
            yield rows.slice(0, cut)
            rows = rows.slice(cut)
        held, n = [rows], rows.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """H with H[e] - H[s], times the inverse power of s, a polynomial hash of data[s:e]."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans; the length takes part."""
    _, down = powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_CODES = np.arange(256, dtype=np.uint8)
LOWER = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES).astype(np.uint8)
WORD = ((_CODES >= 48) & (_CODES <= 57)) | ((_CODES >= 65) & (_CODES <= 90)) | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)


class Words:
    """The words of a column: maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.

    low: the lower-cased bytes; starts, ends: of each word in them; row: the word's row; first: the
    number of the first word of each row (len + 1 entries); hashes: 64 bits of each word."""

    def __init__(self, column: pa.Array):
        data, at = utf8(column)
        self.low, n = LOWER[data], len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = WORD[data]
        edge = np.zeros(n + 1, bool)  # before byte i a row begins
        edge[at] = True
        here, before = inside[1:], inside[:-1]  # of byte i and of byte i - 1
        self.starts = np.flatnonzero(here & (~before | edge))
        self.ends = np.flatnonzero(before & (~here | edge))
        self.first = np.searchsorted(self.starts, at, "left")
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(self.first))
        self.hashes = spans_hash(prefix_sums(self.low), self.starts, self.ends)

    def grams(self, k: int, kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they are all of one row."""
        n = max(0, len(self.hashes) - k + 1)
        out = np.full(n, np.uint64(kind), np.uint64)
        for i in range(k):
            out = out * np.uint64(0xD6E8FEB86659FD93) + self.hashes[i : i + n]
        return mixed(out), self.row[:n] == self.row[k - 1 : k - 1 + n]

    def text(self, a: int, b: int) -> str:
        return b" ".join(self.low[s:e].tobytes() for s, e in zip(self.starts[a:b], self.ends[a:b])).decode("utf-8", "replace")
