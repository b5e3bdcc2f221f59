"""WARC archives by way of a chunked record table.

A payload is a run of rows (record, chunk number, at most `CHUNK` bytes), so neither writer nor
reader ever holds a whole record. Digests are carried from chunk to chunk. The order of work:
chunk rows; SHA-1 of each payload, one chunk at a time; of equal payloads the record with the
largest id becomes the response; chunk rows meet that decision and every task streams its records
into gzip archives in the shared folder (one member per record). Reading streams the archives back
into chunk rows, each with the bytes and the digest so far; the last one describes the record.

Archives get new names in every task attempt and only those that a finished task reports are
listed, so a lost task leaves nothing that is read.

Defined cases: null or empty payloads have no bytes and are compared like any other; rows with
equal payload that share the largest id are all responses; a null id is smaller than any other and
is left out of the record's name; CR and LF in a url are percent-encoded, a null url is left out;
payloads under `least` bytes are never revisits; payloads of any length pass in chunks; an empty
table gives no archive; other columns, of whatever name, are left out."""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bound_batches, materialise, qualified, scratch_path, text_key

#: Bytes in a chunk row, and in an archive before the next one begins.
CHUNK, ARCHIVE = 1 << 20, 1 << 28
DATE, PROFILE = "2024-01-01T00:00:00Z", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:milepost:page:"
READ = "archive string, record bigint, chunk bigint, last boolean, headers map<string,string>, stated_bytes bigint, bytes_so_far bigint, digest_so_far string, data binary"


def bare_digest(h) -> str:
    return base64.b32encode(h.digest()).decode()


def chunk_rows(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", chunk: int = CHUNK) -> DataFrame:
    """id, key, row, url, chunk, last, data: the payloads as chunk rows, a row's chunks next to each other."""
    raw = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("raw") / chunk)).cast("int")
    rows = pages.select(F.col(page_id).alias("id"), text_key(payload).alias("key"), F.monotonically_increasing_id().alias("row"), F.col(url).alias("url"), raw.alias("raw"))
    rows = rows.withColumn("n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk"))
    return rows.select("id", "key", "row", "url", "chunk", (F.col("chunk") == F.col("n") - 1).alias("last"), F.expr(f"substring(raw, chunk * {chunk} + 1, {chunk})").alias("data"))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    h, size = hashlib.sha1(), 0
    for batch in batches:
        at, sizes, digests = [], [], []
        for i, (data, last) in enumerate(zip(batch.column("data").to_pylist(), batch.column("last").to_pylist())):
            h.update(data)
            size += len(data)
            if last:
                at.append(i), sizes.append(size), digests.append(bare_digest(h))
                h, size = hashlib.sha1(), 0
        rows = batch.take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=["id", "key", "bytes", "digest"])


def decided(chunks: DataFrame, least: int = 0) -> DataFrame:
    """id, key, bytes, digest, keeper for each distinct id and payload; keeper: the id of the response, for a revisit."""
    kind = dict(chunks.dtypes)["id"]
    all_of = materialise(chunks.select("id", "key", "last", "data").mapInArrow(_digested, f"id {kind}, key bigint, bytes bigint, digest string"), "warc-digests").distinct()
    shared = all_of.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = materialise(shared, "warc-shared")
    met = all_of.alias("a").join(shared.alias("s"), ["digest", "bytes"], "left")
    return materialise(met.select("id", "key", "bytes", "digest", F.when(~F.col("id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("keeper")), "warc-decided")


def _head(x: dict) -> bytes:
    """The WARC and HTTP header lines of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {x['bytes']}\r\n\r\n".encode()
    revisit = x["keeper"] is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{NAME}{'' if x['id'] is None else x['id']}>", f"WARC-Date: {DATE}"]
    if x["url"] is not None:
        lines.append("WARC-Target-URI: " + x["url"].replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += [f"WARC-Refers-To: <{NAME}{x['keeper']}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{x['digest']}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else x['bytes'])}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + http


def _written(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    name, out, packer, listed, records, size = "", None, None, [], 0, 0
    for batch in batches:
        for x in batch.to_pylist():
            if x["chunk"] == 0:
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                size += out.write(packer.compress(_head(x))) or 0
            if x["keeper"] is None:
                out.write(packer.compress(x["data"]))
            size += len(x["data"])
            if x["last"]:
                out.write(packer.compress(b"\r\n\r\n"))
                out.write(packer.flush())
                records += 1
                if size >= ARCHIVE:
                    out.close()
                    out = None
                    listed.append((name, records))
    if out is not None:
        out.close()
        listed.append((name, records))
    yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n, _ in listed], pa.string()), pa.array([r for _, r in listed], pa.int64())], names=["archive", "records"])


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0, page_id: str = "page_id", url: str = "url", payload: str = "html", chunk: int = CHUNK) -> DataFrame:
    """Write the archives; returns archive, records for each of them."""
    spark = pages.sparkSession
    bound_batches(spark)
    folder = qualified(spark, folder or scratch_path(spark, "archives"))
    chunks = chunk_rows(pages, page_id, url, payload, chunk)
    what = decided(chunks, least)
    met = chunks.join(what, chunks["id"].eqNullSafe(what["id"]) & (chunks["key"] == what["key"]))
    rows = met.select(chunks["id"], chunks["key"], "row", "url", "chunk", "last", "bytes", "digest", "keeper", F.when(F.col("keeper").isNull(), F.col("data")).otherwise(F.lit(b"")).alias("data"))
    # the chunks of a row come from one task, and AQE only ever splits a partition between such tasks
    done = rows.sortWithinPartitions("key", "row", "chunk").drop("key", "row").mapInArrow(lambda b: _written(b, folder), "archive string, records bigint")
    return materialise(done, "warc-list")


def _chunks(archive: str, most: int) -> Iterator[dict]:
    fs, path = pyarrow.fs.FileSystem.from_uri(archive)
    with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as raw, gzip.GzipFile(fileobj=raw) as f:
        for number in itertools.count():
            line = f.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no record at record {number} of {archive}")
            headers: dict[str, str] = {}
            while line := f.readline().rstrip(b"\r\n"):
                name, _, value = line.decode("utf-8", "replace").partition(": ")
                headers[name] = value
            left, stated = int(headers["Content-Length"]), 0
            while left:  # the HTTP head
                line = f.readline(left)
                left -= len(line)
                if line.lower().startswith(b"content-length:"):
                    stated = int(line.split(b":")[1])
                if line == b"\r\n" or not line:
                    break
            h, size = hashlib.sha1(), 0
            for chunk in itertools.count():
                data = f.read(min(most, left))
                left -= len(data)
                h.update(data)
                size += len(data)
                last = not left or not data
                yield {"archive": archive, "record": number, "chunk": chunk, "last": last, "headers": headers, "stated_bytes": stated, "bytes_so_far": size, "digest_so_far": bare_digest(h), "data": data}
                if last:
                    break
            if f.read(4) != b"\r\n\r\n":
                raise ValueError(f"record {number} of {archive} is cut short")


def _read(batches: Iterator[pa.RecordBatch], payload: bool, chunk: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("archive", pa.string()), ("record", pa.int64()), ("chunk", pa.int64()), ("last", pa.bool_()), ("headers", pa.map_(pa.string(), pa.string())), ("stated_bytes", pa.int64()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("data", pa.binary())])

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([r | {"headers": list(r["headers"].items())} | ({} if payload else {"data": None}) for r in rows], schema)

    for x in batches:
        for archive in x.column("archive").to_pylist():
            rows: list[dict] = []
            held = 0
            for row in _chunks(archive, chunk):
                rows.append(row)
                held += len(row["data"]) + 500
                if held > 4 << 20:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)


def read_archives(archives: DataFrame, payload: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of the archives, each archive read by one task; payload=False leaves data null. A path without scheme is one of Spark's default file system."""
    n, root = archives.count(), qualified(archives.sparkSession, "/").rstrip("/")
    full = F.when(F.col("archive").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("archive")).otherwise(F.concat(F.lit(root), "archive"))
    return archives.select(full.alias("archive")).repartition(max(1, min(n, 10_000)), "archive").mapInArrow(lambda b: _read(b, payload, chunk), READ)


def records(chunks: DataFrame) -> DataFrame:
    """archive, record, page_id, record_type, refers_to, payload_bytes, payload_digest, sound, one row for each record."""
    h = lambda k: F.col("headers")[k]
    named = lambda k: F.regexp_extract(h(k), f"{NAME}(-?[0-9]+)>", 1)
    number = lambda k: F.when(F.length(named(k)) > 0, named(k).cast("bigint"))
    stated = F.regexp_extract(h("WARC-Payload-Digest"), "sha1:([A-Z2-7]+)", 1)
    revisit = h("WARC-Type") == "revisit"
    return chunks.where("last").select(
        "archive", "record", number("WARC-Record-ID").alias("page_id"), h("WARC-Type").alias("record_type"), number("WARC-Refers-To").alias("refers_to"),
        F.when(revisit, F.col("stated_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"), F.when(revisit, stated).otherwise(F.col("digest_so_far")).alias("payload_digest"),
        (revisit | ((stated == F.col("digest_so_far")) & (F.col("stated_bytes") == F.col("bytes_so_far")))).alias("sound"))
