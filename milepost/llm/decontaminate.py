"""Benchmark decontamination by winnowing.

Every run of 10 words holds 6 word 5-grams; the smallest hash of each such run is kept as a
fingerprint, in documents and in items alike. A span of 10 words that both share thus shares a
fingerprint. Fingerprints are joined on their hash, and every meeting is extended word by word in
both directions; it counts if the words that match reach 10.

Items of 1 to 9 words are one window of their own length: their single n-gram is the fingerprint.

Defined cases: null or wordless texts have no words and are clean; items without words never
match; repeated rows get equal verdicts, each its own row; rows that share a doc_id but not their
text are judged apart; an item_id that is null counts as the empty string; items that share an
item_id count once; very long texts are read in one piece; an empty
table of either kind gives no rows or no hits; any other column, of whatever name, is left alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Words, bound_batches, materialise, same, slices, text_key

WINDOW, GRAM = 10, 5
#: Bits of the map that keeps most document fingerprints from leaving their task; a full map only costs time.
MAP_BITS = 1 << 22
HIT = "array<struct<h:bigint,kind:int,pos:int,left:int,words:string>>"


def winnowed(words: Words) -> np.ndarray:
    """Numbers of the words at which a kept 5-gram begins."""
    grams, _ = words.grams(GRAM, WINDOW)
    per = WINDOW - GRAM + 1
    n = len(grams) - per + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = grams[:n].copy()
    for i in range(1, per):
        np.minimum(least, grams[i : i + n], out=least)
    whole = words.row[:n] == words.row[WINDOW - 1 : WINDOW - 1 + n]
    kept = np.zeros(len(grams), bool)
    for i in range(per):
        kept[i : i + n] |= whole & (least == grams[i : i + n])
    return np.flatnonzero(kept)


def found(words: Words, kinds: list[int], only: np.ndarray | None) -> list[list[dict]]:
    """For each row its fingerprints (those in the bit map `only`), with the words that extending can need."""
    out: list[list[dict]] = [[] for _ in range(len(words.first) - 1)]
    for kind in kinds:
        if kind == WINDOW:
            grams, _ = words.grams(GRAM, WINDOW)
            at = winnowed(words)
        else:
            grams, whole = words.grams(kind, kind)
            at = np.flatnonzero(whole)
        hashes = grams[at]
        if only is not None:
            bit = hashes % np.uint64(MAP_BITS)
            on = (only[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
            at, hashes = at[on], hashes[on]
        for i, h in zip(at.tolist(), hashes.view(np.int64).tolist()):
            r = int(words.row[i])
            lo, hi = int(words.first[r]), int(words.first[r + 1])
            a, b = (max(lo, i - WINDOW + GRAM), min(hi, i + WINDOW)) if kind == WINDOW else (i, i + kind)
            out[r].append({"h": h, "kind": kind, "pos": i - lo, "left": i - a, "words": words.text(a, b)})
    return out


def _rows(batches: Iterator[pa.RecordBatch], kinds: list[int] | None, only: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    kept = pa.list_(pa.struct([("h", pa.int64()), ("kind", pa.int32()), ("pos", pa.int32()), ("left", pa.int32()), ("words", pa.string())]))
    for whole in batches:
        for batch in slices(whole, "text"):
            words = Words(batch.column("text"))
            n = np.diff(words.first)
            if kinds is None:  # an item has the kind of its length
                hits = [[x for x in hits if x["kind"] == min(k, WINDOW)][: None if k >= WINDOW else 1] for k, hits in zip(n.tolist(), found(words, sorted({min(WINDOW, int(k)) for k in n if k}), None))]
            else:
                hits = found(words, kinds, only)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(2)), pa.array(n.astype(np.int64)), pa.array(hits, kept)], names=["id", "tk", "n_words", "hits"])


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the words around each meeting of fingerprints; keep what reaches a window."""
    for batch in batches:
        out: dict[str, list] = {"id": [], "tk": [], "item_id": [], "a": [], "b": []}
        for x in batch.to_pylist():
            mine, theirs = x["words"].split(" "), x["i_words"].split(" ")
            i, j = x["left"], x["i_left"]
            if x["kind"] != WINDOW:
                a, b = (i, i + x["kind"]) if mine == theirs else (0, 0)
            else:
                a = i
                while a and j - i + a > 0 and mine[a - 1] == theirs[j - i + a - 1]:
                    a -= 1
                b = i
                while b < len(mine) and j - i + b < len(theirs) and mine[b] == theirs[j - i + b]:
                    b += 1
                if b - a < WINDOW or b - i < GRAM:
                    a = b = 0
            if b > a:
                for k, v in (("id", x["id"]), ("tk", x["tk"]), ("item_id", x["item_id"]), ("a", x["pos"] - i + a), ("b", x["pos"] - i + b)):
                    out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out["id"], batch.schema.field("id").type), pa.array(out["tk"], pa.int64()), pa.array(out["item_id"], pa.string()), pa.array(out["a"], pa.int32()), pa.array(out["b"], pa.int32())], names=list(out))


def benchmark_hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, tk (of its text), n_words, n_hit, items (sorted ids), spans (merged later)."""
    spark = docs.sparkSession
    bound_batches(spark)
    kind = dict(docs.dtypes)[doc_id]
    the_items = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.lit(0).cast("long").alias("tk"), F.col(item_text).alias("text"))
    item_rows = the_items.mapInArrow(lambda b: _rows(b, None, None), f"id string, tk bigint, n_words bigint, hits {HIT}")
    prints = materialise(item_rows.select(F.col("id").alias("item_id"), F.inline("hits")).select("item_id", "h", "kind", F.col("left").alias("i_left"), F.col("words").alias("i_words")).distinct(), "item-prints")
    kinds = sorted(r[0] for r in prints.select("kind").distinct().collect())  # 10 values at most
    bits = np.zeros(MAP_BITS // 64, np.uint64)
    bit = F.pmod(F.conv(F.hex("h"), 16, 10).cast("decimal(20,0)"), F.lit(MAP_BITS)).cast("long")
    for r in prints.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("v")).collect():  # MAP_BITS / 64 rows at most
        bits[r["w"]] = np.uint64(r["v"] & (2**64 - 1))
    mine = docs.select(F.col(doc_id).alias("id"), text_key(text).alias("tk"), F.col(text).alias("text"))
    rows = materialise(mine.mapInArrow(lambda b: _rows(b, kinds, bits), f"id {kind}, tk bigint, n_words bigint, hits {HIT}"), "doc-prints")
    met = rows.select("id", "tk", F.inline("hits")).join(prints, ["h", "kind"])
    spans = met.select("id", "tk", "kind", "pos", "left", "words", "item_id", "i_left", "i_words").mapInArrow(_extended, f"id {kind}, tk bigint, item_id string, a int, b int")
    per_doc = spans.groupBy("id", "tk").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("e")), lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], acc["e"]))).alias("n"), F.greatest(acc["e"], x["b"]).alias("e")))["n"]
    per_doc = materialise(per_doc.withColumn("n_hit", covered.cast("long")), "doc-hits")
    return rows.join(per_doc, same(rows, per_doc, "id", "tk"), "left").select(
        rows["id"].alias(doc_id), rows["tk"], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<a:int,b:int>>")).alias("spans"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark window; all columns stay as they are."""
    bad = benchmark_hits(docs, items).where("n_hit > 0").select(F.col("doc_id").alias("__mp_id"), F.col("tk").alias("__mp_tk")).distinct()
    bad = materialise(bad, "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__mp_id"]) & (text_key() == bad["__mp_tk"]), "left_anti")
