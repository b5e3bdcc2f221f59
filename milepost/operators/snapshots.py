"""Versions of accepted scores, and how a later model's scores agree with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["project_code", "report_month", "regime"]


def digest(scores: DataFrame) -> DataFrame:
    """Rows and order-free digests of keys and of keys with scores, by regime."""
    key, row = F.xxhash64(*KEY), F.xxhash64(*KEY, "score")
    return scores.groupBy("regime").agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(key).alias("keys"), F.sum(row.cast("decimal(38,0)")).alias("content"))


def accept(scores: DataFrame, folder: str, version: str) -> None:
    """Write scores (KEY, score) as a version with its digests; a version is written once."""
    scores.select(*KEY, "score").write.parquet(f"{folder}/version={version}/scores")
    digest(scores.sparkSession.read.parquet(f"{folder}/version={version}/scores")).write.parquet(f"{folder}/version={version}/digests")


def accepted(spark, folder: str, version: str) -> DataFrame:
    """The scores of a version, if they are still what was accepted; else an error."""
    scores = spark.read.parquet(f"{folder}/version={version}/scores")
    said, now = spark.read.parquet(f"{folder}/version={version}/digests").alias("a"), digest(scores).alias("b")
    differ = F.coalesce((F.col("a.keys") != F.col("b.keys")) | (F.col("a.content") != F.col("b.content")) | (F.col("a.n_rows") != F.col("b.n_rows")), F.lit(True))
    bad = [r[0] for r in said.join(now, F.col("a.regime") == F.col("b.regime"), "full").where(differ).select(F.coalesce("a.regime", "b.regime")).collect()]  # a row for each regime
    if bad:
        raise ValueError(f"version {version} is not what was accepted: {sorted(bad)}")
    return scores


def reconciled(old: DataFrame, new: DataFrame, tolerance: float) -> DataFrame:
    """By regime: rows of both, keys that only one has, the largest difference, and the status."""
    both = old.select(*KEY, F.col("score").alias("a"), F.lit(1).alias("_a")).join(new.select(*KEY, F.col("score").alias("b"), F.lit(1).alias("_b")), KEY, "full")
    gone, extra = F.count_if(F.col("_b").isNull()), F.count_if(F.col("_a").isNull())
    out = both.groupBy("regime").agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_rows"), gone.alias("missing"), extra.alias("extra"), F.max(F.abs(F.col("a") - F.col("b"))).alias("most"))
    status = F.when((F.col("missing") > 0) | (F.col("extra") > 0), "KEYS_DIFFER").when(F.coalesce(F.col("most") > tolerance, F.lit(False)), "SCORES_DIFFER").otherwise("ACCEPTED")
    return out.withColumn("status", status)
