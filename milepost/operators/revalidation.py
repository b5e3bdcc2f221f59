"""Re-validation of accepted months (D21): only months whose rows have changed are checked and written again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import validation


def digests(clean: DataFrame) -> DataFrame:
    """Rows and an order-free digest of each month."""
    row = F.xxhash64(*[F.col(c) for c in sorted(clean.columns)])
    return clean.groupBy("report_month").agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(row).alias("x"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("s"))


def revalidated(clean: DataFrame, folder: str, tag: str, known: bool) -> list[str]:
    """Bring folder/warnings (by month, each with a row of its counts) up to date with clean; returns the months that were checked.

    The ledger in folder/ledger-<n> holds every month's digest as it was checked; the next one is written beside it, and warnings of changed
    months replace theirs by dynamic partition overwrite. known: whether the folder has been written before. A month that left clean keeps no warnings."""
    spark = clean.sparkSession
    now = digests(clean)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    n = 0
    while fs.exists(hadoop(f"{folder}/ledger-{n}/_SUCCESS")):
        n += 1
    if known != bool(n):
        raise ValueError("the folder has no ledger" if known else "the folder has a ledger")
    now.write.parquet(f"{folder}/ledger-{n}.new")
    now = spark.read.parquet(f"{folder}/ledger-{n}.new")
    old = spark.read.parquet(f"{folder}/ledger-{n - 1}") if n else now.where("false")
    a, b = now.alias("a"), old.alias("b")
    differ = ~(F.col("a.n_rows").eqNullSafe(F.col("b.n_rows")) & F.col("a.x").eqNullSafe(F.col("b.x")) & F.col("a.s").eqNullSafe(F.col("b.s")))
    found = a.join(b, F.col("a.report_month") == F.col("b.report_month"), "full").where(differ).select(F.coalesce("a.report_month", "b.report_month").alias("m"), F.col("a.report_month").isNull().alias("gone")).collect()  # months
    changed, gone = sorted(r["m"] for r in found if not r["gone"]), [r["m"] for r in found if r["gone"]]
    if changed:
        rows = clean.where(F.col("report_month").isin(changed))
        warned = validation.warnings(rows).select("project_code", "field", "rule", "severity", F.lit(1).cast("bigint").alias("n"), "report_month")
        counted = rows.groupBy("report_month").agg(F.count(F.lit(1)).alias("n")).select(F.lit(None).cast("string").alias("project_code"), F.lit(None).cast("string").alias("field"), F.lit("ROWS").alias("rule"), F.lit("").alias("severity"), "n", "report_month")
        out = warned.unionByName(counted).withColumn("checked", F.lit(tag))
        out.hint("rebalance", "report_month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("report_month").parquet(f"{folder}/warnings")
    for m in gone:
        fs.delete(hadoop(f"{folder}/warnings/report_month={m}"), True)
    # the ledger stands only after its warnings; a run that is cut off between checks the same months again
    fs.delete(hadoop(f"{folder}/ledger-{n}"), True)
    fs.rename(hadoop(f"{folder}/ledger-{n}.new"), hadoop(f"{folder}/ledger-{n}"))
    return changed


def warnings(spark, folder: str) -> DataFrame:
    return spark.read.schema("project_code string, field string, rule string, severity string, n bigint, checked string, report_month string").parquet(f"{folder}/warnings")
