"""Serial numbers of completion lists against the ranges that a list may use, and where rows come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Serials in a bin of the range join.
BIN = 64
PROVENANCE = ("source_file", "source_page", "source_row_number", "source_serial_number", "extraction_method")


def islands(rows: DataFrame) -> DataFrame:
    """Runs of serials that follow each other: report_month, first, last."""
    seen = rows.where("source_serial_number is not null").select("report_month", F.col("source_serial_number").cast("long").alias("k")).distinct()
    run = F.col("k") - F.row_number().over(Window.partitionBy("report_month").orderBy("k"))  # the serials of one list
    return seen.withColumn("run", run).groupBy("report_month", "run").agg(F.min("k").alias("first"), F.max("k").alias("last")).drop("run")


def _bins(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.withColumn("bin", F.explode(F.sequence(F.floor(F.col(a) / BIN), F.floor(F.col(b) / BIN))))


def covered(found: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each island with each range that it shares serials with, and how many: an equi-join on month and bin, counted per bin."""
    i, r = _bins(found, "first", "last"), _bins(ranges, "low", "high")
    both = i.join(r, ["report_month", "bin"])
    shared = F.least("last", "high", (F.col("bin") + 1) * BIN - 1) - F.greatest("first", "low", F.col("bin") * BIN) + 1
    return both.withColumn("shared", shared).where("shared > 0").groupBy("report_month", "first", "last", "low", "high").agg(F.sum("shared").alias("shared"))


def checked(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """By month: rows, islands, serials that a range has and no row (gaps), that no range has (foreign), that come again (repeated), ranges that
    overlap, rows without full provenance, and the first fault. ranges: report_month, low, high; months without any are to have 1 to the number of rows."""
    plain = rows.groupBy("report_month").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("source_serial_number").isNull()).alias("unnumbered"), F.count_if(_without()).alias("without_provenance"))
    own = plain.join(ranges.select("report_month").distinct(), "report_month", "left_anti").select("report_month", F.lit(1).cast("long").alias("low"), F.col("n_rows").alias("high"))
    allowed = ranges.select("report_month", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high")).unionByName(own)
    found = islands(rows)
    met = covered(found, allowed)
    in_islands = found.groupBy("report_month").agg(F.count(F.lit(1)).alias("islands"), F.sum(F.col("last") - F.col("first") + 1).alias("serials"))
    in_ranges = allowed.groupBy("report_month").agg(F.sum(F.col("high") - F.col("low") + 1).alias("wanted"))
    w = Window.partitionBy("report_month").orderBy("low")  # the ranges of one list
    overlap = allowed.withColumn("o", F.col("low") <= F.lag("high").over(w)).groupBy("report_month").agg(F.count_if("o").alias("overlaps"))
    out = plain.join(in_islands, "report_month", "left").join(in_ranges, "report_month").join(met.groupBy("report_month").agg(F.sum("shared").alias("shared")), "report_month", "left").join(overlap, "report_month")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = out.select("report_month", "n_rows", zero("islands").alias("islands"), (F.col("wanted") - zero("shared")).cast("long").alias("gaps"), (zero("serials") - zero("shared")).alias("foreign"), (F.col("n_rows") - F.col("unnumbered") - zero("serials")).cast("long").alias("repeated"), "overlaps", "without_provenance")
    status = F.when(F.col("overlaps") > 0, "RANGES_OVERLAP").when(F.col("foreign") > 0, "FOREIGN_SERIAL").when(F.col("repeated") > 0, "REPEATED_SERIAL").when(F.col("gaps") > 0, "SERIAL_GAP").when(F.col("without_provenance") > 0, "NO_PROVENANCE").otherwise("ACCEPTED")
    return out.withColumn("status", status)


def _without():
    out = F.lit(False)
    for c in PROVENANCE:
        out = out | F.coalesce(F.col(c).cast("string") == "", F.lit(True))
    return out
