"""Ranks of groups of any size: range partitions, their counts, and offsets, so that no window spans a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .walkforward import Written


def numbered(df: DataFrame, by: list[str], order: list[Column], written: Written) -> DataFrame:
    """df with position (from 0, in its group) and total. order must tell all rows of a group apart.

    written: writes the rows with the number of their range and reads them. Windows are over one range of one group, or over the counts of
    ranges, of which there are as many as partitions and groups."""
    placed = written(df.repartitionByRange(*by, *order).withColumn("__mp_part", F.spark_partition_id()), "ranges")
    counts = placed.groupBy(*by, "__mp_part").agg(F.count(F.lit(1)).alias("__mp_n"))
    ahead = Window.partitionBy(*by).orderBy("__mp_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "__mp_part", F.coalesce(F.sum("__mp_n").over(ahead), F.lit(0)).alias("__mp_ahead"), F.sum("__mp_n").over(Window.partitionBy(*by)).alias("total"))
    inside = F.row_number().over(Window.partitionBy(*by, "__mp_part").orderBy(*order)) - 1
    keys = [*by, "__mp_part"]
    offsets = offsets.withColumnsRenamed({c: f"__mp_of_{c}" for c in keys})
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"__mp_of_{c}"))
    met = placed.withColumn("__mp_in", inside).join(F.broadcast(offsets), on)  # a row for each range and group
    return met.select(*df.columns, (F.col("__mp_ahead") + F.col("__mp_in")).alias("position"), "total")


def part_of(position: Column, total: Column, parts: int) -> Column:
    """The part (from 1) of a position if all are split into parts as even as possible, the first ones larger."""
    size, rest = F.floor(total / parts), total % parts
    large = rest * (size + 1)
    return F.when(position < large, F.floor(position / (size + 1))).otherwise(rest + F.floor((position - large) / F.greatest(size, F.lit(1)))).cast("int") + 1
