"""Raw report rows to records (C01-C17): an ordered walk as windows over (source_file, raw_sequence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

#: Tokens that every column of a layout's header must contain, by layout.
LAYOUTS = {"THREE": (("s.no",), ("project",), ("cost",)), "FOUR": (("s.no",), ("project",), ("cost",), ("state",))}


def walk() -> WindowSpec:
    return Window.partitionBy("source_file").orderBy("raw_sequence")


def layout_of(cells: Column) -> Column:
    """The one layout whose tokens a header row holds; null if none or several fit."""
    fits = []
    for name, columns in LAYOUTS.items():
        ok = F.size(cells) == len(columns)
        for i, words in enumerate(columns):
            for w in words:
                ok = ok & F.contains(F.lower(F.coalesce(F.try_element_at(cells, F.lit(i + 1)), F.lit(""))), F.lit(w))
        fits.append(F.when(ok, F.lit(name)))
    found = F.array_compact(F.array(*fits))
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def classified(raw: DataFrame) -> DataFrame:
    """header, total, project, heading, continuation, empty or unclassified."""
    cell = lambda i: F.trim(F.coalesce(F.try_element_at("cells", F.lit(i)), F.lit("")))
    blank = F.forall("cells", lambda x: F.trim(F.coalesce(x, F.lit(""))) == "")
    kind = (F.when(blank, "empty").when(layout_of(F.col("cells")).isNotNull(), "header").when(F.lower(cell(2)).startswith("total"), "total").when(cell(1).rlike("^[0-9]+$"), "project")
            .when((cell(1) == "") & (cell(2) != "") & (cell(3) == ""), "heading").when((cell(1) == "") & (cell(3) != ""), "continuation").otherwise("unclassified"))
    return raw.withColumn("row_class", kind)


def filled(rows: DataFrame) -> DataFrame:
    """The heading and the layout above each row."""
    so_far = walk().rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("state", F.last(F.when(F.col("row_class") == "heading", F.try_element_at("cells", F.lit(2))), True).over(so_far)).withColumn("layout", F.last(layout_of(F.col("cells")), True).over(so_far))


def merged(rows: DataFrame) -> DataFrame:
    """Continuations join the record before them, cell by cell; the span of pages is kept."""
    so_far = walk().rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum((F.col("row_class") != "continuation").cast("int")).over(so_far)
    r = rows.withColumn("run", run).where(F.col("row_class").isin("project", "continuation"))
    g = r.groupBy("source_file", "run").agg(F.array_sort(F.collect_list(F.struct("raw_sequence", "row_class", "cells", "state", "source_page"))).alias("x"), F.min("source_page").alias("first_page"), F.max("source_page").alias("last_page"))
    g = g.where(F.col("x")[0]["row_class"] == "project")
    joined = lambda i: F.array_join(F.filter(F.transform("x", lambda y: F.trim(F.coalesce(F.try_element_at(y["cells"], F.lit(i)), F.lit("")))), lambda t: t != ""), " ")
    return g.select("source_file", F.col("x")[0]["raw_sequence"].alias("raw_sequence"), F.col("x")[0]["state"].alias("state"), joined(1).alias("serial"), joined(2).alias("project"), joined(3).alias("cost"), "first_page", "last_page")


def records(joined: DataFrame) -> DataFrame:
    """Typed records: code, name, cost."""
    code = F.regexp_extract("project", r"^(\S+)", 1)
    return joined.select(F.col("source_file").alias("report_month"), F.col("serial").cast("int").alias("serial"), "state", code.alias("project_code"), F.trim(F.regexp_replace("project", r"^\S+", "")).alias("project_name"), F.col("cost").try_cast("double").alias("original_cost"))


def rejects(rows: DataFrame) -> DataFrame:
    """Rows that go nowhere, with why."""
    return rows.where(F.col("row_class").isin("unclassified", "empty")).select("source_file", "raw_sequence", F.when(F.col("row_class") == "empty", "EMPTY_ROW").otherwise("UNCLASSIFIED_ROW").alias("reason"))


def removed(rows: DataFrame) -> DataFrame:
    """Rows of each class per file (C14)."""
    return rows.groupBy("source_file", "row_class").agg(F.count(F.lit(1)).alias("n"))


def pages(rows: DataFrame) -> DataFrame:
    """Page range of each file, and whether it has no gap (C04); layouts in it."""
    return rows.groupBy("source_file").agg(F.min("source_page").alias("first_page"), F.max("source_page").alias("last_page"), (F.max("source_page") - F.min("source_page") + 1 == F.count_distinct("source_page")).alias("contiguous"), F.count_distinct("layout").alias("layouts"))
