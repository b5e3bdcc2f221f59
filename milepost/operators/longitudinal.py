"""Month-over-month comparison (E01-E23). A transition joins a project's months that follow each other in the calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import decrease_band
from ..functions.keys import acronym, without_brackets, without_unit
from ..functions.months import months_between
from ..functions.numbers import change, count_if, state_of
from ..functions.text import compact, gestalt

FIELDS = ("project_name", "agency", "ministry", "sector", "state", "original_cost", "revised_cost", "cumulative_expenditure", "physical_progress")


def pairs(panel: DataFrame) -> DataFrame:
    """Rows of month mi beside the same code's row of month mi + 1; columns a_*, b_*."""
    a = panel.select("project_code", F.col("mi"), F.col("report_month").alias("month_a"), *[F.col(c).alias(f"a_{c}") for c in FIELDS])
    b = panel.select("project_code", (F.col("mi") - 1).alias("mi"), F.col("report_month").alias("month_b"), *[F.col(c).alias(f"b_{c}") for c in FIELDS])
    return a.join(b, ["project_code", "mi"])


def membership(panel: DataFrame) -> DataFrame:
    """Codes in both months, only the earlier, only the later, of every two consecutive months."""
    months = panel.select("mi").distinct()
    ends = months.alias("x").join(months.alias("y"), F.col("x.mi") + 1 == F.col("y.mi")).select(F.col("x.mi").alias("mi"))
    a = panel.select("project_code", "mi").withColumn("a", F.lit(1))
    b = panel.select("project_code", (F.col("mi") - 1).alias("mi")).withColumn("b", F.lit(1))
    m = a.join(b, ["project_code", "mi"], "full").join(ends, "mi", "left_semi")
    return m.groupBy("mi").agg(count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), count_if(F.col("b").isNull()).alias("earlier_only"), count_if(F.col("a").isNull()).alias("later_only"))


def changes(paired: DataFrame) -> DataFrame:
    """Classes of change of three amounts per transition."""
    long = paired.select("month_a", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), change(F.col(f"a_{c}"), F.col(f"b_{c}")).alias("class")) for c in ("revised_cost", "cumulative_expenditure", "physical_progress")])).alias("x")).select("month_a", "x.*")
    return long.groupBy("month_a", "field").pivot("class", ["increased", "decreased", "unchanged", "missing"]).count().na.fill(0)


def states(paired: DataFrame) -> DataFrame:
    return paired.groupBy("month_a", F.concat_ws("_to_", state_of("a_cumulative_expenditure"), state_of("b_cumulative_expenditure")).alias("transition")).agg(F.count(F.lit(1)).alias("n"))


def _differs(c: str, squeeze: bool = False) -> Column:
    clean = (lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))) if squeeze else (lambda x: x)
    return ~clean(F.col(f"a_{c}")).eqNullSafe(clean(F.col(f"b_{c}")))


def identity(paired: DataFrame) -> DataFrame:
    """Changes of names and groups per transition; sector and state also without white space."""
    return paired.groupBy("month_a").agg(*[count_if(_differs(c)).alias(f"{c}_changed") for c in FIELDS[:5]], *[count_if(_differs(c, True)).alias(f"{c}_changed_normalised") for c in ("sector", "state")])


# Short names of known agencies and words of their long forms; headings of groups.
SHORT = ("nhai", "wclcil", "seclcil", "eclcil", "nclcil", "cclcil", "iocl", "bpcl", "hpcl", "gail", "ongc")
SPELLED = ("nationalhighwaysauthority", "coalfields", "petroleum", "naturalgas", "oilcorporation")
HEADINGS = ("Ministry of Coal", "Ministry of Railways", "Ministry of Petroleum & Natural Gas", "MinistryofPetroleumNaturalGas")
SPELLING = 0.82


def agency_category(a: Column, b: Column) -> Column:
    """Six rules in order: formatting, abbreviation or acronym, group heading, spelling, another agency."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    x, y = compact(a), compact(b)
    both = lambda f: compact(f(a)) == compact(f(b))
    given = F.transform(F.regexp_extract_all(F.concat_ws(" ", a, b), F.lit(r"[\[(]([A-Za-z0-9/-]{2,})[\])]")), lambda t: F.lower(t))
    initials = F.filter(F.array(acronym(a), acronym(b)), lambda t: t != "")
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"))
    starts = F.exists(initials, lambda t: (F.length(t) >= 3) & (x.startswith(t) | y.startswith(t)))
    group = F.array_contains(F.concat(words(a), words(b)), "cil") & F.arrays_overlap(words(a), words(b))
    longer = compact(F.when(F.length(b) > F.length(a), b).otherwise(a))
    known = (x.isin(*SHORT) | y.isin(*SHORT)) & F.exists(F.array(*map(F.lit, SPELLED)), lambda t: F.contains(longer, t))
    shorter = both(without_brackets) | both(lambda c: without_unit(without_brackets(c))) | F.arrays_overlap(F.concat(given, initials), F.array(x, y)) | starts | group | known
    heading = lambda c: c.startswith("ministry") | c.startswith("department")
    return (F.when(x == y, "WHITESPACE_PUNCTUATION_CASING_DIFFERENCES").when(shorter, "ABBREVIATION_ACRONYM_DIFFERENCES")
            .when((heading(x) != heading(y)) | a.isin(*HEADINGS), "LIKELY_EXTRACTION_OR_GROUP_HEADING_PROPAGATION_ISSUE").when(gestalt(x, y) >= SPELLING, "APPARENT_SOURCE_SPELLING_CHANGES").otherwise("GENUINE_DIFFERENT_AGENCY_NAMES"))


def name_change(a: Column, b: Column) -> Column:
    """Whether only blanks, signs or case changed."""
    return F.when(compact(a) == compact(b), "SUPERFICIAL_ONLY").otherwise("SUBSTANTIVE_TEXT_CHANGE")


#: Where a row stands in a report.
PLACE = ["report_month", "source_page", "source_row_number"]


def bucketed(cells: DataFrame, name: str, path: str) -> DataFrame:
    """cells (PLACE, cells) as a table in as many buckets of PLACE as shuffles have partitions, so that joins on it leave it where it is."""
    spark = cells.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells.select(*PLACE, "cells").repartition(n, *PLACE).write.bucketBy(n, *PLACE).sortBy(*PLACE).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def with_places(found: DataFrame, panel: DataFrame) -> DataFrame:
    """Events with the page and row of both months."""
    for side in ("a", "b"):
        at = panel.select("project_code", F.col("report_month").alias(f"month_{side}"), F.col("source_page").alias(f"page_{side}"), F.col("source_row_number").alias(f"row_{side}"))
        found = found.join(at, ["project_code", f"month_{side}"], "left")
    return found


def with_raw_cells(found: DataFrame, cells: DataFrame) -> DataFrame:
    """Events (with_places) with the raw cells of both months beside them (E19). cells: `bucketed`; only events are shuffled."""
    for side, name in (("a", "previous_raw_cells"), ("b", "current_raw_cells")):
        at = cells.withColumnsRenamed({"report_month": f"month_{side}", "source_page": f"page_{side}", "source_row_number": f"row_{side}", "cells": name})
        found = found.join(at.hint("shuffle_merge"), [f"month_{side}", f"page_{side}", f"row_{side}"], "left")
    return found


def events(paired: DataFrame) -> DataFrame:
    """Every event that a transition can raise, one row each."""
    drop = lambda c: (F.col(f"a_{c}") - F.col(f"b_{c}")).cast("double")
    one = lambda rule, cond, detail, size=None: F.when(cond, F.struct(F.lit(rule).alias("rule"), detail.alias("detail"), (F.lit(None).cast("double") if size is None else size).alias("size")))
    spent, done = drop("cumulative_expenditure"), drop("physical_progress")
    band = decrease_band(F.round(done, 6))
    found = [
        one("agency_changed", _differs("agency"), agency_category(F.col("a_agency"), F.col("b_agency"))), one("project_name_changed", _differs("project_name"), name_change(F.col("a_project_name"), F.col("b_project_name")), F.round(gestalt(compact(F.col("a_project_name")), compact(F.col("b_project_name"))), 6)),
        one("state_changed", _differs("state"), F.concat_ws(" -> ", "a_state", "b_state")), one("expenditure_decreased", spent > 0, F.when((F.col("a_cumulative_expenditure") > 0) & (F.col("b_cumulative_expenditure") == 0), "positive_to_zero").otherwise("other"), spent),
        one("progress_decreased", done > 0, band, done), one("revised_cost_decreased", drop("revised_cost") > 0, F.lit(""), drop("revised_cost")),
    ]
    return paired.select("project_code", "month_a", "month_b", F.inline(F.array_compact(F.array(*found))))


def flag_rates(panel: DataFrame, flagged: Column, dims: tuple[str, ...]) -> DataFrame:
    """Flagged rows and projects, rate and share per value of each dimension, where any."""
    long = panel.withColumn("_f", F.coalesce(flagged, F.lit(False))).select("project_code", "_f", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("(MISSING)")).alias("value")) for d in dims])).alias("x")).select("project_code", "_f", "x.*")
    g = long.groupBy("dimension", "value").agg(count_if(F.col("_f")).alias("flagged"), F.count_distinct(F.when(F.col("_f"), F.col("project_code"))).alias("projects"), F.count(F.lit(1)).alias("n_rows"))
    return g.withColumn("rate", F.round(F.col("flagged") / F.col("n_rows") * 100, 4)).withColumn("share", F.round(F.col("flagged") / F.sum("flagged").over(Window.partitionBy("dimension")) * 100, 4)).where("flagged > 0")


def two_months(panel: DataFrame, first: str, second: str, flagged: Column) -> DataFrame:
    """Codes flagged in both months, only the first, only the second; ages in months of flagged rows that have begun."""
    two = panel.where(F.col("report_month").isin(first, second)).withColumn("_f", F.coalesce(flagged, F.lit(False)))
    age = F.when(F.col("_f"), months_between("start_date", "report_month"))
    at = lambda m: F.bool_or(F.col("_f") & (F.col("report_month") == m))
    per = two.withColumn("_age", F.when(age >= 0, age)).groupBy("project_code").agg(at(first).alias("a"), at(second).alias("b"), F.collect_list("_age").alias("ages"))  # two at most
    long = per.select("*", F.explode_outer("ages").alias("age"), F.row_number().over(Window.partitionBy("project_code").orderBy(F.lit(1))).alias("nth"))
    one = F.col("nth") == 1
    return long.agg(count_if(one & F.col("a") & F.col("b")).alias("both"), count_if(one & F.col("a") & ~F.col("b")).alias("first_only"), count_if(one & ~F.col("a") & F.col("b")).alias("second_only"), count_if(one & (F.col("a") | F.col("b"))).alias("unique_projects"),
                    F.min("age").cast("long").alias("age_min"), F.median("age").alias("age_median"), F.round(F.avg("age"), 2).alias("age_mean"), F.max("age").cast("long").alias("age_max"))


def depth(panel: DataFrame, *at_least: int) -> DataFrame:
    """Projects with at least k observations, and those in every month."""
    n = panel.groupBy("project_code").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.explode(F.array(*[F.when(F.col("n") >= k, F.lit(k)) for k in at_least])).alias("k")).where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("projects"))
