"""Record validation and quality metrics (D01-D21). Rows are flagged, never changed or dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import count_if

DATES = ("approval_date", "start_date", "original_completion_date", "revised_completion_date")
NUMBERS = ("original_cost", "revised_cost", "cumulative_expenditure", "physical_progress")
CODE = r"^([0-9]{6}|N[0-9]{8}|[0-9]{9})$"
# Severity, priority and category of each rule.
ERROR, WARNING, INFO = ("ERROR", "HIGH", "STRUCTURAL_OR_IMPOSSIBLE"), ("WARNING", "MEDIUM", "STRONG_PLAUSIBILITY_ANOMALY"), ("INFO", "LOW", "UNUSUAL_BUSINESS_STATE")
RULES = {
    "missing_project_code": ERROR, "invalid_project_code": ERROR, "unparseable_date": ERROR, "unparseable_numeric": ERROR, "nonpositive_original_cost": ERROR, "nonpositive_revised_cost": ERROR,
    "physical_progress_above_100": ERROR, "negative_expenditure": ERROR, "completion_date_before_start_date": ERROR, "extreme_expenditure_cost_mismatch": WARNING, "progress_reported_before_start": WARNING,
    "zero_expenditure_positive_progress": INFO, "expenditure_with_zero_progress": INFO, "full_progress_still_ongoing": INFO, "revised_cost_below_original": INFO,
}


def warnings(panel: DataFrame, structurally_absent: Column | None = None) -> DataFrame:
    """One row per record and rule that it breaks: key, field, rule, and the rule's class."""
    c, absent = F.col, F.lit(False) if structurally_absent is None else structurally_absent
    none = c("project_code").isNull() | (c("project_code") == "")
    spent, done, orig, rev, start = c("cumulative_expenditure"), c("physical_progress"), c("original_cost"), c("revised_cost"), c("start_date")
    idle = (spent == 0) & (done > 0)
    early = F.coalesce(start > c("report_month"), F.lit(False))
    late = F.array_join(F.array_compact(F.array(*[F.when(c(f) < start, F.lit(f)) for f in ("original_completion_date", "revised_completion_date")])), ",")

    def warn(rule: str, cond: Column, field: Column | str) -> Column:
        return F.when(cond, F.struct(F.lit(rule).alias("rule"), (F.lit(field) if isinstance(field, str) else field).alias("field")))

    found = [
        warn("missing_project_code", none & ~absent, "project_code"), warn("invalid_project_code", ~none & ~c("project_code").rlike(CODE), "project_code"),
        *[warn("unparseable_date", (c(f"{f}_raw") != "") & c(f).isNull(), f) for f in DATES if f"{f}_raw" in panel.columns], *[warn("unparseable_numeric", (c(f"{f}_raw") != "") & c(f).isNull(), f) for f in NUMBERS if f"{f}_raw" in panel.columns],
        warn("nonpositive_original_cost", orig <= 0, "original_cost"), warn("nonpositive_revised_cost", rev <= 0, "revised_cost"), warn("negative_expenditure", spent < 0, "cumulative_expenditure"),
        warn("extreme_expenditure_cost_mismatch", (rev != 0) & (spent > 3 * rev), "cumulative_expenditure"), warn("revised_cost_below_original", rev < orig, "revised_cost"), warn("physical_progress_above_100", done > 100, "physical_progress"),
        warn("progress_reported_before_start", idle & early, "physical_progress"), warn("zero_expenditure_positive_progress", idle & ~early, "cumulative_expenditure,physical_progress"),
        warn("expenditure_with_zero_progress", (spent > 0) & (done == 0), "cumulative_expenditure,physical_progress"), warn("full_progress_still_ongoing", done == 100, "physical_progress"), warn("completion_date_before_start_date", F.length(late) > 0, late),
    ]
    long = panel.select("project_code", "report_month", F.inline(F.array_compact(F.array(*found))))
    return classified(long)


def classified(long: DataFrame) -> DataFrame:
    """Severity, priority and category by rule; unknown rules are warnings."""
    kinds = long.sparkSession.createDataFrame([(k, *v) for k, v in RULES.items()], "rule string, severity string, priority string, category string")
    out = long.join(F.broadcast(kinds), "rule", "left")  # one row for each rule
    return out.select("project_code", "report_month", "field", "rule", *[F.coalesce(n, F.lit(d)).alias(n) for n, d in zip(("severity", "priority", "category"), WARNING)])


def duplicates(panel: DataFrame, *by: str) -> DataFrame:
    """All rows of a key that comes more than once, with the count."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return panel.where(F.col("project_code").rlike(CODE)).withColumn("duplicate_count", n).where("duplicate_count > 1")


def counts_by(warned: DataFrame, dim: str, known: list[str]) -> DataFrame:
    """Counts per value of dim, 0 for known values without."""
    all_of = warned.sparkSession.createDataFrame([(k,) for k in known], f"{dim} string")
    return all_of.join(warned.groupBy(dim).agg(F.count(F.lit(1)).alias("n")), dim, "left").select(dim, F.coalesce("n", F.lit(0)).alias("n"))


def metrics(panel: DataFrame, warned: DataFrame) -> DataFrame:
    """Records, warned records, warnings, missing and invalid codes."""
    a = panel.agg(F.count(F.lit(1)).alias("records"), count_if(F.col("project_code").isNull()).alias("missing_codes")).withColumn("_k", F.lit(1))
    b = warned.agg(F.count_distinct("project_code", "report_month").alias("warned_rows"), F.count(F.lit(1)).alias("warnings"), count_if(F.col("rule") == "invalid_project_code").alias("invalid_codes")).withColumn("_k", F.lit(1))
    return a.join(b, "_k").drop("_k")


def quality_rows(panel: DataFrame, warned: DataFrame) -> DataFrame:
    """Financial progress, its gap to physical progress, sorted rules."""
    rules = warned.groupBy("project_code", "report_month").agg(F.array_join(F.array_sort(F.collect_set("rule")), "|").alias("warning_rules"))
    cost = F.coalesce(F.when(F.col("revised_cost") > 0, F.col("revised_cost")), F.when(F.col("original_cost") > 0, F.col("original_cost"))).cast("double")
    financial = F.col("cumulative_expenditure").cast("double") / cost * 100
    return panel.join(rules, ["project_code", "report_month"], "left").select("project_code", "report_month", F.round(financial, 6).alias("financial_progress"), F.round(F.col("physical_progress").cast("double") - financial, 6).alias("physical_financial_gap"), F.coalesce("warning_rules", F.lit("")).alias("warning_rules"))


def parse_success(panel: DataFrame) -> DataFrame:
    """Of the raw values that are present, how many parsed."""
    rows = panel.select(F.explode(F.array(*[F.struct(F.lit("date" if f in DATES else f).alias("field"), (F.col(f"{f}_raw") != "").alias("given"), F.col(f).isNotNull().alias("parsed")) for f in (*DATES, *NUMBERS)])).alias("x")).select("x.*").where("given")
    return rows.groupBy("field").agg(F.count(F.lit(1)).alias("given"), count_if(F.col("parsed")).alias("parsed"))


def by_month(warned: DataFrame, months: DataFrame) -> DataFrame:
    """Warnings of each rule per month and over all, 0 where none."""
    wide = warned.groupBy("report_month").pivot("rule", sorted(RULES)).count()
    out = months.join(wide, "report_month", "left").na.fill(0)
    total = out.agg(F.lit("ALL").alias("report_month"), *[F.sum(r).alias(r) for r in sorted(RULES)])
    return out.select("report_month", *sorted(RULES)).unionByName(total)
