"""Portfolio analytics (N01-N24) over panel and risk rows.

"Latest" always means latest within the filter: the filter comes first, then the latest row of each
project, by max_by over one shuffle. Money totals are over latest rows, progress over observations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import count_if, mean, quantiles, total


@dataclass(frozen=True)
class Scope:
    """Filters of N01; state, sector and agency are ILIKE patterns with live wildcards."""

    from_month: str | None = None
    to_month: str | None = None
    state: str | None = None
    sector: str | None = None
    agency: str | None = None
    project_code: str | None = None

    def on(self, df: DataFrame) -> DataFrame:
        if self.from_month:
            df = df.where(F.col("report_month") >= self.from_month)
        if self.to_month:
            df = df.where(F.col("report_month") <= self.to_month)
        for name in ("state", "sector", "agency"):
            if (text := getattr(self, name)) and name in df.columns:
                df = df.where(F.col(name).ilike(f"%{text}%"))
        return df.where(F.col("project_code") == self.project_code) if self.project_code else df


def latest(df: DataFrame) -> DataFrame:
    """The latest row of each project."""
    return df.groupBy("project_code").agg(F.max_by(F.struct(*df.columns), "report_month").alias("x")).select("x.*")


def filled(c: str) -> Column:
    return F.when(F.col(c) != "", F.col(c))


def overview(panel: DataFrame, risk: DataFrame, scope: Scope) -> DataFrame:
    """One row of counts, spans, means and latest totals; null totals on an empty scope."""
    seen = scope.on(panel)
    obs = seen.agg(F.count_distinct("project_code").alias("unique_project_count"), F.count(F.lit(1)).alias("observation_count"), F.min("report_month").alias("earliest_observation_month"), F.max("report_month").alias("latest_observation_month"),
                   *[F.count_distinct(filled(c)).alias(n) for c, n in (("state", "states_count"), ("agency", "agencies_count"), ("sector", "sectors_count"))], mean("physical_progress").alias("average_physical_progress"), F.count("physical_progress").alias("progress_reporting_observations"),
                   *[count_if(F.col(c).isNull()).alias(n) for c, n in (("original_cost", "missing_orig_cost"), ("revised_cost", "missing_rev_cost"), ("cumulative_expenditure", "missing_exp"), ("physical_progress", "missing_progress"))])
    money = latest(seen).agg(total("original_cost").alias("total_sanctioned_cost"), total("revised_cost").alias("total_revised_cost"), total("cumulative_expenditure").alias("total_cumulative_expenditure"))
    assessed = scope.on(risk).agg(F.count_distinct("project_code").alias("assessed_project_count"))
    one = lambda df: df.withColumn("_one", F.lit(1))  # noqa: E731  single rows side by side
    return one(obs).join(one(money), "_one").join(one(assessed), "_one").drop("_one")


def risk_by(risk: DataFrame, *by: str) -> DataFrame:
    """Assessed projects and mean probabilities per group."""
    return risk.groupBy(*by).agg(F.count_distinct("project_code").alias("risk_assessed_project_count"), F.round(F.avg("risk_probability"), 6).alias("average_risk_probability"), F.round(F.avg("raw_probability"), 6).alias("average_raw_probability"))


def with_risk(df: DataFrame, stats: DataFrame, by: str) -> DataFrame:
    return df.join(stats, by, "left").withColumn("risk_assessed_project_count", F.coalesce("risk_assessed_project_count", F.lit(0).cast("long")))


def trends(panel: DataFrame, risk: DataFrame, scope: Scope) -> DataFrame:
    """Per observed month."""
    by = scope.on(panel).groupBy("report_month").agg(
        F.count(F.lit(1)).alias("observation_count"), F.count_distinct("project_code").alias("unique_project_count"), total("cumulative_expenditure").alias("total_cumulative_expenditure"), mean("cumulative_expenditure").alias("average_cumulative_expenditure"),
        total("original_cost").alias("total_original_cost"), total("revised_cost").alias("total_revised_cost"), mean("physical_progress").alias("average_physical_progress"), F.count("physical_progress").alias("progress_reporting_count"))
    return with_risk(by, risk_by(scope.on(risk), "report_month"), "report_month")


def grouped(panel: DataFrame, scope: Scope, by: str, original: bool = False) -> DataFrame:
    """Counts and progress over observations, money over latest rows, per value of by."""
    seen = scope.on(panel)
    some = F.col(by).isNotNull() & (F.col(by) != "")
    obs = seen.where(some).groupBy(by).agg(F.count_distinct("project_code").alias("unique_project_count"), F.count(F.lit(1)).alias("observation_count"), mean("physical_progress").alias("average_physical_progress"), F.count("physical_progress").alias("progress_reporting_count"))
    money = latest(seen).where(some).groupBy(by).agg(total("cumulative_expenditure").alias("total_cumulative_expenditure"), *([total("original_cost").alias("total_original_cost")] if original else []))
    return obs.join(money, by, "left")


def geography(panel: DataFrame, risk: DataFrame, scope: Scope) -> DataFrame:
    return with_risk(grouped(panel, scope, "state"), risk_by(scope.on(risk), "state"), "state").orderBy(F.desc("unique_project_count"), "state")


def sectors(panel: DataFrame, risk: DataFrame, scope: Scope) -> DataFrame:
    return with_risk(grouped(panel, scope, "sector", True), risk_by(scope.on(risk), "sector"), "sector").orderBy(F.desc("unique_project_count"), "sector")


def agencies(panel: DataFrame, scope: Scope) -> DataFrame:
    """Risk columns are fixed: none is known per agency."""
    return grouped(panel, scope, "agency").withColumn("risk_assessed_project_count", F.lit(0).cast("long")).withColumn("average_risk_probability", F.lit(None).cast("double")).withColumn("average_raw_probability", F.lit(None).cast("double")).orderBy(F.desc("unique_project_count"), "agency")


def financials(panel: DataFrame, scope: Scope) -> DataFrame:
    """Sums and means of latest rows, overruns and ratios."""
    over = F.col("revised_cost") > F.col("original_cost")
    one = lambda c, n: [F.count(c).alias(f"{n}_count"), total(c).alias(f"{n}_total"), mean(c).alias(f"{n}_mean")]
    out = latest(scope.on(panel)).agg(*one("original_cost", "original"), *one("revised_cost", "revised"), *one("cumulative_expenditure", "spent"), count_if(over).alias("overrun_count"), total(F.when(over, F.col("revised_cost") - F.col("original_cost"))).alias("escalation_total"))
    return out.withColumn("spent_to_original", F.round(F.col("spent_total") / F.when(F.col("original_total") != 0, F.col("original_total")), 4)).withColumn("spent_to_revised", F.round(F.col("spent_total") / F.when(F.col("revised_total") != 0, F.col("revised_total")), 4))


def progress(panel: DataFrame, scope: Scope) -> DataFrame:
    """Reporting, coverage, distribution."""
    p = F.col("physical_progress")
    out = scope.on(panel).agg(F.count(p).alias("reporting"), count_if(p.isNull()).alias("missing"), F.round(F.count(p) / F.count(F.lit(1)), 4).alias("coverage"), mean(p).alias("mean"), F.min(p).cast("double").alias("min"), F.max(p).cast("double").alias("max"), quantiles(p, 0.1, 0.25, 0.5, 0.75, 0.9).alias("q"))
    return out.select("reporting", "missing", "coverage", "mean", "min", "max", *[F.round(F.col("q")[i], 2).alias(n) for i, n in enumerate(("p10", "p25", "median", "p75", "p90"))])


def progress_by(panel: DataFrame, scope: Scope, by: str = "sector") -> DataFrame:
    return scope.on(panel).groupBy(by).agg(F.count(F.lit(1)).alias("observations"), F.count("physical_progress").alias("reporting"), mean("physical_progress").alias("mean"))


SCORE_AT = (("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95))


def scores(df: DataFrame, c: str = "risk_probability", *by: str) -> DataFrame:
    """min, p25, median, p75, p90, p95, max, mean of scores."""
    out = df.groupBy(*by).agg(F.count(c).alias("n"), F.min(c).alias("min"), quantiles(c, *[p for _, p in SCORE_AT]).alias("q"), F.max(c).alias("max"), F.round(F.avg(c), 6).alias("mean"))
    return out.select(*by, "n", "min", *[F.round(F.col("q")[i], 6).alias(n) for i, (n, _) in enumerate(SCORE_AT)], "max", "mean")


SORTABLE = ("project_code", "report_month", "project_name", "agency", "sector", "state", "original_cost", "revised_cost", "cumulative_expenditure", "physical_progress")


def page_of(panel: DataFrame, scope: Scope, search: str | None, sort: str, descending: bool, page: int, size: int) -> DataFrame:
    """One page of rows in a total order."""
    if sort not in SORTABLE:
        raise ValueError(f"can't sort by {sort}")
    rows = scope.on(panel)
    if search:
        like = f"%{search}%"
        rows = rows.where(F.col("project_code").ilike(like) | F.col("project_name").ilike(like) | F.col("agency").ilike(like))
    order = F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)
    return rows.orderBy(order, "project_code", "report_month").offset((page - 1) * size).limit(size)


def options(panel: DataFrame) -> DataFrame:
    """Distinct filled values of each dimension."""
    dims = ("agency", "sector", "state", "report_month")
    return panel.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims])).alias("x")).select("x.*").where("value <> ''").distinct()


def quick_search(panel: DataFrame, text: str, limit: int) -> DataFrame:
    """Groups whose code, name or agency holds text, latest first."""
    like = f"%{text}%"
    hit = panel.where(F.col("project_code").ilike(like) | F.col("project_name").ilike(like) | F.col("agency").ilike(like))
    return hit.groupBy("project_code", "project_name", "agency").agg(F.max("report_month").alias("latest_month")).orderBy(F.desc("latest_month"), "project_code", "project_name", "agency").limit(limit)


def project_stats(panel: DataFrame) -> DataFrame:
    """Span and latest row of every project."""
    s = panel.groupBy("project_code").agg(F.count(F.lit(1)).alias("observations"), F.min("report_month").alias("first_month"), F.max("report_month").alias("last_month"), F.max_by(F.struct("project_name", "agency", "sector", "state", F.col("cumulative_expenditure").cast("double").alias("cumulative_expenditure"), F.col("physical_progress").cast("double").alias("physical_progress")), "report_month").alias("latest"))
    return s.select("project_code", "observations", "first_month", "last_month", "latest.*")


def cost_history(panel: DataFrame) -> DataFrame:
    """Cost per month with the latest ratio of revised to original."""
    r = (F.col("revised_cost").cast("double") / F.when(F.col("original_cost") > 0, F.col("original_cost").cast("double")))
    last = panel.groupBy("project_code").agg(F.round(F.max_by(r, "report_month"), 4).alias("latest_ratio"))
    return panel.select("project_code", "report_month", F.col("original_cost").cast("double").alias("original_cost"), F.col("revised_cost").cast("double").alias("revised_cost")).join(last, "project_code")


def schedule_history(panel: DataFrame) -> DataFrame:
    """Completion dates per month with the latest ones."""
    last = panel.groupBy("project_code").agg(F.max_by(F.struct(F.col("original_completion_date").alias("latest_original"), F.col("revised_completion_date").alias("latest_revised")), "report_month").alias("x")).select("project_code", "x.*")
    return panel.select("project_code", "report_month", "original_completion_date", "revised_completion_date").join(last, "project_code")


def signals(panel: DataFrame) -> DataFrame:
    """Revisions of every project: a reported value that differs from the original and from the last one counted."""
    by = Window.partitionBy("project_code").orderBy("report_month")

    def new(revised: str, original: str) -> DataFrame:
        rows = panel.where(F.col(revised).isNotNull() & ~F.col(revised).eqNullSafe(F.col(original)))
        last = F.lag(revised).over(by)
        return rows.select("project_code", (last.isNull() | (last != F.col(revised))).cast("long").alias("new")).groupBy("project_code").agg(F.sum("new").alias("n"))

    base = panel.groupBy("project_code").agg(F.max_by(F.struct("revised_cost", "original_cost", "revised_completion_date"), "report_month").alias("x"), F.min("report_month").alias("first_month"), F.max("report_month").alias("last_month"))
    out = base.join(new("revised_cost", "original_cost").withColumnRenamed("n", "cost_revisions"), "project_code", "left").join(new("revised_completion_date", "original_completion_date").withColumnRenamed("n", "schedule_revisions"), "project_code", "left")
    return out.select("project_code", F.col("x.revised_cost").isNotNull().alias("has_revised_cost"), F.col("x.revised_completion_date").isNotNull().alias("has_revised_date"), F.round(F.col("x.revised_cost").cast("double") / F.col("x.original_cost").cast("double"), 4).alias("cost_ratio"),
                      F.coalesce("cost_revisions", F.lit(0)).alias("cost_revisions"), F.coalesce("schedule_revisions", F.lit(0)).alias("schedule_revisions"), "first_month", "last_month")


def recent_changes(panel: DataFrame) -> DataFrame:
    """Last against previous row of every project."""
    by = Window.partitionBy("project_code").orderBy("report_month")
    before = lambda c: F.lag(c).over(by)
    rows = panel.select("project_code", "report_month", before("report_month").alias("previous_month"), *[(F.col(c) - before(c)).cast("double").alias(f"{c}_change") for c in ("cumulative_expenditure", "physical_progress", "revised_cost")],
                        (~F.col("revised_completion_date").eqNullSafe(before("revised_completion_date"))).alias("date_changed"), F.row_number().over(Window.partitionBy("project_code").orderBy(F.desc("report_month"))).alias("back"))
    return rows.where("back = 1 and previous_month is not null").drop("back")


def availability(panel: DataFrame, risk: DataFrame) -> DataFrame:
    """What is known of every project."""
    p = panel.groupBy("project_code").agg(F.bool_or(F.col("revised_cost").isNotNull()).alias("has_costs"), F.bool_or(F.col("physical_progress").isNotNull()).alias("has_progress"))
    return p.join(risk.select("project_code").distinct().withColumn("r", F.lit(True)), "project_code", "left").withColumn("has_risk", F.col("r").isNotNull()).drop("r")
