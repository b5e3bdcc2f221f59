"""Panel readiness audit (F01-F19) and linkage to completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.numbers import change, count_if, spread

def era() -> WindowSpec:
    """A project's months in one era."""
    return Window.partitionBy("project_code", "regime").orderBy("mi")


AUDITED = ("approval_date", "start_date", "original_completion_date", "revised_completion_date", "original_cost", "revised_cost", "cumulative_expenditure", "physical_progress", "ministry", "sector", "state", "agency")
#: Fields that a regime's layout lacks: absent by structure, not missing.
ABSENT = {"LEGACY": ("ministry", "start_date")}


def adjacent(panel: DataFrame) -> DataFrame:
    """Rows whose month before is there too, within an era; columns p_* of that month."""
    fields = ("cumulative_expenditure", "physical_progress", "revised_cost", "revised_completion_date")
    rows = panel.select("project_code", "regime", "report_month", "mi", *fields, F.lag("mi").over(era()).alias("p_mi"), *[F.lag(c).over(era()).alias(f"p_{c}") for c in fields])
    return rows.where(F.col("mi") - F.col("p_mi") == 1)


def coverage(panel: DataFrame) -> DataFrame:
    """Per month of an era: rows, codes new since the listed month before, codes gone by the next; null at the ends."""
    months = panel.select("regime", "report_month").distinct()
    w = Window.partitionBy("regime").orderBy("report_month")
    months = months.withColumn("n", F.row_number().over(w)).withColumn("last", F.max("n").over(Window.partitionBy("regime")))
    seen = panel.select("project_code", "regime", "report_month").distinct().join(F.broadcast(months), ["regime", "report_month"])  # a row for each month
    own = Window.partitionBy("project_code", "regime").orderBy("n")
    seen = seen.withColumn("new", ~F.coalesce(F.lag("n").over(own) == F.col("n") - 1, F.lit(False))).withColumn("gone", ~F.coalesce(F.lead("n").over(own) == F.col("n") + 1, F.lit(False)))
    return seen.groupBy("regime", "report_month").agg(F.count(F.lit(1)).alias("projects"), F.max(F.when(F.col("n") > 1, 0)).alias("_f"), F.max(F.when(F.col("n") < F.col("last"), 0)).alias("_l"), count_if(F.col("new")).alias("new"), count_if(F.col("gone")).alias("gone")).select(
        "regime", "report_month", "projects", F.when(F.col("_f").isNotNull(), F.col("new")).alias("new_projects"), F.when(F.col("_l").isNotNull(), F.col("gone")).alias("disappearing"))


def missingness(panel: DataFrame, *by: str) -> DataFrame:
    """Present, structurally absent, source missing and their rates, per field and group."""
    absent = F.lit(False)
    parts = []
    for f in AUDITED:
        lacks = [regime for regime, fields in ABSENT.items() if f in fields]
        absent = F.col("regime").isin(lacks) if lacks else F.lit(False)
        has = F.col(f).isNotNull() & (F.col(f).cast("string") != "")
        parts.append(F.struct(F.lit(f).alias("field"), F.when(absent, "absent").when(has, "present").otherwise("missing").alias("state")))
    long = panel.select(*by, F.explode(F.array(*parts)).alias("x")).select(*by, "x.*")
    g = long.groupBy(*by, "field").agg(F.count(F.lit(1)).alias("n_rows"), *[count_if(F.col("state") == k).alias(k) for k in ("present", "absent", "missing")])
    return g.select(*by, "field", "n_rows", "present", "absent", "missing", *[F.round(F.col(k) / F.col("n_rows"), 4).alias(f"{k}_rate") for k in ("present", "absent", "missing")])


def change_events(panel: DataFrame, field: str) -> DataFrame:
    """Comparable pairs, ups and downs and their sizes."""
    d = (F.col(field) - F.col(f"p_{field}")).cast("double")
    a = adjacent(panel).where(d.isNotNull()).withColumn("d", d)
    q = lambda cond, p: F.round(F.percentile(F.when(cond, F.abs("d")), F.lit(p)), 4)
    up, down = F.col("d") > 0, F.col("d") < 0
    return a.groupBy("regime").agg(F.count(F.lit(1)).alias("pairs"), count_if(F.col("d") == 0).alias("unchanged"), count_if(up).alias("up"), count_if(down).alias("down"), q(up, 0.5).alias("up_median"), q(up, 0.9).alias("up_p90"), q(down, 0.5).alias("down_median"), F.count_distinct(F.when(up | down, F.col("project_code"))).alias("projects_changed"))


def unchanged_runs(panel: DataFrame, field: str) -> DataFrame:
    """Lengths of runs of one value over months that follow each other (2 and more), counted."""
    step = F.col(field).isNotNull() & (F.lag(field).over(era()) == F.col(field)) & (F.col("mi") - F.lag("mi").over(era()) == 1)
    rows = panel.select("project_code", "regime", "mi", F.col(field), (~F.coalesce(step, F.lit(False))).cast("int").alias("start")).where(F.col(field).isNotNull())
    runs = rows.withColumn("run", F.sum("start").over(era())).groupBy("project_code", "regime", "run").agg(F.count(F.lit(1)).alias("length")).where("length >= 2")
    return runs.groupBy("regime", "length").agg(F.count(F.lit(1)).alias("runs"), F.count_distinct("project_code").alias("projects"))


def numeric_history(panel: DataFrame, field: str) -> DataFrame:
    """Rises, falls, standstills, drops to zero between adjacent months."""
    return adjacent(panel).groupBy("regime").agg(*[count_if(change(F.col(f"p_{field}"), F.col(field)) == k).alias(k) for k in ("increased", "decreased", "unchanged", "missing")], count_if((F.col(f"p_{field}") > 0) & (F.col(field) == 0)).alias("positive_to_zero"))


def zero_spending(panel: DataFrame) -> DataFrame:
    """Zero expenditure per agency, and projects that ever or always have it."""
    zero = F.col("cumulative_expenditure") == 0
    per = panel.groupBy("agency", "project_code").agg(F.count(F.lit(1)).alias("n"), count_if(zero).alias("z"), F.bool_or(zero).alias("ever"), F.bool_and(zero).alias("always"))
    return per.groupBy("agency").agg(F.sum("n").alias("n_rows"), F.sum("z").alias("zero_rows"), count_if(F.col("ever")).alias("ever_zero"), count_if(F.col("always")).alias("always_zero"))


def category_coverage(panel: DataFrame) -> DataFrame:
    """Rows, projects, months per category value; sparse under 10 rows or 3 projects."""
    long = panel.select("project_code", "report_month", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.nullif(F.col(d), F.lit("")), F.lit("(MISSING)")).alias("value")) for d in ("ministry", "sector", "agency", "state")])).alias("x")).select("project_code", "report_month", "x.*")
    g = long.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("project_code").alias("projects"), F.count_distinct("report_month").alias("months"))
    return g.withColumn("sparse", (F.col("n_rows") < 10) | (F.col("projects") < 3))


def horizons(panel: DataFrame, *hs: int) -> DataFrame:
    """For each horizon and era: rows under the calendar's ceiling, rows with every month ahead, and what happens there.

    All frames share one partitioning and order, so every horizon comes from the same shuffle and sort."""
    base = F.coalesce("revised_completion_date", "original_completion_date")
    seen = []
    for h in hs:
        ahead, window = era().rangeBetween(1, h), era().rangeBetween(0, h)
        at = lambda c: F.max(c).over(era().rangeBetween(h, h))  # noqa: E731, B023
        seen.append(F.struct(
            F.lit(h).alias("horizon"), (F.count("mi").over(ahead) == h).alias("complete"), (at("revised_cost") > F.col("revised_cost")).alias("cost_endpoint"),
            F.when(F.count("revised_cost").over(window) >= 2, F.max("revised_cost").over(window) > F.first("revised_cost", True).over(window)).alias("cost_any"),
            (at("revised_completion_date") > base).alias("schedule_endpoint"), (F.max("revised_completion_date").over(ahead) > base).alias("schedule_any"),
            (at("physical_progress") == F.col("physical_progress")).alias("progress_flat"), (at("cumulative_expenditure") == F.col("cumulative_expenditure")).alias("spending_flat")))
    ends = panel.groupBy("regime").agg(F.max("mi").alias("end"))
    rows = panel.select("regime", "mi", F.array(*seen).alias("x")).select("regime", "mi", F.inline("x")).join(F.broadcast(ends), "regime")  # a row for each era
    out = ("cost_endpoint", "cost_any", "schedule_endpoint", "schedule_any", "progress_flat", "spending_flat")
    return rows.where(F.col("mi") + F.col("horizon") <= F.col("end")).groupBy("regime", "horizon").agg(
        F.count(F.lit(1)).alias("ceiling"), count_if(F.col("complete")).alias("complete"),
        *[x for c in out for x in (count_if(F.col("complete") & F.col(c).isNotNull()).alias(f"{c}_known"), count_if(F.col("complete") & F.col(c)).alias(c))])


def distribution(panel: DataFrame, field: str, *by: str) -> DataFrame:
    return panel.groupBy(*by).agg(*spread(field))


def depth_summary(rows: DataFrame, n: str) -> DataFrame:
    """How deep histories are: fewest, most, median, mean, and the share with at least 3, 6 and 12 observations.

    Depths are counted first, so that the median reads one row for each depth."""
    c = rows.groupBy(n).agg(F.count(F.lit(1)).alias("k"))
    deep = lambda at: F.round(100 * F.sum(F.when(F.col(n) >= at, F.col("k")).otherwise(0)) / F.sum("k"), 4).alias(f"from_{at}")
    return c.agg(F.sum("k").alias("projects"), F.min(n).alias("least"), F.max(n).alias("most"), F.expr(f"percentile({n}, 0.5, k)").alias("median"), F.round(F.sum(F.col(n) * F.col("k")) / F.sum("k"), 4).alias("mean"), deep(3), deep(6), deep(12))


def linked(panel: DataFrame, done: DataFrame) -> DataFrame:
    """One row per code of either side: what the panel and the completions know of it."""
    a = panel.groupBy("project_code").agg(F.count(F.lit(1)).alias("observations"), F.max("mi").alias("last_seen"), F.max_by(F.struct("cumulative_expenditure", "physical_progress", "report_month", "regime"), "mi").alias("x")).select("project_code", "observations", "last_seen", "x.*")
    b = done.groupBy("project_code").agg(F.min("mi").alias("completed_mi"), F.min("report_month").alias("completion_month"))
    return a.join(b, "project_code", "full")
