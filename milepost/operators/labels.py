"""Forward labels and trailing features of a panel.

Everything is a window over (project_code, segment) ordered by the month index; offsets are RANGE
frames, so a missing month is a missing value, never a neighbour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.months import SEGMENTS, index_of, month_index, months_between, text_or_null
from ..functions.numbers import count_if, ratio

def by() -> WindowSpec:
    return Window.partitionBy("project_code", "segment").orderBy("mi")


HORIZON = 3


def at_offset(c: Column | str, k: int) -> Column:
    """The value exactly k months from here in the same segment."""
    return F.max(c).over(by().rangeBetween(k, k))


def segment_end() -> Column:
    out = F.lit(None).cast("int")
    for name, _, _, last in SEGMENTS:
        out = F.when(F.col("segment") == name, F.lit(index_of(last))).otherwise(out)
    return out


def effective(panel: DataFrame) -> DataFrame:
    """Effective commitment and where it comes from."""
    source = F.when(F.col("revised_completion_date").isNotNull(), "REVISED").when(F.col("original_completion_date").isNotNull(), "ORIGINAL").otherwise("MISSING")
    return panel.withColumn("baseline", F.coalesce("revised_completion_date", "original_completion_date")).withColumn("baseline_source", source)


def labelled(panel: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Eligibility, label, event and reason, tested in a fixed order."""
    rev = F.col("revised_completion_date")
    p = effective(panel)
    p = p.withColumn("ahead", F.count("mi").over(by().rangeBetween(1, horizon))).withColumn("seen_before", F.coalesce(F.max(rev.isNotNull()).over(by().rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    for k in range(1, horizon + 1):
        p = p.withColumn(f"r{k}", at_offset(rev, k))
    event = F.lit(None).cast("int")
    for k in range(horizon, 0, -1):
        event = F.when(F.col(f"r{k}") > F.col("baseline"), F.lit(k)).otherwise(event)
    seen, unclear = rev.isNotNull(), F.lit(False)
    for k in range(1, horizon + 1):
        here = F.col(f"r{k}")
        unclear = unclear | (seen & here.isNull())
        seen = seen | here.isNotNull()
    p = p.withColumn("event_step", event)
    # Reason codes.
    reason = (F.when(F.col("mi") + horizon > segment_end(), "STRUCTURAL_GAP_OR_REGIME_BOUNDARY").when(F.col("ahead") < horizon, "PROJECT_DISAPPEARED_OR_MONTH_MISSING")
              .when(F.col("baseline").isNull(), "MISSING_BASELINE_COMPLETION_COMMITMENT").when(rev.isNull() & F.col("seen_before"), "BASELINE_REVISION_PERSISTENCE_AMBIGUOUS")
              .when(F.col("event_step").isNotNull(), "ELIGIBLE_POSITIVE").when(unclear, "FUTURE_REVISION_PERSISTENCE_AMBIGUOUS").otherwise("ELIGIBLE_NEGATIVE"))
    p = p.withColumn("reason", reason)
    positive = F.col("reason") == "ELIGIBLE_POSITIVE"
    value = F.lit(None).cast("string")
    for k in range(1, horizon + 1):
        value = F.when(F.col("event_step") == k, F.col(f"r{k}")).otherwise(value)
    return (p.withColumn("label", F.when(positive, 1).when(F.col("reason") == "ELIGIBLE_NEGATIVE", 0))
            .withColumn("extension_type", F.when(positive & rev.isNotNull(), "SUBSEQUENT_REVISION").when(positive, "FIRST_REVISION").when(F.col("reason") == "ELIGIBLE_NEGATIVE", "NONE"))
            .withColumn("event_month", F.when(positive, text_or_null(F.col("mi") + F.col("event_step")))).withColumn("event_value", F.when(positive, value))
            .withColumn("window_end", text_or_null(F.col("mi") + horizon)).drop("ahead", "seen_before", "event_step", *[f"r{k}" for k in range(1, horizon + 1)]))


def prior_counts(panel: DataFrame) -> DataFrame:
    """Upward schedule and cost revisions so far, and months observed."""
    before, upto = by().rowsBetween(Window.unboundedPreceding, -1), by().rowsBetween(Window.unboundedPreceding, 0)

    def raised(revised: str, original: str) -> Column:
        level = F.coalesce(F.last(revised, True).over(before), F.first(original, True).over(upto))
        return (F.col(revised) > level).cast("int")

    p = panel.withColumn("_s", raised("revised_completion_date", "original_completion_date")).withColumn("_c", raised("revised_cost", "original_cost"))
    return p.select(*panel.columns, F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("n_prior_schedule_extensions"), F.coalesce(F.sum("_c").over(upto), F.lit(0)).alias("n_prior_cost_revisions"), F.row_number().over(by()).cast("long").alias("observed_tenure_months"))


def features(panel: DataFrame, progress_from: str = "1997-06", start_from: str = "1999-02", also: tuple[str, ...] = ()) -> DataFrame:
    """The 36 features at T (I06-I10); nothing after T takes part. also: columns of the panel that go along."""
    p = prior_counts(effective(panel))
    spent, done, month = F.col("cumulative_expenditure"), F.col("physical_progress"), F.col("report_month")
    p = p.withColumn("exp_delta_1m", (spent - at_offset(spent, -1)).cast("double")).withColumn("exp_delta_3m", (spent - at_offset(spent, -3)).cast("double")).withColumn("past_progress_delta_3m", (done - at_offset(done, -3)).cast("double"))
    has = lambda c: F.col(c).isNotNull().cast("int")
    lacks = lambda c: F.col(c).isNull().cast("int")
    return p.select(
        "project_code", "report_month", "regime", "segment", "mi", "sector", "agency", "state", F.col("original_cost").cast("double").alias("original_cost"), spent.cast("double").alias("cumulative_expenditure_t"), F.col("revised_cost").cast("double").alias("revised_cost_t"), done.cast("double").alias("physical_progress_t"),
        months_between("approval_date", month).alias("project_age_months"), months_between(month, "original_completion_date").alias("months_to_original_schedule"), months_between(month, "baseline").alias("months_to_effective_schedule"),
        months_between("original_completion_date", "revised_completion_date").alias("schedule_revision_lag_months"), has("revised_completion_date").alias("schedule_has_been_revised"), months_between("start_date", month).alias("months_since_start"),
        ratio(spent, "original_cost").alias("expenditure_to_original_cost_ratio"), ratio("revised_cost", "original_cost").alias("revised_to_original_cost_ratio"), has("revised_cost").alias("cost_has_been_revised"),
        "exp_delta_1m", "exp_delta_3m", (F.col("exp_delta_3m") == 0).cast("int").alias("past_exp_stagnant_3m"), "past_progress_delta_3m", (F.col("past_progress_delta_3m") == 0).cast("int").alias("past_progress_stagnant_3m"),
        "n_prior_schedule_extensions", "n_prior_cost_revisions", "observed_tenure_months", lacks("state").alias("state_is_missing"), lacks("approval_date").alias("approval_date_is_missing"), lacks("original_completion_date").alias("original_completion_date_is_missing"),
        has("revised_cost").alias("revised_cost_is_present"), has("revised_completion_date").alias("revised_date_is_present"), has("physical_progress").alias("physical_progress_is_present"), (month >= progress_from).cast("int").alias("physical_progress_supported"),
        has("start_date").alias("start_date_is_present"), (month >= start_from).cast("int").alias("start_date_supported"), has("exp_delta_1m").alias("exp_delta_1m_is_supported"), has("exp_delta_3m").alias("exp_delta_3m_is_supported"), has("past_progress_delta_3m").alias("progress_delta_3m_is_supported"), *also)


def reasons(labels: DataFrame) -> DataFrame:
    """Counts of each reason by regime."""
    return labels.where("label is null").groupBy("regime", "reason").agg(F.count(F.lit(1)).alias("n_rows"))


def regime_summary(labels: DataFrame) -> DataFrame:
    """Eligible rows by regime."""
    return labels.where("label is not null").groupBy("regime").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("positives"), (F.sum("label") / F.count(F.lit(1))).alias("rate"), count_if(F.col("extension_type") == "FIRST_REVISION").alias("first"), count_if(F.col("extension_type") == "SUBSEQUENT_REVISION").alias("subsequent"))


def persistence(panel: DataFrame) -> DataFrame:
    """Per field and regime, how often a value later goes missing."""
    out = None
    for field in ("revised_completion_date", "revised_cost", "physical_progress"):
        has = F.col(field).isNotNull()
        p = panel.withColumn("gap", ~has & F.coalesce(F.max(has).over(by().rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))).withColumn("lost", ~has & F.coalesce(F.lag(has).over(by()), F.lit(False)) & (F.col("mi") - F.lag("mi").over(by()) == 1))
        one = p.groupBy("regime").agg(F.lit(field).alias("field"), F.count_distinct(F.when(F.col("gap"), F.struct("project_code", "segment"))).alias("projects"), count_if(F.col("gap")).alias("null_months"), count_if(F.col("lost")).alias("transitions"))
        out = one if out is None else out.unionByName(one)
    return out


def variants(panel: DataFrame, horizons: tuple[int, ...] = (1, 3, 6)) -> DataFrame:
    """Stagnation, non-improvement and escalation labels over each horizon (I15), all by one pass over the panel; endpoint: compare with T + horizon only."""
    spent, done, cost, names = "cumulative_expenditure", "physical_progress", "revised_cost", ("spent_flat", "no_progress", "cost_up")
    flags, counts, lines = [], [], []
    for h in horizons:
        flags.append(((F.count("mi").over(by().rangeBetween(1, h)) == h) & (F.col("mi") + h <= segment_end())).alias(f"inside_{h}"))
        counts.append(count_if(F.col(f"inside_{h}")).alias(f"n_{h}"))
        for endpoint in (False, True):
            frame = by().rangeBetween(h if endpoint else 1, h)
            of = [f"{c}_{h}_{endpoint}" for c in names]
            flags += [x.alias(c) for x, c in zip((F.max(spent).over(frame) == F.col(spent), F.max(done).over(frame) <= F.col(done), F.max(cost).over(frame) > F.col(cost)), of)]
            for c in of:
                value = F.when(F.col(f"inside_{h}"), F.col(c))
                counts += [F.count(value).alias(f"{c}_known"), count_if(value).alias(c)]
            lines.append(F.struct(F.col(f"n_{h}").alias("n"), F.lit(h).alias("horizon"), F.lit(endpoint).alias("endpoint"), *[F.col(f"{c}{k}").alias(f"{name}{k}") for name, c in zip(names, of) for k in ("_known", "")]))
    return panel.select("regime", *flags).groupBy("regime").agg(*counts).select("regime", F.inline(F.array(*lines))).where("n > 0").drop("n")


def calendar(panel: DataFrame) -> DataFrame:
    """Fiscal month (April is 1), fiscal year end, month index, signed log of expenditure (I16)."""
    m = F.pmod(F.col("mi"), F.lit(12)) + 1
    spent = F.col("cumulative_expenditure").cast("double")
    return panel.select("project_code", "report_month", (F.pmod(m - 4, F.lit(12)) + 1).cast("int").alias("fiscal_month"), (m == 3).cast("int").alias("fiscal_year_end"), month_index("report_month").alias("month_index"), F.round(F.signum(spent) * F.log1p(F.abs(spent)), 6).alias("signed_log"))
