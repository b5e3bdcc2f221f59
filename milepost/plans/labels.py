"""Queries of labels and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.months import SEGMENTS
from ..operators import labels as op
from .surrogate import COMPLETED_SQL, PANEL_SQL, completed, panel

WITH = "WITH " + PANEL_SQL
BY = "(PARTITION BY project_code, segment ORDER BY mi"
PRIOR = f"""pri AS (SELECT *, CASE WHEN revised_completion_date > coalesce(last_value(revised_completion_date IGNORE NULLS) OVER b, first_value(original_completion_date IGNORE NULLS) OVER u) THEN 1 ELSE 0 END AS s,
  CASE WHEN revised_cost > coalesce(last_value(revised_cost IGNORE NULLS) OVER b, first_value(original_cost IGNORE NULLS) OVER u) THEN 1 ELSE 0 END AS c FROM panel
  WINDOW b AS {BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), u AS {BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
prior AS (SELECT *, CAST(sum(s) OVER u AS BIGINT) AS n_prior_schedule_extensions, CAST(sum(c) OVER u AS BIGINT) AS n_prior_cost_revisions, row_number() OVER {BY}) AS observed_tenure_months FROM pri WINDOW u AS {BY} ROWS UNBOUNDED PRECEDING))"""
ENDS = "CASE segment " + " ".join(f"WHEN '{n}' THEN {int(b[:4]) * 12 + int(b[5:]) - 1}" for n, _, _, b in SEGMENTS) + " END"
OFF = "max({}) OVER (PARTITION BY project_code, segment ORDER BY mi RANGE BETWEEN {} AND {})"
ahead = lambda c, k: OFF.format(c, f"{k} FOLLOWING", f"{k} FOLLOWING")
behind = lambda c, k: OFF.format(c, f"{k} PRECEDING", f"{k} PRECEDING")
LABEL = f"""l1 AS (SELECT *, coalesce(revised_completion_date, original_completion_date) AS baseline, CASE WHEN revised_completion_date IS NOT NULL THEN 'REVISED' WHEN original_completion_date IS NOT NULL THEN 'ORIGINAL' ELSE 'MISSING' END AS baseline_source,
  count(*) OVER (PARTITION BY project_code, segment ORDER BY mi RANGE BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS ahead,
  count(revised_completion_date) OVER {BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS seen,
  {ahead('revised_completion_date', 1)} AS r1, {ahead('revised_completion_date', 2)} AS r2, {ahead('revised_completion_date', 3)} AS r3, {ENDS} AS seg_end FROM panel),
l2 AS (SELECT *, CASE WHEN r1 > baseline THEN 1 WHEN r2 > baseline THEN 2 WHEN r3 > baseline THEN 3 END AS step, revised_completion_date AS r0 FROM l1),
l3 AS (SELECT *, CASE WHEN mi + 3 > seg_end THEN 'STRUCTURAL_GAP_OR_REGIME_BOUNDARY' WHEN ahead < 3 THEN 'PROJECT_DISAPPEARED_OR_MONTH_MISSING' WHEN baseline IS NULL THEN 'MISSING_BASELINE_COMPLETION_COMMITMENT'
  WHEN r0 IS NULL AND seen THEN 'BASELINE_REVISION_PERSISTENCE_AMBIGUOUS' WHEN step IS NOT NULL THEN 'ELIGIBLE_POSITIVE'
  WHEN (r0 IS NOT NULL AND r1 IS NULL) OR (coalesce(r0, r1) IS NOT NULL AND r2 IS NULL) OR (coalesce(r0, r1, r2) IS NOT NULL AND r3 IS NULL) THEN 'FUTURE_REVISION_PERSISTENCE_AMBIGUOUS' ELSE 'ELIGIBLE_NEGATIVE' END AS reason FROM l2),
lab AS (SELECT *, CASE reason WHEN 'ELIGIBLE_POSITIVE' THEN 1 WHEN 'ELIGIBLE_NEGATIVE' THEN 0 END AS label,
  CASE WHEN reason = 'ELIGIBLE_POSITIVE' THEN CASE WHEN r0 IS NULL THEN 'FIRST_REVISION' ELSE 'SUBSEQUENT_REVISION' END WHEN reason = 'ELIGIBLE_NEGATIVE' THEN 'NONE' END AS extension_type,
  CASE WHEN reason = 'ELIGIBLE_POSITIVE' THEN printf('%04d-%02d', (mi+step)//12, (mi+step)%12+1) END AS event_month, CASE WHEN reason = 'ELIGIBLE_POSITIVE' THEN CASE step WHEN 1 THEN r1 WHEN 2 THEN r2 ELSE r3 END END AS event_value,
  printf('%04d-%02d', (mi+3)//12, (mi+3)%12+1) AS window_end FROM l3)"""
mi_of = lambda c: f"(CAST({c}[1:4] AS INT)*12 + CAST({c}[6:7] AS INT) - 1)"
FEATURES = f"""{PRIOR},
feat AS (SELECT *, coalesce(revised_completion_date, original_completion_date) AS baseline, CAST(cumulative_expenditure - {behind('cumulative_expenditure', 1)} AS DOUBLE) AS exp_delta_1m, CAST(cumulative_expenditure - {behind('cumulative_expenditure', 3)} AS DOUBLE) AS exp_delta_3m, CAST(physical_progress - {behind('physical_progress', 3)} AS DOUBLE) AS past_progress_delta_3m FROM prior),
features AS (SELECT project_code, report_month, regime, segment, mi, sector, agency, state, CAST(original_cost AS DOUBLE) AS original_cost, CAST(cumulative_expenditure AS DOUBLE) AS cumulative_expenditure_t, CAST(revised_cost AS DOUBLE) AS revised_cost_t, CAST(physical_progress AS DOUBLE) AS physical_progress_t,
  mi - {mi_of('approval_date')} AS project_age_months, {mi_of('original_completion_date')} - mi AS months_to_original_schedule, {mi_of('baseline')} - mi AS months_to_effective_schedule, {mi_of('revised_completion_date')} - {mi_of('original_completion_date')} AS schedule_revision_lag_months,
  CAST(revised_completion_date IS NOT NULL AS INT) AS schedule_has_been_revised, mi - {mi_of('start_date')} AS months_since_start, CAST(cumulative_expenditure AS DOUBLE) / nullif(CAST(original_cost AS DOUBLE), 0) AS expenditure_to_original_cost_ratio, CAST(revised_cost AS DOUBLE) / nullif(CAST(original_cost AS DOUBLE), 0) AS revised_to_original_cost_ratio,
  CAST(revised_cost IS NOT NULL AS INT) AS cost_has_been_revised, exp_delta_1m, exp_delta_3m, CAST(exp_delta_3m = 0 AS INT) AS past_exp_stagnant_3m, past_progress_delta_3m, CAST(past_progress_delta_3m = 0 AS INT) AS past_progress_stagnant_3m,
  n_prior_schedule_extensions, n_prior_cost_revisions, observed_tenure_months, CAST(state IS NULL AS INT) AS state_is_missing, CAST(approval_date IS NULL AS INT) AS approval_date_is_missing, CAST(original_completion_date IS NULL AS INT) AS original_completion_date_is_missing,
  CAST(revised_cost IS NOT NULL AS INT) AS revised_cost_is_present, CAST(revised_completion_date IS NOT NULL AS INT) AS revised_date_is_present, CAST(physical_progress IS NOT NULL AS INT) AS physical_progress_is_present, CAST(report_month >= '1997-06' AS INT) AS physical_progress_supported,
  CAST(start_date IS NOT NULL AS INT) AS start_date_is_present, CAST(report_month >= '1999-02' AS INT) AS start_date_supported, CAST(exp_delta_1m IS NOT NULL AS INT) AS exp_delta_1m_is_supported, CAST(exp_delta_3m IS NOT NULL AS INT) AS exp_delta_3m_is_supported, CAST(past_progress_delta_3m IS NOT NULL AS INT) AS progress_delta_3m_is_supported FROM feat)"""

# Names of features.
A, B, C, D = ["sector", "agency", "state", "original_cost", "cumulative_expenditure_t", "revised_cost_t", "physical_progress_t", "project_age_months", "months_to_original_schedule", "months_to_effective_schedule", "schedule_revision_lag_months", "months_since_start"], ["expenditure_to_original_cost_ratio", "revised_to_original_cost_ratio", "schedule_has_been_revised", "cost_has_been_revised"], ["exp_delta_1m", "exp_delta_3m", "past_exp_stagnant_3m", "past_progress_delta_3m", "past_progress_stagnant_3m"], [
    "state_is_missing", "approval_date_is_missing", "original_completion_date_is_missing", "revised_cost_is_present", "revised_date_is_present", "physical_progress_is_present", "physical_progress_supported", "start_date_is_present", "start_date_supported", "exp_delta_1m_is_supported", "exp_delta_3m_is_supported", "progress_delta_3m_is_supported"]
KEY = ["project_code", "report_month"]


def _features(*cols: str):
    return (lambda s, d: op.features(panel(s, d)).select(*KEY, *cols)), f"{WITH}, {FEATURES} SELECT {', '.join([*KEY, *cols])} FROM features"


def _persist_sql() -> str:
    one = lambda f: f"""SELECT regime, '{f}' AS field, count(DISTINCT CASE WHEN gap THEN project_code || segment END) AS projects, count(*) FILTER (WHERE gap) AS null_months, count(*) FILTER (WHERE lost) AS transitions FROM (
      SELECT *, {f} IS NULL AND count({f}) OVER {BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS gap, {f} IS NULL AND lag({f}) OVER {BY}) IS NOT NULL AND mi - lag(mi) OVER {BY}) = 1 AS lost FROM panel) GROUP BY regime"""  # noqa: E731
    return f"{WITH} " + " UNION ALL ".join(map(one, ("revised_completion_date", "revised_cost", "physical_progress")))


def _variants_sql() -> str:
    def one(h: int, e: bool) -> str:
        f = f"OVER (PARTITION BY project_code, segment ORDER BY mi RANGE BETWEEN {h if e else 1} FOLLOWING AND {h} FOLLOWING)"
        return f"""SELECT regime, {h} AS horizon, {e} AS endpoint, count(a) AS spent_flat_known, count(*) FILTER (WHERE a) AS spent_flat, count(b) AS no_progress_known, count(*) FILTER (WHERE b) AS no_progress, count(c) AS cost_up_known, count(*) FILTER (WHERE c) AS cost_up FROM (
          SELECT *, max(cumulative_expenditure) {f} = cumulative_expenditure AS a, max(physical_progress) {f} <= physical_progress AS b, max(revised_cost) {f} > revised_cost AS c, count(*) OVER (PARTITION BY project_code, segment ORDER BY mi RANGE BETWEEN 1 FOLLOWING AND {h} FOLLOWING) AS n, {ENDS} AS e FROM panel) WHERE n = {h} AND mi + {h} <= e GROUP BY regime"""
    return f"{WITH} " + " UNION ALL ".join(one(h, e) for h in (1, 3, 6) for e in (False, True))


ENTRIES = [
    ("i01_segments", lambda s, d: panel(s, d).groupBy("segment", "regime").agg(F.count(F.lit(1)).alias("n"), F.min("report_month").alias("first"), F.max("report_month").alias("last")), f"{WITH} SELECT segment, regime, count(*) AS n, min(report_month) AS first, max(report_month) AS last FROM panel GROUP BY 1, 2"),
    ("i02_effective_commitment", lambda s, d: op.effective(panel(s, d)).select(*KEY, "baseline", "baseline_source"), f"{WITH}, {LABEL} SELECT project_code, report_month, baseline, baseline_source FROM lab"),
    ("i03_labels", lambda s, d: op.labelled(panel(s, d)).select(*KEY, "label", "reason", "window_end"), f"{WITH}, {LABEL} SELECT project_code, report_month, label, reason, window_end FROM lab"),
    ("i04_events", lambda s, d: op.labelled(panel(s, d)).where("label = 1").select(*KEY, "extension_type", "event_month", "event_value"), f"{WITH}, {LABEL} SELECT project_code, report_month, extension_type, event_month, event_value FROM lab WHERE label = 1"),
    ("i05_ineligible", lambda s, d: op.reasons(op.labelled(panel(s, d))), f"{WITH}, {LABEL} SELECT regime, reason, count(*) AS n_rows FROM lab WHERE label IS NULL GROUP BY 1, 2"),
    ("i06_features_at_t", *_features(*A)), ("i07_features_ratios", *_features(*B)), ("i08_features_deltas", *_features(*C)),
    ("i09_features_prior", *_features("n_prior_schedule_extensions", "n_prior_cost_revisions", "observed_tenure_months")), ("i10_features_support", *_features(*D)),
    ("i11_persistence", lambda s, d: op.persistence(panel(s, d)), _persist_sql()),
    ("i12_completion_metadata", lambda s, d: panel(s, d).select(*KEY).join(completed(s, d).groupBy("project_code").agg(F.min("report_month").alias("completion_month")), "project_code", "left").withColumn("ever_completed", F.col("completion_month").isNotNull()), f"WITH {COMPLETED_SQL}, f AS (SELECT project_code, min(report_month) AS completion_month FROM completed GROUP BY 1) SELECT p.project_code, p.report_month, completion_month, completion_month IS NOT NULL AS ever_completed FROM panel p LEFT JOIN f USING (project_code)"),
    ("i13_regime_summary", lambda s, d: op.regime_summary(op.labelled(panel(s, d))), f"{WITH}, {LABEL} SELECT regime, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS positives, sum(label)::DOUBLE / count(*) AS rate, count(*) FILTER (WHERE extension_type = 'FIRST_REVISION') AS first, count(*) FILTER (WHERE extension_type = 'SUBSEQUENT_REVISION') AS subsequent FROM lab WHERE label IS NOT NULL GROUP BY 1"),
    ("i14_embargo", lambda s, d: (lambda m: m.alias("t").join(F.broadcast(m.where("mi % 12 = 0").alias("e")), F.col("t.mi") + 3 < F.col("e.mi")).groupBy(F.col("e.mi").alias("origin")).agg(F.count(F.lit(1)).alias("months")))(panel(s, d).select("mi").distinct()), f"{WITH}, m AS (SELECT DISTINCT mi FROM panel) SELECT e.mi AS origin, count(*) AS months FROM m t JOIN m e ON t.mi + 3 < e.mi WHERE e.mi % 12 = 0 GROUP BY 1"),
    ("i15_label_variants", lambda s, d: op.variants(panel(s, d)), _variants_sql()),
    ("i16_calendar", lambda s, d: op.calendar(panel(s, d)), f"{WITH} SELECT project_code, report_month, CAST((mi%12+1-4+12)%12+1 AS INT) AS fiscal_month, CAST(mi%12 = 2 AS INT) AS fiscal_year_end, mi AS month_index, round(sign(CAST(cumulative_expenditure AS DOUBLE))*ln(1+abs(CAST(cumulative_expenditure AS DOUBLE))), 6) AS signed_log FROM panel"),
]
