"""Queries of validation and longitudinal comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import longitudinal as lg
from ..operators import ranks
from ..operators import validation as op
from ..sources.store import kept
from .surrogate import PANEL_SQL, panel

SOURCES = (*op.DATES, *op.NUMBERS)


def raw(s, d):
    """The panel with raw texts; a value that is missing has the raw text `unk` for every seventh project."""
    p = panel(s, d)
    return p.select("*", *[F.when(F.col(c).isNotNull(), F.col(c).cast("string")).when(F.col("ent") % 7 == 0, "unk").otherwise("").alias(f"{c}_raw") for c in SOURCES])


def warned(s, d):
    return op.warnings(raw(s, d))


W = f"WITH {PANEL_SQL}, raw AS (SELECT *, " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN CAST({c} AS VARCHAR) WHEN ent % 7 = 0 THEN 'unk' ELSE '' END AS {c}_raw" for c in SOURCES) + " FROM panel)"
_one = lambda rule, field, cond: f"SELECT project_code, report_month, '{rule}' AS rule, {field} AS field FROM raw WHERE {cond}"
_both = "'cumulative_expenditure,physical_progress'"
_idle = "cumulative_expenditure = 0 AND physical_progress > 0"
WARN = W + ", w0 AS (" + " UNION ALL ".join([
    _one("missing_project_code", "'project_code'", "project_code IS NULL OR project_code = ''"), _one("invalid_project_code", "'project_code'", "NOT regexp_full_match(project_code, '[0-9]{6}|N[0-9]{8}|[0-9]{9}')"),
    *[_one("unparseable_date", f"'{f}'", f"{f}_raw <> '' AND {f} IS NULL") for f in op.DATES], *[_one("unparseable_numeric", f"'{f}'", f"{f}_raw <> '' AND {f} IS NULL") for f in op.NUMBERS],
    _one("nonpositive_original_cost", "'original_cost'", "original_cost <= 0"), _one("nonpositive_revised_cost", "'revised_cost'", "revised_cost <= 0"), _one("negative_expenditure", "'cumulative_expenditure'", "cumulative_expenditure < 0"),
    _one("extreme_expenditure_cost_mismatch", "'cumulative_expenditure'", "revised_cost <> 0 AND cumulative_expenditure > 3 * revised_cost"), _one("revised_cost_below_original", "'revised_cost'", "revised_cost < original_cost"), _one("physical_progress_above_100", "'physical_progress'", "physical_progress > 100"),
    _one("progress_reported_before_start", "'physical_progress'", f"{_idle} AND start_date > report_month"), _one("zero_expenditure_positive_progress", _both, f"{_idle} AND NOT coalesce(start_date > report_month, false)"), _one("expenditure_with_zero_progress", _both, "cumulative_expenditure > 0 AND physical_progress = 0"),
    _one("full_progress_still_ongoing", "'physical_progress'", "physical_progress = 100"), _one("completion_date_before_start_date", "concat_ws(',', CASE WHEN original_completion_date < start_date THEN 'original_completion_date' END, CASE WHEN revised_completion_date < start_date THEN 'revised_completion_date' END)", "original_completion_date < start_date OR revised_completion_date < start_date"),
]) + "), kinds AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{a}', '{b}', '{c}')" for k, (a, b, c) in op.RULES.items()) + ") AS k(rule, severity, priority, category)), warned AS (SELECT project_code, report_month, field, rule, severity, priority, category FROM w0 JOIN kinds USING (rule))"
KEY = "project_code, report_month"


def _rule(rule: str):
    return (lambda s, d: warned(s, d).where(F.col("rule") == rule).select("project_code", "report_month", "field")), f"{WARN} SELECT {KEY}, field FROM warned WHERE rule = '{rule}'"


def _counts_sql(dim: str) -> str:
    return f"{WARN} SELECT k.{dim}, count(w.{dim}) AS n FROM (SELECT DISTINCT {dim} FROM kinds) k LEFT JOIN warned w USING ({dim}) GROUP BY 1"


FI = lg.FIELDS
PAIR = f"WITH {PANEL_SQL}, pr AS (SELECT a.project_code, a.mi, a.report_month AS month_a, b.report_month AS month_b, " + ", ".join(f"a.{c} AS a_{c}, b.{c} AS b_{c}" for c in FI) + " FROM panel a JOIN panel b ON a.project_code = b.project_code AND b.mi = a.mi + 1)"
_st = lambda c: f"CASE WHEN {c} IS NULL THEN 'missing' WHEN {c} = 0 THEN 'zero' WHEN {c} > 0 THEN 'positive' ELSE 'negative' END"
_cl = lambda c: f"CASE WHEN a_{c} IS NULL OR b_{c} IS NULL THEN 'missing' WHEN b_{c} > a_{c} THEN 'increased' WHEN b_{c} < a_{c} THEN 'decreased' ELSE 'unchanged' END"
_dr = lambda c: f"CAST(a_{c} - b_{c} AS DOUBLE)"
_co = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"
_sq = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"
# Agencies are `Brand#` and one or two digits, so that shared digits give the matching blocks; of names that differ only a suffix or case does
_dig = lambda c: f"string_split(substring({_co(c)}, 6), '')"
_like = f"2.0 * (5 + CASE WHEN list_has_any({_dig('a_agency')}, {_dig('b_agency')}) THEN 1 ELSE 0 END) / (length({_co('a_agency')}) + length({_co('b_agency')}))"
AGENCY = f"CASE WHEN {_co('a_agency')} = {_co('b_agency')} THEN 'WHITESPACE_PUNCTUATION_CASING_DIFFERENCES' WHEN {_like} >= 0.82 THEN 'APPARENT_SOURCE_SPELLING_CHANGES' ELSE 'GENUINE_DIFFERENT_AGENCY_NAMES' END"
_shared = f"least(length({_co('a_project_name')}), length({_co('b_project_name')}))"
EVENTS = PAIR + f""", ev AS (SELECT project_code, month_a, month_b, 'agency_changed' AS rule, {AGENCY} AS detail, NULL::DOUBLE AS size FROM pr WHERE a_agency IS DISTINCT FROM b_agency
UNION ALL SELECT project_code, month_a, month_b, 'project_name_changed', CASE WHEN {_co('a_project_name')} = {_co('b_project_name')} THEN 'SUPERFICIAL_ONLY' ELSE 'SUBSTANTIVE_TEXT_CHANGE' END, round(2.0 * {_shared} / (length({_co('a_project_name')}) + length({_co('b_project_name')})), 6) FROM pr WHERE a_project_name IS DISTINCT FROM b_project_name
UNION ALL SELECT project_code, month_a, month_b, 'state_changed', concat_ws(' -> ', a_state, b_state), NULL FROM pr WHERE a_state IS DISTINCT FROM b_state
UNION ALL SELECT project_code, month_a, month_b, 'expenditure_decreased', CASE WHEN a_cumulative_expenditure > 0 AND b_cumulative_expenditure = 0 THEN 'positive_to_zero' ELSE 'other' END, {_dr('cumulative_expenditure')} FROM pr WHERE a_cumulative_expenditure > b_cumulative_expenditure
UNION ALL SELECT project_code, month_a, month_b, 'progress_decreased', CASE WHEN round({_dr('physical_progress')}, 6) < 1 THEN '<1' WHEN round({_dr('physical_progress')}, 6) <= 5 THEN '1-5' WHEN round({_dr('physical_progress')}, 6) <= 10 THEN '5-10' ELSE '>10' END, {_dr('physical_progress')} FROM pr WHERE a_physical_progress > b_physical_progress
UNION ALL SELECT project_code, month_a, month_b, 'revised_cost_decreased', '', {_dr('revised_cost')} FROM pr WHERE a_revised_cost > b_revised_cost)"""


def ev(s, d):
    return lg.events(lg.pairs(panel(s, d)))


def _event(rule: str):
    return (lambda s, d: ev(s, d).where(F.col("rule") == rule).drop("rule")), f"{EVENTS} SELECT project_code, month_a, month_b, detail, size FROM ev WHERE rule = '{rule}'"


def idle():
    return (F.col("cumulative_expenditure") == 0) & (F.col("physical_progress") > 0)


DIMS = ("report_month", "regime", "sector", "agency", "state", "ministry")
RATES = f"WITH {PANEL_SQL}, lo AS (" + " UNION ALL ".join(f"SELECT project_code, coalesce({_idle}, false) AS f, '{x}' AS dimension, coalesce({x}, '(MISSING)') AS value FROM panel" for x in DIMS) + """), g AS (SELECT dimension, value, count(*) FILTER (WHERE f) AS flagged, count(DISTINCT project_code) FILTER (WHERE f) AS projects, count(*) AS n_rows FROM lo GROUP BY 1, 2)
SELECT * FROM (SELECT *, round(flagged::DOUBLE / n_rows * 100, 4) AS rate, round(flagged::DOUBLE / sum(flagged) OVER (PARTITION BY dimension) * 100, 4) AS share FROM g) WHERE flagged > 0"""
ONLY = f"WITH {PANEL_SQL}"
SERIAL = "row_number() OVER (PARTITION BY report_month ORDER BY project_code)"


def _serials(s, d):
    """Rows of a month numbered by code; every 29th number is left out, every 31st comes twice."""
    codes = ranks.numbered(panel(s, d).select("report_month", "project_code"), ["report_month"], [F.col("project_code")], lambda df, name: kept(s, d, f"serials-{name}", lambda: df))
    return serial_gaps(codes.select("report_month", (F.col("position") + 1).alias("n")))


def serial_gaps(numbered):
    """Gaps and repeats of the numbers of a month, of which every 29th is left out and every 31st comes twice. All of it is counted by one grouping of the numbers."""
    rows = numbered.where("n % 29 <> 0").select("report_month", F.explode(F.when(F.col("n") % 31 == 0, F.array("n", "n")).otherwise(F.array("n"))).alias("n"))
    each = rows.groupBy("report_month", "n").agg(F.count(F.lit(1)).alias("times"))
    return each.groupBy("report_month").agg((F.max("n") - F.count(F.lit(1))).alias("gaps"), F.count_if(F.col("times") > 1).alias("repeats"))


SERIALS = f"""{ONLY}, n0 AS (SELECT report_month, {SERIAL} AS n FROM panel), r AS (SELECT report_month, n FROM n0 WHERE n % 29 <> 0 UNION ALL SELECT report_month, n FROM n0 WHERE n % 31 = 0 AND n % 29 <> 0), t AS (SELECT report_month, max(n) AS m, max(n) - count(DISTINCT n) AS gaps FROM r GROUP BY 1)
SELECT report_month, gaps, (SELECT count(*) FROM (SELECT n FROM r WHERE r.report_month = t.report_month GROUP BY n HAVING count(*) > 1)) AS repeats FROM t"""


def _e21(s, d):
    """Of codes without spending but with progress in the earlier month: what the next month brings."""
    p = lg.pairs(panel(s, d)).where("a_cumulative_expenditure = 0 and a_physical_progress > 0")
    from ..functions.numbers import change, state_of
    return p.groupBy("month_a", state_of("b_cumulative_expenditure").alias("next_state"), change(F.col("a_physical_progress"), F.col("b_physical_progress")).alias("progress")).agg(F.count(F.lit(1)).alias("n"))


ENTRIES = [
    ("d01_code_rules", lambda s, d: op.warnings(raw(s, d).withColumn("project_code", F.when(F.col("ent") % 53 == 0, F.lit(None)).when(F.col("ent") % 59 == 0, "12X").otherwise(F.col("project_code")))).where("field = 'project_code'").groupBy("report_month", "rule").agg(F.count(F.lit(1)).alias("n")), f"{ONLY} SELECT report_month, CASE WHEN ent % 53 = 0 THEN 'missing_project_code' ELSE 'invalid_project_code' END AS rule, count(*) AS n FROM panel WHERE ent % 53 = 0 OR ent % 59 = 0 GROUP BY 1, 2"),
    ("d02_unparseable_date", *_rule("unparseable_date")), ("d03_unparseable_numeric", *_rule("unparseable_numeric")),
    ("d04_nonpositive_cost", lambda s, d: op.warnings(raw(s, d).withColumn("original_cost", F.col("original_cost") - 500000)).where("rule = 'nonpositive_original_cost'").select("project_code", "report_month"), f"{ONLY} SELECT {KEY} FROM panel WHERE original_cost - 500000 <= 0"),
    ("d05_negative_expenditure", *_rule("negative_expenditure")), ("d06_extreme_mismatch", *_rule("extreme_expenditure_cost_mismatch")), ("d07_revised_below_original", *_rule("revised_cost_below_original")), ("d08_progress_above_100", *_rule("physical_progress_above_100")),
    ("d09_zero_expenditure", *_rule("zero_expenditure_positive_progress")), ("d10_spend_without_progress", lambda s, d: op.warnings(raw(s, d).withColumn("physical_progress", F.floor(F.col("physical_progress") / 8).cast("decimal(6,2)"))).where("rule = 'expenditure_with_zero_progress'").select("project_code", "report_month"), f"{ONLY} SELECT {KEY} FROM panel WHERE floor(physical_progress / 8) = 0 AND cumulative_expenditure > 0"),
    ("d11_full_progress", lambda s, d: op.warnings(raw(s, d).withColumn("physical_progress", F.when(F.col("physical_progress") > 100, F.lit(100).cast("decimal(6,2)")).otherwise(F.col("physical_progress")))).where("rule = 'full_progress_still_ongoing'").select("project_code", "report_month"), f"{ONLY} SELECT {KEY} FROM panel WHERE physical_progress >= 100"),
    ("d12_completion_before_start", lambda s, d: op.warnings(raw(s, d).withColumn("start_date", F.when(F.col("ent") % 3 == 0, "2000-06").otherwise(F.col("start_date")))).where("rule = 'completion_date_before_start_date'").select("project_code", "report_month", "field"), f"{ONLY}, q AS (SELECT * EXCLUDE (start_date), CASE WHEN ent % 3 = 0 THEN '2000-06' ELSE start_date END AS start_date FROM panel) SELECT {KEY}, concat_ws(',', CASE WHEN original_completion_date < start_date THEN 'original_completion_date' END, CASE WHEN revised_completion_date < start_date THEN 'revised_completion_date' END) AS field FROM q WHERE original_completion_date < start_date OR revised_completion_date < start_date"),
    ("d13_classified_warnings", lambda s, d: warned(s, d), f"{WARN} SELECT * FROM warned"),
    ("d14_duplicates", lambda s, d: op.duplicates(panel(s, d).withColumn("half", F.floor(F.col("mi") / 6)), "project_code", "half").select("project_code", "report_month", "duplicate_count"), f"{ONLY} SELECT * FROM (SELECT {KEY}, count(*) OVER (PARTITION BY project_code, mi // 6) AS duplicate_count FROM panel) WHERE duplicate_count > 1"),
    ("d15_counts_by_rule", lambda s, d: op.counts_by(warned(s, d), "rule", sorted(op.RULES)), _counts_sql("rule")), ("d15_counts_by_severity", lambda s, d: op.counts_by(warned(s, d), "severity", ["ERROR", "WARNING", "INFO"]), _counts_sql("severity")),
    ("d15_metrics", lambda s, d: op.metrics(panel(s, d), warned(s, d)), f"{WARN} SELECT (SELECT count(*) FROM panel) AS records, (SELECT count(*) FROM panel WHERE project_code IS NULL) AS missing_codes, count(DISTINCT project_code || report_month) AS warned_rows, count(*) AS warnings, count(*) FILTER (WHERE rule = 'invalid_project_code') AS invalid_codes FROM warned"),
    ("d16_quality_rows", lambda s, d: op.quality_rows(panel(s, d), warned(s, d)), f"{WARN}, r AS (SELECT {KEY}, array_to_string(list_sort(list_distinct(list(rule))), '|') AS warning_rules FROM warned GROUP BY 1, 2), f AS (SELECT *, CAST(cumulative_expenditure AS DOUBLE) / CAST(coalesce(CASE WHEN revised_cost > 0 THEN revised_cost END, CASE WHEN original_cost > 0 THEN original_cost END) AS DOUBLE) * 100 AS fp FROM panel) SELECT f.project_code, f.report_month, round(fp, 6) AS financial_progress, round(CAST(physical_progress AS DOUBLE) - fp, 6) AS physical_financial_gap, coalesce(warning_rules, '') AS warning_rules FROM f LEFT JOIN r USING (project_code, report_month)"),
    ("d17_serial_gaps", _serials, SERIALS),
    ("d18_parse_success", lambda s, d: op.parse_success(raw(s, d)), f"{W} SELECT field, count(*) AS given, count(*) FILTER (WHERE ok) AS parsed FROM (" + " UNION ALL ".join(f"SELECT '{'date' if c in op.DATES else c}' AS field, {c}_raw <> '' AS given, {c} IS NOT NULL AS ok FROM raw" for c in SOURCES) + ") WHERE given GROUP BY 1"),
    ("d19_warnings_by_month", lambda s, d: op.by_month(warned(s, d), panel(s, d).select("report_month").distinct()), f"{WARN}, m AS (SELECT report_month, " + ", ".join(f"count(*) FILTER (WHERE rule = '{r}') AS {r}" for r in sorted(op.RULES)) + " FROM (SELECT DISTINCT report_month FROM panel) LEFT JOIN warned USING (report_month) GROUP BY 1) SELECT * FROM m UNION ALL SELECT 'ALL', " + ", ".join(f"CAST(sum({r}) AS BIGINT)" for r in sorted(op.RULES)) + " FROM m"),
    ("d23_label_checks", lambda s, d: __import__("milepost.operators.labels", fromlist=["x"]).labelled(panel(s, d)).where("label is not null").agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when((F.col("label") == 1) & ~(F.col("event_value") > F.col("baseline")), 1)).alias("bad_evidence"), F.count(F.when(F.col("window_end") <= F.col("report_month"), 1)).alias("bad_window")), f"WITH {PANEL_SQL}, {__import__('milepost.plans.labels', fromlist=['x']).LABEL} SELECT count(*) AS n_rows, count(*) FILTER (WHERE label = 1 AND NOT event_value > baseline) AS bad_evidence, count(*) FILTER (WHERE window_end <= report_month) AS bad_window FROM lab WHERE label IS NOT NULL"),
    ("e02_rows_by_month", lambda s, d: panel(s, d).groupBy("report_month").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("project_code").alias("projects")), f"{ONLY} SELECT report_month, count(*) AS n_rows, count(DISTINCT project_code) AS projects FROM panel GROUP BY 1"),
    ("e03_observation_depth", lambda s, d: lg.depth(panel(s, d), 3, 6, 10, 12, 16, 18, 19), f"{ONLY} SELECT k, count(*) AS projects FROM (SELECT count(*) AS n FROM panel GROUP BY project_code), (SELECT unnest([3, 6, 10, 12, 16, 18, 19]) AS k) WHERE n >= k GROUP BY 1"),
    ("e04_membership", lambda s, d: lg.membership(panel(s, d)), f"{ONLY}, m AS (SELECT DISTINCT mi FROM panel), e AS (SELECT x.mi FROM m x JOIN m y ON y.mi = x.mi + 1) SELECT e.mi, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS both, count(*) FILTER (WHERE b IS NULL) AS earlier_only, count(*) FILTER (WHERE a IS NULL) AS later_only FROM e JOIN (SELECT coalesce(x.mi, y.mi) AS mi, x.project_code AS a, y.project_code AS b FROM panel x FULL JOIN (SELECT project_code, mi - 1 AS mi FROM panel) y ON x.project_code = y.project_code AND x.mi = y.mi) f ON f.mi = e.mi GROUP BY 1"),
    ("e05_transitions", lambda s, d: lg.pairs(panel(s, d)).groupBy("month_a", "month_b").agg(F.count(F.lit(1)).alias("n")), f"{PAIR} SELECT month_a, month_b, count(*) AS n FROM pr GROUP BY 1, 2"),
    ("e06_change_classes", lambda s, d: lg.changes(lg.pairs(panel(s, d))), f"{PAIR}, c AS (" + " UNION ALL ".join(f"SELECT month_a, '{c}' AS field, {_cl(c)} AS k FROM pr" for c in ("revised_cost", "cumulative_expenditure", "physical_progress")) + ") SELECT month_a, field, " + ", ".join(f"count(*) FILTER (WHERE k = '{k}') AS {k}" for k in ("increased", "decreased", "unchanged", "missing")) + " FROM c GROUP BY 1, 2"),
    ("e07_expenditure_states", lambda s, d: lg.states(lg.pairs(panel(s, d))), f"{PAIR} SELECT month_a, {_st('a_cumulative_expenditure')} || '_to_' || {_st('b_cumulative_expenditure')} AS transition, count(*) AS n FROM pr GROUP BY 1, 2"),
    ("e08_identity_changes", lambda s, d: lg.identity(lg.pairs(panel(s, d))), f"{PAIR} SELECT month_a, " + ", ".join(f"count(*) FILTER (WHERE a_{c} IS DISTINCT FROM b_{c}) AS {c}_changed" for c in FI[:5]) + ", " + ", ".join(f"count(*) FILTER (WHERE {_sq('a_' + c)} <> {_sq('b_' + c)}) AS {c}_changed_normalised" for c in ("sector", "state")) + " FROM pr GROUP BY 1"),
    ("e09_warnings_by_pair", lambda s, d: ev(s, d).groupBy("month_a", "rule").agg(F.count(F.lit(1)).alias("n")), f"{EVENTS} SELECT month_a, rule, count(*) AS n FROM ev GROUP BY 1, 2"),
    ("e10_agency_changed", *_event("agency_changed")), ("e11_name_changed", *_event("project_name_changed")), ("e12_state_changed", *_event("state_changed")), ("e13_expenditure_decreased", *_event("expenditure_decreased")), ("e14_progress_decreased", *_event("progress_decreased")), ("e15_revised_cost_decreased", *_event("revised_cost_decreased")),
    ("e16_agency_categories", lambda s, d: ev(s, d).where("rule = 'agency_changed'").groupBy(F.col("detail").alias("category")).agg(F.count(F.lit(1)).alias("n")), f"{EVENTS} SELECT detail AS category, count(*) AS n FROM ev WHERE rule = 'agency_changed' GROUP BY 1"),
    ("e17_top_agency_pairs", lambda s, d: lg.pairs(panel(s, d)).where("a_agency <> b_agency").groupBy("a_agency", "b_agency").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "a_agency", "b_agency").limit(20), f"{PAIR} SELECT a_agency, b_agency, count(*) AS n FROM pr WHERE a_agency <> b_agency GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20"),
    ("e18_rule_matrix", lambda s, d: ev(s, d).groupBy("month_a").pivot("rule", ["agency_changed", "expenditure_decreased", "progress_decreased", "project_name_changed", "revised_cost_decreased", "state_changed"]).count().na.fill(0), f"{EVENTS} SELECT month_a, " + ", ".join(f"count(*) FILTER (WHERE rule = '{r}') AS {r}" for r in ("agency_changed", "expenditure_decreased", "progress_decreased", "project_name_changed", "revised_cost_decreased", "state_changed")) + " FROM ev GROUP BY 1"),
    ("e20_flag_rates", lambda s, d: lg.flag_rates(panel(s, d), idle(), DIMS), RATES), ("e21_idle_transitions", _e21, f"{PAIR} SELECT month_a, {_st('b_cumulative_expenditure')} AS next_state, {_cl('physical_progress')} AS progress, count(*) AS n FROM pr WHERE a_cumulative_expenditure = 0 AND a_physical_progress > 0 GROUP BY 1, 2, 3"),
    ("e22_flagged_in_two_months", lambda s, d: lg.two_months(panel(s, d), "1999-06", "1999-07", idle()),
     f"""{ONLY}, t AS (SELECT *, coalesce({_idle}, false) AS f, mi - (CAST(start_date[1:4] AS INT) * 12 + CAST(start_date[6:7] AS INT) - 1) AS age FROM panel WHERE report_month IN ('1999-06', '1999-07')), z AS (SELECT project_code, bool_or(f AND report_month = '1999-06') AS a, bool_or(f AND report_month = '1999-07') AS b FROM t GROUP BY 1)
      SELECT * FROM (SELECT count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT b) AS first_only, count(*) FILTER (WHERE b AND NOT a) AS second_only, count(*) FILTER (WHERE a OR b) AS unique_projects FROM z), (SELECT CAST(min(age) AS BIGINT) AS age_min, CAST(median(age) AS DOUBLE) AS age_median, round(avg(age), 2) AS age_mean, CAST(max(age) AS BIGINT) AS age_max FROM t WHERE f AND age >= 0)"""),
    ("e23_increases_by_agency", lambda s, d: lg.pairs(panel(s, d)).where("a_cumulative_expenditure = 0 and b_cumulative_expenditure > 0").groupBy("a_agency").agg(F.count(F.lit(1)).alias("n")), f"{PAIR} SELECT a_agency, count(*) AS n FROM pr WHERE a_cumulative_expenditure = 0 AND b_cumulative_expenditure > 0 GROUP BY 1"),
]
