"""Queries of the readiness audit and of linkage to completions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bands import depth_band
from ..functions.numbers import count_if
from ..operators import longitudinal as lg
from ..operators import readiness as op
from .surrogate import COMPLETED_SQL, PANEL_SQL, completed, panel

ONLY, BOTH = f"WITH {PANEL_SQL}", f"WITH {COMPLETED_SQL}"
E = "(PARTITION BY project_code, regime ORDER BY mi)"
ADJ = f"{ONLY}, ad AS (SELECT * FROM (SELECT *, lag(mi) OVER {E} AS p_mi, " + ", ".join(f"lag({c}) OVER {E} AS p_{c}" for c in ("cumulative_expenditure", "physical_progress", "revised_cost", "revised_completion_date")) + " FROM panel) WHERE mi - p_mi = 1)"


def _miss_sql(by: str) -> str:
    parts = []
    for f in op.AUDITED:
        lacks = [era for era, fields in op.ABSENT.items() if f in fields]
        cond = f"regime IN ({', '.join(repr(x) for x in lacks)})" if lacks else "false"
        parts.append(f"SELECT {by + ',' if by else ''} '{f}' AS field, CASE WHEN {cond} THEN 'absent' WHEN {f} IS NOT NULL THEN 'present' ELSE 'missing' END AS st FROM panel")
    rates = ", ".join(f"round(count(*) FILTER (WHERE st = '{k}')::DOUBLE / count(*), 4) AS {k}_rate" for k in ("present", "absent", "missing"))
    return f"{ONLY} SELECT {by + ',' if by else ''} field, count(*) AS n_rows, " + ", ".join(f"count(*) FILTER (WHERE st = '{k}') AS {k}" for k in ("present", "absent", "missing")) + f", {rates} FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


def _horizon_sql(h: int) -> str:
    r = lambda a, b: f"OVER (PARTITION BY project_code, regime ORDER BY mi RANGE BETWEEN {a} AND {b})"
    at, ah, wi = r(f"{h} FOLLOWING", f"{h} FOLLOWING"), r("1 FOLLOWING", f"{h} FOLLOWING"), r("CURRENT ROW", f"{h} FOLLOWING")
    base = "coalesce(revised_completion_date, original_completion_date)"
    cols = {"cost_endpoint": f"max(revised_cost) {at} > revised_cost", "cost_any": f"CASE WHEN count(revised_cost) {wi} >= 2 THEN max(revised_cost) {wi} > first_value(revised_cost IGNORE NULLS) {wi} END", "schedule_endpoint": f"max(revised_completion_date) {at} > {base}", "schedule_any": f"max(revised_completion_date) {ah} > {base}", "progress_flat": f"max(physical_progress) {at} = physical_progress", "spending_flat": f"max(cumulative_expenditure) {at} = cumulative_expenditure"}
    aggs = ", ".join(f"count(*) FILTER (WHERE complete AND {c} IS NOT NULL) AS {c}_known, count(*) FILTER (WHERE complete AND {c}) AS {c}" for c in cols)
    return f"SELECT regime, {h} AS horizon, count(*) AS ceiling, count(*) FILTER (WHERE complete) AS complete, {aggs} FROM (SELECT regime, mi + {h} <= max(mi) OVER (PARTITION BY regime) AS inside, count(*) {ah} = {h} AS complete, {', '.join(f'{v} AS {k}' for k, v in cols.items())} FROM panel) WHERE inside GROUP BY 1"


def _change_sql(f: str) -> str:
    return f"{ADJ}, x AS (SELECT *, CAST({f} - p_{f} AS DOUBLE) AS d FROM ad) SELECT regime, count(*) AS pairs, count(*) FILTER (WHERE d = 0) AS unchanged, count(*) FILTER (WHERE d > 0) AS up, count(*) FILTER (WHERE d < 0) AS down, round(quantile_cont(abs(d), 0.5) FILTER (WHERE d > 0), 4) AS up_median, round(quantile_cont(abs(d), 0.9) FILTER (WHERE d > 0), 4) AS up_p90, round(quantile_cont(abs(d), 0.5) FILTER (WHERE d < 0), 4) AS down_median, count(DISTINCT project_code) FILTER (WHERE d <> 0) AS projects_changed FROM x WHERE d IS NOT NULL GROUP BY 1"


def _hist_sql(f: str) -> str:
    k = f"CASE WHEN p_{f} IS NULL OR {f} IS NULL THEN 'missing' WHEN {f} > p_{f} THEN 'increased' WHEN {f} < p_{f} THEN 'decreased' ELSE 'unchanged' END"
    return f"{ADJ} SELECT regime, " + ", ".join(f"count(*) FILTER (WHERE {k} = '{x}') AS {x}" for x in ("increased", "decreased", "unchanged", "missing")) + f", count(*) FILTER (WHERE p_{f} > 0 AND {f} = 0) AS positive_to_zero FROM ad GROUP BY 1"


def _spread_sql(f: str) -> str:
    v = f"CAST({f} AS DOUBLE)"
    return f"{ONLY} SELECT regime, count({f}) AS count, min({v}) AS min, round(quantile_cont({v}, 0.25), 4) AS p25, round(quantile_cont({v}, 0.5), 4) AS median, round(CAST(sum({f}) AS DOUBLE) / count({f}), 4) AS mean, round(quantile_cont({v}, 0.75), 4) AS p75, max({v}) AS max, CAST(sum({f}) AS DOUBLE) AS sum FROM panel GROUP BY 1"


RUNS = f"{ONLY}, r AS (SELECT project_code, regime, mi, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER {E} AS run FROM (SELECT *, coalesce(lag(cumulative_expenditure) OVER {E} = cumulative_expenditure AND mi - lag(mi) OVER {E} = 1, false) AS same FROM panel)), l AS (SELECT project_code, regime, run, count(*) AS length FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 2) SELECT regime, length, count(*) AS runs, count(DISTINCT project_code) AS projects FROM l GROUP BY 1, 2"
COVER = f"{ONLY}, m AS (SELECT regime, report_month, row_number() OVER (PARTITION BY regime ORDER BY report_month) AS n, count(*) OVER (PARTITION BY regime) AS last FROM (SELECT DISTINCT regime, report_month FROM panel)), s AS (SELECT project_code, regime, report_month, n, last, lag(n) OVER w AS b, lead(n) OVER w AS a FROM panel JOIN m USING (regime, report_month) WINDOW w AS (PARTITION BY project_code, regime ORDER BY n)) SELECT regime, report_month, count(*) AS projects, CASE WHEN any_value(n) > 1 THEN count(*) FILTER (WHERE b IS NULL OR b <> n - 1) END AS new_projects, CASE WHEN any_value(n) < any_value(last) THEN count(*) FILTER (WHERE a IS NULL OR a <> n + 1) END AS disappearing FROM s GROUP BY 1, 2"
# arg_max of one column skips nulls, so the last row is taken as a struct
LINK = f"{BOTH}, ob AS (SELECT project_code, count(*) AS observations, max(mi) AS last_seen, unnest(arg_max({{'cumulative_expenditure': cumulative_expenditure, 'physical_progress': physical_progress, 'report_month': report_month, 'regime': regime}}, mi)) FROM panel GROUP BY 1), cm AS (SELECT project_code, min(mi) AS completed_mi, min(report_month) AS completion_month FROM completed GROUP BY 1), lk AS (SELECT * FROM ob FULL JOIN cm USING (project_code))"


def link(s, d):
    # a few completions under codes that the panel doesn't know, and some a year early
    c = completed(s, d).withColumn("project_code", F.when(F.col("ent") % 5 == 0, F.concat(F.lit("9"), F.col("project_code"))).otherwise(F.col("project_code"))).withColumn("mi", F.when(F.col("ent") % 12 == 0, F.col("mi") - 12).otherwise(F.col("mi")))
    return op.linked(panel(s, d), c)


LINK = LINK.replace("cm AS (SELECT project_code, min(mi)", "cm AS (SELECT CASE WHEN ent % 5 = 0 THEN '9' || project_code ELSE project_code END AS project_code, min(CASE WHEN ent % 12 = 0 THEN mi - 12 ELSE mi END)")
BAND = "CASE WHEN observations <= 2 THEN '1-2' WHEN observations <= 5 THEN '3-5' WHEN observations <= 11 THEN '6-11' WHEN observations <= 17 THEN '12-17' WHEN observations <= 26 THEN '18-26' ELSE '27+' END"
IS = "last_seen IS NOT NULL AND completed_mi IS NOT NULL"


def ratio():
    return F.col("revised_cost").cast("double") / F.col("original_cost").cast("double")


FIELDS4 = ("original_cost", "cumulative_expenditure", "physical_progress")
ENTRIES = [
    ("f01_era_rows", lambda s, d: panel(s, d).groupBy("regime", "segment", "report_month").agg(F.count(F.lit(1)).alias("n_rows")), f"{ONLY} SELECT regime, segment, report_month, count(*) AS n_rows FROM panel GROUP BY 1, 2, 3"),
    ("f02_adjacent_pairs", lambda s, d: op.adjacent(panel(s, d)).select("project_code", "report_month", F.col("p_cumulative_expenditure").cast("double").alias("previous")), f"{ADJ} SELECT project_code, report_month, CAST(p_cumulative_expenditure AS DOUBLE) AS previous FROM ad"),
    ("f03_depth", lambda s, d: lg.depth(panel(s, d), 3, 6, 9, 12, 16, 18, 24, 27), f"{ONLY} SELECT k, count(*) AS projects FROM (SELECT count(*) AS n FROM panel GROUP BY project_code), (SELECT unnest([3, 6, 9, 12, 16, 18, 24, 27]) AS k) WHERE n >= k GROUP BY 1"),
    ("f04_monthly_coverage", lambda s, d: op.coverage(panel(s, d)), COVER),
    ("f05_missingness", lambda s, d: op.missingness(panel(s, d)), _miss_sql("")), ("f06_missingness_by_month", lambda s, d: op.missingness(panel(s, d), "report_month"), _miss_sql("report_month")), ("f06_missingness_by_sector", lambda s, d: op.missingness(panel(s, d), "sector"), _miss_sql("sector")), ("f06_missingness_by_agency", lambda s, d: op.missingness(panel(s, d), "agency"), _miss_sql("agency")),
    ("f07_cost_changes", lambda s, d: op.change_events(panel(s, d), "revised_cost"), _change_sql("revised_cost")), ("f07_progress_changes", lambda s, d: op.change_events(panel(s, d), "physical_progress"), _change_sql("physical_progress")),
    ("f08_reported_counts", lambda s, d: (lambda n: n.select("field", F.explode(F.array(*[F.when(F.col("n") >= k, F.lit(k)) for k in (2, 3, 6, 9, 12)])).alias("k")).where("k is not null").groupBy("field", "k").agg(F.count(F.lit(1)).alias("projects")))(panel(s, d).select("project_code", F.explode(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in ("revised_cost", "physical_progress")])).alias("field")).where("field is not null").groupBy("project_code", "field").agg(F.count(F.lit(1)).alias("n"))), f"{ONLY}, n AS (SELECT project_code, 'revised_cost' AS field, count(revised_cost) AS n FROM panel GROUP BY 1 UNION ALL SELECT project_code, 'physical_progress', count(physical_progress) FROM panel GROUP BY 1) SELECT field, k, count(*) AS projects FROM n, (SELECT unnest([2, 3, 6, 9, 12]) AS k) WHERE n >= k GROUP BY 1, 2"),
    ("f09_unchanged_runs", lambda s, d: op.unchanged_runs(panel(s, d), "cumulative_expenditure"), RUNS),
    ("f10_expenditure_history", lambda s, d: op.numeric_history(panel(s, d), "cumulative_expenditure"), _hist_sql("cumulative_expenditure")), ("f10_progress_history", lambda s, d: op.numeric_history(panel(s, d), "physical_progress"), _hist_sql("physical_progress")),
    ("f11_zero_spending", lambda s, d: op.zero_spending(panel(s, d)), f"{ONLY}, p AS (SELECT agency, project_code, count(*) AS n, count(*) FILTER (WHERE cumulative_expenditure = 0) AS z, bool_or(cumulative_expenditure = 0) AS e, bool_and(cumulative_expenditure = 0) AS a FROM panel GROUP BY 1, 2) SELECT agency, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(z) AS BIGINT) AS zero_rows, count(*) FILTER (WHERE e) AS ever_zero, count(*) FILTER (WHERE a) AS always_zero FROM p GROUP BY 1"),
    ("f12_category_coverage", lambda s, d: op.category_coverage(panel(s, d)), f"{ONLY}, l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS dimension, coalesce(nullif({c}, ''), '(MISSING)') AS value, project_code, report_month FROM panel" for c in ("ministry", "sector", "agency", "state")) + ") SELECT dimension, value, count(*) AS n_rows, count(DISTINCT project_code) AS projects, count(DISTINCT report_month) AS months, count(*) < 10 OR count(DISTINCT project_code) < 3 AS sparse FROM l GROUP BY 1, 2"),
    ("f13_horizons", lambda s, d: op.horizons(panel(s, d), 1, 3, 6, 12), f"{ONLY} " + " UNION ALL ".join(_horizon_sql(h) for h in (1, 3, 6, 12))),
    *[(f"f{n}_{name}", (lambda cols: lambda s, d: op.horizons(panel(s, d), 1, 3, 6, 12).select("regime", "horizon", *cols))(cols), f"{ONLY} SELECT regime, horizon, {', '.join(cols)} FROM (" + " UNION ALL ".join(_horizon_sql(h) for h in (1, 3, 6, 12)) + ")") for n, name, cols in ((14, "cost_escalation", ["cost_endpoint_known", "cost_endpoint", "cost_any_known", "cost_any"]), (15, "schedule_revision", ["schedule_endpoint_known", "schedule_endpoint", "schedule_any_known", "schedule_any"]), (16, "progress_stagnation", ["progress_flat_known", "progress_flat"]), (17, "spending_stagnation", ["spending_flat_known", "spending_flat"]))],
    *[(f"f18_distribution_{c}", (lambda c: lambda s, d: op.distribution(panel(s, d), c, "regime"))(c), _spread_sql(c)) for c in FIELDS4],
    ("f19_totals", lambda s, d: panel(s, d).groupBy("regime").agg(F.count(F.lit(1)).alias("n_rows"), count_if(F.col("project_code").isNull()).alias("missing_codes"), (F.count(F.lit(1)) - F.count_distinct("project_code", "report_month")).alias("duplicate_rows")), f"{ONLY} SELECT regime, count(*) AS n_rows, count(*) FILTER (WHERE project_code IS NULL) AS missing_codes, count(*) - count(DISTINCT project_code || report_month) AS duplicate_rows FROM panel GROUP BY 1"),
    ("h01_earliest_completion", lambda s, d: completed(s, d).groupBy("project_code").agg(F.min("report_month").alias("completion_month")), f"{BOTH} SELECT project_code, min(report_month) AS completion_month FROM completed GROUP BY 1"),
    ("h02_match_counts", lambda s, d: link(s, d).agg(count_if(F.col("last_seen").isNotNull() & F.col("completed_mi").isNotNull()).alias("matched"), count_if(F.col("last_seen").isNull()).alias("completed_only"), count_if(F.col("completed_mi").isNull()).alias("ongoing_only")), f"{LINK} SELECT count(*) FILTER (WHERE {IS}) AS matched, count(*) FILTER (WHERE last_seen IS NULL) AS completed_only, count(*) FILTER (WHERE completed_mi IS NULL) AS ongoing_only FROM lk"),
    ("h03_match_by_code_style", lambda s, d: link(s, d).where("completed_mi is not null").groupBy(F.when(F.col("project_code").rlike("^9?N"), "LEGACY").otherwise("MODERN").alias("style")).agg(F.count(F.lit(1)).alias("completed"), F.count("last_seen").alias("matched")), f"{LINK} SELECT CASE WHEN regexp_matches(project_code, '^9?N') THEN 'LEGACY' ELSE 'MODERN' END AS style, count(*) AS completed, count(last_seen) AS matched FROM lk WHERE completed_mi IS NOT NULL GROUP BY 1"),
    ("h04_depth_of_matched", lambda s, d: link(s, d).where("last_seen is not null and completed_mi is not null").groupBy(depth_band(F.col("observations")).alias("band")).agg(F.count(F.lit(1)).alias("projects"), F.min("observations").alias("least"), F.max("observations").alias("most")), f"{LINK} SELECT {BAND} AS band, count(*) AS projects, min(observations) AS least, max(observations) AS most FROM lk WHERE {IS} GROUP BY 1"),
    ("h04_depth_summary", lambda s, d: op.depth_summary(link(s, d).where("last_seen is not null and completed_mi is not null"), "observations"), f"{LINK} SELECT count(*) AS projects, min(observations) AS least, max(observations) AS most, median(observations) AS median, round(avg(observations), 4) AS mean, " + ", ".join(f"round(100 * count(*) FILTER (WHERE observations >= {k}) / count(*), 4) AS from_{k}" for k in (3, 6, 12)) + f" FROM lk WHERE {IS}"),
    ("h05_completion_lag", lambda s, d: link(s, d).select((F.col("completed_mi") - F.col("last_seen")).alias("lag")).where("lag is not null").groupBy("lag").agg(F.count(F.lit(1)).alias("n")), f"{LINK} SELECT completed_mi - last_seen AS lag, count(*) AS n FROM lk WHERE {IS} GROUP BY 1"),
    ("h06_reappearance", lambda s, d: link(s, d).where("completed_mi < last_seen").select("project_code", (F.col("completed_mi") - F.col("last_seen")).alias("lag"), F.array_join(F.array_compact(F.array(F.lit("REAPPEARS"), F.when(F.col("last_seen") - F.col("completed_mi") > 6, "LONG_OVERLAP"), F.when(F.col("physical_progress") < 100, "NOT_FINISHED"))), "|").alias("flags")), f"{LINK} SELECT project_code, completed_mi - last_seen AS lag, concat_ws('|', 'REAPPEARS', CASE WHEN last_seen - completed_mi > 6 THEN 'LONG_OVERLAP' END, CASE WHEN physical_progress < 100 THEN 'NOT_FINISHED' END) AS flags FROM lk WHERE completed_mi < last_seen"),
    ("h07_terminal_snapshot", lambda s, d: link(s, d).where("last_seen is not null and completed_mi is not null").select("project_code", "report_month", "completion_month", F.col("cumulative_expenditure").cast("double").alias("cumulative_expenditure")), f"{LINK} SELECT project_code, report_month, completion_month, CAST(cumulative_expenditure AS DOUBLE) AS cumulative_expenditure FROM lk WHERE {IS}"),
    ("h08_field_availability", lambda s, d: completed(s, d).agg(*[F.round(F.count(c) / F.count(F.lit(1)), 4).alias(c) for c in ("start_date", "approval_date", "revised_completion_date", "revised_cost", "state", "ministry")]), f"{BOTH} SELECT " + ", ".join(f"round(count({c})::DOUBLE / count(*), 4) AS {c}" for c in ("start_date", "approval_date", "revised_completion_date", "revised_cost", "state", "ministry")) + " FROM completed"),
    ("h09_cost_outcome", lambda s, d: completed(s, d).agg(F.count(ratio()).alias("known"), *[F.round(F.percentile(ratio(), F.lit(p)), 4).alias(n) for n, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9))], count_if(ratio() > 1).alias("over"), count_if(ratio() < 1).alias("under"), count_if(ratio() == 1).alias("on_budget")), f"{BOTH}, q AS (SELECT CAST(revised_cost AS DOUBLE) / CAST(original_cost AS DOUBLE) AS r FROM completed) SELECT count(r) AS known, " + ", ".join(f"round(quantile_cont(r, {p}), 4) AS {n}" for n, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9))) + ", count(*) FILTER (WHERE r > 1) AS over, count(*) FILTER (WHERE r < 1) AS under, count(*) FILTER (WHERE r = 1) AS on_budget FROM q"),
]
