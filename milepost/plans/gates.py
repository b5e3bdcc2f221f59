"""Queries of contract gates, re-validation, serial ranges and raw cells beside events."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import contracts, labels, longitudinal, revalidation, serials
from ..sources.store import folder, kept
from .labels import LABEL
from .risk import SQL as RISK_SQL
from .risk import risk
from .surrogate import COMPLETED_SQL, PANEL_SQL, completed, panel

ONLY = f"WITH {PANEL_SQL}"


def _eligible(s, d):
    p = panel(s, d)
    return labels.labelled(p).where("label is not null").select("project_code", "report_month", "label").join(p.select("project_code", "report_month", "regime", "ent", "mi"), ["project_code", "report_month"])


def moved(rows):
    """The months of some projects become one outside of every segment; of a project's moved months the earliest stays."""
    late = rows.withColumn("report_month", F.when(F.col("ent") % 43 == 0, F.lit("2031-01")).otherwise(F.col("report_month")))
    first = Window.partitionBy("regime", "project_code", "report_month").orderBy("mi")
    return late.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def _gates(s, d):
    """The eligible rows of both regimes, as they are and with faults put in, against a contract with their counts."""
    rows = kept(s, d, "eligible", lambda: _eligible(s, d))
    said = {r["regime"]: (r["n"], r["p"]) for r in rows.groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("p")).collect()}  # two regimes
    contract = contracts.Contract("label", 3, ("project_code", "report_month"), (), expected=said)
    as_is = rows.withColumn("variant", F.lit("as_built"))
    relabelled = as_is.withColumn("variant", F.lit("label_two")).withColumn("label", F.when(F.col("ent") % 29 == 0, 2).otherwise(F.col("label")))
    twice = as_is.unionByName(as_is.where("ent % 31 = 0")).withColumn("variant", F.lit("key_twice"))
    fewer = as_is.where("ent % 37 <> 0").withColumn("variant", F.lit("rows_lost"))
    flipped = as_is.withColumn("variant", F.lit("label_flipped")).withColumn("label", F.when(F.col("ent") % 41 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    late = moved(as_is.withColumn("variant", F.lit("month_moved")))
    return contracts.gates(as_is.unionByName(relabelled).unionByName(twice).unionByName(fewer).unionByName(flipped).unionByName(late), contract, "regime", "variant")


GATES = f"""WITH {PANEL_SQL}, {LABEL}, e AS (SELECT p.regime, p.project_code, p.report_month, l.label, p.ent FROM panel p JOIN lab l ON p.project_code = l.project_code AND p.report_month = l.report_month WHERE l.label IS NOT NULL),
x AS (SELECT regime, count(*) AS n, sum(label) AS p FROM e GROUP BY 1),
v AS (SELECT 'as_built' AS variant, * FROM e UNION ALL SELECT 'label_two', regime, project_code, report_month, CASE WHEN ent % 29 = 0 THEN 2 ELSE label END, ent FROM e
  UNION ALL SELECT 'key_twice', * FROM e UNION ALL SELECT 'key_twice', * FROM e WHERE ent % 31 = 0 UNION ALL SELECT 'rows_lost', * FROM e WHERE ent % 37 <> 0
  UNION ALL SELECT 'label_flipped', regime, project_code, report_month, CASE WHEN ent % 41 = 0 THEN 1 - label ELSE label END, ent FROM e
  UNION ALL SELECT 'month_moved', regime, project_code, report_month, label, ent FROM e WHERE ent % 43 <> 0
  UNION ALL SELECT * FROM (SELECT DISTINCT ON (regime, project_code) 'month_moved', regime, project_code, '2031-01', label, ent FROM e WHERE ent % 43 = 0 ORDER BY regime, project_code, e.report_month)),
c AS (SELECT regime, variant, count(*) AS n_rows, count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 0) AS negatives, count(*) FILTER (WHERE label NOT IN (0, 1)) AS bad_labels, count(*) - count(DISTINCT project_code || '|' || report_month) AS repeated,
  0 AS no_key, count(*) FILTER (WHERE report_month = '2031-01') AS outside FROM v GROUP BY 1, 2)
SELECT c.*, CASE WHEN repeated > 0 THEN 'KEY_REPEATED' WHEN bad_labels > 0 THEN 'LABEL_DOMAIN' WHEN outside > 0 THEN 'SEGMENT' WHEN n_rows <> n THEN 'ROW_COUNT' WHEN positives <> p THEN 'POSITIVE_COUNT' ELSE 'PASS' END AS status FROM c JOIN x USING (regime)"""


def _gated(s, d):
    """Eligible rows read through the assertions of the contract, by month."""
    contract = contracts.Contract("label", 3, ("project_code", "report_month"), ())
    return contracts.sound(kept(s, d, "eligible", lambda: _eligible(s, d)), contract).groupBy("report_month").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("label").cast("long").alias("positives"))


FIELDS = ["project_code", "report_month", "start_date", "original_completion_date", "revised_completion_date", "original_cost", "revised_cost", "cumulative_expenditure", "physical_progress"]


def _changed(p):
    """Months of every fifth index get another progress for some projects; those of every eleventh leave."""
    progress = F.when((F.col("mi") % 5 == 0) & (F.col("ent") % 7 == 0), F.lit(150)).otherwise(F.col("physical_progress")).cast("decimal(6,2)")
    return p.where("mi % 11 <> 0").withColumn("physical_progress", progress)


def _revalidated(s, d):
    """Months checked, some changed, checked again: what is on record, and in which run each month was checked last."""
    path, p = folder(s, "revalidated"), panel(s, d)
    revalidation.revalidated(p.select(*FIELDS), path, "first", False)
    revalidation.revalidated(_changed(p).select(*FIELDS), path, "second", True)
    return revalidation.warnings(s, path).groupBy("report_month", "checked", "rule").agg(F.sum("n").alias("n"))


_RULES = [
    ("nonpositive_original_cost", "original_cost <= 0"), ("nonpositive_revised_cost", "revised_cost <= 0"), ("negative_expenditure", "cumulative_expenditure < 0"), ("extreme_expenditure_cost_mismatch", "revised_cost <> 0 AND cumulative_expenditure > 3 * revised_cost"),
    ("revised_cost_below_original", "revised_cost < original_cost"), ("physical_progress_above_100", "progress > 100"), ("progress_reported_before_start", "cumulative_expenditure = 0 AND progress > 0 AND coalesce(start_date > report_month, false)"),
    ("zero_expenditure_positive_progress", "cumulative_expenditure = 0 AND progress > 0 AND NOT coalesce(start_date > report_month, false)"), ("expenditure_with_zero_progress", "cumulative_expenditure > 0 AND progress = 0"), ("full_progress_still_ongoing", "progress = 100"),
    ("completion_date_before_start_date", "original_completion_date < start_date OR revised_completion_date < start_date"), ("invalid_project_code", "NOT regexp_full_match(project_code, '[0-9]{6}|N[0-9]{8}|[0-9]{9}')"),
]
REVALIDATED = f"""WITH {PANEL_SQL}, hit AS (SELECT DISTINCT report_month FROM panel WHERE mi % 5 = 0 AND ent % 7 = 0 AND mi % 11 <> 0 AND physical_progress IS DISTINCT FROM 150),
q AS (SELECT *, CASE WHEN mi % 5 = 0 AND ent % 7 = 0 THEN 150 ELSE physical_progress END AS progress, CASE WHEN report_month IN (SELECT report_month FROM hit) THEN 'second' ELSE 'first' END AS checked FROM panel WHERE mi % 11 <> 0)
SELECT report_month, checked, 'ROWS' AS rule, count(*) AS n FROM q GROUP BY 1, 2
""" + "\n".join(f"UNION ALL SELECT report_month, checked, '{rule}', count(*) FROM q WHERE {cond} GROUP BY 1, 2" for rule, cond in _RULES)


def _numbered(s, d):
    """Completions with serials: in months of index 0 (mod 4) from two ranges of a ledger, else from 1 on; some are foreign, repeated or without a page."""
    w = Window.partitionBy("report_month").orderBy("project_code")
    c = completed(s, d).withColumn("n", F.row_number().over(w)).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("report_month")))
    half = F.ceil(F.col("all") / 2)
    k = F.when(F.col("mi") % 4 == 0, F.when(F.col("n") <= half, 10 + F.col("n")).otherwise(30 + F.col("n"))).otherwise(F.col("n"))
    k = F.when((F.col("mi") % 5 == 1) & (F.col("n") == 2), k + 500).when((F.col("mi") % 5 == 2) & (F.col("n") == 3), k - 1).otherwise(k)
    page = F.when((F.col("mi") % 7 == 3) & (F.col("n") == 1), F.lit(None).cast("int")).otherwise(1)
    rows = c.select("project_code", "report_month", F.col("report_month").alias("source_file"), page.alias("source_page"), F.col("n").alias("source_row_number"), k.cast("int").alias("source_serial_number"), F.lit("grid").alias("extraction_method"))
    size = c.where("mi % 4 = 0 and n = 1").select("report_month", half.alias("half"), "all")
    ranges = size.select("report_month", F.inline(F.array(F.struct(F.lit(11).cast("long").alias("low"), (10 + F.col("half")).cast("long").alias("high")), F.struct((31 + F.col("half")).cast("long").alias("low"), (30 + F.col("all")).cast("long").alias("high"))))).where("low <= high")
    return rows, ranges


SERIALS = f"""WITH {COMPLETED_SQL}, c AS (SELECT report_month, mi, row_number() OVER (PARTITION BY report_month ORDER BY project_code) AS n, count(*) OVER (PARTITION BY report_month) AS total FROM completed),
b AS (SELECT *, CASE WHEN mi % 4 = 0 THEN CASE WHEN n <= (total + 1) // 2 THEN 10 + n ELSE 30 + n END ELSE n END AS allowed FROM c),
k AS (SELECT *, CASE WHEN mi % 5 = 1 AND n = 2 THEN allowed + 500 WHEN mi % 5 = 2 AND n = 3 THEN allowed - 1 ELSE allowed END AS serial FROM b),
u AS (SELECT DISTINCT report_month, serial FROM k),
i AS (SELECT report_month, count(*) AS islands FROM u WHERE NOT EXISTS (SELECT 1 FROM u v WHERE v.report_month = u.report_month AND v.serial = u.serial - 1) GROUP BY 1),
g AS (SELECT report_month, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.report_month = k.report_month AND u.serial = k.allowed)) AS gaps FROM k GROUP BY 1),
f AS (SELECT report_month, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM k WHERE u.report_month = k.report_month AND u.serial = k.allowed)) AS "foreign" FROM u GROUP BY 1),
r AS (SELECT report_month, count(*) AS n_rows, count(*) - count(DISTINCT serial) AS repeated, count(*) FILTER (WHERE mi % 7 = 3 AND n = 1) AS without_provenance FROM k GROUP BY 1)
SELECT report_month, n_rows, islands, gaps, "foreign", repeated, 0::BIGINT AS overlaps, without_provenance, CASE WHEN "foreign" > 0 THEN 'FOREIGN_SERIAL' WHEN repeated > 0 THEN 'REPEATED_SERIAL' WHEN gaps > 0 THEN 'SERIAL_GAP' WHEN without_provenance > 0 THEN 'NO_PROVENANCE' ELSE 'ACCEPTED' END AS status
FROM r JOIN i USING (report_month) JOIN g USING (report_month) JOIN f USING (report_month)"""


def _cells(s, d):
    """Events of two months with the raw cells of both."""
    p = panel(s, d).withColumn("source_page", (F.floor(F.col("ent") / 40) + 1).cast("int")).withColumn("source_row_number", (F.col("ent") % 40).cast("int"))
    raw = p.where("ent % 13 <> 0").select(*longitudinal.PLACE, F.array("project_code", "agency", F.col("original_cost").cast("string")).alias("cells"))
    cells = longitudinal.bucketed(raw, f"raw_cells_{uuid.uuid4().hex}", folder(s, "raw-cells"))
    found = longitudinal.pairs(p).where(~F.col("a_agency").eqNullSafe(F.col("b_agency"))).select("project_code", "month_a", "month_b")
    out = longitudinal.with_raw_cells(longitudinal.with_places(found, p), cells)
    return out.select("project_code", "month_a", "month_b", *[F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c) for c in ("previous_raw_cells", "current_raw_cells")])


CELLS = ONLY + """, r AS (SELECT *, CASE WHEN ent % 13 <> 0 THEN project_code || '|' || agency || '|' || CAST(original_cost AS VARCHAR) ELSE '' END AS cells FROM panel)
SELECT a.project_code, a.report_month AS month_a, b.report_month AS month_b, a.cells AS previous_raw_cells, b.cells AS current_raw_cells FROM r a JOIN r b ON a.project_code = b.project_code AND b.mi = a.mi + 1 WHERE a.agency IS DISTINCT FROM b.agency"""
_SOLE = "project_code, report_month"
ENTRIES = [
    ("c15_one_layout", lambda s, d: contracts.one_layout(panel(s, d).select(F.col("report_month").alias("source_file"), F.when(F.col("mi") % 2 == 0, "NINE").otherwise("EIGHT").alias("layout"))), ONLY + " SELECT DISTINCT report_month AS source_file, CASE WHEN mi % 2 = 0 THEN 'NINE' ELSE 'EIGHT' END AS layout FROM panel"),
    ("d20_serial_ranges", lambda s, d: serials.checked(*_numbered(s, d)), SERIALS),
    ("d21_revalidation", _revalidated, REVALIDATED),
    ("d22_contract_gates", _gates, GATES),
    ("d22_asserted_rows", _gated, f"WITH {PANEL_SQL}, {LABEL} SELECT report_month, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS positives FROM lab WHERE label IS NOT NULL GROUP BY 1"),
    ("e04_unique_membership", lambda s, d: longitudinal.membership(contracts.once(panel(s, d).select("project_code", "mi"), "project_code", "mi")), ONLY + """, m AS (SELECT DISTINCT mi FROM panel), e AS (SELECT x.mi FROM m x JOIN m y ON y.mi = x.mi + 1), a AS (SELECT e.mi, p.project_code FROM e JOIN panel p ON p.mi = e.mi), b AS (SELECT e.mi, p.project_code FROM e JOIN panel p ON p.mi = e.mi + 1)
SELECT mi, count(*) FILTER (WHERE a.project_code IS NOT NULL AND b.project_code IS NOT NULL) AS both, count(*) FILTER (WHERE b.project_code IS NULL) AS earlier_only, count(*) FILTER (WHERE a.project_code IS NULL) AS later_only FROM a FULL JOIN b USING (mi, project_code) GROUP BY 1"""),
    ("e19_raw_cells", _cells, CELLS),
    ("i01_assigned_months", lambda s, d: contracts.assigned(panel(s, d).drop("segment", "regime")).groupBy("segment", "regime").agg(F.count(F.lit(1)).alias("n_rows"), F.min("report_month").alias("first"), F.max("report_month").alias("last")), ONLY + " SELECT segment, regime, count(*) AS n_rows, min(report_month) AS first, max(report_month) AS last FROM panel GROUP BY 1, 2"),
    ("m01_joined_once", lambda s, d: contracts.joined_once(risk(s, d).select("project_code", "report_month", "risk_rank"), panel(s, d).select("project_code", "report_month", "project_name"), ["project_code", "report_month"]), f"{RISK_SQL} SELECT {_SOLE}, risk_rank, panel.project_name FROM risk JOIN panel USING (project_code, report_month)"),
    ("m06_exact_record", lambda s, d: contracts.exact(risk(s, d), "000011", "2000-06").select("project_code", "report_month", "regime", "risk_rank"), f"{RISK_SQL} SELECT {_SOLE}, regime, risk_rank FROM risk WHERE project_code = '000011' AND report_month = '2000-06'"),
    ("m13_default_options", lambda s, d: contracts.options(risk(s, d), None, "agency", "sector", "state", "regime").select("month", F.size("months").cast("long").alias("months"), "dimension", F.array_join("values", "|").alias("values")), f"""{RISK_SQL}, t AS (SELECT max(report_month) AS month, count(DISTINCT report_month) AS months FROM risk),
l AS (SELECT DISTINCT dimension, value FROM (SELECT 'agency' AS dimension, agency AS value FROM risk, t WHERE report_month = month UNION ALL SELECT 'sector', sector FROM risk, t WHERE report_month = month UNION ALL SELECT 'state', state FROM risk, t WHERE report_month = month UNION ALL SELECT 'regime', regime FROM risk, t WHERE report_month = month) WHERE value <> '')
SELECT month, months, dimension, string_agg(value, '|' ORDER BY lower(value), value) AS "values" FROM l, t GROUP BY 1, 2, 3"""),
]
