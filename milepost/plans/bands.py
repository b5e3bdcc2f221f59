"""Queries of bands (B24) and of embargoes at any month."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands
from ..operators import contracts, longitudinal
from .metrics import SC, scored
from .surrogate import PANEL_SQL, panel

ONLY = f"WITH {PANEL_SQL}"
_AGE = "(CAST(report_month[1:4] AS INT) * 12 + CAST(report_month[6:7] AS INT)) - (CAST(start_date[1:4] AS INT) * 12 + CAST(start_date[6:7] AS INT))"
AGE_SQL = f"CASE WHEN start_date IS NULL THEN 'START_DATE_MISSING' WHEN {_AGE} < 0 THEN 'STARTS_AFTER_REPORT' WHEN {_AGE} < 12 THEN '[0,1 year)' WHEN {_AGE} < 24 THEN '[1,2 years)' WHEN {_AGE} < 36 THEN '[2,3 years)' WHEN {_AGE} < 60 THEN '[3,5 years)' WHEN {_AGE} < 120 THEN '[5,10 years)' ELSE '[10+ years)' END"
PROGRESS_SQL = "CASE WHEN physical_progress IS NULL THEN 'MISSING' WHEN physical_progress = 0 THEN 'ZERO' WHEN physical_progress < 0 OR physical_progress > 100 THEN 'OUTSIDE_RANGE' WHEN physical_progress <= 25 THEN '(0,25]' WHEN physical_progress <= 50 THEN '(25,50]' WHEN physical_progress <= 75 THEN '(50,75]' ELSE '(75,100]' END"
FALL_SQL = "a.physical_progress - b.physical_progress"


def _falls(s, d):
    p = longitudinal.pairs(panel(s, d)).withColumn("band", bands.decrease_band(F.col("a_physical_progress") - F.col("b_physical_progress")))
    return p.where("band is not null").groupBy("month_a", "band").agg(F.count(F.lit(1)).alias("n"))


#: An origin in every regime that is no turn of a year or quarter.
ORIGIN = {"LEGACY": 1998 * 12 + 6, "MODERN": 2000 * 12 + 10}


def _embargoed(s, d):
    """Training rows of an origin in the middle of a year, each asserted to lie outside of the embargo."""
    out = None
    for regime, origin in ORIGIN.items():
        rows = contracts.embargoed(scored(s, d).where((F.col("regime") == regime) & (F.col("mi") + 3 < origin)), origin, 3).groupBy("regime", "report_month").agg(F.count(F.lit(1)).alias("n_rows"))
        out = rows if out is None else out.unionByName(rows)
    return out


DEPTH_SQL = "CASE WHEN n <= 2 THEN '1-2' WHEN n <= 5 THEN '3-5' WHEN n <= 11 THEN '6-11' WHEN n <= 17 THEN '12-17' WHEN n <= 26 THEN '18-26' ELSE '27+' END"
ENTRIES = [
    ("b24_depth_bands", lambda s, d: panel(s, d).groupBy("regime", "project_code").agg(F.count(F.lit(1)).alias("n")).groupBy("regime", bands.depth_band(F.col("n")).alias("band")).agg(F.count(F.lit(1)).alias("projects")), f"{ONLY} SELECT regime, {DEPTH_SQL} AS band, count(*) AS projects FROM (SELECT regime, project_code, count(*) AS n FROM panel GROUP BY 1, 2) GROUP BY 1, 2"),
    ("b24_age_bands", lambda s, d: panel(s, d).groupBy("report_month", bands.age_band("start_date", "report_month").alias("band")).agg(F.count(F.lit(1)).alias("n")), f"{ONLY} SELECT report_month, {AGE_SQL} AS band, count(*) AS n FROM panel GROUP BY 1, 2"),
    ("b24_progress_ranges", lambda s, d: panel(s, d).groupBy("report_month", bands.progress_band(F.col("physical_progress")).alias("band")).agg(F.count(F.lit(1)).alias("n")), f"{ONLY} SELECT report_month, {PROGRESS_SQL} AS band, count(*) AS n FROM panel GROUP BY 1, 2"),
    ("b24_decrease_bands", _falls, ONLY + f" SELECT a.report_month AS month_a, CASE WHEN {FALL_SQL} < 1 THEN '<1' WHEN {FALL_SQL} <= 5 THEN '1-5' WHEN {FALL_SQL} <= 10 THEN '5-10' ELSE '>10' END AS band, count(*) AS n FROM panel a JOIN panel b ON a.project_code = b.project_code AND b.mi = a.mi + 1 WHERE {FALL_SQL} > 0 GROUP BY 1, 2"),
    ("i14_embargo_any_month", _embargoed, SC + " SELECT regime, report_month, count(*) AS n_rows FROM sc WHERE (regime = 'LEGACY' AND mi + 3 < " + str(ORIGIN["LEGACY"]) + ") OR (regime = 'MODERN' AND mi + 3 < " + str(ORIGIN["MODERN"]) + ") GROUP BY 1, 2"),
]
