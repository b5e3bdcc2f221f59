"""Smaller queries: bands, predicates, unions, ledgers, ranks of models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import months
from ..functions.numbers import platt
from ..operators import metrics
from .metrics import BS, SC, scored
from .sources import _ledger
from .surrogate import COMPLETED_SQL, PANEL_SQL, completed, panel

ONLY, BOTH = f"WITH {PANEL_SQL}", f"WITH {COMPLETED_SQL}"
KEY = "project_code, report_month"
#: Progress bands and age bands (B24): upper edges and names.
PROGRESS = [(0, "0"), (25, "0-25"), (50, "25-50"), (75, "50-75"), (100, "75-100")]


def band(c, edges, last):
    out = F.lit(last)
    for edge, name in reversed(edges):
        out = F.when(c <= edge, F.lit(name)).otherwise(out)
    return F.when(c.isNull(), "missing").otherwise(out)


BAND = "CASE WHEN {0} IS NULL THEN 'missing' " + " ".join(f"WHEN {{0}} <= {e} THEN '{n}'" for e, n in PROGRESS) + " ELSE 'over 100' END"


def _calibration_table(s, d):
    """Raw against operational (Platt) Brier and calibration error per fold."""
    x = scored(s, d).where("score < 1")
    y = x.withColumn("score", platt(F.log(F.col("score") / (1 - F.col("score"))), 1.2, 0.45))
    a = metrics.brier(x, "regime", "fold").select("regime", "fold", F.col("brier").alias("raw"))
    b = metrics.brier(y, "regime", "fold").select("regime", "fold", F.col("brier").alias("operational"))
    return a.join(b, ["regime", "fold"]).withColumn("change", F.round(F.col("operational") - F.col("raw"), 7)).select("regime", "fold", F.round("raw", 7).alias("raw"), F.round("operational", 7).alias("operational"), "change")


_op = "1 / (1 + exp(-(1.2::DOUBLE * ln(score / (1 - score)) + 0.45::DOUBLE)))"
CALIBRATION = SC + f", c AS (SELECT regime, fold, round(avg((score - label) ** 2), 8) AS raw, round(avg(({_op} - label) ** 2), 8) AS operational FROM sc WHERE score < 1 GROUP BY 1, 2) SELECT regime, fold, round(raw, 7) AS raw, round(operational, 7) AS operational, round(operational - raw, 7) AS change FROM c"


def _fold_stability(s, d):
    """Average precision over folds: mean, population deviation, extremes, and the best fold."""
    ap = metrics.average_precision(scored(s, d), "regime", "fold").where("average_precision is not null")
    return ap.groupBy("regime").agg(F.round(F.avg("average_precision"), 7).alias("mean"), F.round(F.stddev_pop("average_precision"), 7).alias("std"), F.round(F.min("average_precision"), 7).alias("least"), F.round(F.max("average_precision"), 7).alias("most"), F.max_by("fold", "average_precision").alias("best_fold"))


STABILITY = BS + ", a AS (SELECT regime, fold, sum(p::DOUBLE / nullif(positives, 0) * (tp::DOUBLE / alerts)) AS v FROM bs GROUP BY 1, 2) SELECT regime, round(avg(v), 7) AS mean, round(stddev_pop(v), 7) AS std, round(min(v), 7) AS least, round(max(v), 7) AS most, arg_max(fold, v) AS best_fold FROM a WHERE v IS NOT NULL GROUP BY 1"


def _completed_checks(s, d):
    """Completions: rows, keys that repeat, code formats, months between start and completion."""
    c = completed(s, d)
    return c.groupBy("report_month").agg(F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) - F.count_distinct("project_code")).alias("repeated"), F.count(F.when(~F.col("project_code").rlike("^([0-9]{6}|N[0-9]{8})$"), 1)).alias("bad_code"), F.count("original_cost").alias("costs_parsed"))


def _ranked_models(s, d):
    """Scores and their negation as two models, ranked by average precision per regime."""
    x = scored(s, d)
    two = x.withColumn("model", F.lit("score")).unionByName(x.withColumn("score", 1 - F.col("score")).withColumn("model", F.lit("reverse")))
    ap = metrics.average_precision(two, "regime", "model")
    return ap.select("regime", "model", F.round("average_precision", 7).alias("average_precision"), F.rank().over(Window.partitionBy("regime").orderBy(F.desc("average_precision"))).cast("long").alias("place"))


ENTRIES = [
    ("b23_consecutive", lambda s, d: panel(s, d).withColumn("p", F.lag("report_month").over(Window.partitionBy("project_code").orderBy("report_month"))).select("project_code", "report_month", months.consecutive("p", "report_month").alias("follows")), f"{ONLY} SELECT {KEY}, mi - lag(mi) OVER (PARTITION BY project_code ORDER BY report_month) = 1 AS follows FROM panel"),
    ("b24_progress_bands", lambda s, d: panel(s, d).groupBy("report_month", band(F.col("physical_progress"), PROGRESS, "over 100").alias("band")).agg(F.count(F.lit(1)).alias("n")), f"{ONLY} SELECT report_month, {BAND.format('physical_progress')} AS band, count(*) AS n FROM panel GROUP BY 1, 2"),
    ("b30_platt", lambda s, d: panel(s, d).select("project_code", "report_month", F.round(platt(F.col("cumulative_expenditure").cast("double") / 1000, -0.5, 0.25), 9).alias("out")), f"{ONLY} SELECT {KEY}, round(1 / (1 + exp(-greatest(-709, least(709, -0.5::DOUBLE * (CAST(cumulative_expenditure AS DOUBLE) / 1000) + 0.25)))), 9) AS out FROM panel"),
    ("d20_completed_checks", _completed_checks, f"{BOTH} SELECT report_month, count(*) AS n_rows, count(*) - count(DISTINCT project_code) AS repeated, count(*) FILTER (WHERE NOT regexp_full_match(project_code, '[0-9]{{6}}|N[0-9]{{8}}')) AS bad_code, count(original_cost) AS costs_parsed FROM completed GROUP BY 1"),
    ("e01_union_of_months", lambda s, d: (lambda p: p.where("regime = 'LEGACY'").unionByName(p.where("regime = 'MODERN'")))(panel(s, d).select("project_code", "report_month", "regime", "agency")), f"{ONLY} SELECT {KEY}, regime, agency FROM panel"),
    ("j19_fold_stability", _fold_stability, STABILITY), ("j26_model_ranks", _ranked_models, None), ("k16_calibration_folds", _calibration_table, CALIBRATION),
    ("n24_active_version", lambda s, d: _ledger(s, d).where("status = 'ACTIVE' and n_rows > 0").groupBy().agg(F.coalesce(F.max_by("version", "version"), F.lit("NOT_INGESTED")).alias("version"), F.max("n_rows").alias("n_rows")), f"{ONLY} SELECT 'v2' AS version, count(*) AS n_rows FROM panel"),
]
