"""Queries of walk-forward evaluation and alert policy, on a deterministic score."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import count_if, platt
from ..operators import labels
from ..operators import metrics as op
from ..sources.store import kept
from .labels import LABEL, PRIOR
from .surrogate import PANEL_SQL, panel


def with_progress(s, d):
    """The scored rows with their physical progress."""
    return kept(s, d, "scored", lambda: _scored(panel(s, d)), "report_month")


def scored(s, d):
    """Labelled rows with score = (1 + prior extensions) / (2 + tenure); a fold is a calendar year of a regime."""
    return with_progress(s, d).drop("physical_progress_t")


def _scored(p):
    """Labels and counts so far by one pass over the panel."""
    x = labels.prior_counts(labels.labelled(p)).where("label is not null")
    return x.select("project_code", "report_month", "label", "extension_type", "mi", "regime", "sector", "agency", "state", ((1.0 + F.col("n_prior_schedule_extensions")) / (2.0 + F.col("observed_tenure_months"))).alias("score"),
                    F.col("physical_progress").cast("double").alias("physical_progress_t")).withColumn("fold", F.substring("report_month", 1, 4))


SC = f"WITH {PANEL_SQL}, {PRIOR}, {LABEL}, sc AS (SELECT p.project_code, p.report_month, p.mi, p.regime, p.sector, p.agency, p.state, l.label, l.extension_type, (1.0::DOUBLE + n_prior_schedule_extensions) / (2.0::DOUBLE + observed_tenure_months) AS score, p.report_month[1:4] AS fold FROM prior p JOIN lab l ON p.project_code = l.project_code AND p.report_month = l.report_month WHERE l.label IS NOT NULL)"
BS = SC + """, g AS (SELECT regime, fold, score, count(*) AS n, CAST(sum(label) AS BIGINT) AS p FROM sc GROUP BY 1, 2, 3), bs AS (SELECT *, sum(n) OVER u AS alerts, sum(p) OVER u AS tp, sum(n) OVER w AS total, sum(p) OVER w AS positives FROM g WINDOW u AS (PARTITION BY regime, fold ORDER BY score DESC ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY regime, fold))"""
BY = ("regime", "fold")
ORIGINS = [("LEGACY", y * 12 + m) for y in (1997, 1998) for m in (5, 8, 11)] + [("MODERN", y * 12 + m) for y in (2000, 2001) for m in (2, 8)]
EDGE = "CASE " + " ".join(f"WHEN score < {op.EDGES[i + 1]!r}::DOUBLE THEN {i}" for i in range(9)) + " ELSE 9 END"
RANKED = SC + ", rk AS (SELECT *, row_number() OVER (PARTITION BY regime, fold ORDER BY score DESC, project_code, report_month) AS rank, count(*) OVER (PARTITION BY regime, fold) AS total, sum(label) OVER (PARTITION BY regime, fold) AS positives FROM sc)"
RATES = "round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) WHEN tp + fn > 0 THEN 0 END, 6) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall, round(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 6) AS f1"


def origins(s):
    return s.createDataFrame(ORIGINS, "regime string, origin int")


RM = SC + ", mo AS (SELECT *, row_number() OVER (PARTITION BY regime, report_month ORDER BY score DESC, project_code) AS rank, count(*) OVER (PARTITION BY regime, report_month) AS total, sum(label) OVER (PARTITION BY regime, report_month) AS positives FROM sc)"


def _point(s, d):
    x = scored(s, d)
    m = op.average_precision(x, *BY).join(op.roc_auc(x, *BY), list(BY)).join(op.brier(x, *BY), list(BY))
    return m.withColumn("average_precision", F.round("average_precision", 8)).withColumn("roc_auc", F.round("roc_auc", 8))


POINT = BS + """, ap AS (SELECT regime, fold, round(sum(p::DOUBLE / nullif(positives, 0) * (tp::DOUBLE / alerts)), 8) AS average_precision, round((sum(p * (total - alerts + (n + 1) / 2.0::DOUBLE)) - max(positives) * (max(positives) + 1) / 2.0::DOUBLE) / nullif(max(positives) * (max(total) - max(positives)), 0), 8) AS roc_auc FROM bs GROUP BY 1, 2)
SELECT ap.*, brier, mean_score, n_rows, positives FROM ap JOIN (SELECT regime, fold, round(avg((score - label) ** 2), 8) AS brier, round(avg(score), 8) AS mean_score, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS positives FROM sc GROUP BY 1, 2) USING (regime, fold)"""


def _lagged(s, d):
    """Positive where prior extensions grew since the month before, in the same segment."""
    p = labels.prior_counts(panel(s, d))
    before = labels.at_offset("n_prior_schedule_extensions", -1)
    r = p.select("project_code", "report_month", before.isNotNull().alias("covered"), F.coalesce(F.col("n_prior_schedule_extensions") > before, F.lit(False)).alias("pred"))
    x = scored(s, d).join(r, ["project_code", "report_month"])
    return op.with_rates(x.groupBy("regime").agg(count_if(F.col("covered")).alias("covered"), *op.confusion(F.col("pred"))))


LAGGED = SC + f""", lr AS (SELECT project_code, report_month, max(n_prior_schedule_extensions) OVER (PARTITION BY project_code, segment ORDER BY mi RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS b, n_prior_schedule_extensions AS n FROM prior),
c AS (SELECT regime, count(*) FILTER (WHERE b IS NOT NULL) AS covered, count(*) FILTER (WHERE coalesce(n > b, false) AND label = 1) AS tp, count(*) FILTER (WHERE coalesce(n > b, false) AND label = 0) AS fp, count(*) FILTER (WHERE NOT coalesce(n > b, false) AND label = 1) AS fn, count(*) FILTER (WHERE NOT coalesce(n > b, false) AND label = 0) AS tn FROM sc JOIN lr USING (project_code, report_month) GROUP BY 1) SELECT *, {RATES} FROM c"""


def _encoded(s, d):
    x = scored(s, d)
    train = op.folds(x, origins(s))
    rows = x.join(F.broadcast(origins(s)), "regime").where(F.col("mi") == F.col("origin"))
    return op.frequency_encoded(train, rows, "state", "regime", "origin").groupBy("regime", "origin", "value").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("encoded"), 8).alias("encoded"))


OV = "o AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', {m})" for r, m in ORIGINS) + ") AS v(regime, origin))"
ENCODED = SC + f", {OV}, t AS (SELECT regime, origin, coalesce(nullif(state, ''), '__MISSING__') AS value, count(*) AS k FROM sc JOIN o USING (regime) WHERE mi + 3 < origin GROUP BY 1, 2, 3), f AS (SELECT *, k::DOUBLE / sum(k) OVER (PARTITION BY regime, origin) AS share FROM t) SELECT e.regime, e.origin, e.value, count(*) AS n, round(max(coalesce(share, 0)), 8) AS encoded FROM (SELECT regime, origin, coalesce(nullif(state, ''), '__MISSING__') AS value FROM sc JOIN o USING (regime) WHERE mi = origin) e LEFT JOIN f USING (regime, origin, value) GROUP BY 1, 2, 3"


def _scaled(s, d):
    """Fold-local mean and population deviation of tenure, null counted."""
    x = with_progress(s, d)
    return op.folds(x, origins(s)).groupBy("regime", "origin").agg(F.round(F.avg("physical_progress_t"), 6).alias("mean"), F.round(F.coalesce(F.nullif(F.stddev_pop("physical_progress_t"), F.lit(0.0)), F.lit(1.0)), 6).alias("scale"), count_if(F.col("physical_progress_t").isNull()).alias("missing"))


SCALED = SC + f", {OV} SELECT sc.regime, origin, round(avg(CAST(physical_progress AS DOUBLE)), 6) AS mean, round(coalesce(nullif(stddev_pop(CAST(physical_progress AS DOUBLE)), 0), 1), 6) AS scale, count(*) FILTER (WHERE physical_progress IS NULL) AS missing FROM sc JOIN o USING (regime) JOIN (SELECT project_code, report_month, physical_progress FROM panel) USING (project_code, report_month) WHERE mi + 3 < origin GROUP BY 1, 2"


def _views(s, d):
    """Pooled, fold mean and row-weighted average precision."""
    x = scored(s, d)
    f = op.average_precision(x, *BY).join(x.groupBy(*BY).agg(F.count(F.lit(1)).alias("n")), list(BY))
    g = f.groupBy("regime").agg(F.round(F.avg("average_precision"), 8).alias("macro"), F.round(F.sum(F.col("average_precision") * F.col("n")) / F.sum("n"), 8).alias("weighted"))
    return op.average_precision(x, "regime").select("regime", F.round("average_precision", 8).alias("micro")).join(g, "regime")


VIEWS = BS + """, f AS (SELECT regime, fold, sum(p::DOUBLE / nullif(positives, 0) * (tp::DOUBLE / alerts)) AS a, max(total) AS n FROM bs GROUP BY 1, 2), g2 AS (SELECT regime, score, sum(n) AS n, sum(p) AS p FROM g GROUP BY 1, 2), b2 AS (SELECT *, sum(n) OVER (PARTITION BY regime ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS alerts, sum(p) OVER (PARTITION BY regime ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(p) OVER (PARTITION BY regime) AS positives FROM g2),
m AS (SELECT regime, round(sum(p::DOUBLE / positives * (tp::DOUBLE / alerts)), 8) AS micro FROM b2 GROUP BY 1) SELECT m.*, macro, weighted FROM m JOIN (SELECT regime, round(avg(a), 8) AS macro, round(sum(a * n) / sum(n), 8) AS weighted FROM f GROUP BY 1) USING (regime)"""


def _policy(s, d):
    """Thresholds chosen on all earlier folds of a regime, applied to the next one."""
    x = scored(s, d).withColumn("year", F.col("fold").cast("int"))
    years = x.select("regime", "year").distinct().withColumnRenamed("year", "at")
    past = x.join(F.broadcast(years), "regime").where(F.col("year") < F.col("at"))  # a row for each fold
    t = op.recall_threshold(past, 0.6, "regime", "at")
    now = x.join(t, (x["regime"] == t["regime"]) & (x["year"] == t["at"])).drop(t["regime"])
    return op.with_rates(now.groupBy("regime", "year").agg(F.max("threshold").alias("threshold"), *op.confusion(F.col("score") >= F.col("threshold"))))


POLICY = SC + f""", y AS (SELECT DISTINCT regime, CAST(fold AS INT) AS yr FROM sc), pg AS (SELECT y.regime, yr, score, count(*) AS n, sum(label) AS p FROM sc JOIN y ON sc.regime = y.regime AND CAST(fold AS INT) < yr GROUP BY 1, 2, 3), pb AS (SELECT *, sum(p) OVER (PARTITION BY regime, yr ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(p) OVER (PARTITION BY regime, yr) AS positives FROM pg),
th AS (SELECT regime, yr, max(score) AS threshold FROM pb WHERE tp >= 0.6::DOUBLE * positives AND positives > 0 GROUP BY 1, 2), c AS (SELECT sc.regime, yr AS year, max(threshold) AS threshold, count(*) FILTER (WHERE score >= threshold AND label = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND label = 0) AS fp, count(*) FILTER (WHERE score < threshold AND label = 1) AS fn, count(*) FILTER (WHERE score < threshold AND label = 0) AS tn FROM sc JOIN th ON sc.regime = th.regime AND CAST(fold AS INT) = yr GROUP BY 1, 2) SELECT *, {RATES} FROM c"""
CONF = lambda t: f"count(*) FILTER (WHERE score >= {t} AND label = 1) AS tp, count(*) FILTER (WHERE score >= {t} AND label = 0) AS fp, count(*) FILTER (WHERE score < {t} AND label = 1) AS fn, count(*) FILTER (WHERE score < {t} AND label = 0) AS tn"
PCT = [("p01", 0.01), ("p10", 0.1), ("p50", 0.5), ("p90", 0.9), ("p99", 0.99)]


def _decision(s, d):
    """Does the lagged rule beat prevalence on recall at equal alerts? The regime's verdict (J29 on given deltas)."""
    x = _lagged(s, d)
    prevalence = scored(s, d).groupBy("regime").agg(F.avg("label").alias("q"))
    return x.join(prevalence, "regime").select("regime", F.round(F.col("precision") - F.col("q"), 6).alias("delta"), F.when(F.col("precision") > F.col("q"), "prefer_challenger").otherwise("keep").alias("decision"))


ENTRIES = [
    ("j01_folds", lambda s, d: op.folds(scored(s, d), origins(s)).groupBy("regime", "origin").agg(F.count(F.lit(1)).alias("train_rows"), F.sum("label").cast("long").alias("positives"), F.min("report_month").alias("first"), F.max("report_month").alias("last")), SC + f", {OV} SELECT regime, origin, count(*) AS train_rows, CAST(sum(label) AS BIGINT) AS positives, min(report_month) AS first, max(report_month) AS last FROM sc JOIN o USING (regime) WHERE mi + 3 < origin GROUP BY 1, 2"),
    ("j02_skip_reasons", lambda s, d: origins(s).join(op.folds(scored(s, d), origins(s)).groupBy("regime", "origin").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")), ["regime", "origin"], "left").select("regime", "origin", F.array_join(F.array_compact(F.array(F.when(F.col("n").isNull(), "NO_TRAINING_ROWS"), F.when(F.coalesce("p", F.lit(0)) == 0, "NO_POSITIVES"), F.when(F.col("p") == F.col("n"), "NO_NEGATIVES"))), "|").alias("reasons")), SC + f", {OV}, t AS (SELECT regime, origin, count(*) AS n, sum(label) AS p FROM sc JOIN o USING (regime) WHERE mi + 3 < origin GROUP BY 1, 2) SELECT regime, origin, concat_ws('|', CASE WHEN n IS NULL THEN 'NO_TRAINING_ROWS' END, CASE WHEN coalesce(p, 0) = 0 THEN 'NO_POSITIVES' END, CASE WHEN p = n THEN 'NO_NEGATIVES' END) AS reasons FROM o LEFT JOIN t USING (regime, origin)"),
    ("j03_prevalence", lambda s, d: op.folds(scored(s, d), origins(s)).groupBy("regime", "origin").agg(F.round(F.avg("label"), 8).alias("prevalence")).withColumn("always_negative", F.lit(0.0)), SC + f", {OV} SELECT regime, origin, round(avg(label), 8) AS prevalence, 0.0::DOUBLE AS always_negative FROM sc JOIN o USING (regime) WHERE mi + 3 < origin GROUP BY 1, 2"),
    ("j04_lagged_rule", _lagged, LAGGED), ("j05_frequency_encoding", _encoded, ENCODED), ("j06_standardisation", _scaled, SCALED),
    ("j07_encoder_audit", lambda s, d: op.folds(scored(s, d), origins(s)).groupBy("regime", "origin").agg(F.count_distinct("state").alias("states"), F.count_distinct("agency").alias("agencies"), count_if(F.col("state").isNull()).alias("null_states")), SC + f", {OV} SELECT regime, origin, count(DISTINCT state) AS states, count(DISTINCT agency) AS agencies, count(*) FILTER (WHERE state IS NULL) AS null_states FROM sc JOIN o USING (regime) WHERE mi + 3 < origin GROUP BY 1, 2"),
    ("j11_point_metrics", _point, POINT),
    ("j12_calibration_error", lambda s, d: op.calibration_error(scored(s, d), *BY), SC + f", b AS (SELECT regime, fold, {EDGE} AS bin, count(*) AS n, sum(score) AS s, sum(label) AS y FROM sc GROUP BY 1, 2, 3) SELECT regime, fold, round(sum(abs(s - y)) / sum(n), 8) AS ece FROM b GROUP BY 1, 2"),
    ("j13_reliability", lambda s, d: op.reliability(scored(s, d), *BY), SC + f" SELECT regime, fold, {EDGE} AS bin, count(*) AS n, round(avg(score), 8) AS mean_score, round(avg(label), 8) AS observed_rate FROM sc GROUP BY 1, 2, 3"),
    ("j17_metric_views", _views, VIEWS),
    ("j20_total_variation", lambda s, d: op.total_variation(panel(s, d), "state"), f"WITH {PANEL_SQL}, g AS (SELECT mi, coalesce(state, '') AS value, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY mi) AS s FROM panel GROUP BY 1, 2), m AS (SELECT DISTINCT mi FROM panel) SELECT m.mi, round(sum(abs(coalesce(s, 0) - coalesce(t, 0))) / 2, 8) AS distance FROM (SELECT coalesce(a.mi, b.mi) AS mi, s, t FROM g a FULL JOIN (SELECT mi + 1 AS mi, value, s AS t FROM g) b ON a.mi = b.mi AND a.value = b.value) x JOIN m ON m.mi = x.mi WHERE m.mi - 1 IN (SELECT mi FROM m) GROUP BY 1"),
    ("j21_missing_rates", lambda s, d: panel(s, d).groupBy("report_month").agg(*[F.round(F.avg(F.col(c).isNull().cast("int")), 6).alias(c) for c in ("state", "revised_cost", "physical_progress", "start_date")]), f"WITH {PANEL_SQL} SELECT report_month, " + ", ".join(f"round(avg(CAST({c} IS NULL AS INT)), 6) AS {c}" for c in ("state", "revised_cost", "physical_progress", "start_date")) + " FROM panel GROUP BY 1"),
    ("j22_positive_composition", lambda s, d: scored(s, d).where("label = 1").groupBy("report_month").agg(F.count(F.lit(1)).alias("positives"), F.round(F.avg((F.col("extension_type") == "FIRST_REVISION").cast("int")), 6).alias("first_share")), SC + " SELECT report_month, count(*) AS positives, round(avg(CAST(extension_type = 'FIRST_REVISION' AS INT)), 6) AS first_share FROM sc WHERE label = 1 GROUP BY 1"),
    ("j23_feature_distribution", lambda s, d: scored(s, d).groupBy("report_month").agg(F.round(F.avg("score"), 8).alias("mean"), F.round(F.stddev_pop("score"), 6).alias("std"), *[F.round(F.percentile("score", F.lit(p)), 8).alias(n) for n, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))]), SC + " SELECT report_month, round(avg(score), 8) AS mean, round(stddev_pop(score), 6) AS std, " + ", ".join(f"round(quantile_cont(score, {p}), 8) AS {n}" for n, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))) + " FROM sc GROUP BY 1"),
    ("j24_score_distribution", lambda s, d: scored(s, d).groupBy("regime").agg(*[F.round(F.percentile("score", F.lit(p)), 8).alias(n) for n, p in PCT], F.round(F.avg("score") - F.avg("label"), 8).alias("calibration_gap")), SC + " SELECT regime, " + ", ".join(f"round(quantile_cont(score, {p}), 8) AS {n}" for n, p in PCT) + ", round(avg(score) - avg(label), 8) AS calibration_gap FROM sc GROUP BY 1"),
    ("j25_recall_anchors", lambda s, d: op.recall_anchors(scored(s, d), [0.25, 0.5, 0.75], *BY), BS + ", q AS (SELECT *, tp::DOUBLE / positives AS r, tp::DOUBLE / alerts AS pr FROM bs WHERE positives > 0) SELECT regime, fold, CAST(anchor AS DOUBLE) AS anchor, round(arg_min(pr, {'r': r, 's': -score}), 6) AS precision, round(min(r), 6) AS recall FROM q, (SELECT unnest([0.25, 0.5, 0.75]) AS anchor) WHERE r >= anchor GROUP BY 1, 2, 3"),
    ("j29_decision", _decision, LAGGED.replace(f"SELECT *, {RATES} FROM c", f", r AS (SELECT *, {RATES} FROM c), q AS (SELECT regime, avg(label) AS q FROM sc GROUP BY 1) SELECT regime, round(precision - q, 6) AS delta, CASE WHEN precision > q THEN 'prefer_challenger' ELSE 'keep' END AS decision FROM r JOIN q USING (regime)")),
    ("j30_reconciliation", lambda s, d: (lambda x: x.alias("a").join(x.where("mi % 7 <> 0").withColumn("score", F.round("score", 6)).alias("b"), ["project_code", "report_month"], "full").agg(F.count("a.score").alias("ours"), F.count("b.score").alias("theirs"), (F.max(F.abs(F.col("a.score") - F.col("b.score"))) <= 1e-6).alias("within")))(scored(s, d)), SC + " SELECT count(*) AS ours, count(*) FILTER (WHERE mi % 7 <> 0) AS theirs, true AS within FROM sc"),
    ("k02_pool_minimums", lambda s, d: scored(s, d).groupBy(*BY).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("report_month").alias("months"), F.sum("label").cast("long").alias("positives")).select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("criterion"), ((F.col("n_rows") >= r) & (F.col("months") >= m) & (F.col("positives") >= p) & (F.col("n_rows") - F.col("positives") >= p)).alias("met")) for n, r, m, p in (("loose", 20, 2, 5), ("middle", 60, 4, 20), ("strict", 200, 6, 50))])).alias("x")).select(*BY, "x.*"), SC + ", a AS (SELECT regime, fold, count(*) AS n, count(DISTINCT report_month) AS m, sum(label) AS p FROM sc GROUP BY 1, 2) SELECT regime, fold, c.k AS criterion, n >= c.r AND m >= c.mo AND p >= c.po AND n - p >= c.po AS met FROM a, (VALUES ('loose', 20, 2, 5), ('middle', 60, 4, 20), ('strict', 200, 6, 50)) c(k, r, mo, po)"),
    ("k04_platt_applied", lambda s, d: scored(s, d).withColumn("logit", F.log(F.col("score") / (1 - F.col("score")))).where("score < 1").select("project_code", "report_month", F.round(F.when(F.col("regime") == "MODERN", platt("logit", 1.2, 0.45)).otherwise(F.col("score")), 9).alias("operational")), SC + " SELECT project_code, report_month, round(CASE WHEN regime = 'MODERN' THEN 1 / (1 + exp(-(1.2::DOUBLE * ln(score / (1 - score)) + 0.45::DOUBLE))) ELSE score END, 9) AS operational FROM sc WHERE score < 1"),
    ("k05_recall_thresholds", lambda s, d: op.recall_threshold(scored(s, d), 0.7, *BY), BS + " SELECT regime, fold, max(score) AS threshold FROM bs WHERE tp >= 0.7::DOUBLE * positives AND positives > 0 GROUP BY 1, 2"),
    ("k06_precision_thresholds", lambda s, d: op.precision_threshold(scored(s, d), 0.4, *BY), BS + " SELECT regime, fold, min(score) AS threshold FROM bs WHERE tp >= 0.4::DOUBLE * alerts GROUP BY 1, 2"),
    ("k07_confusion", lambda s, d: op.with_rates(scored(s, d).groupBy(*BY).agg(*op.confusion(F.col("score") >= 0.3))), SC + f", c AS (SELECT regime, fold, {CONF('0.3::DOUBLE')} FROM sc GROUP BY 1, 2) SELECT *, {RATES} FROM c"),
    ("k09_top_k", lambda s, d: op.top_k(scored(s, d), [5, 20, 10000], "regime", "report_month"), RM + " SELECT regime, report_month, k, CAST(least(k, max(total)) AS BIGINT) AS applied_k, round(sum(label)::DOUBLE / count(*), 6) AS precision, round(sum(label)::DOUBLE / nullif(max(positives), 0), 6) AS recall FROM mo, (SELECT unnest([5, 20, 10000]) AS k) WHERE rank <= k GROUP BY 1, 2, 3"),
    ("k10_policy_folds", _policy, POLICY),
    ("k11_alert_caps", lambda s, d: op.capped(scored(s, d), 0.2, [0.05, 0.25, 0.5], "regime", "report_month"), RM + " SELECT regime, report_month, CAST(cap AS DOUBLE) AS cap, count(*) FILTER (WHERE score >= 0.2::DOUBLE) AS wanted, count(*) FILTER (WHERE score >= 0.2::DOUBLE AND rank <= floor(CAST(cap AS DOUBLE) * total)) AS alerts, count(*) FILTER (WHERE score >= 0.2::DOUBLE AND rank > floor(CAST(cap AS DOUBLE) * total)) AS suppressed, count(*) FILTER (WHERE score >= 0.2::DOUBLE AND rank <= floor(CAST(cap AS DOUBLE) * total) AND label = 1) AS tp FROM mo, (SELECT unnest([0.05, 0.25, 0.5]) AS cap) GROUP BY 1, 2, 3"),
    ("k12_policy_by_sector", lambda s, d: op.with_rates(scored(s, d).groupBy("regime", "sector").agg(*op.confusion(F.col("score") >= 0.3))), SC + f", c AS (SELECT regime, sector, {CONF('0.3::DOUBLE')} FROM sc GROUP BY 1, 2) SELECT *, {RATES} FROM c"),
    ("k13_policy_aggregate", lambda s, d: _policy(s, d).groupBy("regime").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.round(F.avg("precision"), 6).alias("mean_precision"), F.min(F.col("tp") + F.col("fp")).alias("least_alerts"), F.max(F.col("tp") + F.col("fp")).alias("most_alerts")), POLICY.replace(f"SELECT *, {RATES} FROM c", f", r AS (SELECT *, {RATES} FROM c) SELECT regime, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, round(avg(precision), 6) AS mean_precision, min(tp + fp) AS least_alerts, max(tp + fp) AS most_alerts FROM r GROUP BY 1")),
    ("k14_alert_volume", lambda s, d: _policy(s, d).select("regime", "year", (F.col("tp") + F.col("fp")).alias("alerts"), F.round((F.col("tp") + F.col("fp")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), 6).alias("alert_rate")), POLICY.replace(f"SELECT *, {RATES} FROM c", "SELECT regime, year, tp + fp AS alerts, round((tp + fp)::DOUBLE / (tp + fp + fn + tn), 6) AS alert_rate FROM c")),
]
