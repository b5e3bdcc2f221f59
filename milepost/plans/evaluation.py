"""Queries that compare folds and models: deciles, unseen categories, calibration learnt on earlier folds, model ranks, accepted scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics, ranks, snapshots
from ..operators import walkforward as wf
from ..sources.store import folder, kept
from .metrics import EDGE, OV, SC, origins, scored, with_progress
from .risk import features

WORDS = ("sector", "agency", "state")


def _writing(s, d, prefix):
    return lambda df, name: kept(s, d, f"{prefix}-{name}", lambda: df)


def _deciles(s, d):
    """Scores of a regime in ten parts as even as possible, lowest first."""
    x = ranks.numbered(scored(s, d).select("regime", "project_code", "report_month", "score", "label"), ["regime"], [F.col("score"), F.col("project_code"), F.col("report_month")], _writing(s, d, "deciles"))
    g = x.groupBy("regime", ranks.part_of(F.col("position"), F.col("total"), 10).alias("decile"))
    return g.agg(F.count(F.lit(1)).alias("n_rows"), F.min("score").alias("least"), F.max("score").alias("most"), F.round(F.avg("score"), 8).alias("mean_score"), F.round(F.avg("label"), 8).alias("observed_rate"))


DECILES = SC + """, n AS (SELECT *, ntile(10) OVER (PARTITION BY regime ORDER BY score, project_code, report_month) AS decile FROM sc)
SELECT regime, CAST(decile AS INT) AS decile, count(*) AS n_rows, min(score) AS least, max(score) AS most, round(avg(score), 8) AS mean_score, round(avg(label), 8) AS observed_rate FROM n GROUP BY 1, 2"""


def _fold_gaps(s, d):
    """Score minus observed rate, Brier score and calibration error of each fold."""
    x = scored(s, d)
    mean = x.groupBy("regime", "fold").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("label"), 8).alias("observed_rate"), F.round(F.avg("score"), 8).alias("mean_score"), F.round(F.avg("score") - F.avg("label"), 8).alias("gap"))
    return mean.join(metrics.brier(x, "regime", "fold").select("regime", "fold", "brier"), ["regime", "fold"]).join(metrics.calibration_error(x, "regime", "fold"), ["regime", "fold"])


GAPS = SC + f""", b AS (SELECT regime, fold, {EDGE} AS bin, sum(score) AS s, sum(label) AS y, count(*) AS n FROM sc GROUP BY 1, 2, 3), e AS (SELECT regime, fold, round(sum(abs(s - y)) / sum(n), 8) AS ece FROM b GROUP BY 1, 2)
SELECT regime, fold, count(*) AS n_rows, round(avg(label), 8) AS observed_rate, round(avg(score), 8) AS mean_score, round(avg(score) - avg(label), 8) AS gap, round(avg((score - label) ** 2), 8) AS brier, any_value(ece) AS ece FROM sc JOIN e USING (regime, fold) GROUP BY 1, 2"""
QUANTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def _summary(s, d):
    """Moments and quantiles of all scores of a regime (J24). Quantiles come from the counts of distinct scores, not from all values in one task."""
    counts = scored(s, d).groupBy("regime", "score").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y"))
    up = Window.partitionBy("regime").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    c = counts.withColumn("to", F.sum("n").over(up)).withColumn("all", F.sum("n").over(Window.partitionBy("regime")))
    at = lambda q, up: (F.ceil if up else F.floor)(q * (F.col("all") - 1))
    value = lambda q, up: F.min(F.when(F.col("to") > at(q, up), F.col("score")))
    share = lambda q: F.max(q * (F.col("all") - 1) - F.floor(q * (F.col("all") - 1)))
    quantile = [F.round(value(q, False) + share(q) * (value(q, True) - value(q, False)), 8).alias(f"p{round(100 * q):02d}") for q in QUANTILES]
    return c.groupBy("regime").agg(F.sum("n").alias("n_rows"), F.round(F.sum(F.col("n") * F.col("score")) / F.sum("n"), 8).alias("mean"), F.min("score").alias("minimum"), F.max("score").alias("maximum"), F.round(F.sum("y") / F.sum("n"), 8).alias("observed_rate"), *quantile)


SUMMARY = SC + " SELECT regime, count(*) AS n_rows, round(avg(score), 8) AS mean, min(score) AS minimum, max(score) AS maximum, round(avg(label), 8) AS observed_rate, " + ", ".join(f"round(quantile_cont(score, {q}), 8) AS p{round(100 * q):02d}" for q in QUANTILES) + " FROM sc GROUP BY 1"


def _unseen(s, d):
    """Shares of an origin's rows whose category no training row has (J19). A category is unseen if the month in which it first appears in its
    regime is not before the embargo: one comparison, whatever the number of folds."""
    level = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("__MISSING__"))
    x = scored(s, d).select("regime", "mi", "label", *[level(c).alias(c) for c in WORDS])
    now = x.join(F.broadcast(origins(s)), "regime").where(F.col("mi") == F.col("origin"))
    for c in WORDS:
        now = now.join(x.groupBy("regime", c).agg(F.min("mi").alias(f"{c}_first")), ["regime", c])
    unseen = lambda c: F.count_if(F.col(f"{c}_first") + 3 >= F.col("origin"))
    rates = now.groupBy("regime", "origin").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("label").cast("long").alias("positives"), *[F.round(unseen(c) / F.count(F.lit(1)), 8).alias(f"{c}_unseen") for c in WORDS], F.round((unseen("sector") + unseen("agency") + unseen("state")) / (3 * F.count(F.lit(1))), 8).alias("cell_unseen"))
    training = metrics.folds(x, origins(s)).groupBy("regime", "origin").agg(F.count(F.lit(1)).alias("training_rows"))
    return rates.join(training, ["regime", "origin"], "left")


_MISS = lambda c: f"(SELECT count(*) FROM e WHERE e.regime = o.regime AND e.mi = o.origin AND NOT EXISTS (SELECT 1 FROM e t WHERE t.regime = e.regime AND t.mi + 3 < o.origin AND t.{c} = e.{c}))"
UNSEEN = SC + f", {OV}, e AS (SELECT regime, mi, label, " + ", ".join(f"coalesce(nullif({c}, ''), '__MISSING__') AS {c}" for c in WORDS) + f"""  FROM sc),
u AS (SELECT o.regime, o.origin, {", ".join(f"{_MISS(c)} AS {c}" for c in WORDS)}, (SELECT count(*) FROM e WHERE e.regime = o.regime AND mi + 3 < o.origin) AS training_rows FROM o)
SELECT u.regime, u.origin, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS positives, round(any_value(u.sector) / count(*), 8) AS sector_unseen, round(any_value(u.agency) / count(*), 8) AS agency_unseen, round(any_value(u.state) / count(*), 8) AS state_unseen,
  round((any_value(u.sector) + any_value(u.agency) + any_value(u.state)) / (3 * count(*)), 8) AS cell_unseen, nullif(any_value(training_rows), 0) AS training_rows FROM u JOIN e ON e.regime = u.regime AND e.mi = u.origin GROUP BY 1, 2"""


def _logits(s, d):
    return scored(s, d).where("score < 1").withColumn("logit", F.log(F.col("score") / (1 - F.col("score"))))


def _pools(s, d):
    """For each fold (a year) the rows of all earlier folds of its regime."""
    x = _logits(s, d)
    years = x.select("regime", F.col("fold").alias("at")).distinct()
    return x.join(F.broadcast(years), "regime").where(F.col("fold") < F.col("at")).select("regime", F.col("at").alias("fold"), "label", "logit")


def _slopes(s, d):
    return kept(s, d, "fold-slopes", lambda: wf.platt_by_fold(_pools(s, d), "regime", "fold"))


def _fit_sql(rounds: int) -> str:
    """Newton steps for slope a and intercept b of every fold at once, one after another."""
    parts = ["it0 AS (SELECT regime, fold, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM pool GROUP BY 1, 2 HAVING min(label) < max(label))"]
    for k in range(rounds):
        parts.append(f"h{k} AS (SELECT regime, fold, any_value(a) AS a, any_value(b) AS b, sum((p - label) * logit) + 1e-6 * any_value(a) AS ga, sum(p - label) AS gb, sum(p * (1 - p) * logit * logit) + 1e-6 AS aa, sum(p * (1 - p) * logit) AS ab, sum(p * (1 - p)) AS bb FROM (SELECT pool.*, a, b, 1 / (1 + exp(-greatest(-709, least(709, a * logit + b)))) AS p FROM pool JOIN it{k} USING (regime, fold)) GROUP BY 1, 2)")
        parts.append(f"d{k} AS (SELECT *, (bb * ga - ab * gb) / (aa * bb - ab * ab) AS da, (aa * gb - ab * ga) / (aa * bb - ab * ab) AS db FROM h{k})")
        parts.append(f"it{k + 1} AS (SELECT regime, fold, a - da * least(1, 5 / greatest(abs(da), abs(db), 1e-300)) AS a, b - db * least(1, 5 / greatest(abs(da), abs(db), 1e-300)) AS b FROM d{k})")
    return ", ".join(parts)


ROUNDS = 14
POOL = SC + ", lg AS (SELECT *, ln(score / (1 - score)) AS logit FROM sc WHERE score < 1), yr AS (SELECT DISTINCT regime, fold FROM lg), pool AS (SELECT yr.regime, yr.fold, label, logit FROM yr JOIN lg ON lg.regime = yr.regime AND lg.fold < yr.fold), " + _fit_sql(ROUNDS)


def _fitted_calibration(s, d):
    """Raw against operational scores of each fold, the latter by slope and intercept learnt on all earlier folds."""
    x = _logits(s, d).join(F.broadcast(_slopes(s, d)), ["regime", "fold"])  # a row for each fold
    y = x.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-709.0), F.least(F.lit(709.0), F.col("slope") * F.col("logit") + F.col("intercept"))))))
    out = x.groupBy("regime", "fold").agg(F.round(F.max("slope"), 6).alias("slope"), F.round(F.max("intercept"), 6).alias("intercept"))
    for name, df in (("raw", x), ("operational", y)):
        out = out.join(metrics.brier(df, "regime", "fold").select("regime", "fold", F.round("brier", 7).alias(f"{name}_brier")), ["regime", "fold"])
        out = out.join(metrics.calibration_error(df, "regime", "fold").select("regime", "fold", F.round("ece", 7).alias(f"{name}_ece")), ["regime", "fold"])
    return out


CALIBRATED = POOL + f""", c AS (SELECT lg.regime, lg.fold, label, score AS raw, 1 / (1 + exp(-greatest(-709, least(709, a * logit + b)))) AS operational, a, b FROM lg JOIN it{ROUNDS} i ON lg.regime = i.regime AND lg.fold = i.fold),
l AS (SELECT regime, fold, label, a, b, 'raw' AS kind, raw AS score FROM c UNION ALL SELECT regime, fold, label, a, b, 'operational', operational FROM c),
e AS (SELECT regime, fold, kind, round(sum(abs(s - y)) / sum(n), 8) AS ece FROM (SELECT regime, fold, kind, {EDGE} AS bin, sum(score) AS s, sum(label) AS y, count(*) AS n FROM l GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
m AS (SELECT regime, fold, kind, any_value(a) AS a, any_value(b) AS b, round(avg((score - label) ** 2), 8) AS brier FROM l GROUP BY 1, 2, 3)
SELECT r.regime, r.fold, round(r.a, 6) AS slope, round(r.b, 6) AS intercept, round(r.brier, 7) AS raw_brier, round(er.ece, 7) AS raw_ece, round(o.brier, 7) AS operational_brier, round(eo.ece, 7) AS operational_ece
FROM m r JOIN m o ON r.regime = o.regime AND r.fold = o.fold AND r.kind = 'raw' AND o.kind = 'operational' JOIN e er ON er.regime = r.regime AND er.fold = r.fold AND er.kind = 'raw' JOIN e eo ON eo.regime = r.regime AND eo.fold = r.fold AND eo.kind = 'operational'"""


def _three_models(s, d):
    """Scores of three models: revisions so far, distance of progress from full, and the regime's rate."""
    x = with_progress(s, d)
    shortfall = 1 - F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(F.col("physical_progress_t").cast("double"), F.lit(50.0)))) / 100
    models = F.array(F.struct(F.lit("revisions").alias("model"), F.col("score").alias("score")), F.struct(F.lit("shortfall").alias("model"), shortfall.alias("score")), F.struct(F.lit("rate").alias("model"), F.lit(0.5).alias("score")))
    return x.select("project_code", "report_month", "regime", "fold", "label", F.inline(models))


def _compared(s, d):
    """Models by average precision per regime: rank, distance to the reference (revisions), winner, value without the last fold, and its spread over folds."""
    x = _three_models(s, d)
    last = x.groupBy("regime").agg(F.max("fold").alias("last"))
    pooled = metrics.average_precision(x, "regime", "model")
    without = metrics.average_precision(x.join(F.broadcast(last), "regime").where("fold < last"), "regime", "model").withColumnRenamed("average_precision", "without_last")
    folds = metrics.average_precision(x, "regime", "model", "fold").groupBy("regime", "model").agg(F.round(F.avg("average_precision"), 7).alias("fold_mean"), F.round(F.stddev_pop("average_precision"), 7).alias("fold_std"), F.round(F.min("average_precision"), 7).alias("fold_least"), F.round(F.max("average_precision"), 7).alias("fold_most"))
    reference = pooled.where("model = 'revisions'").select("regime", F.col("average_precision").alias("ref"))
    w = Window.partitionBy("regime").orderBy(F.desc("average_precision"), "model")  # three models
    out = pooled.join(reference, "regime").join(without, ["regime", "model"], "left").join(folds, ["regime", "model"]).withColumn("place", F.row_number().over(w).cast("long"))
    return out.select("regime", "model", F.round("average_precision", 7).alias("average_precision"), F.round(F.col("average_precision") - F.col("ref"), 7).alias("delta"), "place", (F.col("place") == 1).alias("winner"), F.round("without_last", 7).alias("without_last"), "fold_mean", "fold_std", "fold_least", "fold_most")


_AP = lambda name, by, where="": f"{name} AS (SELECT {by}, sum(p::DOUBLE / nullif(positives, 0) * (tp::DOUBLE / alerts)) AS v FROM (SELECT *, sum(n) OVER u AS alerts, sum(p) OVER u AS tp, sum(p) OVER (PARTITION BY {by}) AS positives FROM (SELECT {by}, score, count(*) AS n, sum(label) AS p FROM m3 {where} GROUP BY {by}, score) WINDOW u AS (PARTITION BY {by} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) GROUP BY {by})"
_SHORT = "1 - least(100::DOUBLE, greatest(0::DOUBLE, coalesce(CAST(physical_progress AS DOUBLE), 50))) / 100"
COMPARED = SC + f""", pr AS (SELECT project_code, report_month, physical_progress FROM panel),
b3 AS (SELECT regime, fold, label, score AS s1, {_SHORT} AS s2 FROM sc JOIN pr USING (project_code, report_month)),
m3 AS (SELECT regime, fold, label, 'revisions' AS model, s1 AS score FROM b3 UNION ALL SELECT regime, fold, label, 'shortfall', s2 FROM b3 UNION ALL SELECT regime, fold, label, 'rate', 0.5 FROM b3),
{_AP("pool3", "regime, model")}, {_AP("less3", "regime, model", "WHERE fold < (SELECT max(fold) FROM sc WHERE sc.regime = m3.regime)")}, {_AP("fold3", "regime, model, fold")},
s3 AS (SELECT regime, model, round(avg(v), 7) AS fold_mean, round(stddev_pop(v), 7) AS fold_std, round(min(v), 7) AS fold_least, round(max(v), 7) AS fold_most FROM fold3 GROUP BY 1, 2),
r3 AS (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY v DESC, model) AS place FROM pool3)
SELECT regime, model, round(r3.v, 7) AS average_precision, round(r3.v - (SELECT v FROM pool3 q WHERE q.regime = r3.regime AND q.model = 'revisions'), 7) AS delta, place, place = 1 AS winner, round(less3.v, 7) AS without_last, fold_mean, fold_std, fold_least, fold_most
FROM r3 LEFT JOIN less3 USING (regime, model) JOIN s3 USING (regime, model)"""


def _reconciled(s, d):
    """An accepted version of the revision scores against the same model computed anew from the features, without some months, and against another model."""
    path = folder(s, "accepted")
    snapshots.accept(scored(s, d), path, "v1")
    old = snapshots.accepted(s, path, "v1")
    anew = features(s, d).join(old.select(*snapshots.KEY), ["project_code", "report_month", "regime"]).select(*snapshots.KEY, ((1.0 + F.col("n_prior_schedule_extensions")) / (2.0 + F.col("observed_tenure_months"))).alias("score"))
    other = _three_models(s, d).where("model = 'shortfall'")
    checks = {"same": anew, "fewer_months": anew.where("substring(report_month, 6, 2) <> '03'"), "other_model": other}
    out = None
    for name, new in checks.items():
        one = snapshots.reconciled(old, new, 1e-12).select(F.lit(name).alias("candidate"), "regime", "n_rows", "missing", "extra", F.round("most", 9).alias("most"), "status")
        out = one if out is None else out.unionByName(one)
    return out


RECONCILED = SC + f""", pr AS (SELECT project_code, report_month, physical_progress FROM panel), b AS (SELECT regime, report_month, abs(score - ({_SHORT})) AS gap FROM sc JOIN pr USING (project_code, report_month))
SELECT 'same' AS candidate, regime, count(*) AS n_rows, 0::BIGINT AS missing, 0::BIGINT AS extra, 0.0::DOUBLE AS most, 'ACCEPTED' AS status FROM sc GROUP BY 2
UNION ALL SELECT 'fewer_months', regime, count(*) FILTER (WHERE report_month[6:7] <> '03'), count(*) FILTER (WHERE report_month[6:7] = '03'), 0, 0.0, 'KEYS_DIFFER' FROM sc GROUP BY 2
UNION ALL SELECT 'other_model', regime, count(*), 0, 0, round(max(gap), 9), 'SCORES_DIFFER' FROM b GROUP BY 2"""
ENTRIES = [
    ("j19_unseen_rates", _unseen, UNSEEN),
    ("j24_deciles", _deciles, DECILES),
    ("j24_fold_gaps", _fold_gaps, GAPS),
    ("j24_score_summary", _summary, SUMMARY),
    ("j26_model_comparison", _compared, COMPARED),
    ("j30_accepted_versions", _reconciled, RECONCILED),
    ("k03_platt_by_fold", lambda s, d: _slopes(s, d).select("regime", "fold", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept")), POOL + f" SELECT regime, fold, round(a, 6) AS slope, round(b, 6) AS intercept FROM it{ROUNDS}"),
    ("k16_fitted_calibration", _fitted_calibration, CALIBRATED),
]
