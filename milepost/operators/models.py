"""Features, boosted trees, weighted metrics and comparisons of the walk-forward evaluation.

Logistic fits of all folds are in `walkforward`, bootstraps in `bootstrap`. Boosted trees are fitted fold by fold."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CATEGORICAL = ("sector", "agency", "state")
# The features' names and families.
STATIC = (
    "original_cost", "cumulative_expenditure_t", "revised_cost_t", "physical_progress_t", "project_age_months", "months_to_original_schedule", "months_to_effective_schedule", "schedule_revision_lag_months", "schedule_has_been_revised", "months_since_start",
    "expenditure_to_original_cost_ratio", "revised_to_original_cost_ratio", "cost_has_been_revised", "state_is_missing", "approval_date_is_missing", "original_completion_date_is_missing", "revised_cost_is_present", "revised_date_is_present",
    "physical_progress_is_present", "physical_progress_supported", "start_date_is_present", "start_date_supported",
)
TRAJECTORY = (
    "exp_delta_1m", "exp_delta_3m", "past_exp_stagnant_3m", "past_progress_delta_3m", "past_progress_stagnant_3m", "n_prior_schedule_extensions", "n_prior_cost_revisions", "observed_tenure_months", "exp_delta_1m_is_supported", "exp_delta_3m_is_supported",
    "progress_delta_3m_is_supported",
)
FAMILIES = {"static_at_t": (*CATEGORICAL, *STATIC), "trajectory_only": TRAJECTORY, "full_v1": (*CATEGORICAL, *STATIC, *TRAJECTORY), "numeric_only_full_v1": (*STATIC, *TRAJECTORY)}
ALL = FAMILIES["full_v1"]
HORIZON = 3
#: Replicates of a bootstrap.
REPLICATES = 1_000


def training(rows: DataFrame, regime: str, origin: int) -> DataFrame:
    """Labelled rows of the regime whose label window ends before the origin."""
    return rows.where((F.col("regime") == regime) & (F.col("mi") + HORIZON < origin))


def evaluation(rows: DataFrame, regime: str, origin: int) -> DataFrame:
    return rows.where((F.col("regime") == regime) & (F.col("mi") == origin))


def columns(features: tuple[str, ...]) -> list[str]:
    """Names of the matrix columns, in order."""
    numeric = [c for c in features if c not in CATEGORICAL]
    return [*(f"{c}_z" for c in numeric), *(f"{c}_share_z" for c in features if c in CATEGORICAL), *(f"{c}_n" for c in numeric)]


def boosted(train: DataFrame, rows: DataFrame, trees: int = 300, depth: int = 5, features: tuple[str, ...] = ALL) -> DataFrame:
    """rows with score, from gradient-boosted trees; categories by index, unseen ones a level of their own; missing numbers are a value
    far from all others (J09)."""
    numeric, words = [c for c in features if c not in CATEGORICAL], [c for c in features if c in CATEGORICAL]
    ready = lambda df: df.select(*[c for c in df.columns if c not in features], *[F.coalesce(F.col(c).cast("double"), F.lit(-1e6)).alias(c) for c in numeric], *[F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("__MISSING__")).alias(c) for c in words])
    steps = [*[StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep") for c in words], VectorAssembler(inputCols=[*numeric, *[f"{c}_i" for c in words]], outputCol="features"), GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=512, seed=42)]
    return Pipeline(stages=steps).fit(ready(train)).transform(ready(rows)).withColumn("score", vector_to_array("probability")[1])


def skipped(train: DataFrame, rows: DataFrame) -> list[str]:
    """Why a fold can't be fitted."""
    classes = {r[0] for r in train.select("label").distinct().collect()}
    return [*(["NO_TARGET_ROWS"] if rows.isEmpty() else []), *(["NO_TRAINING_ROWS"] if not classes else []), *(["TRAINING_HAS_ONE_CLASS"] if len(classes) == 1 else [])]


def walked(rows: DataFrame, origins: list[tuple[str, int]], score) -> DataFrame:
    """Scores of every origin that can be fitted (none: no rows); score(train, now) gives rows with score, 0 to 1."""
    out = rows.where("false").select("project_code", "report_month", "regime", "mi", "label", F.lit(None).cast("double").alias("score"))
    for regime, origin in origins:
        train, now = training(rows, regime, origin), evaluation(rows, regime, origin)
        if not skipped(train, now):
            out = out.unionByName(score(train, now).select("project_code", "report_month", "regime", "mi", "label", "score"))
    return out


def importance(found: DataFrame) -> DataFrame:
    """Mean, deviation and extremes of each feature over folds, ranked."""
    g = found.groupBy("regime", "feature").agg(F.count(F.lit(1)).alias("folds"), F.avg("importance").alias("mean"), F.stddev_pop("importance").alias("std"), F.min("importance").alias("least"), F.max("importance").alias("most"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("regime").orderBy(F.desc("mean"), "feature")).cast("long"))


def platt(df: DataFrame, strength: float = 1e6) -> DataFrame:
    """Slope and intercept of the label on the raw logit with C = strength."""
    x = VectorAssembler(inputCols=["logit"], outputCol="features").transform(df)
    m = LogisticRegression(regParam=1.0 / (strength * df.count()), standardization=False, maxIter=200, tol=1e-10).fit(x)
    return df.sparkSession.createDataFrame([(float(m.coefficients[0]), float(m.intercept))], "slope double, intercept double")


METRICS = ("average_precision", "roc_auc", "precision", "recall", "f1", "brier", "mean_score", "ece")


def weighted(df: DataFrame, *by: str) -> DataFrame:
    """METRICS of rows with label, score and weight w per group; alerts are scores of 0.5 or more."""
    y, p, w = F.col("label"), F.col("score"), F.col("w")
    alert = p >= 0.5
    bins = F.least(F.floor(p * 10), F.lit(9))
    g = df.withColumn("_bin", bins).groupBy(*by, "score", "_bin").agg(F.sum(w).alias("n"), F.sum(w * y).alias("pos"))
    up = Window.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    curve = g.withColumn("alerts", F.sum("n").over(up)).withColumn("tp", F.sum("pos").over(up))
    some = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0.0))
    hit = lambda cond: F.sum(F.when(cond, F.col("pos")).otherwise(0.0))
    at = p >= 0.5
    gaps = [F.abs(F.sum(F.when(F.col("_bin") == i, F.col("n") * p - F.col("pos")).otherwise(0.0))) for i in range(10)]
    s = curve.groupBy(*by).agg(F.sum("n").alias("N"), F.sum("pos").alias("P"), F.sum(F.col("pos") * F.col("tp") / F.col("alerts")).alias("ap"), F.sum((F.col("n") - F.col("pos")) * (F.col("tp") - F.col("pos") / 2)).alias("u"), some(at).alias("alerts"), hit(at).alias("tp"),
                               F.sum(F.col("pos") * (1 - p) * (1 - p) + (F.col("n") - F.col("pos")) * p * p).alias("b"), F.sum(F.col("n") * p).alias("m"), sum(gaps[1:], gaps[0]).alias("gap"))
    over = lambda a, b: a / F.when(b > 0, b)
    none = F.when(F.col("P") > 0, F.lit(0.0))
    return s.select(*by, over(F.col("ap"), F.col("P")).alias("average_precision"), over(F.col("u"), F.col("P") * (F.col("N") - F.col("P"))).alias("roc_auc"), F.when(F.col("alerts") > 0, over(F.col("tp"), F.col("alerts"))).otherwise(none).alias("precision"), over(F.col("tp"), F.col("P")).alias("recall"),
                    over(2 * F.col("tp"), F.col("alerts") + F.col("P")).alias("f1"), (F.col("b") / F.col("N")).alias("brier"), (F.col("m") / F.col("N")).alias("mean_score"), (F.col("gap") / F.col("N")).alias("ece"))


def decided(deltas: DataFrame, *by: str) -> DataFrame:
    """Prefer the challenger if the interval of average precision excludes 0 and the delta is positive."""
    d = deltas.where("metric = 'average_precision'")
    return d.select(*by, "delta", "significant", F.when(F.col("significant") & (F.col("delta") > 0), "PREFER_CHALLENGER").when(F.col("significant"), "KEEP_REFERENCE").otherwise("INCONCLUSIVE").alias("decision"))


def weighting_effect(plain: DataFrame, balanced: DataFrame, *by: str) -> DataFrame:
    """What weighing classes evenly changes, and how far mean scores are from the observed rate."""
    one = lambda df, k: weighted(df.withColumn("w", F.lit(1.0)), *by).join(df.groupBy(*by).agg(F.avg("label").alias("rate")), list(by)).select(*by, *[F.col(m).alias(f"{k}_{m}") for m in ("average_precision", "roc_auc", "brier", "ece")], F.abs(F.col("mean_score") - F.col("rate")).alias(f"{k}_gap"))
    both = one(plain, "plain").join(one(balanced, "balanced"), list(by))
    return both.select("*", *[(F.col(f"balanced_{m}") - F.col(f"plain_{m}")).alias(f"{m}_change") for m in ("average_precision", "roc_auc", "brier", "ece", "gap")])
