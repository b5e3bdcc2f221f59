"""Walk-forward folds and metrics (J01-J28), alert policy.

A scored frame has fold columns, label (0 or 1) and score. Curves work on distinct scores: one
aggregation per fold and score, then windows over those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import count_if

# Edges of ten equal bins as a linear space gives them.
EDGES = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]


def folds(rows: DataFrame, origins: DataFrame) -> DataFrame:
    """Training rows of each origin: same regime, label known before the origin (J01). origins: regime, origin."""
    return rows.join(F.broadcast(origins), "regime").where(F.col("mi") + 3 < F.col("origin"))  # a few origins for each regime


def by_score(df: DataFrame, *by: str) -> DataFrame:
    """Rows and positives at each distinct score and above it."""
    g = df.groupBy(*by, "score").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("p"))
    w = Window.partitionBy(*by)
    up = w.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return g.select("*", F.sum("n").over(up).alias("alerts"), F.sum("p").over(up).alias("tp"), F.sum("n").over(w).alias("total"), F.sum("p").over(w).alias("positives"))


def average_precision(df: DataFrame, *by: str) -> DataFrame:
    """Step-wise, ties in one step."""
    s = by_score(df, *by)
    return s.groupBy(*by).agg(F.sum(F.col("p") / F.when(F.col("positives") > 0, F.col("positives")) * (F.col("tp") / F.col("alerts"))).alias("average_precision"))


def roc_auc(df: DataFrame, *by: str) -> DataFrame:
    """Rank sum with average ranks for ties."""
    s = by_score(df, *by).withColumn("rank", F.col("total") - F.col("alerts") + (F.col("n") + 1) / 2)
    g = s.groupBy(*by).agg(F.sum(F.col("p") * F.col("rank")).alias("r"), F.max("positives").alias("p"), F.max("total").alias("t"))
    n = F.col("t") - F.col("p")
    return g.select(*by, ((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.when(F.col("p") * n > 0, F.col("p") * n)).alias("roc_auc"))


def confusion(pred: Column, label: Column | None = None) -> list[Column]:
    y = F.col("label") if label is None else label
    return [count_if(pred & (y == 1)).alias("tp"), count_if(pred & (y == 0)).alias("fp"), count_if(~pred & (y == 1)).alias("fn"), count_if(~pred & (y == 0)).alias("tn")]


def with_rates(df: DataFrame) -> DataFrame:
    """Precision, recall and F1; without alerts precision and F1 are 0 if there are positives, else null."""
    tp, alerts, positives = F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
    none = F.when(positives > 0, F.lit(0.0))
    precision = F.when(alerts > 0, tp / F.when(alerts > 0, alerts)).otherwise(none)
    recall = tp / F.when(positives > 0, positives)
    return df.withColumn("precision", F.round(precision, 6)).withColumn("recall", F.round(recall, 6)).withColumn("f1", F.round(F.when(2 * tp + F.col("fp") + F.col("fn") > 0, 2 * tp / F.when(2 * tp + F.col("fp") + F.col("fn") > 0, 2 * tp + F.col("fp") + F.col("fn"))), 6))


def brier(df: DataFrame, *by: str) -> DataFrame:
    d = F.col("score") - F.col("label")
    return df.groupBy(*by).agg(F.round(F.avg(d * d), 8).alias("brier"), F.round(F.avg("score"), 8).alias("mean_score"), F.count(F.lit(1)).alias("n_rows"), F.sum("label").cast("long").alias("positives"))


def bin_of(score: Column) -> Column:
    out = F.lit(9)
    for i in range(8, -1, -1):
        out = F.when(score < EDGES[i + 1], F.lit(i)).otherwise(out)
    return out


def reliability(df: DataFrame, *by: str) -> DataFrame:
    """Rows, mean score and observed rate per bin."""
    return df.groupBy(*by, bin_of(F.col("score")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 8).alias("mean_score"), F.round(F.avg("label"), 8).alias("observed_rate"))


def calibration_error(df: DataFrame, *by: str) -> DataFrame:
    """Weighted distance of score and rate over bins."""
    g = df.groupBy(*by, bin_of(F.col("score")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.sum("label").alias("y"))
    return g.groupBy(*by).agg(F.round(F.sum(F.abs(F.col("s") - F.col("y"))) / F.sum("n"), 8).alias("ece"))


def recall_threshold(df: DataFrame, floor: float, *by: str) -> DataFrame:
    """The highest score whose alerts reach the recall floor."""
    return by_score(df, *by).where(F.col("tp") >= floor * F.col("positives")).where("positives > 0").groupBy(*by).agg(F.max("score").alias("threshold"))


def precision_threshold(df: DataFrame, floor: float, *by: str) -> DataFrame:
    """The lowest score whose alerts keep the precision floor."""
    return by_score(df, *by).where(F.col("tp") >= floor * F.col("alerts")).groupBy(*by).agg(F.min("score").alias("threshold"))


def ranked(df: DataFrame, *by: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "project_code")))


def top_k(df: DataFrame, ks: list[int], *by: str) -> DataFrame:
    """Precision and recall of the k highest; k is cut to the rows there are."""
    r = ranked(df, *by).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy(*by))).withColumn("positives", F.sum("label").over(Window.partitionBy(*by)))
    long = r.select("*", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).where("rank <= k")
    return long.groupBy(*by, "k").agg(F.least(F.col("k"), F.max("total")).cast("long").alias("applied_k"), F.round(F.sum("label") / F.count(F.lit(1)), 6).alias("precision"), F.round(F.sum("label") / F.max(F.when(F.col("positives") > 0, F.col("positives"))), 6).alias("recall"))


def capped(df: DataFrame, threshold: float, caps: list[float], *by: str) -> DataFrame:
    """Alerts over a threshold under a cap on their share, and what the cap suppresses."""
    r = ranked(df, *by).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    long = r.select("*", F.explode(F.array(*[F.lit(c) for c in caps])).alias("cap")).withColumn("room", F.floor(F.col("cap") * F.col("total")))
    over = F.col("score") >= threshold
    return long.groupBy(*by, "cap").agg(count_if(over).alias("wanted"), count_if(over & (F.col("rank") <= F.col("room"))).alias("alerts"), count_if(over & (F.col("rank") > F.col("room"))).alias("suppressed"), count_if(over & (F.col("rank") <= F.col("room")) & (F.col("label") == 1)).alias("tp"))


def recall_anchors(df: DataFrame, anchors: list[float], *by: str) -> DataFrame:
    """Precision at the lowest recall that is at least the anchor."""
    s = by_score(df, *by).where("positives > 0").withColumn("recall", F.col("tp") / F.col("positives")).withColumn("precision", F.col("tp") / F.col("alerts"))
    long = s.select("*", F.explode(F.array(*[F.lit(a) for a in anchors])).alias("anchor")).where("recall >= anchor")
    return long.groupBy(*by, "anchor").agg(F.round(F.min_by("precision", F.struct("recall", (-F.col("score")).alias("s"))), 6).alias("precision"), F.round(F.min("recall"), 6).alias("recall"))


def frequency_encoded(train: DataFrame, rows: DataFrame, field: str, *by: str) -> DataFrame:
    """Share of the field's value among the fold's training rows; unseen 0, missing a value of its own."""
    value = F.coalesce(F.nullif(F.col(field), F.lit("")), F.lit("__MISSING__"))
    seen = train.groupBy(*by, value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    seen = seen.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by))).drop("n")
    return rows.withColumn("value", value).join(seen, [*by, "value"], "left").withColumn("encoded", F.coalesce("share", F.lit(0.0))).drop("share")


def total_variation(df: DataFrame, field: str) -> DataFrame:
    """Half the summed distance of category shares of each month and the month before it."""
    g = df.groupBy("mi", F.coalesce(F.col(field), F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("mi"))).select("mi", "value", "share")
    months = df.select("mi").distinct()
    both = months.alias("x").join(months.alias("y"), F.col("x.mi") == F.col("y.mi") + 1).select(F.col("x.mi").alias("mi"))
    a, b = g.withColumnRenamed("share", "s"), g.select((F.col("mi") + 1).alias("mi"), "value", F.col("share").alias("t"))
    m = a.join(b, ["mi", "value"], "full").join(both, "mi", "left_semi")
    return m.groupBy("mi").agg(F.round(F.sum(F.abs(F.coalesce("s", F.lit(0.0)) - F.coalesce("t", F.lit(0.0)))) / 2, 8).alias("distance"))
