"""Weighted metrics, bootstraps and Platt scaling against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from milepost.operators import models

SCHEMA = "project_code string, report_month string, regime string, label int, score double"


def made(spark, shift=0.0):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        y = int(rng.random() < 0.4)
        rows.append((f"p{i % 60}", f"2000-{i // 60 + 1:02d}", "M", y, min(1.0, max(0.0, round(0.3 + 0.3 * y + rng.gauss(0, 0.2) + shift, 2)))))
    return spark.createDataFrame(rows, SCHEMA), rows


def metrics(rows):
    """rows: label, score, weight."""
    n, pos = sum(w for *_, w in rows), sum(w for y, _, w in rows if y)
    ap, seen, hits = 0.0, 0.0, 0.0
    for s in sorted({s for _, s, _ in rows}, reverse=True):
        here = [(y, w) for y, t, w in rows if t == s]
        seen, p = seen + sum(w for _, w in here), sum(w for y, w in here if y)
        hits += p
        ap += p / pos * hits / seen
    auc = sum(w * v * (1.0 if s > t else 0.5 if s == t else 0.0) for y, s, w in rows if y for x, t, v in rows if not x) / (pos * (n - pos))
    tp, alerts = sum(w for y, s, w in rows if y and s >= 0.5), sum(w for _, s, w in rows if s >= 0.5)
    ece = sum(abs(sum(w * (s - y) for y, s, w in rows if min(9, math.floor(s * 10)) == b)) for b in range(10)) / n
    return {"average_precision": ap, "roc_auc": auc, "precision": tp / alerts, "recall": tp / pos, "f1": 2 * tp / (alerts + pos), "brier": sum(w * (s - y) ** 2 for y, s, w in rows) / n, "mean_score": sum(w * s for _, s, w in rows) / n, "ece": ece}


def test_weighted_metrics(spark):
    df, rows = made(spark)
    got = models.weighted(df.withColumn("w", F.when(F.col("score") > 0.4, 3.0).otherwise(1.0)), "regime").first()
    want = metrics([(y, s, 3.0 if s > 0.4 else 1.0) for *_, y, s in rows])
    assert {m: got[m] for m in models.METRICS} == pytest.approx(want)


def test_platt_fit(spark):
    _, rows = made(spark)
    x = [(float(y), math.log(s / (1 - s))) for *_, y, s in rows if 0 < s < 1]
    a = b = 0.0
    for _ in range(50):  # Newton steps
        p = [1 / (1 + math.exp(-(a * t + b))) for _, t in x]
        ga, gb = sum((y - q) * t for (y, t), q in zip(x, p)), sum(y - q for (y, _), q in zip(x, p))
        haa, hab, hbb = (sum(q * (1 - q) * k for q, k in zip(p, ks)) for ks in ([t * t for _, t in x], [t for _, t in x], [1.0] * len(x)))
        det = haa * hbb - hab * hab
        a, b = a + (hbb * ga - hab * gb) / det, b + (haa * gb - hab * ga) / det
    got = models.platt(spark.createDataFrame(x, "label double, logit double")).first()
    assert (got["slope"], got["intercept"]) == pytest.approx((a, b), abs=1e-4)
