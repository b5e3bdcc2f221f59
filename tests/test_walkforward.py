"""Fits of all folds at once against a plain fit of each; replicate vectors against plain draws."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from milepost.operators import bootstrap, models
from milepost.operators import walkforward as wf

FEATURES = ("sector", "agency", "original_cost", "physical_progress_t", "project_age_months")
ORIGINS = [("A", 3), ("A", 6), ("A", 8), ("A", 9), ("A", 40), ("B", 8), ("B", 9)]


def held(df, name):
    return df.persist()


def made(rng, n=900):
    rows = []
    for i in range(n):
        regime, mi = ("A", "B")[i % 3 == 0], rng.randrange(10)
        cost = None if rng.random() < 0.15 else rng.gauss(5e6, 1e6)
        progress = None if regime == "B" else rng.uniform(0, 100)
        sector = rng.choice(["road", "rail", "", None, f"late{mi}"])
        y = int(rng.random() < 1 / (1 + math.exp(-((cost or 5e6) - 5e6) / 1e6 - (sector == "road") + 0.02 * (progress or 50))))
        rows.append((f"p{i}", f"2000-{mi + 1:02d}", regime, mi, 0 if regime == "B" and mi < 5 else y, sector, rng.choice(["x", "y"]), cost, progress, 7.0))
    return rows


SCHEMA = "project_code string, report_month string, regime string, mi int, label int, sector string, agency string, original_cost double, physical_progress_t double, project_age_months double"


def plain_matrix(train, rows):
    cols = []
    for c in range(7, 10):
        v = [r[c] for r in train if r[c] is not None]
        m, s = (np.mean(v), np.std(v) if np.std(v) > 1e-9 * max(1, abs(np.mean(v))) else 1.0) if v else (0.0, 1.0)
        cols.append([0.0 if r[c] is None else (r[c] - m) / s for r in rows])
    for c in (5, 6):
        level = lambda r: r[c] or "__MISSING__"  # noqa: B023, E731
        share = {x: sum(level(r) == x for r in train) / len(train) for x in {level(r) for r in train}}
        v = [share[level(r)] for r in train]
        s = np.std(v) if np.std(v) > 1e-9 else 1.0
        cols.append([(share.get(level(r), 0.0) - np.mean(v)) / s for r in rows])
    cols += [[float(r[c] is None) for r in rows] for c in range(7, 10)]
    return np.array(cols).T


def plain_fit(z, y, weight, keep):
    z = np.concatenate([z[:, keep], np.ones((len(z), 1))], axis=1)
    w, penalty = np.zeros(z.shape[1]), np.append(np.ones(z.shape[1] - 1), 0)
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ w))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.lstsq(h, z.T @ (weight * (p - y)) + penalty * w, rcond=None)[0]
        w = w - step
    return w


@pytest.fixture(scope="module")
def walked(spark):
    rows = made(random.Random(1))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    folds, ready = wf.learnt(df, ORIGINS, held, FEATURES)
    return rows, folds, ready


def test_audit(walked):
    assert [(a["status"], a["reason"]) for a in walked[1].audit] == [("SKIPPED", "NO_TRAINING_ROWS"), ("GENERATED", ""), ("GENERATED", ""), ("GENERATED", ""), ("SKIPPED", "NO_TARGET_ROWS"), ("SKIPPED", "TRAINING_HAS_ONE_CLASS"), ("GENERATED", "")]


@pytest.mark.parametrize("name, features, balanced", [("full", FEATURES, False), ("even", FEATURES, True), ("part", ("sector", "original_cost"), False)])
def test_all_folds_equal_plain_fits(walked, name, features, balanced):
    rows, folds, ready = walked
    fits = wf.fitted(folds, ready, {name: (features, balanced)})
    got = {r["project_code"]: (r["score"], r["logit"]) for r in wf.scores(folds, ready, fits).collect()}
    names = models.columns(FEATURES)
    keep = [names.index(c) for c in models.columns(features)]
    want = {}
    for regime, origin in (ORIGINS[i] for i in (1, 2, 3, 6)):
        train, now = [r for r in rows if r[2] == regime and r[3] + 3 < origin], [r for r in rows if r[2] == regime and r[3] == origin]
        y = np.array([r[4] for r in train])
        weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if balanced else np.ones(len(y))
        w = plain_fit(plain_matrix(train, train), y, weight, sorted(keep))
        for r, e in zip(now, np.c_[plain_matrix(train, now)[:, sorted(keep)], np.ones(len(now))] @ w):
            want[r[0]] = e
    assert set(got) == set(want) and len(want) > 100
    assert all(abs(got[k][1] - want[k]) < 1e-5 for k in want)
    assert all(abs(got[k][0] - 1 / (1 + math.exp(-want[k]))) < 1e-6 for k in want)


def test_fits_that_start_from_some_rows_end_on_all(walked, monkeypatch):
    _, folds, ready = walked
    want, names = wf.fitted(folds, ready, {"full": (FEATURES, False)}), []
    monkeypatch.setattr(wf, "START", 60)
    got = wf.fitted(folds, ready, {"full": (FEATURES, False)}, written=lambda df, name: names.append(name) or df.persist())
    assert names == ["fold-start"] and [f.fold for f in got] == [f.fold for f in want] and all(f.done for f in got)
    assert all(np.abs(a.w - b.w).max() < 1e-6 for a, b in zip(got, want))


def test_rows_for_fits_hold_no_shares(walked):
    """A share for each fold in every row was most of what moved."""
    assert [c for c, kind in walked[2].dtypes if kind.startswith("array")] == ["x"]


def test_folds_are_judged_and_trees_grown_without_fits(spark, monkeypatch):
    from milepost.plans import models as plans

    def none(*args, **kinds):
        raise AssertionError("a fit")

    monkeypatch.setattr(wf, "fitted", none)
    monkeypatch.setattr(wf, "learnt", none)
    assert plans._audit(spark, "/root/testdata/sf0.001", True).count() == len(plans.ORIGINS)
    assert set(plans._last(spark, "/root/testdata/sf0.001")) <= {*plans.ORIGINS}


def test_a_query_fits_only_its_folds(monkeypatch):
    from milepost.plans import models as plans

    asked, folds = [], wf.Folds([("LEGACY", 1), *plans.ORIGINS], (), [], np.zeros(0), np.zeros(0))
    monkeypatch.setattr(plans, "_folds", lambda s, d: (folds, None))
    monkeypatch.setattr(plans, "_walk", lambda s, d, walk={"fits": {}}: walk)
    monkeypatch.setattr(plans, "_audited", lambda s, d: [{"regime": g, "origin": o, "status": "GENERATED"} for g, o in folds.origins])
    monkeypatch.setattr(wf, "fitted", lambda folds, ready, models, at, written: asked.append((*models, at)) or [wf.Fit("x", i, np.zeros(0)) for i in at])
    assert [len(plans._fits(None, "d", "full", scope)) for scope in ("last", "origins", "all")] == [2, len(plans.ORIGINS), len(plans.ORIGINS) + 1]
    assert [len(at) for _, at in asked] == [2, len(plans.ORIGINS) - 2, 1]


def test_contributions_add_up(walked):
    _, folds, ready = walked
    fits = wf.fitted(folds, ready, {"full": (FEATURES, False)}, [2])
    parts = wf.contributions(folds, ready, fits)
    bad = parts.groupBy("project_code", "base", "score").agg(F.sum("contribution").alias("s")).where("abs(1 / (1 + exp(-(base + s))) - score) > 1e-12")
    assert bad.count() == 0 and parts.count() == len(models.columns(FEATURES)) * wf.scores(folds, ready, fits).count()


def test_platt_by_fold(spark):
    rng = random.Random(2)
    pool = [(f, int(rng.random() < 1 / (1 + math.exp(-(a * x + b)))), x) for f, a, b in (("u", 1.3, 0.4), ("v", 0.5, -1.0)) for x in (rng.gauss(0, 2) for _ in range(2000))] + [("w", 1, 0.5)] * 3
    got = {r["fold"]: (r["slope"], r["intercept"]) for r in wf.platt_by_fold(spark.createDataFrame(pool, "fold string, label int, logit double"), "fold").collect()}
    assert set(got) == {"u", "v"}
    for f in got:
        z, y = np.array([[x, 1.0] for g, _, x in pool if g == f]), np.array([t for g, t, _ in pool if g == f])
        w = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-z @ w))
            w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z, z.T @ (p - y))
        assert got[f] == pytest.approx(tuple(w), abs=1e-5)


def plain_metrics(y, s, w):
    order = np.argsort(-s, kind="stable")
    y, s, w = y[order], s[order], w[order]
    n, p, ap, pairs, tp, alerts = w.sum(), (w * y).sum(), 0.0, 0.0, 0.0, 0.0
    for v in dict.fromkeys(s.tolist()):
        at = s == v
        pos, all_of = (w * y)[at].sum(), w[at].sum()
        tp, alerts = tp + pos, alerts + all_of
        ap += pos * tp / alerts if alerts else 0
        pairs += (all_of - pos) * (tp - pos / 2)
    over = w[s >= 0.5].sum()
    hit = (w * y)[s >= 0.5].sum()
    bins = np.minimum(9, np.floor(s * 10)).astype(int)
    ece = sum(abs((w * (s - y))[bins == b].sum()) for b in range(10)) / n
    return {"average_precision": ap / p, "roc_auc": pairs / (p * (n - p)), "precision": hit / over, "recall": hit / p, "f1": 2 * hit / (over + p), "brier": (w * (s - y) ** 2).sum() / n, "mean_score": (w * s).sum() / n, "ece": ece}


@pytest.mark.parametrize("strata", [False, True])
def test_replicates_equal_plain_draws(spark, strata, monkeypatch):
    monkeypatch.setattr(bootstrap, "ROWS", 37)
    rng = random.Random(3)
    rows = [("ab"[i % 2], f"p{i % 70}", f"m{i % 6}", int(rng.random() < 0.4), round(rng.random(), 2)) for i in range(600)]
    df = spark.createDataFrame(rows, "regime string, project_code string, report_month string, label int, score double").repartition(6)
    out = {(r["regime"], r["metric"]): r["drawn"] for r in bootstrap.replicated(df, ["project_code"], ["regime"], held, 20, strata).collect()}
    unit = {r["project_code"]: r["h"] for r in df.select("project_code", F.xxhash64("project_code").alias("h")).distinct().collect()}
    drawn = dict(zip(unit, bootstrap.weights(np.array(list(unit.values()), np.int64), 20)))
    for regime in "ab":
        mine = [r for r in rows if r[0] == regime]
        y, s = np.array([r[3] for r in mine]), np.array([r[4] for r in mine])
        for k in range(21):
            w = np.array([drawn[r[1]][k] for r in mine])
            if strata:
                w = np.where(y == 1, w * y.sum() / (w * y).sum(), w * (1 - y).sum() / (w * (1 - y)).sum())
            for metric, value in plain_metrics(y, s, w).items():
                assert out[regime, metric][k] == pytest.approx(value), (metric, k)


def test_draws_are_poisson():
    w = bootstrap.weights(np.arange(2000, dtype=np.int64), 300)
    assert (w[:, 0] == 1).all() and abs(w[:, 1:].mean() - 1) < 0.01 and abs((w[:, 1:] == 0).mean() - math.exp(-1)) < 0.01 and w.max() >= 5


def test_intervals_and_paired_deltas(spark):
    rng = random.Random(5)
    rows = [(f"p{i % 60}", f"2000-{i // 60 + 1:02d}", "M", y := int(rng.random() < 0.4), min(1.0, max(0.0, round(0.3 + 0.3 * y + rng.gauss(0, 0.2), 2)))) for i in range(300)]
    a = spark.createDataFrame(rows, "project_code string, report_month string, regime string, label int, score double")
    b = a.withColumn("score", F.round(1 - F.col("score"), 2))
    for r in bootstrap.interval(a, ["report_month"], ["regime"], held, 200).collect():
        assert r["ci_lower"] <= r["point"] <= r["ci_upper"]
    out = {r["metric"]: r for r in bootstrap.paired(a, b, ["project_code"], ["regime"], held, 100).collect()}
    assert out["roc_auc"]["delta"] == pytest.approx(2 * out["roc_auc"]["challenger"] - 1) and out["roc_auc"]["significant"]
    assert models.decided(bootstrap.paired(a, a, ["project_code"], ["regime"], held, 20), "regime").first()["decision"] == "INCONCLUSIVE"
    with pytest.raises(ValueError):
        bootstrap.paired(a, b.where("report_month < '2000-05'"), ["project_code"], ["regime"], held, 2)


def test_scored_rows_take_one_pass(spark):
    """Labels, counts so far and progress come from the same sorted rows: nothing is joined."""
    from milepost.plans import metrics
    from milepost.plans.surrogate import panel

    d = "/root/testdata/sf0.001"
    found = metrics._scored(panel(spark, d))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and found.where("physical_progress_t is not null").count() > 0
    assert "physical_progress_t" not in metrics.scored(spark, d).columns


def test_contributors_are_added_up_before_they_meet_records(spark):
    from milepost.plans import sources

    t = {"risk_records": spark.createDataFrame([(1, "p", "m"), (2, "p", "m"), (3, "q", "m")], "record_id long, project_code string, report_month string"), "feature_catalog": spark.createDataFrame([(1, "a"), (2, "b")], "feature_id int, feature string"),
         "contributors": spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.25), (2, 1, 1.0), (3, 2, -1.0), (3, 9, 7.0)], "record_id long, feature_id int, contribution double")}
    out = sources._joined(t)
    assert sorted(map(tuple, out.collect())) == [("p", "m", 3, 1.75), ("q", "m", 1, -1.0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [record_id") == 1
