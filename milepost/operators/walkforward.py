"""Logistic fits of every fold at once.

A fold is a regime and an origin month; it trains on the regime's labelled rows whose label window ends before the origin and scores the
rows of that month. Encoders of all folds come from one aggregation by month (counts, means and squared deviations merged over
months, category counts cumulated), and a step of all fits is one aggregation: tasks return each fit's loss, gradient and, where it
is asked for, Hessian over their rows, Spark adds them up per fit, the driver solves one small system a fit. So the number of jobs is that of
steps, whatever the number of folds, and the driver holds a few numbers for each fold and pair of features, and for each fold and category level.

Tasks encode a row once for all folds of its regime (centred numbers, what is missing, shares of its levels); what a fold has of its own is linear in
that, so sums are turned into a fold's columns on the driver. A Hessian is used again as long as steps shrink fast. Many rows
start from the optimum of some of them; every fit ends on the loss and gradient of all its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import ALL, CATEGORICAL, HORIZON, columns

STEPS, TOLERANCE = 60, 1e-7
#: About so many rows give the starting point of fits.
START = 200_000
#: A Hessian serves again if what is left to gain has shrunk to this share.
SHRUNK = 0.01
Written = Callable[[DataFrame, str], DataFrame]


@dataclass
class Fit:
    """One model of a fold: its matrix columns, class weights, and what has been learnt."""

    name: str
    fold: int
    at: np.ndarray
    weights: tuple[float, float] = (1.0, 1.0)
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))
    before: np.ndarray | None = None
    loss: float = np.inf
    done: bool = False
    gain: float = np.inf
    hessian: np.ndarray | None = None


@dataclass
class Folds:
    """Origins, who trains them, and the encoders of each; columns in the order of `columns`. shares: of a regime and category the share of
    each level (by its number) in each fold of the regime."""

    origins: list[tuple[str, int]]
    features: tuple[str, ...]
    audit: list[dict]
    mean: np.ndarray
    scale: np.ndarray
    shares: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    @property
    def numeric(self) -> list[str]:
        return [c for c in self.features if c not in CATEGORICAL]

    @property
    def words(self) -> list[str]:
        return [c for c in self.features if c in CATEGORICAL]


def _merged(parts: list[tuple[float, float, float]]) -> tuple[float, float, float]:
    """Count, mean and squared deviations of several sets together."""
    n, mean, m2 = 0.0, 0.0, 0.0
    for k, m, s in parts:
        if k:
            d = m - mean
            n, mean, m2 = n + k, mean + d * k / (n + k), m2 + s + d * d * n * k / (n + k)
    return n, mean, m2


def _level(c: str):
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("__MISSING__"))


def counted(rows: DataFrame) -> list[dict]:
    """Labelled rows and positives of each regime and month."""
    return [r.asDict() for r in rows.groupBy("regime", "mi").agg(F.count(F.lit(1)).alias("_rows"), F.sum("label").cast("long").alias("_positives")).collect()]  # a row for each month


def audited(monthly: list, origins: list[tuple[str, int]]) -> list[dict]:
    """Which folds can be fitted, and on what. monthly: regime, mi, _rows, _positives."""
    audit = []
    for regime, origin in origins:
        months = [r for r in monthly if r["regime"] == regime and r["mi"] + HORIZON < origin]
        now = [r for r in monthly if r["regime"] == regime and r["mi"] == origin]
        n, positives = sum(r["_rows"] for r in months), sum(r["_positives"] for r in months)
        reasons = [*(["NO_TARGET_ROWS"] if not now else []), *(["NO_TRAINING_ROWS"] if not n else []), *(["TRAINING_HAS_ONE_CLASS"] if n and positives in (0, n) else [])]
        audit.append({"regime": regime, "origin": origin, "status": "SKIPPED" if reasons else "GENERATED", "reason": "|".join(reasons), "target_rows": sum(r["_rows"] for r in now), "rows": n, "positives": positives,
                      "first": min((r["mi"] for r in months), default=None), "last": max((r["mi"] for r in months), default=None)})
    return audit


def learnt(rows: DataFrame, origins: list[tuple[str, int]], written: Written, features: tuple[str, ...] = ALL) -> tuple[Folds, DataFrame]:
    """The encoders of all folds, and the rows ready for fits: keys, label, x (numbers, null if missing), and the number of each category's
    level. rows is read several times. written: writes a table that is read several times, and reads it."""
    folds = Folds(origins, features, [], np.zeros(0), np.zeros(0))
    numeric, words = folds.numeric, folds.words
    one = lambda c: F.struct(F.count(c).alias("n"), F.coalesce(F.avg(c), F.lit(0.0)).cast("double").alias("mean"), F.coalesce(F.var_pop(c), F.lit(0.0)).cast("double").alias("var")).alias(c)
    monthly = rows.groupBy("regime", "mi").agg(F.count(F.lit(1)).alias("_rows"), F.sum("label").cast("long").alias("_positives"), *map(one, numeric)).collect()  # a row for each month
    folds.audit = audited(monthly, origins)
    counts = rows.select("regime", "mi", F.inline(F.array(*[F.struct(F.lit(c).alias("field"), _level(c).alias("level")) for c in words]))).groupBy("regime", "field", "level", "mi").agg(F.count(F.lit(1)).alias("n"))
    levels = counts.groupBy("regime", "field", "level").agg(F.collect_list(F.struct("mi", "n")).alias("by_month")).orderBy("regime", "field", "level").collect()  # a row for each level of the categories
    mean, scale = np.zeros((len(origins), len(features))), np.ones((len(origins), len(features)))
    for i, (regime, origin) in enumerate(origins):
        months = [r for r in monthly if r["regime"] == regime and r["mi"] + HORIZON < origin]
        for j, c in enumerate(numeric):
            k, m, m2 = _merged([(r[c]["n"], r[c]["mean"], r[c]["var"] * r[c]["n"]) for r in sorted(months, key=lambda r: r["mi"])])
            mean[i, j] = m
            scale[i, j] = np.sqrt(m2 / k) if k and m2 > 1e-12 * k * max(m * m, 1e-12) else 1.0
    numbers: dict[str, list[tuple]] = {c: [] for c in words}
    for regime in sorted({g for g, _ in origins}):
        mine = [i for i, (g, _) in enumerate(origins) if g == regime]
        for j, c in enumerate(words, len(numeric)):
            of = [r for r in levels if r["regime"] == regime and r["field"] == c]
            numbers[c] += [(regime, r["level"], k) for k, r in enumerate(of)]
            seen = np.array([[float(sum(x["n"] for x in r["by_month"] if x["mi"] + HORIZON < origins[i][1])) for i in mine] for r in of]).reshape(len(of), len(mine))
            folds.shares[regime, c] = seen / np.array([max(1, folds.audit[i]["rows"]) for i in mine])
            for place, i in enumerate(mine):
                n = seen[:, place].sum()
                if n:
                    m, square = (seen[:, place] ** 2).sum() / n**2, (seen[:, place] ** 3).sum() / n**3
                    mean[i, j] = m
                    scale[i, j] = np.sqrt(square - m * m) if square - m * m > 1e-12 * square else 1.0
    folds.mean, folds.scale = mean, scale
    ready = rows.select("project_code", "report_month", "regime", "mi", F.col("label").cast("int").alias("label"), F.array(*[F.col(c).cast("double") for c in numeric]).alias("x"), *[_level(c).alias(f"_{c}") for c in words])
    for c in words:
        ready = ready.join(F.broadcast(rows.sparkSession.createDataFrame(numbers[c], f"regime string, _{c} string, {c}_level int")), ["regime", f"_{c}"])
    return folds, ready.drop(*[f"_{c}" for c in words])


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _matrix(batch: pa.RecordBatch, folds: Folds, fold: int, place: int, rows: np.ndarray) -> np.ndarray:
    """The matrix columns of some rows as a fold encodes them, and ones."""
    x = _numbers(batch)[rows]
    n = x.shape[1]
    z = np.empty((len(rows), 2 * n + len(folds.words) + 1))
    missing = np.isnan(x)
    z[:, :n] = np.where(missing, 0.0, (x - folds.mean[fold, :n]) / folds.scale[fold, :n])
    for j, c in enumerate(folds.words):
        share = folds.shares[folds.origins[fold][0], c][batch.column(f"{c}_level").to_numpy()[rows], place]
        z[:, n + j] = (share - folds.mean[fold, n + j]) / folds.scale[fold, n + j]
    z[:, n + len(folds.words) : -1] = missing
    z[:, -1] = 1.0
    return z


def _centre(folds: Folds, regime: str) -> tuple[np.ndarray, np.ndarray]:
    """What tasks subtract from the numbers of a regime, and what they divide by: as its last fold does."""
    last = max((o, i) for i, (g, o) in enumerate(folds.origins) if g == regime)[1]
    n = len(folds.numeric)
    return folds.mean[last, :n], folds.scale[last, :n]


def _turn(folds: Folds, fold: int) -> np.ndarray:
    """A fold's matrix columns and ones from the columns of a task: centred numbers, what is missing, ones, shares."""
    n, q = len(folds.numeric), len(folds.words)
    centre, size = _centre(folds, folds.origins[fold][0])
    mean, scale = folds.mean[fold], folds.scale[fold]
    a, j, i = np.zeros((2 * n + q + 1, 2 * n + 1 + q)), np.arange(n), np.arange(q)
    a[j, j], a[j, n + j], a[j, 2 * n] = size / scale[:n], (mean[:n] - centre) / scale[:n], (centre - mean[:n]) / scale[:n]
    a[n + i, 2 * n + 1 + i], a[n + i, 2 * n] = 1 / scale[n:], -mean[n:] / scale[n:]
    a[n + q + j, n + j] = 1.0
    a[-1, 2 * n] = 1.0
    return a


def _places(folds: Folds) -> list[int]:
    """The number of each fold among those of its regime."""
    return [sum(g == regime for g, _ in folds.origins[:i]) for i, (regime, _) in enumerate(folds.origins)]


def _summed(batches: Iterator[pa.RecordBatch], folds: Folds, fits: list[Fit]) -> Iterator[pa.RecordBatch]:
    """Of every open fit loss, gradient and, if it has none, Hessian (upper half) over the task's rows, in the columns that all folds share."""
    place, total = _places(folds), {}
    groups = []
    for regime in sorted({folds.origins[f.fold][0] for f in fits if not f.done}):
        here = [k for k, f in enumerate(fits) if not f.done and folds.origins[f.fold][0] == regime]
        v = np.stack([_turn(folds, fits[k].fold)[fits[k].at].T @ fits[k].w for k in here], axis=1)
        groups.append((regime, here, v, np.array([place[fits[k].fold] for k in here]), np.array([folds.origins[fits[k].fold][1] for k in here]), np.array([fits[k].weights for k in here]).T, _centre(folds, regime)))
    for batch in batches:
        if not batch.num_rows:
            continue
        of = batch.column("regime").dictionary_encode()
        codes, known = of.indices.to_numpy(), of.dictionary.to_pylist()
        mi, label, numbers = batch.column("mi").to_numpy(), batch.column("label").to_numpy(), _numbers(batch)
        for regime, here, v, at, origins, weights, (centre, size) in groups:
            rows = np.flatnonzero((codes == known.index(regime)) & (mi + HORIZON < origins.max())) if regime in known else []
            if not len(rows):
                continue
            x, t, n = numbers[rows], label[rows][:, None], numbers.shape[1]
            u = np.empty((len(rows), 2 * n + 1))
            missing = np.isnan(x)
            u[:, :n] = np.where(missing, 0.0, (x - centre) / size)
            u[:, n : 2 * n], u[:, 2 * n] = missing, 1.0
            shares = [folds.shares[regime, c][:, at][batch.column(f"{c}_level").to_numpy()[rows]] for c in folds.words]
            e = u @ v[: 2 * n + 1] + sum(s * v[2 * n + 1 + j] for j, s in enumerate(shares))
            weight = np.where(t == 1, weights[1], weights[0]) * (mi[rows][:, None] + HORIZON < origins)
            p = 1 / (1 + np.exp(-np.clip(e, -709, 709)))
            loss, r = (weight * (np.logaddexp(0, e) - t * e)).sum(axis=0), weight * (p - t)
            gradient = np.concatenate([u.T @ r, *[(s * r).sum(axis=0)[None] for s in shares]])
            for i, k in enumerate(here):
                one = np.concatenate([[loss[i]], gradient[:, i]])
                if fits[k].hessian is None:  # in the fold's own columns: near-constant ones lose digits in those that folds share
                    mine = np.flatnonzero(weight[:, i])
                    z = _matrix(batch, folds, fits[k].fold, at[i], rows[mine])[:, fits[k].at]
                    own, y, c = z @ fits[k].w, t[mine, 0], weight[mine, i]
                    p1 = 1 / (1 + np.exp(-np.clip(own, -709, 709)))
                    h = (z * (c * p1 * (1 - p1))[:, None]).T @ z
                    one = np.concatenate([[(c * (np.logaddexp(0, own) - y * own)).sum()], z.T @ (c * (p1 - y)), h[np.triu_indices(len(h))]])
                total[k] = total[k] + one if k in total else one
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["fit", "sums"])


def _added(key: tuple, table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x) for x in table["sums"].to_pylist()]
    return pa.table({"fit": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([np.sum(parts, axis=0).tobytes()], pa.binary())})


def fitted(folds: Folds, ready: DataFrame, models: dict[str, tuple[tuple[str, ...], bool]], at: list[int] | None = None, strength: float = 1.0, written: Written | None = None) -> list[Fit]:
    """L2 logistic regressions with C = strength of every model in every fold (or those in at) that can be fitted. models: name to its
    features and whether classes are weighed evenly. The intercept is not penalised. written: writes the rows that give the start."""
    names = columns(folds.features)
    fits = []
    for name, (features, balanced) in models.items():
        mine = {*columns(features)}
        taken = np.array([*(i for i, c in enumerate(names) if c in mine), len(names)])
        for i, a in enumerate(folds.audit):
            if a["status"] == "GENERATED" and (at is None or i in at):
                even = (a["rows"] / (2 * (a["rows"] - a["positives"])), a["rows"] / (2 * a["positives"]))
                fits.append(Fit(name, i, taken, even if balanced else (1.0, 1.0), np.zeros(len(taken))))
    parts = ceil(max((a["rows"] for a in folds.audit), default=0) / START)
    if written and parts > 1:
        some = written(ready.where(F.pmod(F.xxhash64("project_code", "report_month"), F.lit(parts)) == 0), "fold-start")
        _stepped(folds, some, fits, strength * parts)
        for f in fits:  # no worse than without any weights
            a = folds.audit[f.fold]
            f.done, f.loss, f.gain, f.before, f.hessian = False, float(np.log(2) * (f.weights[0] * (a["rows"] - a["positives"]) + f.weights[1] * a["positives"])), np.inf, np.zeros(len(f.w)), None
    _stepped(folds, ready, fits, strength)
    return fits


def _stepped(folds: Folds, rows: DataFrame, fits: list[Fit], strength: float) -> None:
    """Newton steps of all fits until nothing is to gain, or at most STEPS."""
    for _ in range(STEPS):
        if all(f.done for f in fits):
            break
        sums = rows.mapInArrow(lambda b: _summed(b, folds, fits), "fit int, sums binary").groupBy("fit").applyInArrow(_added, "fit int, sums binary").collect()  # a row for each fit
        if not sums:
            break
        for r in sums:
            fit, v = fits[r["fit"]], np.frombuffer(r["sums"])
            turn = _turn(folds, fit.fold)[fit.at]
            n, m = turn.shape
            penalty = np.append(np.ones(n - 1), 0.0) / strength
            fresh = fit.hessian is None
            loss, g = v[0] + 0.5 * (penalty * fit.w**2).sum(), (v[1 : n + 1] if fresh else turn @ v[1 : m + 1]) + penalty * fit.w
            if loss > fit.loss + 1e-9 * abs(fit.loss):  # too far: half the way back
                fit.w, fit.hessian = (fit.w + fit.before) / 2, None
                continue
            if fresh:
                upper = np.zeros((n, n))
                upper[np.triu_indices(n)] = v[n + 1 :]
                fit.hessian = upper + np.triu(upper, 1).T + np.diag(penalty)
            step = np.linalg.lstsq(fit.hessian, g, rcond=None)[0]
            gain = float(g @ step)
            little = gain < TOLERANCE**2 * max(1.0, abs(loss))
            fit.done = bool(fresh and little)  # the last step is Newton's own: near-constant columns ask for all its digits
            if little or gain > SHRUNK * fit.gain:  # the next step gets a Hessian of its own
                fit.hessian = None
            fit.gain, fit.loss, fit.before, fit.w = gain, loss, fit.w, fit.w - step


def scores(folds: Folds, ready: DataFrame, fits: list[Fit]) -> DataFrame:
    """Scores of each fit's target month: model, keys, regime, mi, label, logit, score."""
    place = _places(folds)
    schema = "model string, project_code string, report_month string, regime string, mi int, label int, logit double, score double"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regime, mi = np.array(batch.column("regime").to_pylist(), object), batch.column("mi").to_numpy()
            for fit in fits:
                rows = np.flatnonzero((regime == folds.origins[fit.fold][0]) & (mi == folds.origins[fit.fold][1]))
                if len(rows):
                    e = _matrix(batch, folds, fit.fold, place[fit.fold], rows)[:, fit.at] @ fit.w
                    of = [batch.column(c).take(pa.array(rows)) for c in ("project_code", "report_month", "regime", "mi", "label")]
                    yield pa.RecordBatch.from_arrays([pa.array([fit.name] * len(rows)), *of[:3], of[3].cast(pa.int32()), of[4].cast(pa.int32()), pa.array(e), pa.array(1 / (1 + np.exp(-np.clip(e, -709, 709))))], names=["model", "project_code", "report_month", "regime", "mi", "label", "logit", "score"])

    months = F.concat_ws("|", "regime", "mi").isin(*{f"{folds.origins[f.fold][0]}|{folds.origins[f.fold][1]}" for f in fits})
    return ready.where(months).mapInArrow(scored, schema)


def contributions(folds: Folds, ready: DataFrame, fits: list[Fit]) -> DataFrame:
    """Coefficient times transformed value of each matrix column of each fit's target rows, in long form."""
    place, names = _places(folds), columns(folds.features)
    schema = "project_code string, report_month string, regime string, base double, score double, parts array<double>"

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regime, mi = np.array(batch.column("regime").to_pylist(), object), batch.column("mi").to_numpy()
            for fit in fits:
                rows = np.flatnonzero((regime == folds.origins[fit.fold][0]) & (mi == folds.origins[fit.fold][1]))
                if len(rows):
                    z = _matrix(batch, folds, fit.fold, place[fit.fold], rows)
                    w = np.zeros(len(names) + 1)
                    w[fit.at] = fit.w
                    own = z[:, :-1] * w[:-1]
                    e = own.sum(axis=1) + w[-1]
                    of = [batch.column(c).take(pa.array(rows)) for c in ("project_code", "report_month", "regime")]
                    yield pa.RecordBatch.from_arrays([*of, pa.array(np.full(len(rows), w[-1])), pa.array(1 / (1 + np.exp(-np.clip(e, -709, 709)))), pa.array(list(own), pa.list_(pa.float64()))], names=["project_code", "report_month", "regime", "base", "score", "parts"])

    named = F.arrays_zip(F.array(*map(F.lit, names)).alias("feature"), F.col("parts").alias("contribution"))
    months = F.concat_ws("|", "regime", "mi").isin(*{f"{folds.origins[f.fold][0]}|{folds.origins[f.fold][1]}" for f in fits})
    return ready.where(months).mapInArrow(parts, schema).select("project_code", "report_month", "regime", "base", "score", F.inline(named).alias("feature", "contribution"))


def importances(folds: Folds, fits: list[Fit]) -> list[tuple[str, int, str, float]]:
    """regime, origin, source feature, absolute coefficients of its matrix columns together."""
    names, out = columns(folds.features), []
    for fit in fits:
        sums = dict.fromkeys(folds.features, 0.0)
        for at, w in zip(fit.at[:-1], fit.w):
            sums[names[at].removesuffix("_z").removesuffix("_n").removesuffix("_share")] += abs(float(w))
        out += [(*folds.origins[fit.fold], k, v) for k, v in sums.items()]
    return out


def platt_by_fold(pool: DataFrame, *by: str, strength: float = 1e6) -> DataFrame:
    """Slope and intercept of the label on the raw logit per group, with C = strength, all groups by one aggregation a Newton step.

    pool: by, label, logit. Groups (folds of an evaluation) with one class only are left out."""
    y, x = F.col("label").cast("double"), F.col("logit")
    first = pool.groupBy(*by).agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select(*by).collect()
    state = {tuple(r): np.array([0.0, 0.0]) for r in first}
    spark, kinds = pool.sparkSession, ", ".join(f"{c} {t}" for c, t in pool.select(*by).dtypes)
    table = lambda: spark.createDataFrame([(*k, float(a), float(b)) for k, (a, b) in state.items()], f"{kinds}, slope double, intercept double")
    for _ in range(STEPS):
        if not state:
            break
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-709.0), F.least(F.lit(709.0), F.col("slope") * x + F.col("intercept")))))
        v = p * (1 - p)
        sums = pool.join(F.broadcast(table()), list(by)).groupBy(*by).agg(F.sum((p - y) * x).alias("ga"), F.sum(p - y).alias("gb"), F.sum(v * x * x).alias("aa"), F.sum(v * x).alias("ab"), F.sum(v).alias("bb"), F.max("slope").alias("a"), F.max("intercept").alias("b")).collect()  # a row for each fold
        moved = 0.0
        for r in sums:
            penalty = 1 / strength
            step = np.linalg.lstsq(np.array([[r["aa"] + penalty, r["ab"]], [r["ab"], r["bb"]]]), np.array([r["ga"] + penalty * r["a"], r["gb"]]), rcond=None)[0]
            step *= min(1.0, 5.0 / max(1e-300, float(np.abs(step).max())))
            state[tuple(r[c] for c in by)] = np.array([r["a"], r["b"]]) - step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-9:
            break
    return table()
