"""Sums, means and spreads with the types that the queries return."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(c: Column | str) -> Column:
    """Exact decimal sum, as a double; null over nothing."""
    return F.sum(_col(c)).cast("double")


def mean(c: Column | str, digits: int = 2) -> Column:
    """Mean of what is present, from the exact sum."""
    c = _col(c)
    return F.round(F.sum(c).cast("double") / F.count(c), digits)


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def quantiles(c: Column | str, *at: float) -> Column:
    """Linear interpolation at (n - 1) p; an array in the order of at."""
    return F.percentile(_col(c).cast("double"), F.array(*[F.lit(p) for p in at]))


def spread(c: Column | str, digits: int = 4) -> list[Column]:
    """count, min, p25, median, mean, p75, max, sum."""
    c = _col(c)
    q = lambda p: F.round(F.percentile(c.cast("double"), F.lit(p)), digits)
    return [F.count(c).alias("count"), F.min(c).cast("double").alias("min"), q(0.25).alias("p25"), q(0.5).alias("median"), mean(c, digits).alias("mean"), q(0.75).alias("p75"), F.max(c).cast("double").alias("max"), total(c).alias("sum")]


def ratio(n: Column | str, d: Column | str) -> Column:
    """Null where either is null or the denominator is 0."""
    d = _col(d)
    return _col(n).cast("double") / F.when(d != 0, d.cast("double"))


def state_of(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c.isNull(), "missing").when(c == 0, "zero").when(c > 0, "positive").otherwise("negative")


def change(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), "missing").when(b > a, "increased").when(b < a, "decreased").otherwise("unchanged")


def effective_cost(revised: Column | str, original: Column | str) -> Column:
    r, o = _col(revised), _col(original)
    return F.when(r > 0, r).when(o > 0, o)


def platt(logit: Column | str, slope: float, intercept: float) -> Column:
    x = F.lit(slope) * _col(logit) + F.lit(intercept)
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-709.0), F.least(F.lit(709.0), x))))
