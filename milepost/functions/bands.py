"""Bands of ages, progress, decreases and depths of history."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .months import months_between

# Names of bands, and for ages the months below which each ends.
AGES = ((0, "STARTS_AFTER_REPORT"), (12, "[0,1 year)"), (24, "[1,2 years)"), (36, "[2,3 years)"), (60, "[3,5 years)"), (120, "[5,10 years)"))
OLDEST, NO_START = "[10+ years)", "START_DATE_MISSING"
DEPTHS = ((2, "1-2"), (5, "3-5"), (11, "6-11"), (17, "12-17"), (26, "18-26"))
PROGRESS = ((25, "(0,25]"), (50, "(25,50]"), (75, "(50,75]"), (100, "(75,100]"))


def age_band(start: Column | str, month: Column | str) -> Column:
    """The age of a project in a month; an empty start is missing."""
    age, out = months_between(start, month), F.lit(OLDEST)
    for below, name in reversed(AGES):
        out = F.when(age < below, name).otherwise(out)
    return F.when(age.isNull(), NO_START).otherwise(out)


def progress_band(value: Column) -> Column:
    out = F.lit("OUTSIDE_RANGE")
    for top, name in reversed(PROGRESS):
        out = F.when((value > 0) & (value <= top), name).otherwise(out)
    return F.when(value.isNull(), "MISSING").when(value == 0, "ZERO").otherwise(out)


def depth_band(n: Column) -> Column:
    """How many observations a project has; 27 are the whole LEGACY era."""
    out = F.lit("27+")
    for top, name in reversed(DEPTHS):
        out = F.when(n <= top, name).otherwise(out)
    return out


def decrease_band(size: Column) -> Column:
    """How far progress fell; null where it didn't."""
    return F.when(size > 0, F.when(size < 1, "<1").when(size <= 5, "1-5").when(size <= 10, "5-10").otherwise(">10"))
