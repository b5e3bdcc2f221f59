"""Months as text YYYY-MM at the edge and as year * 12 + month - 1 for arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Continuous segments of the panel: name, regime, first and last month.
SEGMENTS = [("SEGMENT_1", "LEGACY", "1995-01", "1996-11"), ("SEGMENT_2", "LEGACY", "1997-01", "1997-03"), ("SEGMENT_3", "LEGACY", "1997-06", "1998-12"), ("SEGMENT_4", "MODERN", "1999-01", "2001-11")]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def index_of(month: str) -> int:
    return int(month[:4]) * 12 + int(month[5:7]) - 1


def month_index(month: Column | str) -> Column:
    """Integer index; null stays null."""
    m = _col(month)
    return F.substring(m, 1, 4).cast("int") * 12 + F.substring(m, 6, 2).cast("int") - 1


def month_text(index: Column | str) -> Column:
    """Padded, not formatted: format_string parses its pattern in each row."""
    i = _col(index)
    padded = lambda x, n: F.lpad(x.cast("int").cast("string"), n, "0")
    return F.concat(padded(F.floor(i / 12), 4), F.lit("-"), padded(i % 12 + 1, 2))


def text_or_null(index: Column | str) -> Column:
    i = _col(index)
    return F.when(i.isNotNull(), month_text(i))


def add_months(month: Column | str, n: int) -> Column:
    return text_or_null(month_index(month) + n)


def months_between(start: Column | str, end: Column | str) -> Column:
    """Whole calendar months from start to end; null if either is absent."""
    return month_index(end) - month_index(start)


def consecutive(earlier: Column | str, later: Column | str) -> Column:
    return months_between(earlier, later) == 1


def following(month: Column | str, n: int) -> Column:
    """The n months after month, as text."""
    i = month_index(month)
    return F.transform(F.sequence(i + 1, i + n), month_text)
