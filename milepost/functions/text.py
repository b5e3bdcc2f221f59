"""Text and parse functions (B01-B17, B20, B31), pure Catalyst expressions; what B19 and B21 need of Python as Arrow UDFs. Keys made of them are in keys.py."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Texts that mean that a value is missing; month names.
MISSING = ("", "-", "/", "(-)", "na", "n/a", "n.a.", "nil", "none")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row however often body names it."""
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))


def squeeze(c: Column) -> Column:
    """White space runs become one blank, ends go, null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def is_missing(c: Column) -> Column:
    """A missing token, also after inner blanks are taken out."""
    return F.lower(squeeze(c)).isin(*MISSING) | F.lower(F.regexp_replace(squeeze(c), " ", "")).isin(*MISSING)


def identifier(c: Column) -> Column:
    return F.when(~is_missing(c), squeeze(c))


def number(c: Column) -> Column:
    """Commas and % go, one pair of brackets is unwrapped without changing the sign; blanks inside make it null,
    exponents don't (B04)."""
    bare = F.regexp_replace(squeeze(c), "[,%]", "")
    bare = F.trim(F.regexp_replace(F.trim(bare), r"^\((.*)\)$", "$1"))
    return F.when(~is_missing(c) & bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), bare.try_cast("double"))


def month(c: Column) -> Column:
    """MM/YYYY of 19xx or 20xx as YYYY-MM."""
    form = r"^(0[1-9]|1[0-2])/((?:19|20)[0-9]{2})$"
    t = squeeze(c)
    return F.when(t.rlike(form), F.concat(F.regexp_extract(t, form, 2), F.lit("-"), F.regexp_extract(t, form, 1)))


def _named(t: Column) -> Column:
    return F.lpad(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(t, 1, 3))).cast("string"), 2, "0")


def legacy_month(c: Column) -> Column:
    """M-YYYY or M/YYYY of 19xx or 20xx, Mon-YY or Mon-20YY, also with blanks between characters."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    digits, words = r"^(0?[1-9]|1[0-2])[-/]((?:19|20)[0-9]{2})$", r"^([A-Za-z]{3})-([0-9]{2}|20[0-9]{2})$"
    year = F.regexp_extract(t, words, 2)
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    return (F.when(t.rlike(digits), F.concat(F.regexp_extract(t, digits, 2), F.lit("-"), F.lpad(F.regexp_extract(t, digits, 1), 2, "0")))
            .when(t.rlike(words) & (_named(t) != "00"), F.concat(full, F.lit("-"), _named(t))))


def cell_lines(c: Column) -> Column:
    """The lines of a cell without outer and repeated blanks; empty ones go."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), squeeze), lambda x: x != "")


def triplet(c: Column) -> Column:
    """Lines of a cell as original, (revised) and {anticipated} or [anticipated]; missing tokens are null."""
    return let(cell_lines(c), _triplet)


def _triplet(lines: Column) -> Column:
    inner = lambda *forms: identifier(F.try_element_at(F.transform(F.filter(lines, lambda x: _wrapped(x, *forms)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2)), F.lit(-1)))
    plain = F.filter(lines, lambda x: ~_wrapped(x, "()", "{}", "[]") & ~is_missing(x))
    return F.struct(F.try_element_at(plain, F.lit(1)).alias("original"), inner("()").alias("revised"), inner("{}", "[]").alias("anticipated"))


def _wrapped(c: Column, *forms: str) -> Column:
    out = F.lit(False)
    for a, z in forms:
        out = out | (c.startswith(a) & c.endswith(z))
    return out


def unwrapped(c: Column) -> Column:
    """Without the brackets around it."""
    return F.when(_wrapped(c, "()"), F.trim(F.substring(c, F.lit(2), F.length(c) - 2))).otherwise(c)


def parenthesized_pair(c: Column) -> Column:
    """First line, and the others together without their brackets; missing tokens are null."""
    rest = lambda lines: F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), " ")
    return let(cell_lines(c), lambda lines: F.struct(identifier(F.try_element_at(lines, F.lit(1))).alias("first"), let(rest(lines), lambda x: identifier(unwrapped(x))).alias("second")))


def composite(c: Column) -> Column:
    """Lines name..., agency, and one with a six-digit code; null if there is none."""
    return let(cell_lines(c), _composite)


def _composite(lines: Column) -> Column:
    n = F.size(lines)
    code = F.regexp_extract(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("")), r"\b([0-9]{6})\b", 1)
    name = F.array_join(F.slice(lines, 1, F.greatest(n - 2, F.lit(0))), " ")
    return F.when((n >= 2) & (code != ""), F.struct(name.alias("name"), unwrapped(F.try_element_at(lines, F.lit(-2))).alias("agency"), code.alias("code")))


def banner_month(c: Column) -> Column:
    """`April, 2023` anywhere in a text as YYYY-MM."""
    form = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*,?\s+((?:19|20)[0-9]{2})\b"
    name = F.regexp_extract(c, form, 1)
    return F.when(name != "", F.concat(F.regexp_extract(c, form, 2), F.lit("-"), _named(name)))


def compact(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def tokens(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all tokens; 0 if there are none."""
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / F.when(n > 0, n)).otherwise(0.0)


def code_style(c: Column) -> Column:
    """Six digits, N and eight digits, nine digits."""
    return F.when(c.rlike("^[0-9]{6}$"), "SIX").when(c.rlike("^N[0-9]{8}$"), "LEGACY").when(c.rlike("^[0-9]{9}$"), "NINE").otherwise("OTHER")


@F.pandas_udf(StringType())
def ascii_fold(text: pd.Series) -> pd.Series:
    """NFKD without what isn't ASCII."""
    return text.map(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode(), na_action="ignore")


#: Texts of this length and more are compared one by one: difflib leaves out what is frequent in them.
LONG = 200
#: Pairs whose tables are in memory at once.
PAIRS = 2_048


def _codes(texts: list[str]) -> np.ndarray:
    """A row of characters for each text, 2 and up; zeros behind it."""
    wide = any(not t.isascii() for t in texts)
    size = max(map(len, texts), default=0)
    flat = b"".join(t.ljust(size, "\0").encode("utf-32-le" if wide else "ascii") for t in texts)
    return np.frombuffer(flat, np.uint32 if wide else np.uint8).reshape(len(texts), size).astype(np.uint32 if wide else np.uint16) + 2


def _pieces(of: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, empty: int) -> np.ndarray:
    """Parts of some rows from low to high, one in each column; empty stands below them."""
    at = low + np.arange((high - low).max())[:, None]
    return np.where(at < high, of[rows, np.minimum(at, of.shape[1] - 1)], empty)


def matched(a: list[str], b: list[str]) -> np.ndarray:
    """How many characters of each pair of texts below LONG are in matching blocks: the longest common run (earliest in a, then
    in b), then what is left and right of it. All pairs take each step together."""
    total, x, y = np.zeros(len(a), np.int64), _codes(a), _codes(b)
    rows, a0, a1, b0, b1 = np.arange(len(a)), np.zeros(len(a), np.int64), np.array([*map(len, a)], np.int64), np.zeros(len(a), np.int64), np.array([*map(len, b)], np.int64)
    while True:
        some = (a0 < a1) & (b0 < b1)
        rows, a0, a1, b0, b1 = (v[some] for v in (rows, a0, a1, b0, b1))
        if not len(rows):
            return total
        left, right = _pieces(x, rows, a0, a1, 0), _pieces(y, rows, b0, b1, 1)
        back = (255 - np.arange(len(right), dtype=np.uint16))[:, None]  # of runs of one length the first in b has the highest value
        run, best, end = np.zeros(right.shape, np.uint16), np.zeros(len(rows), np.uint16), np.zeros(len(rows), np.int64)
        for i in range(len(left)):
            run[1:] = run[:-1]
            run[0] = 0
            run += 1
            run *= left[i] == right
            most = ((run << 8) | back).max(axis=0)
            longer = most >> 8 > best >> 8
            best[longer], end[longer] = most[longer], i + 1
        size, i, j = (best >> 8).astype(np.int64), a0 + end, b0 + 256 - (best & 255)
        np.add.at(total, rows, size)
        hit = size > 0
        rows, a0, a1, b0, b1 = (np.concatenate([u[hit], v[hit]]) for u, v in ((rows, rows), (a0, i), (i - size, a1), (b0, j), (j - size, b1)))


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """difflib's ratio of each pair."""
    out = np.empty(len(a))
    short = np.array([len(x) < LONG and len(y) < LONG for x, y in zip(a, b)], bool)
    for k in np.flatnonzero(~short):
        out[k] = difflib.SequenceMatcher(None, a[k], b[k]).ratio()
    places = np.flatnonzero(short)
    for start in range(0, len(places), PAIRS):
        at = places[start : start + PAIRS]
        x, y = [a[k] for k in at], [b[k] for k in at]
        size = np.array([len(p) + len(q) for p, q in zip(x, y)])
        out[at] = np.where(size > 0, 2.0 * matched(x, y) / np.maximum(size, 1), 1.0)
    return out


def repeated_ratios(a, b) -> np.ndarray:
    """difflib's ratio of each pair; null counts as empty. Pairs that come again are compared once."""
    pairs = [(x or "", y or "") for x, y in zip(a, b)]
    apart = list(dict.fromkeys(pairs))
    found = dict(zip(apart, ratios([x for x, _ in apart], [y for _, y in apart]).tolist()))
    return np.array([found[p] for p in pairs], float)


@F.pandas_udf(DoubleType())
def gestalt(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks."""
    return pd.Series(repeated_ratios(a, b))
