"""Keys that texts are compared by (B18), accents taken off (B19), likeness of names.

Texts of ASCII letters stay inside the JVM; only those that hold others go to Python."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import ascii_fold, compact, gestalt, jaccard

# Words that an acronym leaves out.
IGNORED = ("and", "of", "the", "limited", "ltd", "corporation", "company", "ministry", "department")
#: A short form of an agency's name.
SHORT_FORM = "[A-Za-z][A-Za-z0-9/&.-]{1,15}"


@F.pandas_udf(StringType())
def _decomposed(c: pd.Series) -> pd.Series:
    """Lower-case words of letters and digits after NFKD; an accent inside a word parts it."""
    return c.map(lambda t: " ".join(re.findall("[a-z0-9]+", unicodedata.normalize("NFKD", t).casefold())), na_action="ignore")


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _beyond_ascii(c: Column) -> Column:
    """The text if it holds other characters than ASCII, else null."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), c)


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normal(c: Column | str) -> Column:
    """Words of letters and digits, joined by blanks; null counts as empty."""
    c = _text(c)
    return F.coalesce(_decomposed(_beyond_ascii(c)), F.array_join(_words(c), " "))


def folded(c: Column | str) -> Column:
    """NFKD without what isn't ASCII; null counts as empty."""
    c = _text(c)
    return F.coalesce(ascii_fold(_beyond_ascii(c)), c)


def alnum(c: Column | str) -> Column:
    """Letters and digits of the folded text in lower case."""
    return compact(folded(c))


def words(c: Column | str) -> Column:
    """Words of the folded text in lower case, in order."""
    return _words(folded(c))


def without_brackets(c: Column) -> Column:
    return _strip(F.regexp_replace(c, r"\s*[\[(][^\])]*[\])]\s*", " "))


def without_unit(c: Column) -> Column:
    """A roman number of up to three at the end goes."""
    return _strip(F.regexp_replace(c, r"(?i)\s*-\s*(?:I|II|III)\s*$", ""))


def acronym(c: Column) -> Column:
    """Initials of a folded text's words outside of brackets, but those of IGNORED."""
    return F.array_join(F.transform(F.filter(_words(without_brackets(c)), lambda w: ~w.isin(*IGNORED)), lambda w: F.substring(w, 1, 1)), "")


def agency_key(c: Column) -> Column:
    """A short name as it is, else the last short form in brackets, else initials; null if there is none."""
    c = _text(c)
    bracketed = F.try_element_at(F.regexp_extract_all(c, F.lit(rf"[\[(]({SHORT_FORM})[\])]")), F.lit(-1))
    initials = F.lower(F.array_join(F.transform(F.regexp_extract_all(c, F.lit("([A-Za-z0-9]+)")), lambda w: F.substring(w, 1, 1)), ""))
    return F.nullif(F.when(c.rlike(rf"^\s*{SHORT_FORM}\s*$"), compact(c)).when(bracketed.isNotNull(), compact(bracketed)).otherwise(initials), F.lit(""))


def similarity(a: Column, b: Column) -> Column:
    """The higher of the ratio of matching blocks and the shared words of two normal texts; 0 if either is empty."""
    x, y = F.replace(a, F.lit(" "), F.lit("")), F.replace(b, F.lit(" "), F.lit(""))
    tokens = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda t: t != ""))
    return F.when((x == "") | (y == ""), 0.0).otherwise(F.greatest(gestalt(x, y), jaccard(tokens(a), tokens(b))))
