"""Identity, date and cost cells of report rows (B09-B11, B13-B17), as Catalyst expressions over lines and characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import MONTHS, _wrapped, cell_lines, identifier, is_missing, let, squeeze, unwrapped

# Month names.
MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
CODE = "N[0-9]{8}|[0-9]{9}"
#: A line of two brackets, a line that is one.
PAIR, ALONE = r"^\(([^()]*)\)\s+\(([^()]*)\)$", r"^\(([^()]*)\)$"


def _null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _last(lines: Column, fits) -> Column:
    """The number (from 1) of the last line that fits; null if none does."""
    return F.array_max(F.transform(lines, lambda x, i: F.when(fits(x, i + 1), i + 1)))


def _upto(lines: Column, n: Column) -> Column:
    return F.slice(lines, 1, F.greatest(n, F.lit(0)))


def _from(lines: Column, n: Column) -> Column:
    return F.slice(lines, F.greatest(n, F.lit(1)), F.greatest(F.size(lines) - n + 1, F.lit(0)))


def project_identity(c: Column) -> Column:
    """name, agency, six-digit code, legacy code, pmgid of a composite cell, read from its last line on.

    The last line `(legacy) (pmgid)` names both; without one, lines in brackets right after the code do."""
    end = lambda lines, at_pair: F.coalesce(at_pair - 1, F.size(lines))
    code = lambda lines, at_pair: _last(lines, lambda x, i: x.rlike(r"^\([0-9]{6}\)$") & (i <= end(lines, at_pair)))
    return let(cell_lines(c), lambda lines: let(_last(lines, lambda x, i: x.rlike(PAIR)), lambda at_pair: let(code(lines, at_pair), lambda at_code: _identity(lines, at_pair, at_code, F.coalesce(at_code - 1, end(lines, at_pair))))))


def _after(lines: Column, at_pair: Column, at_code: Column) -> Column:
    """The lines in brackets right after the code, up to the first that isn't alone in its brackets."""
    after = F.when(at_code.isNotNull() & at_pair.isNull(), _from(lines, at_code + 1)).otherwise(F.array().cast("array<string>"))
    stop = lambda xs: F.array_min(F.transform(xs, lambda x, i: F.when(~x.rlike(ALONE), i)))
    return let(after, lambda xs: F.slice(xs, 1, F.coalesce(stop(xs), F.size(xs))))


def _identity(lines: Column, at_pair: Column, at_code: Column, stop_agency: Column) -> Column:
    of_pair = lambda k: let(F.regexp_extract(F.try_element_at(lines, at_pair), PAIR, k), identifier)
    single = lambda k: let(F.regexp_extract(F.try_element_at(_after(lines, at_pair, at_code), F.lit(k)), ALONE, 1), identifier)
    closed = F.coalesce(F.try_element_at(lines, F.nullif(stop_agency, F.lit(0))).endswith(")"), F.lit(False))
    begin = F.when(closed, _last(lines, lambda x, i: x.startswith("(") & (i <= stop_agency)))
    agency = lambda at: let(F.array_join(F.slice(lines, at, stop_agency - at + 1), " "), lambda t: _null(squeeze(F.substring(t, F.lit(2), F.length(t) - 2))))
    named = let(begin, lambda at: F.struct(squeeze(F.array_join(_upto(lines, F.coalesce(at - 1, stop_agency)), " ")).alias("project_name"), agency(at).alias("agency")))
    return let(named, lambda x: F.struct(
        x["project_name"].alias("project_name"), x["agency"].alias("agency"),
        F.regexp_extract(F.try_element_at(lines, at_code), r"([0-9]{6})", 1).alias("project_code"),
        F.when(at_pair.isNotNull(), of_pair(1)).otherwise(single(1)).alias("legacy_ocms_code"), F.when(at_pair.isNotNull(), of_pair(2)).otherwise(single(2)).alias("pmgid")))


def _bracketed_end(c: Column) -> Column:
    """How many characters the balanced bracket at the end of a text has; null if there is none."""
    step = lambda a, x: F.when(a["found"].isNotNull(), a).otherwise(_counted(a, x))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("found"))
    return F.when(c.endswith(")"), F.aggregate(F.split(F.reverse(c), ""), start, step, lambda a: a["found"]))


def _counted(a: Column, x: Column) -> Column:
    depth = a["depth"] + F.when(x == ")", 1).when(x == "(", -1).otherwise(0)
    return F.struct(depth.alias("depth"), (a["n"] + 1).alias("n"), F.when((x == "(") & (depth == 0), a["n"] + 1).alias("found"))


def legacy_identity(c: Column) -> Column:
    """`name (agency) (code)`, the agency by balanced brackets from the right."""
    form = rf"^(.*)\s*\(({CODE})\)$"
    return let(squeeze(c), lambda t: let(F.rtrim(F.regexp_extract(t, form, 1)), lambda head: let(_bracketed_end(head), lambda n: _legacy(t, form, head, n))))


def _legacy(t: Column, form: str, head: Column, n: Column) -> Column:
    has = t.rlike(form)
    name = F.when(~has, t).when(n.isNull(), head).otherwise(squeeze(F.substring(head, F.lit(1), F.length(head) - n)))
    agency = F.when(has & n.isNotNull(), _null(squeeze(F.substring(head, F.length(head) - n + 2, n - 2))))
    return F.struct(name.alias("project_name"), agency.alias("agency"), F.when(has, F.regexp_extract(t, form, 2)).alias("project_code"))


def six_column_identity(c: Column) -> Column:
    """Lines name..., agency, (code), state of the six-column layout; null without a code after a line."""
    return let(cell_lines(c), lambda lines: let(_last(lines, lambda x, i: x.rlike(rf"\(({CODE})\)")), lambda at: _six_column(lines, at)))


def _six_column(lines: Column, at: Column) -> Column:
    bare = lambda x: F.regexp_replace(x, r"^[()]+|[()]+$", "")
    agency = F.try_element_at(lines, at - 1)
    return F.when(at >= 2, F.struct(
        F.array_join(_upto(lines, at - 2), " ").alias("project_name"), F.when(_wrapped(agency, "()"), bare(agency)).otherwise(agency).alias("agency"),
        F.regexp_extract(F.try_element_at(lines, at), rf"\(({CODE})\)", 1).alias("project_code"), F.array_join(F.transform(_from(lines, at + 1), bare), " ").alias("state")))


def five_column_identity(c: Column) -> Column:
    """`name (agency) - [code]` of the five-column layout; null if a part is missing or brackets don't balance."""
    form = rf"(?s)^(.*?)\[({CODE})\]\s*$"
    anywhere = rf"(?s)^(.*?)\[({CODE})\]"
    t = F.coalesce(c, F.lit(""))
    pick = lambda k: F.when(t.rlike(form), F.regexp_extract(t, form, k)).otherwise(F.regexp_extract(t, anywhere, k))
    head = F.rtrim(F.regexp_replace(F.regexp_replace(pick(1), r"\s+$", ""), r"-$", ""))
    return let(F.regexp_replace(head, r"\s+$", ""), lambda head: let(_bracketed_end(head), lambda n: _five_column(head, n, pick(2))))


def _five_column(head: Column, n: Column, code: Column) -> Column:
    name, agency = squeeze(F.substring(head, F.lit(1), F.length(head) - n)), squeeze(F.substring(head, F.length(head) - n + 2, n - 2))
    return F.when(n.isNotNull() & (code != "") & (name != "") & (agency != ""), F.struct(name.alias("project_name"), agency.alias("agency"), code.alias("project_code")))


def milestone_identity(c: Column, states: list[str]) -> Column:
    """`name - [code], agency, state`; the state is spelled as in states if its letters and digits agree."""
    t, form = F.coalesce(c, F.lit("")), rf"(?s)^(.*?)\[({CODE})\](.*)$"
    has = t.rlike(form)
    head = F.trim(F.when(has, F.regexp_extract(t, form, 1)).otherwise(t))
    name = squeeze(F.when(has, F.regexp_replace(head, r"-$", "")).otherwise(head))
    parts = F.filter(F.transform(F.split(F.regexp_extract(t, form, 3), ","), squeeze), lambda x: x != "")
    key = lambda x: F.regexp_replace(F.upper(x), "[^A-Z0-9]+", "")
    state = F.try_element_at(parts, F.lit(2))
    known = F.filter(F.array(*map(F.lit, states)), lambda x: key(x) == key(state))
    return F.struct(
        name.alias("project_name"), F.when(has, F.try_element_at(parts, F.lit(1))).alias("agency"), F.when(has, F.regexp_extract(t, form, 2)).alias("project_code"),
        F.when(has, F.coalesce(F.try_element_at(known, F.lit(1)), state)).alias("state"))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(squeeze(c), r"^[()]+|[()]+$", "")


def completed_month(c: Column) -> Column:
    """MM/20YY, also in brackets, as YYYY-MM; nothing else."""
    form = r"^(0[1-9]|1[0-2])/(20[0-9]{2})$"
    t = _stripped(c)
    return F.when(~is_missing(c) & t.rlike(form), F.concat(F.regexp_extract(t, form, 2), F.lit("-"), F.regexp_extract(t, form, 1)))


def completed_cost(c: Column) -> Column:
    """A number with commas, also in brackets; numbers with blanks between digits stay null."""
    t = F.regexp_replace(_stripped(c), ",", "")
    return F.when(~is_missing(c) & t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))


def _bare_lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def completion_dates(c: Column) -> Column:
    """Three lines: actual, original, revised; two: original, revised; one: actual."""
    lines = _bare_lines(c)
    n, at = F.size(lines), (lambda k: F.try_element_at(lines, F.lit(k)))
    return F.struct(F.when(n != 2, at(1)).alias("actual"), F.when(n == 3, at(2)).when(n == 2, at(1)).alias("original"), F.when(n == 3, at(3)).when(n == 2, at(2)).alias("revised"))


def approval_and_start(c: Column) -> Column:
    """Two lines: approval, start; a single one is the start if it begins with a bracket."""
    lines = _bare_lines(c)
    n, one, two = F.size(lines), F.try_element_at(lines, F.lit(1)), F.try_element_at(lines, F.lit(2))
    return F.struct(F.when((n > 1) | ~one.startswith("("), one).alias("approval"), F.when(n > 1, two).when(one.startswith("("), one).alias("start"))


def report_month(page: Column, file_name: Column, path: Column) -> Column:
    """`Month YYYY` in the page, else in the file name, else a month of either with the year in the path."""
    names = "|".join(MONTH_NAMES)
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    tries = [(low(page), rf"\b({names})\s+(20[0-9]{{2}})\b"), (low(file_name), rf"({names})[_ -]+(20[0-9]{{2}})")]
    number = lambda name: F.lpad(F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(name, 1, 3)).cast("string"), 2, "0")
    found = [F.when(c.rlike(form), F.concat(F.regexp_extract(c, form, 2), F.lit("-"), number(F.regexp_extract(c, form, 1)))) for c, form in tries]
    year = F.regexp_extract(F.coalesce(path, F.lit("")), r"\b(20[0-9]{2})\b", 1)
    loose = F.coalesce(_null(F.regexp_extract(low(file_name), rf"(?:^|[^a-z])({names})(?:[^a-z]|$)", 1)), _null(F.regexp_extract(low(page), rf"\b({names})\b", 1)))
    return F.coalesce(*found, F.when((year != "") & loose.isNotNull(), F.concat(year, F.lit("-"), number(loose))))


__all__ = ["approval_and_start", "completed_cost", "completed_month", "completion_dates", "five_column_identity", "legacy_identity", "milestone_identity", "project_identity", "report_month", "six_column_identity", "unwrapped"]
