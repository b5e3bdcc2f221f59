"""Queries of identity, date and cost cells: cells are laid out from the panel, and its columns are what must come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells as f
from .surrogate import PANEL_SQL, panel

WITH = f"WITH {PANEL_SQL}"
KEY = ["project_code", "report_month"]
#: What the expected results have in common: a code of six digits, one of nine characters, two lines of the name.
SIX, LONG = "lpad(CAST(ent AS VARCHAR), 6, '0')", "'N' || lpad(CAST(ent AS VARCHAR), 8, '0')"


def _made(s, d):
    ent = F.col("ent").cast("string")
    p = panel(s, d).withColumn("k", F.col("ent") % 4).withColumn("six", F.lpad(ent, 6, "0")).withColumn("long", F.concat(F.lit("N"), F.lpad(ent, 8, "0")))
    return p.withColumn("name", F.regexp_replace("project_name", "^(\\S+) ", "$1 \n ")).withColumn("flat", F.col("project_name"))


def _parsed(s, d, cell, parse, *names):
    return _made(s, d).select(*KEY, parse(cell).alias("x")).select(*KEY, *[F.col(f"x.{n}").alias(f"{n}_out") for n in names])


def _cat(*parts):
    return F.concat(*[F.lit(x[1:]) if x.startswith("=") else F.col(x) for x in parts])


def _identity(s, d):
    """Only a code; code and legacy code; both ids on a line; no agency; the agency on two lines every third month."""
    ids = F.when(F.col("k") == 1, _cat("=\n(", "long", "=)")).when(F.col("k") == 2, _cat("=\n(", "long", "=) (", "six", "=)")).when(F.col("k") == 3, F.lit("\n(-) (77)")).otherwise("")
    agency = F.when(F.col("mi") % 3 == 0, _cat("=\n(", "agency", "=\nGroup)")).when(F.col("mi") % 3 == 1, _cat("=\n(", "agency", "=)")).otherwise("")
    return _parsed(s, d, F.concat("name", agency, F.lit("\n("), "six", F.lit(")"), ids), f.project_identity, "project_name", "agency", "project_code", "legacy_ocms_code", "pmgid")


def _out(columns: str, where: str = "") -> str:
    return f"{WITH} SELECT project_code, report_month, {columns} FROM panel{where}"


AGENCY = "agency AS agency_out"
STATES = ["UNITED STATES", "UNITED KINGDOM", "SAUDI ARABIA"]

ENTRIES = [
    ("b09_project_identity", _identity, _out(f"project_name AS project_name_out, CASE mi % 3 WHEN 0 THEN agency || ' Group' WHEN 1 THEN agency END AS agency_out, {SIX} AS project_code_out, "
                                             f"CASE ent % 4 WHEN 1 THEN {LONG} WHEN 2 THEN {LONG} END AS legacy_ocms_code_out, CASE ent % 4 WHEN 2 THEN {SIX} WHEN 3 THEN '77' END AS pmgid_out")),
    ("b10_legacy_identity", lambda s, d: _parsed(s, d, F.when(F.col("k") == 0, _cat("flat", "= (", "agency", "=)")).when(F.col("k") == 1, _cat("name", "= (", "agency", "= (", "six", "=)) (", "long", "=)")).otherwise(_cat("name", "= (", "long", "=)")), f.legacy_identity, "project_name", "agency", "project_code"),
     _out(f"CASE ent % 4 WHEN 0 THEN project_name || ' (' || agency || ')' ELSE project_name END AS project_name_out, CASE ent % 4 WHEN 1 THEN agency || ' (' || {SIX} || ')' END AS agency_out, CASE WHEN ent % 4 > 0 THEN {LONG} END AS project_code_out")),
    ("b11_six_column_identity", lambda s, d: _parsed(s, d, F.when(F.col("k") == 0, F.col("name")).otherwise(F.concat("name", F.lit("\n("), "agency", F.lit(")\n("), "long", F.lit(")\n("), F.coalesce("state", F.lit("NONE")), F.lit(")"))), f.six_column_identity, "project_name", "agency", "project_code", "state"),
     _out(f"CASE WHEN ent % 4 > 0 THEN project_name END AS project_name_out, CASE WHEN ent % 4 > 0 THEN agency END AS agency_out, CASE WHEN ent % 4 > 0 THEN {LONG} END AS project_code_out, CASE WHEN ent % 4 > 0 THEN coalesce(state, 'NONE') END AS state_out")),
    ("b13_five_column_identity", lambda s, d: _parsed(s, d, F.when(F.col("k") == 0, _cat("name", "=\n- [", "long", "=]")).when(F.col("k") == 1, _cat("name", "=\n(", "agency", "= (", "six", "=))\n- [", "long", "=] ")).otherwise(_cat("name", "=\n(", "agency", "=) [", "long", "=]")), f.five_column_identity, "project_name", "agency", "project_code"),
     _out(f"CASE WHEN ent % 4 > 0 THEN project_name END AS project_name_out, CASE WHEN ent % 4 = 1 THEN agency || ' (' || {SIX} || ')' WHEN ent % 4 > 1 THEN agency END AS agency_out, CASE WHEN ent % 4 > 0 THEN {LONG} END AS project_code_out")),
    ("b14_milestone_identity", lambda s, d: _parsed(s, d, F.when(F.col("k") == 0, F.col("name")).otherwise(F.concat("name", F.lit(" - ["), "long", F.lit("], "), "agency", F.coalesce(F.concat(F.lit(", "), F.replace(F.lower("state"), F.lit(" "), F.lit("-"))), F.lit("")))), lambda c: f.milestone_identity(c, STATES), "project_name", "agency", "project_code", "state"),
     _out(f"project_name AS project_name_out, CASE WHEN ent % 4 > 0 THEN agency END AS agency_out, CASE WHEN ent % 4 > 0 THEN {LONG} END AS project_code_out, CASE WHEN ent % 4 > 0 THEN CASE WHEN state IN ('UNITED STATES', 'UNITED KINGDOM', 'SAUDI ARABIA') THEN state ELSE replace(lower(state), ' ', '-') END END AS state_out")),
    ("b15_completed_values", lambda s, d: _made(s, d).select(*KEY, f.completed_month(F.concat(F.lit("("), F.substring("report_month", 6, 2), F.when(F.col("k") == 0, F.lit("/1/")).otherwise(F.lit("/20")), F.substring("report_month", 3, 2), F.lit(")"))).alias("month_out"), f.completed_cost(F.when(F.col("k") == 1, F.lit("1 2 3")).when(F.col("k") == 2, F.lit("n / a")).otherwise(F.format_number(F.col("original_cost"), 2))).alias("cost_out")),
     _out("CASE WHEN ent % 4 > 0 THEN '20' || report_month[3:] END AS month_out, CASE WHEN ent % 4 NOT IN (1, 2) THEN CAST(original_cost AS DOUBLE) END AS cost_out")),
    ("b16_date_cells", lambda s, d: _made(s, d).select(*KEY, f.completion_dates(F.array_join(F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), F.col("k").cast("int")), "\n")).alias("x"), f.approval_and_start(F.when(F.col("k") == 0, "05/1999\n(06/1999)").when(F.col("k") == 1, "(06/1999)").when(F.col("k") == 2, "05/1999")).alias("y")).select(*KEY, "x.*", "y.*"),
     _out("CASE ent % 4 WHEN 1 THEN 'a' WHEN 3 THEN 'a' END AS actual, CASE ent % 4 WHEN 2 THEN 'a' WHEN 3 THEN 'b' END AS original, CASE ent % 4 WHEN 2 THEN 'b' WHEN 3 THEN 'c' END AS revised, CASE WHEN ent % 4 IN (0, 2) THEN '05/1999' END AS approval, CASE WHEN ent % 4 IN (0, 1) THEN '(06/1999)' END AS start")),
    ("b17_report_month", lambda s, d: (lambda t: _made(s, d).select(*KEY, f.report_month(F.when(F.col("k") == 0, F.concat(F.lit("Status in "), t, F.lit(" now"))).when(F.col("k") == 2, F.lit("no month")), F.when(F.col("k") == 1, F.concat(F.lit("list_"), F.replace(t, F.lit(" "), F.lit("-")), F.lit(".pdf"))).when(F.col("k") == 2, F.concat(F.lit("x-"), F.date_format(F.to_date(F.concat("report_month", F.lit("-01"))), "MMMM"), F.lit(".pdf"))).otherwise("none.pdf"), F.concat(F.lit("/in/20"), F.substring("report_month", 3, 2), F.lit("/x"))).alias("month_out")))(F.date_format(F.to_date(F.concat(F.lit("20"), F.substring("report_month", 3, 5), F.lit("-01"))), "MMMM yyyy")),
     _out("CASE WHEN ent % 4 < 3 THEN '20' || report_month[3:] END AS month_out")),
]
