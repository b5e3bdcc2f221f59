"""Queries from raw rows to records. Reports of four layouts are laid out from the panel, ledgers of three from the completions;
what must come back is said in SQL over the same rows, not parsed again."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import rawrows as simple
from ..operators import reports as op
from ..sources.store import kept
from .surrogate import COMPLETED_SQL, PANEL_SQL, completed, panel, table

#: The layout of a month's report, by its month index.
LAYOUTS = (op.NINE, op.EIGHT, op.ANNEXURE, op.MILESTONES)
HEADERS = {
    op.NINE: ["State", "Sector", "Sl No", "Project Name Agency Name Project Code", "Date of Approval", "Date of Commissioning Original Revised Anticipated", "Cost Original Revised Anticipated", "Cumulative Expenditure", "Physical Progress"],
    op.EIGHT: ["Sl.No", "Project Name Agency Project Code", "State", "Date of Approval Start Date", "DoC Revised DoC", "Cost Revised Cost", "Cumulative Expenditure", "Physical Progress"],
    op.ANNEXURE: ["Si.No", "Project", "Approval", "Commissioning", "Cost", "Expenditure"],
    op.MILESTONES: ["Si.No", "Project", "Date of Approval", "", "Original Revised Anticipated Date of Commissioning", "Original Revised Anticipated Cost", "Cumulative Expenditure Cost Overrun Time Overrun", "", "Miles tones achieved total"],
}
NONE = "(NONE)"


def _words(s, d):
    """States (nations, or regions where the panel has these) and sectors that can be headings: a few dozen and at most 150 names."""
    one = lambda t, c: [r[0] for r in table(s, d, t).select(c).distinct().orderBy(c).collect()]
    return [f"{x} REGION" for x in (*one("nation", "n_name"), *one("region", "r_name"), NONE)], one("part", "p_type")


def _numbered(s, d):
    w = Window.partitionBy("report_month").orderBy("mn", "st", "sector", "project_code")
    p = panel(s, d).withColumn("mn", F.coalesce("ministry", F.lit(NONE))).withColumn("st", F.concat(F.coalesce("state", F.lit(NONE)), F.lit(" REGION")))
    before = lambda *cs: ~F.coalesce(F.lag(F.concat_ws("|", *cs)).over(w) == F.concat_ws("|", *cs), F.lit(False))
    p = p.withColumn("n", F.row_number().over(w)).withColumn("last", F.lead(F.lit(1)).over(w).isNull()).withColumn("new_mn", before("mn")).withColumn("new_st", before("mn", "st")).withColumn("new_sec", before("mn", "st", "sector"))
    long = F.concat(F.lit("N"), F.lpad(F.col("ent").cast("string"), 8, "0"))
    return p.withColumn("long", long).withColumn("lay", _layout())


def _layout():
    """The layout of a month."""
    return F.element_at(F.array(*map(F.lit, LAYOUTS)), (F.col("mi") % 4 + 1).cast("int"))


def raw(s, d):
    return kept(s, d, "reports", lambda: _raw(s, d), "source_file", spread=False)


def _raw(s, d):
    """Header and total come with a month's first and last row, so that rows of a month stay together for whoever walks them."""
    p, e = _numbered(s, d), F.lit("")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    dash = lambda c: F.coalesce(F.concat(F.substring(c, 6, 2), F.lit("-"), F.substring(c, 1, 4)), F.lit("-"))
    slash = lambda c: F.coalesce(F.concat(F.substring(c, 6, 2), F.lit("/"), F.substring(c, 1, 4)), F.lit("-"))
    lines = lambda a, b: F.concat(a, F.lit("\n("), b, F.lit(")"))
    dates, costs, serial = lines(dash("original_completion_date"), dash("revised_completion_date")), lines(text("original_cost"), text("revised_cost")), F.col("n").cast("string")
    at = lambda k, *cells: F.struct((F.col("n") * 8 + k).alias("raw_sequence"), F.array(*[F.lit(c) if isinstance(c, str) else c for c in cells]).alias("cells"))
    broken, split, odd = F.col("st") == "NATION_24 REGION", F.col("n") % 13 == 0, F.when(F.col("n") % 97 == 0, F.lit(1))
    first = lambda c, new: F.when(F.col(new), F.when(broken & F.lit(c == "st"), "NATION_24").otherwise(F.col(c))).otherwise("")
    rows = {
        op.NINE: [at(0, first("st", "new_st"), first("sector", "new_sec"), serial, F.concat("project_name", F.lit(" ("), "agency", F.lit(") ("), "long", F.lit(")")), dash("approval_date"), dates, costs, text("cumulative_expenditure"), text("physical_progress")),
                  F.when(F.col("new_st") & broken, at(1, "REGION", *[""] * 8)), F.when(odd.isNotNull(), at(3, "", "", "x", "", "", "", "", "", "")), F.when(F.col("n") % 89 == 0, at(4, *[""] * 9))],
        op.EIGHT: [F.when(F.col("new_mn"), at(-2, "", F.concat(F.lit("Ministry of "), "mn"), *[""] * 6)), F.when(F.col("new_sec") & ~(F.col("new_mn") & (F.col("n") % 2 == 0)), at(-1, "", F.col("sector"), *[""] * 6)),
                   at(0, serial, F.concat("project_name", F.lit("\n("), "agency", F.lit(")\n("), F.lpad(F.col("ent").cast("string"), 6, "0"), F.lit(")\n("), "long", F.lit(") (-)")), text("st"), lines(slash("approval_date"), slash("start_date")), lines(slash("original_completion_date"), slash("revised_completion_date")), costs, text("cumulative_expenditure"), text("physical_progress")), F.when(odd.isNotNull(), at(3, "x", *[""] * 7))],
        op.ANNEXURE: [F.when(F.col("new_st"), at(-2, "", F.col("st"), *[""] * 4)), F.when(F.col("new_sec"), at(-1, "", F.lower("sector"), *[""] * 4)),
                      F.when(F.col("n") % 29 == 0, at(0, F.concat_ws(" ", serial, serial), "", "", "", "", "")).when(F.col("n") % 31 == 0, at(0, F.concat_ws(" ", serial, "project_name"), *[""] * 5)).when(F.col("n") % 37 == 0, at(0, "", "", dash("approval_date"), dates, costs, text("cumulative_expenditure"))).otherwise(at(0, serial, F.col("project_name"), dash("approval_date"), dates, costs, lines(text("cumulative_expenditure"), F.lit("x")))),
                      F.when(split & (F.col("n") % 29 != 0) & (F.col("n") % 31 != 0) & (F.col("n") % 37 != 0), at(1, "", "PART TWO", *[""] * 4))],
        op.MILESTONES: [F.when(F.col("new_sec"), at(-1, "", F.col("sector"), *[""] * 5)), F.when(split, at(0, serial, F.col("project_name"), dash("approval_date"), dates, costs, text("cumulative_expenditure"), "1/2")).otherwise(at(0, serial, F.concat("project_name", F.lit(" - ["), "long", F.lit("], "), "agency", F.lit(", "), F.lower("st")), dash("approval_date"), dates, costs, text("cumulative_expenditure"), "1/2")),
                        F.when(split, at(1, "", F.concat(F.lit("- ["), "long", F.lit("], "), "agency", F.lit(", "), F.lower("st")), *[""] * 5)), F.when(F.col("n") % 17 == 0, at(2, "", F.col("agency"), *[""] * 5)), F.when(odd.isNotNull(), at(4, *[""] * 7))],
    }
    head, total = F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>")
    for name, words in HEADERS.items():
        width = 7 if name == op.MILESTONES else len(words)
        head = F.when(F.col("lay") == name, F.array(*map(F.lit, words))).otherwise(head)
        total = F.when(F.col("lay") == name, F.array(*[F.lit("Total" if i == (3 if name == op.NINE else 1) else "1" if i == 5 and name not in (op.MILESTONES, op.ANNEXURE) else "") for i in range(width)])).otherwise(total)
    # the highest number of a month is how many rows it has
    ends = [F.when(F.col("n") == 1, F.struct(F.lit(0).alias("raw_sequence"), head.alias("cells"))), F.when(F.col("last"), F.struct((F.col("n") * 8 + 5).alias("raw_sequence"), total.alias("cells")))]
    whole = lambda name: F.array_compact(F.array(*rows[name], *ends))
    parts = F.when(F.col("lay") == op.NINE, whole(op.NINE)).when(F.col("lay") == op.EIGHT, whole(op.EIGHT)).when(F.col("lay") == op.ANNEXURE, whole(op.ANNEXURE)).otherwise(whole(op.MILESTONES))
    return p.select(F.col("report_month").alias("source_file"), F.inline(parts)).withColumn("source_page", (F.floor(F.col("raw_sequence") / 400) + 1).cast("int"))


def classes(s, d):
    """Raw rows with layout, class and what the headings above say. They are laid out and walked where a month's rows are: they move once, as rows of the panel."""
    return kept(s, d, "report-classes", lambda: op.filled(op.classified(op.with_layout(_raw(s, d)), *_words(s, d))), "source_file", spread=False)


def _unlabelled(r):
    none = F.lit(None).cast("string")
    return r.withColumn("state", none).withColumn("sector", none)


def rows(s, d):
    """The rows of classes with what label groups say; they are not written once more."""
    return labelled(classes(s, d))


def labelled(r):
    """Adds state and sector, which only nine-column files print by groups: rows of other files have none and stay out of the joins."""
    nine = F.coalesce(F.col("layout").startswith(op.NINE), F.lit(False))
    return op.group_labels(r.where(nine), (0, "state"), (1, "sector")).unionByName(_unlabelled(r.where(~nine)))


def found(s, d):
    return op.records(kept(s, d, "report-merged", lambda: op.merged(rows(s, d))), _words(s, d)[0])


P = (f"WITH {PANEL_SQL}, q AS (SELECT *, coalesce(ministry, '{NONE}') AS mn, coalesce(state, '{NONE}') || ' REGION' AS st, 'N' || lpad(CAST(ent AS VARCHAR), 8, '0') AS long, ['NINE', 'EIGHT', 'ANNEXURE', 'MILESTONES'][CAST(mi % 4 AS INT) + 1] AS lay FROM panel), "
     "w AS (SELECT *, row_number() OVER o AS n, mn IS DISTINCT FROM lag(mn) OVER o AS new_mn, mn || '|' || st IS DISTINCT FROM lag(mn || '|' || st) OVER o AS new_st, mn || '|' || st || '|' || sector IS DISTINCT FROM lag(mn || '|' || st || '|' || sector) OVER o AS new_sec "
     "FROM q WINDOW o AS (PARTITION BY report_month ORDER BY mn, st, sector, project_code)), p AS (SELECT *, report_month AS source_file, max(n) OVER (PARTITION BY report_month) AS m, n % 13 = 0 AS split, n % 29 = 0 OR n % 31 = 0 OR n % 37 = 0 AS bad FROM w)")
_ANN, _MIL, _EIGHT, _NINE = (f"lay = '{x}'" for x in ("ANNEXURE", "MILESTONES", "EIGHT", "NINE"))
CLASSES = [
    ("n * 8 - 2", "CASE lay WHEN 'EIGHT' THEN 'ministry_heading' ELSE 'state_heading' END", f"({_EIGHT} AND new_mn) OR ({_ANN} AND new_st)"), ("n * 8 - 1", "'sector_heading'", f"(new_sec AND lay IN ('ANNEXURE', 'MILESTONES')) OR ({_EIGHT} AND new_sec AND NOT (new_mn AND n % 2 = 0))"),
    ("n * 8", f"CASE WHEN {_ANN} AND n % 29 = 0 THEN 'merged_serial' WHEN {_ANN} AND n % 31 = 0 THEN 'bled_serial' WHEN {_ANN} AND n % 37 = 0 THEN 'omitted_serial' ELSE 'project' END", "true"),
    ("n * 8 + 1", "CASE lay WHEN 'NINE' THEN 'fragment' ELSE 'continuation' END", f"({_NINE} AND new_st AND st = 'NATION_24 REGION') OR ({_ANN} AND split AND NOT bad) OR ({_MIL} AND split)"), ("n * 8 + 2", "'agency_heading'", f"{_MIL} AND n % 17 = 0"),
    ("n * 8 + 3", "'unclassified'", "lay IN ('NINE', 'EIGHT') AND n % 97 = 0"), ("n * 8 + 4", "'empty'", f"({_NINE} AND n % 89 = 0) OR ({_MIL} AND n % 97 = 0)"), ("n * 8 + 5", "'total'", "n = m"), ("0", "'header'", "n = 1"),
]
ALL = P + ", a AS (" + " UNION ALL ".join(f"SELECT source_file, lay, CAST({seq} AS BIGINT) AS raw_sequence, {kind} AS row_class FROM p WHERE {where}" for seq, kind, where in CLASSES) + ")"
SECTOR8 = f"last_value(CASE WHEN {CLASSES[1][2]} THEN sector END IGNORE NULLS) OVER (PARTITION BY report_month, mn ORDER BY n)"
#: A month that is a day short: only layout EIGHT reads start dates and revised values that hang on an approval.
RECORDS = P + f""", r AS (SELECT *, {SECTOR8} AS s8 FROM p), g AS (SELECT * FROM r WHERE NOT ({_ANN} AND bad))
SELECT report_month, CAST(n AS INT) AS source_serial_number, CASE WHEN {_EIGHT} THEN lpad(CAST(ent AS VARCHAR), 6, '0') WHEN {_ANN} THEN NULL ELSE long END AS project_code, CASE WHEN {_EIGHT} THEN long END AS legacy_ocms_code,
  CASE WHEN {_ANN} AND split THEN project_name || ' PART TWO' ELSE project_name END AS project_name, CASE WHEN {_ANN} THEN NULL ELSE agency END AS agency, CASE WHEN {_EIGHT} THEN 'Ministry of ' || mn END AS ministry,
  CASE WHEN {_EIGHT} THEN s8 WHEN {_ANN} THEN lower(sector) ELSE sector END AS sector, st AS state, approval_date, CASE WHEN {_EIGHT} THEN start_date END AS start_date, original_completion_date, revised_completion_date,
  CAST(original_cost AS DOUBLE) AS original_cost, CAST(revised_cost AS DOUBLE) AS revised_cost, CAST(cumulative_expenditure AS DOUBLE) AS cumulative_expenditure, CASE WHEN lay IN ('NINE', 'EIGHT') THEN CAST(physical_progress AS DOUBLE) END AS physical_progress,
  CAST(n * 8 // 400 + 1 AS INT) AS source_page, CASE WHEN {_EIGHT} AND cumulative_expenditure IS NULL THEN '-' ELSE CAST(cumulative_expenditure AS VARCHAR) END AS cumulative_expenditure_raw FROM g"""
SHOWN = ["report_month", "source_serial_number", "project_code", "legacy_ocms_code", "project_name", "agency", "ministry", "sector", "state", "approval_date", "start_date", "original_completion_date", "revised_completion_date", "original_cost", "revised_cost", "cumulative_expenditure", "physical_progress", "source_page", "cumulative_expenditure_raw"]


def _codes(s, d):
    """Nine-column pages whose codes slipped down a row where n % 7 is 3 to 5, and whose last code is missing in every third file."""
    p = _numbered(s, d).where(F.col("lay") == op.NINE)
    code, slips = F.concat(F.lit("("), "long", F.lit(")")), lambda c: (F.pmod(c, F.lit(7))).between(3, 5)
    w = Window.partitionBy("report_month", "source_page").orderBy("n")
    p = p.withColumn("code", code).withColumn("source_page", F.floor(F.col("n") / 50).cast("int"))
    before, last = F.lag("code").over(w), F.lead("n").over(w).isNull()
    # a row whose code slipped holds the code of the row above in front; the row after the last that slipped holds both
    mine = F.when(slips(F.col("n")) & ~last, F.array().cast("array<string>")).when(last & (F.col("mi") % 3 == 0) & ~slips(F.col("n") - 1), F.array().cast("array<string>")).otherwise(F.array("code"))
    above = F.when(slips(F.col("n") - 1) & before.isNotNull(), F.array(before)).otherwise(F.array().cast("array<string>"))
    p = p.select(F.col("report_month").alias("source_file"), "source_page", F.col("n").alias("raw_sequence"), F.col("n").cast("int").alias("serial"), F.concat(above, F.array("project_name"), mine).alias("lines"), "code")
    pages = p.groupBy("source_file", "source_page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("raw_sequence", "code"))), lambda x: x["code"]), " ").alias("page_text"))
    return op.repaired_codes(p.drop("code"), pages).select("source_file", F.col("raw_sequence").cast("long").alias("raw_sequence"), F.array_join("lines", "|").alias("lines"))


def _pages(s, d):
    """Page texts of several kinds from the titles and headers that pages have."""
    text = lambda x: F.lit(x)
    kinds = F.array(*map(F.lit, ["All Ongoing Projects  Sl.No Project Name Physical Progress", "Project List: Ongoing Projects as of March (North-East)", "Month wise list of completed projects", "Month wise list of completed projects and deleted projects", "Completed projects during month", "Project list: completed during March, ongoing projects Table 3", "Details of ongoing projects Annexure XVIII", "contents"]))
    p = panel(s, d).select("report_month", "ent").withColumn("page_text", F.concat(F.element_at(kinds, (F.col("ent") % 8 + 1).cast("int")), text("\n p "), F.col("ent").cast("string")))
    return p.groupBy("report_month", op.page_kind(F.col("page_text")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _tables(s, d):
    """Of every page one to three tables: the right one, one without a header, one without numbers."""
    header = F.array(*map(F.lit, HEADERS[op.NINE]))
    row = lambda k: F.array(*[F.lit("1" if i == k else "a") for i in range(9)])
    one = lambda i, h, r: F.struct(F.lit(i).alias("table_index"), h.alias("header"), F.array(r).alias("rows"))
    k = F.col("ent") % 4
    some = F.when(k == 0, F.array(one(0, header, row(2)), one(1, row(2), row(2)))).when(k == 1, F.array(one(0, header, row(1)))).when(k == 2, F.array(one(0, header, row(1)), one(1, header, row(2)), one(2, header, row(2)))).otherwise(F.array(one(0, row(0), row(0)), one(1, header, row(1)), one(2, header, row(2))))
    return panel(s, d).select(F.col("report_month").alias("source_file"), F.col("ent").cast("int").alias("source_page"), F.inline(some))


def _ledgers(s, d):
    """Completion lists in three layouts by month: FIVE lists the month before under its banner too."""
    c = completed(s, d).withColumn("name", F.regexp_replace("project_name", "^(\\S+) ", "$1\n")).withColumn("long", F.concat(F.lit("N"), F.lpad(F.col("ent").cast("string"), 8, "0"))).withColumn("six", F.lpad(F.col("ent").cast("string"), 6, "0"))
    c = c.withColumn("lay", F.element_at(F.array(F.lit("FIVE"), F.lit("SIX"), F.lit("SEVEN")), (F.col("mi") % 3 + 1).cast("int"))).withColumn("file_mi", F.col("mi"))
    late = c.where("lay = 'SEVEN'").withColumn("lay", F.lit("FIVE")).withColumn("file_mi", F.col("mi") + 1)  # of a FIVE file the month before is a SEVEN month
    c = c.unionByName(late).withColumn("old", F.col("file_mi") > F.col("mi"))
    w = Window.partitionBy("file_mi").orderBy(F.desc("old"), "sector", "project_code")
    c = c.withColumn("n", F.row_number().over(w)).withColumn("new_sec", ~F.coalesce(F.lag(F.concat_ws("|", "old", "sector")).over(w) == F.concat_ws("|", "old", "sector"), F.lit(False))).withColumn("new_mi", ~F.coalesce(F.lag("old").over(w) == F.col("old"), F.lit(False)))
    e = F.lit("")
    at = lambda k, *cells: F.struct((F.col("n") * 4 + k).alias("raw_sequence"), F.array(*[F.lit(x) if isinstance(x, str) else x for x in cells]).alias("cells"))
    money = lambda col: F.coalesce(F.col(col).cast("string"), F.lit("-"))
    month = lambda col: F.coalesce(F.concat(F.lit("("), F.substring(col, 6, 2), F.lit("/20"), F.substring(col, 3, 2), F.lit(")")), F.lit("-"))
    title = F.date_format(F.to_date(F.concat(F.lit("20"), F.substring("report_month", 3, 5), F.lit("-01"))), "MMMM, yyyy")
    five = [F.when(F.col("new_mi"), at(-2, e, title, e, e, e)), F.when(F.col("new_sec"), at(-1, e, F.col("sector"), e, e, e)), at(0, F.col("n").cast("string"), F.concat("name", F.lit("\n("), "agency", F.lit(")\n- ["), "long", F.lit("]")), money("original_cost"), month("original_completion_date"), money("cumulative_expenditure"))]
    six = [F.when(F.col("new_sec"), at(-1, F.col("sector"), *[""] * 5)), at(0, e, F.col("n").cast("string"), F.concat("name", F.lit("\n("), "agency", F.lit(")\n("), "long", F.lit(")\n("), F.coalesce("state", F.lit(NONE)), F.lit(")")), money("original_cost"), month("original_completion_date"), money("cumulative_expenditure"))]
    seven = [F.when(F.col("new_sec"), at(-1, e, F.col("sector"), *[""] * 5)), at(0, F.col("n").cast("string"), F.concat("name", F.lit("\n("), "agency", F.lit(")\n"), "six"), F.coalesce("state", F.lit(NONE)), F.concat(F.regexp_replace(month("approval_date"), "[()]", ""), F.lit("\n"), month("start_date")), F.concat_ws("\n", month("report_month"), month("original_completion_date"), month("revised_completion_date")), F.concat_ws("\n", money("original_cost"), money("revised_cost")), money("cumulative_expenditure"))]
    parts = F.when(F.col("lay") == "FIVE", F.array_compact(F.array(*five))).when(F.col("lay") == "SIX", F.array_compact(F.array(*six))).otherwise(F.array_compact(F.array(*seven)))
    file = F.concat(F.lit("20"), F.lpad((F.floor(F.col("file_mi") / 12) % 100).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("file_mi") % 12 + 1).cast("string"), 2, "0"))
    raw = c.select(file.alias("source_file"), F.col("lay").alias("layout"), F.inline(parts)).withColumn("report_month", F.col("source_file")).withColumn("source_page", (F.floor(F.col("raw_sequence") / 200) + 1).cast("int"))
    return op.of_month(op.completed_classes(raw))


CODE = "'N' || lpad(CAST(ent AS VARCHAR), 8, '0')"
LEDGER = (f"WITH {COMPLETED_SQL}, c0 AS (SELECT *, ['FIVE', 'SIX', 'SEVEN'][CAST(mi % 3 AS INT) + 1] AS lay, mi AS fm FROM completed), c1 AS (SELECT * FROM c0 UNION ALL SELECT * REPLACE ('FIVE' AS lay, mi + 1 AS fm) FROM c0 WHERE lay = 'SEVEN'), "
          "c2 AS (SELECT *, printf('20%02d-%02d', (fm // 12) % 100, fm % 12 + 1) AS file, row_number() OVER (PARTITION BY fm ORDER BY fm > mi DESC, sector, project_code) AS n FROM c1)")
#: The six-column layout prints the state in brackets; all brackets at its ends go.
LEDGER_STATE = "CASE lay WHEN 'SIX' THEN trim(coalesce(state, '{NONE}'), '()') WHEN 'SEVEN' THEN coalesce(state, '{NONE}') END"
M20 = lambda c: f"CASE WHEN {c} IS NOT NULL THEN '20' || {c}[3:] END"

ENTRIES = [
    ("c01_header_layouts", lambda s, d: raw(s, d).where("raw_sequence = 0").select("source_file", op.header_layout(F.col("cells")).alias("layout")), f"{P} SELECT DISTINCT source_file, lay AS layout FROM p"),
    ("c02_page_kinds", _pages, f"WITH {PANEL_SQL} SELECT report_month, ['ONGOING', NULL, 'COMPLETED_LEDGER', NULL, 'COMPLETED', NULL, 'ONGOING', NULL][CAST(ent % 8 AS INT) + 1] AS kind, count(*) AS n FROM panel GROUP BY 1, 2"),
    ("c03_candidates", lambda s, d: op.selected(op.audited(_tables(s, d))), f"WITH {PANEL_SQL} SELECT report_month AS source_file, CAST(ent AS INT) AS source_page, [2, 1, 3, 3][CAST(ent % 4 AS INT) + 1]::BIGINT AS tables, [1, 0, 2, 1][CAST(ent % 4 AS INT) + 1]::BIGINT AS matching, CASE ent % 4 WHEN 0 THEN 0 WHEN 3 THEN 2 END AS table_index, ['SELECTED', 'NO_CANDIDATE', 'SEVERAL_CANDIDATES', 'SELECTED'][CAST(ent % 4 AS INT) + 1] AS status FROM panel"),
    ("c04_page_ranges", lambda s, d: simple.pages(classes(s, d)), f"{ALL} SELECT source_file, CAST(min(raw_sequence // 400 + 1) AS INT) AS first_page, CAST(max(raw_sequence // 400 + 1) AS INT) AS last_page, max(raw_sequence // 400) - min(raw_sequence // 400) + 1 = count(DISTINCT raw_sequence // 400) AS contiguous, 1::BIGINT AS layouts FROM a GROUP BY 1"),
    ("c05_row_classes", lambda s, d: classes(s, d).select("source_file", F.col("raw_sequence").cast("long").alias("raw_sequence"), "row_class"), f"{ALL} SELECT source_file, raw_sequence, row_class FROM a"),
    ("c06_headings_filled", lambda s, d: classes(s, d).where("row_class = 'project' and layout <> 'NINE'").select("source_file", F.col("raw_sequence").cast("long").alias("raw_sequence"), "ministry", F.col("h_sector").alias("sector"), F.col("h_state").alias("state")),
     P + f", r AS (SELECT *, {SECTOR8} AS s8 FROM p) SELECT source_file, n * 8 AS raw_sequence, CASE WHEN {_EIGHT} THEN 'Ministry of ' || mn END AS ministry, CASE WHEN {_EIGHT} THEN s8 WHEN {_ANN} THEN lower(sector) ELSE sector END AS sector, CASE WHEN {_ANN} THEN st END AS state FROM r WHERE NOT ({_NINE}) AND NOT ({_ANN} AND bad)"),
    ("c07_continuations_merged", lambda s, d: op.merged(_unlabelled(classes(s, d))).where("layout in ('ANNEXURE', 'MILESTONES')").select("source_file", F.element_at("cells", 1).alias("serial"), F.element_at("cells", 2).alias("project"), F.col("source_page").alias("first_page"), "last_page"),
     P + f" SELECT source_file, CAST(n AS VARCHAR) AS serial, CASE WHEN {_ANN} THEN project_name || CASE WHEN split THEN ' PART TWO' ELSE '' END ELSE project_name || CASE WHEN split THEN chr(10) ELSE ' ' END || '- [' || long || '], ' || agency || ', ' || lower(st) END AS project, CAST(n * 8 // 400 + 1 AS INT) AS first_page, CAST((n * 8 + CASE WHEN split THEN 1 ELSE 0 END) // 400 + 1 AS INT) AS last_page FROM p WHERE {_MIL} OR ({_ANN} AND NOT bad)"),
    ("c08_group_labels", lambda s, d: rows(s, d).where("row_class = 'project' and layout = 'NINE'").select("source_file", F.col("raw_sequence").cast("long").alias("raw_sequence"), "state", "sector"), P + f" SELECT source_file, n * 8 AS raw_sequence, st AS state, sector FROM p WHERE {_NINE}"),
    ("c09_repaired_codes", _codes, P + f" SELECT source_file, n AS raw_sequence, project_name || '|(' || long || ')' AS lines FROM p WHERE {_NINE}"),
    ("c10_records", lambda s, d: found(s, d).select(*SHOWN), RECORDS),
    ("c11_completed_records", lambda s, d: op.completed_records(_ledgers(s, d)).drop("source_page", "source_file", "source_row_number", "extraction_method"),
     LEDGER + f""" SELECT CASE lay WHEN 'SEVEN' THEN lpad(CAST(ent AS VARCHAR), 6, '0') ELSE {CODE} END AS project_code, project_name, agency, NULL::VARCHAR AS ministry, sector, {LEDGER_STATE.format(NONE=NONE)} AS state, CASE WHEN lay = 'SEVEN' THEN {M20('approval_date')} END AS approval_date, CASE WHEN lay = 'SEVEN' THEN {M20('start_date')} END AS start_date,
      {M20('original_completion_date')} AS original_completion_date, CASE WHEN lay = 'SEVEN' THEN {M20('revised_completion_date')} END AS revised_completion_date, CASE WHEN lay = 'SEVEN' THEN {M20('report_month')} END AS actual_completion_date, CAST(original_cost AS DOUBLE) AS original_cost, CASE WHEN lay = 'SEVEN' THEN CAST(revised_cost AS DOUBLE) END AS revised_cost,
      CAST(cumulative_expenditure AS DOUBLE) AS cumulative_expenditure, file AS report_month, CAST(n AS INT) AS source_serial_number FROM c2 WHERE fm = mi"""),
    ("c12_banner_filter", lambda s, d: _ledgers(s, d).where("row_class in ('project', 'prior_cumulative_project')").groupBy("source_file", "layout", "row_class").agg(F.count(F.lit(1)).alias("n")), LEDGER + " SELECT file AS source_file, lay AS layout, CASE WHEN fm = mi THEN 'project' ELSE 'prior_cumulative_project' END AS row_class, count(*) AS n FROM c2 GROUP BY ALL"),
    ("c13_rejects", lambda s, d: op.rejects(classes(s, d), found(s, d)).select("source_file", F.col("raw_sequence").cast("long").alias("raw_sequence"), "reason"),
     f"{ALL} SELECT source_file, raw_sequence, CASE row_class WHEN 'merged_serial' THEN 'multiple_source_projects_merged_in_one_detected_row' WHEN 'bled_serial' THEN 'serial_project_cell_bleed' WHEN 'omitted_serial' THEN 'source_omitted_serial_project_row' WHEN 'empty' THEN 'empty_table_row' ELSE 'unclassified_non_project_row' END AS reason FROM a WHERE row_class IN ('merged_serial', 'bled_serial', 'omitted_serial', 'empty', 'unclassified')"),
    ("c14_removed_counts", lambda s, d: simple.removed(classes(s, d)), f"{ALL} SELECT source_file, row_class, count(*) AS n FROM a GROUP BY 1, 2"),
    ("c15_constant_layouts", lambda s, d: op.constant_layouts(op.with_layout(raw(s, d).where("raw_sequence > 0 or substring(source_file, 6, 2) <> '07'").unionByName(raw(s, d).where("raw_sequence = 0 and substring(source_file, 6, 2) = '05'").withColumn("raw_sequence", F.lit(9)).withColumn("cells", F.array(*map(F.lit, HEADERS[op.ANNEXURE])))))),
     P + " SELECT DISTINCT source_file, CASE WHEN source_file[6:7] = '07' OR (source_file[6:7] = '05' AND lay <> 'ANNEXURE') THEN NULL ELSE lay END AS layout, CASE WHEN source_file[6:7] = '07' OR (source_file[6:7] = '05' AND lay <> 'ANNEXURE') THEN 'FAILED' ELSE 'CONSTANT' END AS status FROM p"),
    ("c16_inherited_layouts", lambda s, d: op.with_layout(raw(s, d).withColumn("cells", F.when((F.size("cells") == 9) & (F.col("raw_sequence") % 8 == 0) & (F.col("raw_sequence") > 0), F.when(F.col("raw_sequence") % 16 == 0, F.slice("cells", 3, 7)).otherwise(F.slice("cells", 2, 8))).otherwise(F.col("cells")))).where("layout = 'NINE' and raw_sequence > 0 and raw_sequence % 8 = 0").select("source_file", F.col("raw_sequence").cast("long").alias("raw_sequence"), F.size("cells").cast("long").alias("cells"), F.element_at("cells", 3).alias("serial")),
     P + f" SELECT source_file, n * 8 AS raw_sequence, 9::BIGINT AS cells, CAST(n AS VARCHAR) AS serial FROM p WHERE {_NINE}"),
    ("c17_uncoded", lambda s, d: op.routed(found(s, d), False).groupBy("source_file").agg(F.count(F.lit(1)).alias("n")), P + f" SELECT source_file, count(*) AS n FROM p WHERE {_ANN} AND NOT bad GROUP BY 1"),
]
