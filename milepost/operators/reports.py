"""Report rows of every layout to records (C01-C17): row classes, headings carried forward, label fragments, displaced codes,
continuations, projections. The ordered walk is windows over (source_file, raw_sequence); what depends on the decision before
it is a fold over the few rows of a page or the label rows of a file."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import cells as f
from ..functions import text
from ..functions.numbers import count_if

NINE, EIGHT, ANNEXURE, MILESTONES = "NINE", "EIGHT", "ANNEXURE", "MILESTONES"
# Words that each column of a layout's header holds, and words that a column must not hold.
SIGNATURES = {
    EIGHT: ((("sl.no",), ("project name", "agency", "project code"), ("state",), ("date of approval", "start date"), ("doc", "revised doc"), ("cost", "revised cost"), ("cumulative", "expenditure"), ("physical progress",)), {}),
    "EIGHT_APPROVAL_ONLY": ((("sl.no",), ("project name", "agency", "project code"), ("state",), ("date of approval",), ("orignal/target doc", "revised doc"), ("orignal cost", "revised cost"), ("cumulative", "expenditure"), ("physical progress",)), {4: "start date"}),
    NINE: ((("state",), ("sector",), ("sl no",), ("project name", "agency name", "project code"), ("date", "approval"), ("date of commissioning", "original", "revised", "anticipated"), ("cost original", "revised", "anticipated"), ("cumulative", "expenditure"), ("physical", "progress")), {}),
    "NINE_PROGRESS_ONLY": ((("state",), ("sector",), ("sl no",), ("project name", "agency name", "project code"), ("date", "approval"), ("date of commissioning", "original", "revised", "anticipated"), ("cost original", "revised", "anticipated"), ("cumulative", "expenditure"), ("progress",)), {9: "physical"}),
    ANNEXURE: ((("si.no",), ("project",), ("approval",), ("commissioning",), ("cost",), ("expenditure",)), {}),
    MILESTONES: ((("si.no",), ("project",), ("date of", "approval"), (), ("original", "revised", "anticipated", "date of", "commissioning"), ("original", "revised", "anticipated", "cost"), ("cumulative", "expenditure", "cost overrun", "time overrun"), (), ("miles tones", "achieved", "total")), {}),
}
# Openings of a ministry heading.
MINISTRY = ("Ministry of ", "Department of ", "Department for ")
METHOD = "grid"


def walk() -> WindowSpec:
    return Window.partitionBy("source_file").orderBy("raw_sequence")


def so_far() -> WindowSpec:
    return walk().rowsBetween(Window.unboundedPreceding, 0)


def cell(i: int) -> Column:
    """The i-th cell (from 0) without outer and repeated blanks."""
    return text.squeeze(F.try_element_at("cells", F.lit(i + 1)))


def _populated() -> Column:
    return F.size(F.filter("cells", lambda x: text.squeeze(x) != ""))


def header_layout(cells: Column) -> Column:
    """The one layout whose words a header row holds and whose forbidden words it doesn't; null if none or several fit."""
    return text.let(F.transform(cells, lambda x: F.lower(text.squeeze(x))), _layout)


def _layout(cells: Column) -> Column:
    """The layout of cells that are squeezed and in lower case."""
    fits = []
    for name, (columns, never) in SIGNATURES.items():
        at = lambda i: F.try_element_at(cells, F.lit(i))
        ok = [F.size(cells) == len(columns), *(F.contains(at(i), F.lit(w)) for i, words in enumerate(columns, 1) for w in words), *(~F.contains(at(i), F.lit(w)) for i, w in never.items())]
        fits.append(F.when(reduce(lambda a, b: a & b, ok), F.lit(name)))
    return text.let(F.array_compact(F.array(*fits)), lambda found: F.when(F.size(found) == 1, F.try_element_at(found, F.lit(1))))


def page_kind(page: Column) -> Column:
    """ONGOING, COMPLETED_LEDGER, COMPLETED or null, by phrases that a page holds and others that it doesn't."""
    t = F.lower(text.squeeze(page))
    has = lambda *xs: reduce(lambda a, b: a & b, (F.contains(t, F.lit(x)) for x in xs))
    some = lambda *xs: reduce(lambda a, b: a | b, (F.contains(t, F.lit(x)) for x in xs))
    listed, region = "project list: ongoing projects as of", some("north-east", "north east")
    ongoing = (has("all ongoing projects", "sl.no", "project name", "physical progress") | has(listed, "state", "sector", "sl no", "project name", "cumulative", "expenditure", "progress") | (has(listed) & ~region)
               | (has("details of ongoing projects") & some("annexure xviii", "annexure - xviii", "annexure-xviii")) | (has("costing rs 150 crore and above") & some("detail of ongoing projects", "details of ongoing projects")))
    ledger = has("month wise list of completed projects") & ~some("ongoing projects", "deleted projects", "1000 crore", "table-20", "table 20")
    completed = some("project list: completed during", "completed projects during month") & ~(has("ongoing projects") & some("table 3", "table:-3", "table-3"))
    return F.when(ledger, "COMPLETED_LEDGER").when(completed, "COMPLETED").when(ongoing, "ONGOING")


def audited(tables: DataFrame) -> DataFrame:
    """tables: source_file, source_page, table_index, header, rows (arrays of cells). One row for each candidate, with why it isn't one."""
    layout = header_layout(F.col("header"))
    serial = F.when(F.col("layout").startswith("NINE"), 2).otherwise(0)
    numbered = F.size(F.filter("rows", lambda r: text.squeeze(F.try_element_at(r, serial + 1)).rlike("^[0-9]+$") & (F.size(r) == F.size("header"))))
    out = tables.withColumn("layout", layout).withColumn("project_rows", numbered.cast("long"))
    reason = F.when(F.col("layout").isNull(), "NO_HEADER_SIGNATURE").when(F.col("project_rows") == 0, "NO_NUMERIC_SERIAL")
    return out.withColumn("reason", reason).select("source_file", "source_page", "table_index", "layout", "project_rows", "reason", F.col("reason").isNull().alias("matches"))


def selected(audit: DataFrame) -> DataFrame:
    """Per page the one candidate that matches; pages with none or several fail."""
    g = audit.groupBy("source_file", "source_page").agg(F.count(F.lit(1)).alias("tables"), count_if(F.col("matches")).alias("matching"), F.min(F.when(F.col("matches"), F.col("table_index"))).alias("table_index"))
    return g.withColumn("status", F.when(F.col("matching") == 1, "SELECTED").when(F.col("matching") == 0, "NO_CANDIDATE").otherwise("SEVERAL_CANDIDATES")).withColumn("table_index", F.when(F.col("matching") == 1, F.col("table_index")))


def with_layout(raw: DataFrame) -> DataFrame:
    """The layout of the header above, inherited by later pages; rows of 7 or 8 cells of a nine-column file are padded."""
    rows = raw.withColumn("layout", F.last(header_layout(F.col("cells")), True).over(so_far()))
    short = lambda n: (F.col("layout") == NINE) & (F.size("cells") == n)
    two = F.array(F.lit(""), F.lit(""))
    return rows.withColumn("cells", F.when(short(7), F.concat(two, "cells")).when(short(8), F.concat(two, F.slice("cells", 2, 7))).otherwise(F.col("cells")))


def constant_layouts(rows: DataFrame) -> DataFrame:
    """Per file its layout, and FAILED where there is none or more than one."""
    g = rows.groupBy("source_file").agg(F.count_distinct("layout").alias("layouts"), F.min("layout").alias("layout"))
    return g.select("source_file", F.when(F.col("layouts") == 1, F.col("layout")).alias("layout"), F.when(F.col("layouts") == 1, "CONSTANT").otherwise("FAILED").alias("status"))


def classified(rows: DataFrame, states: list[str], sectors: list[str]) -> DataFrame:
    """row_class of each row by the rules of its layout (C05). states, sectors: the words that can be headings."""
    n, one = _populated(), cell(1)
    number = lambda i: cell(i).rlike("^[0-9]+$")
    is_state, is_sector = F.upper(one).isin(*[x.upper() for x in states]), F.lower(one).isin(*[x.lower() for x in sectors])
    total = F.contains(F.lower(one), F.lit("total"))
    annexure = (F.when(number(0), "project").when(cell(0).rlike(r"^[0-9]+(\s+[0-9]+)+$"), "merged_serial").when(cell(0).rlike(r"^[0-9]+\s+\S") & (one == ""), "bled_serial")
                .when((cell(0) == "") & (one != ""), F.when(is_state, "state_heading").when(is_sector, "sector_heading").when(total | F.lower(one).rlike(r"si\.no|details of ongoing"), "total").otherwise("continuation"))
                .when((cell(0) == "") & (cell(2) != "") & (cell(3) != "") & (cell(4) != "") & (cell(5) != ""), "omitted_serial").when(n == 0, "empty"))
    # after a record whose code has come, a single cell is a heading; before, it continues the record
    milestones = (F.when(number(0), "project").when((cell(0) == "") & is_sector & (n == 1), "sector_heading").when((cell(0) == "") & (F.lower(one) == "total"), "total")
                  .when((cell(0) == "") & (n == 1) & (one != "") & F.coalesce(F.col("_coded"), F.lit(True)), "agency_heading").when(n == 0, "empty").when((cell(0) == "") & ~F.coalesce(F.col("_closed"), F.lit(True)), "continuation"))
    grouped = (F.when(number(2), "project").when(((cell(0) != "") | (one != "")) & (n <= 2), "fragment").when((cell(2) == "") & (F.lower(one).startswith("total") | F.lower(cell(3)).startswith("total")), "total").when(n == 0, "empty"))
    plain = (F.when(number(0), "project").when((cell(0) == "") & F.lower(one).startswith("total"), "total").when((cell(0) == "") & (n == 1) & (one != ""), F.when(reduce(lambda a, b: a | b, (one.startswith(x) for x in MINISTRY)), "ministry_heading").otherwise("sector_heading")).when(n == 0, "empty"))
    # of milestone files: whether the record that is open has its code, and whether any is open
    coded = F.when(number(0) | one.rlike(rf"\[({f.CODE})\]"), one.rlike(rf"\[({f.CODE})\]"))
    before = walk().rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_coded", F.last(coded, True).over(before)).withColumn("_closed", F.last(F.when(number(0), False).when((cell(0) == "") & (n == 1) & (is_sector | (F.lower(one) == "total")), True), True).over(before))
    kind = F.when(header_layout(F.col("cells")).isNotNull(), "header").otherwise(F.coalesce(F.when(F.col("layout") == ANNEXURE, annexure).when(F.col("layout") == MILESTONES, milestones).when(F.col("layout").startswith("NINE"), grouped).otherwise(plain), F.lit("unclassified")))
    return rows.withColumn("row_class", kind).drop("_coded", "_closed")


def _key(label: str) -> str:
    return label.lower().replace(" ", "")


def merged_label(current: str | None, piece: str) -> str:
    """A label and a fragment of it: by containment, by words that both share, else one after the other."""
    if current is None:
        return piece
    if _key(piece) in _key(current):
        return current
    if _key(current) in _key(piece):
        return piece
    a, b = current.split(" "), piece.split(" ")
    low_a, low_b = [x.lower() for x in a], [x.lower() for x in b]
    shared = next((k for k in range(min(len(a), len(b)), 0, -1) if low_a[-k:] == low_b[:k]), 0)
    return " ".join([*a, *b[shared:]])


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of label rows in order the final label of each group. Only the group that is open is held."""
    file = now = group = None
    for batch in batches:
        done = []
        for source, number, start, label in zip(*(batch.column(c).to_pylist() for c in ("source_file", "grp", "start", "label"))):
            if source != file:
                if now is not None:
                    done.append((file, group, now))
                file, now, group = source, None, 0
            if start:
                if now is not None:
                    done.append((file, group, now))
                now, group = now if now is not None and _key(label) in _key(now) else label, number
            else:
                now = merged_label(now, label)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["source_file", "grp", "label"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([group], pa.int64()), pa.array([now])], names=["source_file", "grp", "label"])


def group_labels(rows: DataFrame, *labels: tuple[int, str]) -> DataFrame:
    """Of nine-column files the labels of each project row, by (cell, name): groups begin where a project row has one; fragments that come
    later complete the label of the whole group (C08). Adds the names.

    The label rows of a file, a few for each page, pass in order through one task, which holds the open group only; rows meet
    their group's label by file and group number. rows is read once for each label and once more."""
    given = {name: F.col(f"_{name}") for _, name in labels}
    rows = rows.withColumns({f"_{name}": F.nullif(cell(i), F.lit("")) for i, name in labels})  # before rows move: pieces move without their cells
    starts = {name: (F.col("row_class") == "project") & label.isNotNull() for name, label in given.items()}
    out = numbered = rows.select("*", *[F.sum(start.cast("int")).over(so_far()).alias(f"grp_{name}") for name, start in starts.items()])
    for name, label in given.items():
        pieces = numbered.where(label.isNotNull() & F.col("row_class").isin("project", "fragment")).select("source_file", "raw_sequence", F.col(f"grp_{name}").alias("grp"), starts[name].alias("start"), label.alias("label"))
        found = pieces.repartition("source_file").sortWithinPartitions("source_file", "raw_sequence").drop("raw_sequence").mapInArrow(_labelled, "source_file string, grp bigint, label string")
        out = out.join(found.where("grp > 0").withColumnsRenamed({"label": name, "grp": f"grp_{name}"}), ["source_file", f"grp_{name}"], "left")
    return out.drop(*[f"{x}{name}" for name in given for x in ("grp_", "_")])


def filled(rows: DataFrame) -> DataFrame:
    """ministry, sector and state of each row from the headings above; a ministry heading resets the sector."""
    heading = lambda kind: F.when(F.col("row_class") == kind, cell(1))
    r = rows.withColumn("ministry", F.last(heading("ministry_heading"), True).over(so_far())).withColumn("_run", F.sum((F.col("row_class") == "ministry_heading").cast("int")).over(so_far()))
    by_run = Window.partitionBy("source_file", "_run").orderBy("raw_sequence").rowsBetween(Window.unboundedPreceding, 0)
    return r.withColumn("h_sector", F.last(heading("sector_heading"), True).over(by_run)).withColumn("h_state", F.last(F.when(F.col("row_class") == "state_heading", F.upper(cell(1))), True).over(so_far())).drop("_run")


def merged(rows: DataFrame) -> DataFrame:
    """Continuations join the record before them cell by cell (annexure names by a blank, others by a new line); pages spanned."""
    stops = F.col("row_class").isin("project", "sector_heading", "total", "agency_heading") | ((F.col("layout") != MILESTONES) & F.col("row_class").isin("merged_serial", "bled_serial"))
    r = rows.withColumn("run", F.sum(stops.cast("int")).over(so_far())).where(F.col("row_class").isin("project", "continuation"))
    g = r.groupBy("source_file", "run").agg(F.array_sort(F.collect_list(F.struct("raw_sequence", "cells"))).alias("x"), F.min_by(F.struct("row_class", "layout", "raw_sequence", "source_page", "ministry", "h_sector", "h_state", "sector", "state"), "raw_sequence").alias("head"), F.max("source_page").alias("last_page"))
    g = g.where("head.row_class = 'project'")
    at = lambda i: F.filter(F.transform("x", lambda y: F.coalesce(F.try_element_at(y["cells"], i + 1), F.lit(""))), lambda t: F.trim(t) != "")
    cells = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.when(F.col("head.layout") == ANNEXURE, F.array_join(at(i), " ")).otherwise(F.array_join(at(i), "\n")))
    return g.select("source_file", "head.*", cells.alias("cells"), "last_page")


def _record(rows: DataFrame, month, serial: Column, identity: dict[str, Column], given: dict[str, Column]) -> DataFrame:
    """One projection onto the 31 columns: identity as it is, given values raw and parsed; what a layout lacks is null."""
    none = F.lit(None).cast("string")
    ids = [identity.get(k, none).alias(k) for k in ("project_code", "legacy_ocms_code", "pmgid", "project_name", "agency", "ministry", "sector", "state")]
    dates = ("approval_date", "start_date", "original_completion_date", "revised_completion_date")
    numbers = ("original_cost", "revised_cost", "cumulative_expenditure", "physical_progress")
    rows = rows.select("*", *[given.get(k, none).alias(f"{k}_raw") for k in (*dates, *numbers)])
    pages = F.when(F.col("last_page") > F.col("source_page"), F.concat_ws("-", "source_page", "last_page")).otherwise(F.col("source_page").cast("string"))
    return rows.select(
        *ids, *[month(F.col(f"{k}_raw")).alias(k) for k in dates], *[text.number(F.col(f"{k}_raw")).alias(k) for k in numbers], F.col("source_file").alias("report_month"), *[f"{k}_raw" for k in (*dates, *numbers)],
        "source_file", "source_page", pages.alias("source_pages"), F.col("raw_sequence").alias("source_row_number"), text.squeeze(serial).try_cast("int").alias("source_serial_number"), F.lit(METHOD).alias("extraction_method"))


def records(joined: DataFrame, states: list[str]) -> DataFrame:
    """The 31 columns of a record, by a projection for each layout."""
    c = lambda i: F.element_at("cells", i + 1)
    of = lambda name: joined.where(F.col("layout").startswith(name))
    bare = lambda x: F.nullif(text.squeeze(x), F.lit(""))
    ids = lambda *names: {n: F.col(f"i.{n}") for n in names}
    spent = F.try_element_at(text.cell_lines(c(5)), F.lit(1))
    spent = text.identifier(F.when(~spent.rlike(r"^[(\[]"), spent))
    pair = lambda rows, *names: rows.select("*", *[text.parenthesized_pair(c(i)).alias(n) for i, n in names])
    three = lambda rows, *names: rows.select("*", *[text.triplet(c(i)).alias(n) for i, n in names])
    two = {"original_completion_date": F.col("doc.original"), "revised_completion_date": F.col("doc.revised"), "original_cost": F.col("cost.original"), "revised_cost": F.col("cost.revised")}
    eight = _record(
        pair(of("EIGHT"), (3, "begun"), (4, "doc"), (5, "cost")).withColumn("i", f.project_identity(c(1))), text.month, c(0),
        {**ids("project_code", "legacy_ocms_code", "pmgid", "project_name", "agency"), "ministry": F.col("ministry"), "sector": F.col("h_sector"), "state": bare(c(2))},
        {"approval_date": F.col("begun.first"), "start_date": F.col("begun.second"), "original_completion_date": F.col("doc.first"), "revised_completion_date": F.col("doc.second"), "original_cost": F.col("cost.first"), "revised_cost": F.col("cost.second"), "cumulative_expenditure": bare(c(6)), "physical_progress": bare(c(7))})
    nine = _record(
        three(of("NINE"), (5, "doc"), (6, "cost")).withColumn("i", f.legacy_identity(c(3))), text.legacy_month, c(2),
        {**ids("project_code", "project_name", "agency"), "sector": F.col("sector"), "state": F.col("state")}, {"approval_date": text.identifier(c(4)), **two, "cumulative_expenditure": text.identifier(c(7)), "physical_progress": text.identifier(c(8))})
    annexure = _record(
        three(of("ANNEXURE"), (3, "doc"), (4, "cost")), text.legacy_month, c(0), {"project_name": text.squeeze(c(1)), "sector": F.col("h_sector"), "state": F.col("h_state")}, {"approval_date": text.identifier(c(2)), **two, "cumulative_expenditure": spent})
    milestones = _record(
        three(of("MILESTONES"), (3, "doc"), (4, "cost")).withColumn("i", f.milestone_identity(c(1), states)), text.legacy_month, c(0),
        {**ids("project_code", "project_name", "agency", "state"), "sector": F.upper("h_sector")}, {"approval_date": text.identifier(c(2)), **two, "cumulative_expenditure": spent})
    return eight.unionByName(nine).unionByName(annexure).unionByName(milestones)


def routed(found: DataFrame, coded: bool = True) -> DataFrame:
    """Records of files whose layout has identifiers; or (coded=False) of those without, which stay out of the panel (C17)."""
    files = found.groupBy("source_file").agg(F.bool_or(F.col("project_code").isNotNull()).alias("has"))
    return found.join(files.where("has" if coded else "not has").select("source_file"), "source_file", "left_semi")


def repaired_codes(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Codes that slipped to the row below go back (C09). rows: source_file, source_page, raw_sequence, serial (int, may be null), lines
    (of the project cell); pages: source_file, source_page, page_text. Returns lines as mended and the method.

    A leading code moves up if serials are adjacent, the row above has no code of its own left, and the row has another code or the next
    row leads with one too. A last row without code gets the page's last code if it is the only one that no row has."""
    is_code = lambda x: x.rlike(rf"^\(({f.CODE})\)$")
    leads = lambda xs: F.coalesce(is_code(F.try_element_at(xs, F.lit(1))), F.lit(False))
    page = rows.groupBy("source_file", "source_page").agg(F.array_sort(F.collect_list(F.struct("raw_sequence", "serial", "lines"))).alias("r"))  # the rows of one page
    nexts = F.transform("r", lambda x, i: F.struct(x["raw_sequence"].alias("raw_sequence"), x["serial"].alias("serial"), x["lines"].alias("lines"), leads(F.coalesce(F.get(F.col("r"), i + 1)["lines"], F.array().cast("array<string>"))).alias("next")))

    def step(acc: Column, x: Column) -> Column:
        # what the row above still holds: its own leading code has moved on if it was displaced too
        left = F.when(acc["moved"], F.slice(acc["lines"], 2, F.greatest(F.size(acc["lines"]) - 1, F.lit(0)))).otherwise(acc["lines"])
        others = F.exists(F.slice(x["lines"], 2, F.greatest(F.size(x["lines"]) - 1, F.lit(0))), is_code)
        moves = F.coalesce(leads(x["lines"]) & (x["serial"] == acc["serial"] + 1) & ~F.exists(left, is_code) & (others | x["next"]), F.lit(False))
        return F.struct(moves.alias("moved"), x["lines"].alias("lines"), x["serial"].alias("serial"), F.concat(acc["all"], F.array(moves)).alias("all"))

    begin = F.struct(F.lit(False).alias("moved"), F.array().cast("array<string>").alias("lines"), F.lit(None).cast("int").alias("serial"), F.array().cast("array<boolean>").alias("all"))
    page = page.withColumn("r", nexts).withColumn("moved", F.aggregate("r", begin, step, lambda a: a["all"]))
    tail = lambda xs: F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0)))
    mended = F.transform("r", lambda x, i: F.struct(
        x["raw_sequence"].alias("raw_sequence"), x["serial"].alias("serial"), F.concat(F.when(F.get("moved", i), tail(x["lines"])).otherwise(x["lines"]), F.when(F.coalesce(F.get("moved", i + 1), F.lit(False)), F.slice(F.get(F.col("r"), i + 1)["lines"], 1, 1)).otherwise(F.array().cast("array<string>"))).alias("lines"),
        F.when(F.coalesce(F.get("moved", i + 1), F.lit(False)), "adjacent_serial_and_code_chain").alias("method")))
    page = page.withColumn("r", mended).join(pages, ["source_file", "source_page"], "left")
    have = F.flatten(F.transform("r", lambda x: F.filter(x["lines"], is_code)))
    said = F.transform(F.regexp_extract_all(F.coalesce("page_text", F.lit("")), F.lit(rf"\(({f.CODE})\)")), lambda x: F.concat(F.lit("("), x, F.lit(")")))
    count = lambda xs, v: F.size(F.filter(xs, lambda y: y == v))
    # as often as the page prints it beyond the rows that have it
    free = F.flatten(F.transform(F.array_distinct("said"), lambda v: F.array_repeat(v, F.greatest(count(F.col("said"), v) - count(F.col("have"), v), F.lit(0)))))
    page = page.withColumn("have", have).withColumn("said", said).withColumn("free", free)
    last = F.array_max(F.transform(F.filter("r", lambda x: x["serial"].isNotNull()), lambda x: x["raw_sequence"]))
    sure = (F.size("free") == 1) & (F.element_at("free", 1) == F.element_at("said", -1))
    back = lambda x: F.coalesce(sure & (x["raw_sequence"] == last) & ~F.exists(x["lines"], is_code), F.lit(False))
    out = page.select("source_file", "source_page", F.inline(F.transform("r", lambda x: F.struct(
        x["raw_sequence"].alias("raw_sequence"), x["serial"].alias("serial"), F.when(back(x), F.concat(x["lines"], F.slice("free", 1, 1))).otherwise(x["lines"]).alias("lines"), F.when(back(x), "unique_unassigned_final_page_code").otherwise(x["method"]).alias("method")))))
    return out


def rejects(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows that go nowhere, with why, and records without a code, which are listed as well as kept."""
    # Reasons.
    why = {"merged_serial": "multiple_source_projects_merged_in_one_detected_row", "bled_serial": "serial_project_cell_bleed", "omitted_serial": "source_omitted_serial_project_row", "empty": "empty_table_row", "unclassified": "unclassified_non_project_row"}
    reason = F.lit(None).cast("string")
    for k, v in why.items():
        reason = F.when(F.col("row_class") == k, v).otherwise(reason)
    bad = rows.withColumn("reason", reason).where("reason is not null").select("source_file", "raw_sequence", "reason")
    return bad.unionByName(routed(found).where("project_code is null").select("source_file", F.col("source_row_number").alias("raw_sequence"), F.lit("missing_project_code").alias("reason")))


def completed_classes(raw: DataFrame) -> DataFrame:
    """row_class, ministry, sector and banner month of completion rows (C05, C06, C12). layout: FIVE, SIX or SEVEN."""
    n, low = _populated(), F.lower(F.array_join("cells", " "))
    rest = lambda k: F.size(F.filter(F.slice("cells", k + 1, 9), lambda x: text.squeeze(x) != "")) == 0
    header = F.lower(cell(0)).rlike("month wise list|sl")
    banner = text.banner_month(cell(1))
    five = F.when(header, "header").when(n == 0, "empty").when((cell(0) == "") & banner.isNotNull() & rest(2), "month_heading").when((cell(0) == "") & (cell(1) != "") & rest(2), "sector_heading").when(cell(0).rlike("^[0-9]+$"), "project").when(F.contains(low, F.lit("total")), "total")
    repeated = F.lower(F.concat_ws(" ", cell(0), cell(1))).contains("sl") & F.lower(F.array_join(F.slice("cells", 3, 9), " ")).contains("cost")
    six = F.when(repeated, "header").when((cell(0) != "") & ~cell(1).rlike("^[0-9]+$") & rest(2), "sector_heading").when(n == 0, "empty").when(~cell(1).rlike("^[0-9]+$"), F.when(F.contains(low, F.lit("total")), "total").otherwise("empty")).otherwise("project")
    seven = (F.when(repeated, "header").when(cell(0).rlike("^[0-9]+$"), "project").when(n == 0, "empty").when(F.contains(F.lower(cell(1)), F.lit("total")), "total")
             .when(cell(1).startswith("Ministry of") | cell(1).startswith("Department of"), "ministry_heading").when(cell(1) != "", "sector_heading").otherwise("empty"))
    r = raw.withColumn("row_class", F.coalesce(F.when(F.col("layout") == "FIVE", five).when(F.col("layout") == "SIX", six).otherwise(seven), F.lit("unclassified")))
    r = r.withColumn("banner", F.last(F.when(F.col("row_class") == "month_heading", banner), True).over(so_far())).withColumn("_run", F.sum((F.col("row_class") == "ministry_heading").cast("int")).over(so_far()))
    r = r.withColumn("ministry", F.last(F.when(F.col("row_class") == "ministry_heading", cell(1)), True).over(so_far()))
    by_run = Window.partitionBy("source_file", "_run").orderBy("raw_sequence").rowsBetween(Window.unboundedPreceding, 0)
    return r.withColumn("sector", F.last(F.when(F.col("row_class") == "sector_heading", F.when(F.col("layout") == "SIX", cell(0)).otherwise(cell(1))), True).over(by_run)).drop("_run")


def of_month(rows: DataFrame) -> DataFrame:
    """A cumulative ledger lists earlier months too: their projects become prior_cumulative_project and go no further."""
    prior = (F.col("layout") == "FIVE") & (F.col("row_class") == "project") & ~F.col("banner").eqNullSafe(F.col("report_month"))
    return rows.withColumn("row_class", F.when(prior, "prior_cumulative_project").otherwise(F.col("row_class")))


def completed_records(rows: DataFrame) -> DataFrame:
    """Completion records of the three layouts (C11)."""
    p = rows.where("row_class = 'project'").select(
        "*", f.five_column_identity(F.element_at("cells", 2)).alias("i5"), f.six_column_identity(F.element_at("cells", 3)).alias("i6"), text.composite(F.element_at("cells", 2)).alias("i7"),
        f.approval_and_start(F.try_element_at("cells", F.lit(4))).alias("begun"), f.completion_dates(F.try_element_at("cells", F.lit(5))).alias("doc"), F.filter(F.split(F.coalesce(F.try_element_at("cells", F.lit(6)), F.lit("")), "\n"), lambda x: F.trim(x) != "").alias("costs"))
    by = lambda five, six, seven: F.when(F.col("layout") == "FIVE", five).when(F.col("layout") == "SIX", six).otherwise(seven)
    none = F.lit(None).cast("string")
    month, cost = f.completed_month, f.completed_cost
    return p.select(
        by(F.col("i5.project_code"), F.col("i6.project_code"), F.col("i7.code")).alias("project_code"), by(F.col("i5.project_name"), F.col("i6.project_name"), F.col("i7.name")).alias("project_name"), by(F.col("i5.agency"), F.col("i6.agency"), F.col("i7.agency")).alias("agency"),
        F.when(F.col("layout") == "SEVEN", F.col("ministry")).alias("ministry"), by(F.col("sector"), F.coalesce(F.nullif(cell(0), F.lit("")), "sector"), F.col("sector")).alias("sector"), by(none, F.col("i6.state"), cell(2)).alias("state"),
        month(by(none, none, F.col("begun.approval"))).alias("approval_date"), month(by(none, none, F.col("begun.start"))).alias("start_date"), month(by(cell(3), cell(4), F.col("doc.original"))).alias("original_completion_date"), month(by(none, none, F.col("doc.revised"))).alias("revised_completion_date"),
        month(by(none, none, F.col("doc.actual"))).alias("actual_completion_date"), cost(by(cell(2), cell(3), F.get("costs", F.lit(0)))).alias("original_cost"), cost(by(none, none, F.get("costs", F.lit(1)))).alias("revised_cost"), cost(by(cell(4), cell(5), cell(6))).alias("cumulative_expenditure"),
        "report_month", "source_file", "source_page", F.col("raw_sequence").alias("source_row_number"), by(cell(0), cell(1), cell(0)).try_cast("int").alias("source_serial_number"), F.lit(METHOD).alias("extraction_method"))
