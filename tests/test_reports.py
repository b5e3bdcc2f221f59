"""Cells, labels and displaced codes on literal rows."""

import pytest
from pyspark.sql import functions as F

from milepost.functions import cells, text
from milepost.operators import reports


def one(spark, value, parse):
    return spark.createDataFrame([(value,)], "c string").select(parse(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize("value, want", [("1,234.50 %", 1234.5), ("(12)", 12.0), ("1e5", 100000.0), ("1 234", None), ("n / a", None), ("( 3 )", 3.0), (None, None), ("", None)])
def test_numbers(spark, value, want):
    assert one(spark, value, text.number) == want


@pytest.mark.parametrize("value, want", [("3-1821", None), ("Mar2021", None), ("Mar-1921", None), ("M a r -2 1", "2021-03"), ("2 - 2 0 1 8", "2018-02"), ("Mar-2021", "2021-03"), ("13-2020", None), ("March/21", None), (None, None)])
def test_legacy_months(spark, value, want):
    assert one(spark, value, text.legacy_month) == want


@pytest.mark.parametrize("value, want", [
    ("Line A\nphase 2\n(Agency\nof X)\n(612786)\n(N01000001) (9)", ("Line A phase 2", "Agency of X", "612786", "N01000001", "9")),
    ("Line A\n(Agency)\n(612786)\n(N01000001)\n(77)", ("Line A", "Agency", "612786", "N01000001", "77")),
    ("Line A\n(612786)\ntext", ("Line A", None, "612786", None, None)), ("no code", ("no code", None, None, None, None)), (None, ("", None, None, None, None)),
])
def test_project_identity(spark, value, want):
    assert tuple(one(spark, value, cells.project_identity)) == want


@pytest.mark.parametrize("value, want", [("Road (east) (NHAI (N)) (N12345678)", ("Road (east)", "NHAI (N)", "N12345678")), ("Road (123456789)", ("Road", None, "123456789")), ("Road) (N12345678)", ("Road)", None, "N12345678")), ("Road", ("Road", None, None))])
def test_legacy_identity(spark, value, want):
    assert tuple(one(spark, value, cells.legacy_identity)) == want


@pytest.mark.parametrize("now, piece, want", [(None, "UTTAR", "UTTAR"), ("UTTAR PRADESH", "pradesh", "UTTAR PRADESH"), ("UTTAR", "UTTAR PRADESH", "UTTAR PRADESH"), ("ROAD TRANSPORT", "TRANSPORT AND HIGHWAYS", "ROAD TRANSPORT AND HIGHWAYS"), ("ROAD", "AIR", "ROAD AIR")])
def test_label_fragments(now, piece, want):
    assert reports.merged_label(now, piece) == want


def test_group_labels(spark):
    """Fragments complete the group before them, a shorter label that begins a group again keeps the longer one; each file for itself."""
    rows = [("f", 1, "project", "UTTAR"), ("f", 2, "project", ""), ("f", 3, "fragment", "PRADESH"), ("f", 4, "project", "Uttar"), ("f", 5, "project", "GOA"), ("f", 6, "total", "x"), ("g", 1, "project", ""), ("g", 2, "project", "ASSAM"), ("g", 3, "fragment", "ASSAM REGION"), ("h", 1, "project", "")]
    df = spark.createDataFrame([(f, n, k, [c]) for f, n, k, c in rows], "source_file string, raw_sequence int, row_class string, cells array<string>").repartition(3)
    got = {(r["source_file"], r["raw_sequence"]): r["state"] for r in reports.group_labels(df, (0, "state")).collect()}
    assert got == {("f", 1): "UTTAR PRADESH", ("f", 2): "UTTAR PRADESH", ("f", 3): "UTTAR PRADESH", ("f", 4): "UTTAR PRADESH", ("f", 5): "GOA", ("f", 6): "GOA", ("g", 1): None, ("g", 2): "ASSAM REGION", ("g", 3): "ASSAM REGION", ("h", 1): None}


def test_code_printed_twice_and_assigned_once(spark):
    a = "(N00000001)"
    df = spark.createDataFrame([("f", 1, 1, 1, ["p1", a]), ("f", 1, 2, 2, ["p2"])], "source_file string, source_page int, raw_sequence int, serial int, lines array<string>")
    page = lambda said: spark.createDataFrame([("f", 1, said)], "source_file string, source_page int, page_text string")
    last = lambda said: {r["raw_sequence"]: r["lines"] for r in reports.repaired_codes(df, page(said)).collect()}[2]
    assert last(f"{a} {a}") == ["p2", a]
    assert last(f"{a} {a} {a}") == ["p2"]  # two are free
    assert last(a) == ["p2"]


def test_displaced_codes(spark):
    a, b, c, d = ("(N0000000%d)" % i for i in range(1, 5))
    rows = [(1, 1, ["p1"]), (2, 2, [a, "p2"]), (3, 3, [b, "p3", c]), (4, 4, ["p4"]), (5, None, ["total"])]
    df = spark.createDataFrame([("f", 1, *r) for r in rows], "source_file string, source_page int, raw_sequence int, serial int, lines array<string>")
    mend = lambda said: {r["raw_sequence"]: r["lines"] for r in reports.repaired_codes(df, spark.createDataFrame([("f", 1, said)], "source_file string, source_page int, page_text string")).collect()}
    assert mend(f"{a} {b} {c} {d}") == {1: ["p1", a], 2: ["p2", b], 3: ["p3", c], 4: ["p4", d], 5: ["total"]}
    assert mend(f"{d} {a} {b} {c}")[4] == ["p4"]  # free, but not the last one on the page
    assert mend("")[4] == ["p4"]


def test_cells_of_a_header_are_read_once(spark):
    """All layouts look at the same squeezed cells; a file's first words decide, whatever their case and blanks."""
    cells = [" Si.No", "PROJECT", "Approval ", "Com\nCommissioning", "Cost", None]
    df = spark.createDataFrame([(cells,), ([*cells[:5], "expenditure"],), (None,)], "cells array<string>")
    out = df.select(reports.header_layout(F.col("cells")).alias("x"))
    assert out._jdf.queryExecution().analyzed().toString().count("regexp_replace(") == 1
    assert [r["x"] for r in out.collect()] == [None, "ANNEXURE", None]


def test_only_nine_column_files_get_group_labels(spark):
    """The serial of another layout stands in the cell of the state; it is no label, and such rows are not joined."""
    from milepost.plans import rawrows

    rows = [("f", 1, "NINE", "project", ["UTTAR", "Rail"]), ("f", 2, "NINE", "fragment", ["PRADESH", ""]), ("g", 1, "EIGHT", "project", ["1", "Bridge"]), ("h", 1, None, "unclassified", ["x", "y"])]
    df = spark.createDataFrame(rows, "source_file string, raw_sequence int, layout string, row_class string, cells array<string>")
    got = {(r["source_file"], r["raw_sequence"]): (r["state"], r["sector"]) for r in rawrows.labelled(df).collect()}
    assert got == {("f", 1): ("UTTAR PRADESH", "Rail"), ("f", 2): ("UTTAR PRADESH", "Rail"), ("g", 1): (None, None), ("h", 1): (None, None)}
