"""A failing case for every gate; months re-validated alone; serial ranges; raw cells joined in their buckets."""

import os

import pytest
from pyspark.sql import functions as F

from milepost.operators import contracts, longitudinal, revalidation, serials
from milepost.operators.contracts import Contract, ContractError

CONTRACT = Contract("label", 3, ("project_code", "report_month"), ("label",), expected={"LEGACY": (2, 1)})
SAID = {"target": {"name": "label", "horizon": 3}, "features": {"ordered": ["a", "b"], "count": 2, "metadata": ["m"], "forbidden": ["c"]}, "segments": [("S", "LEGACY", "1995-01", "1996-11")], "expected": {"LEGACY": [2, 1]}}


def table(spark, *rows):
    return spark.createDataFrame(list(rows), "project_code string, report_month string, label int")


def test_description():
    assert contracts.read(SAID).features == ("a", "b")
    for section in contracts.SECTIONS:
        with pytest.raises(ContractError, match="sections missing"):
            contracts.read({k: v for k, v in SAID.items() if k != section})
    with pytest.raises(ContractError, match="features are named"):
        contracts.read(SAID | {"features": {"ordered": ["a"], "count": 2}})
    with pytest.raises(ContractError, match="know the future"):
        contracts.no_leakage(Contract("y", 3, (), ("a", "b"), ("b",)))
    contracts.same_target(CONTRACT, "label", 3)
    with pytest.raises(ContractError, match="over 6 months"):
        contracts.same_target(CONTRACT, "label", 6)
    with pytest.raises(ContractError, match="segments differ"):
        contracts.same_segments(CONTRACT, list(CONTRACT.segments[1:]))


def test_columns(spark):
    df = table(spark, ("p", "1995-01", 1))
    assert contracts.same_columns(df, CONTRACT) is df
    for other, said in ((df.drop("label"), "missing"), (df.withColumn("more", F.lit(1)), "not in the contract"), (df.select("label", "project_code", "report_month"), "another order")):
        with pytest.raises(ContractError, match=said):
            contracts.same_columns(other, CONTRACT)


@pytest.mark.parametrize("row, said", [((None, "1995-01", 1), "no key"), (("p", "1995-02", 2), "neither 0 nor 1"), (("p", "1995-02", None), "neither 0 nor 1"), (("p", "1996-12", 1), "outside of every segment"), (("p", "1996-09", 1), "leaves its segment")])
def test_rows(spark, row, said):
    good = [("p", "1995-01", 1), ("q", "1996-08", 0)]
    assert contracts.sound(table(spark, *good), CONTRACT).count() == 2
    with pytest.raises(Exception, match=said):
        contracts.sound(table(spark, *good, row), CONTRACT).collect()


@pytest.mark.parametrize("rows, status", [
    ([("p", "1995-01", 1), ("q", "1995-01", 0)], "PASS"), ([("p", "1995-01", 1)], "ROW_COUNT"), ([("p", "1995-01", 0), ("q", "1995-01", 0)], "POSITIVE_COUNT"), ([("p", "1995-01", 1), ("p", "1995-01", 1)], "KEY_REPEATED"),
    ([(None, "1995-01", 1), ("q", "1995-01", 0)], "KEY_MISSING"), ([("p", "1995-01", 3), ("q", "1995-01", 0)], "LABEL_DOMAIN"), ([("p", "1996-10", 1), ("q", "1995-01", 0)], "SEGMENT"),
])
def test_gates(spark, rows, status):
    assert contracts.gates(table(spark, *rows).withColumn("regime", F.lit("LEGACY")), CONTRACT, "regime").first()["status"] == status


def test_observed(spark):
    df, seen = contracts.observed(table(spark, ("p", "1995-01", 1), ("q", "1995-01", 0), ("r", "1995-01", 0)), CONTRACT)
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"n_rows": 3, "positives": 1, "negatives": 2}


def test_refusals(spark):
    twice = table(spark, ("p", "1995-01", 1), ("p", "1995-01", 0))
    with pytest.raises(Exception, match="more than once"):
        contracts.once(twice, "project_code", "report_month").collect()
    with pytest.raises(Exception, match="outside of every segment"):
        contracts.assigned(table(spark, ("p", "1994-01", 1))).collect()
    with pytest.raises(Exception, match="inside the embargo"):
        contracts.embargoed(spark.createDataFrame([("p", "x", 10)], "project_code string, report_month string, mi int"), 13, 3).collect()
    assert contracts.embargoed(spark.createDataFrame([("p", "x", 9)], "project_code string, report_month string, mi int"), 13, 3).count() == 1
    files = spark.createDataFrame([("f", "NINE"), ("f", "EIGHT")], "source_file string, layout string")
    with pytest.raises(Exception, match="layout changes"):
        contracts.one_layout(files).collect()
    assert contracts.one_layout(files.where("layout = 'NINE'")).count() == 1
    left = table(spark, ("p", "1995-01", 1))
    with pytest.raises(Exception, match="no partner"):
        contracts.joined_once(left, table(spark, ("q", "1995-01", 1)).withColumnRenamed("label", "other"), ["project_code", "report_month"]).collect()
    with pytest.raises(Exception, match="more than once"):
        contracts.joined_once(left, twice.withColumnRenamed("label", "other"), ["project_code", "report_month"]).collect()
    records = spark.createDataFrame([("p", "1995-01", "A", "x"), ("p", "1995-01", "B", "y"), ("q", "1995-02", "A", "b")], "project_code string, report_month string, regime string, sector string")
    with pytest.raises(Exception, match="several regimes"):
        contracts.exact(records, "p", "1995-01").collect()
    assert contracts.exact(records, "q", "1995-02").count() == 1
    with pytest.raises(Exception, match="no records in 1990-01"):
        contracts.options(records, "1990-01", "sector").collect()


def test_options_without_case(spark):
    records = spark.createDataFrame([("p", "1995-02", x) for x in ("b", "A", "C", "a", "", None)] + [("p", "1995-01", "z")], "project_code string, report_month string, sector string")
    row = contracts.options(records, None, "sector").first()
    assert (row["month"], row["months"], row["values"]) == ("1995-02", ["1995-01", "1995-02"], ["A", "a", "b", "C"])


SCHEMA = "project_code string, report_month string, start_date string, original_completion_date string, revised_completion_date string, original_cost decimal(14,2), revised_cost decimal(14,2), cumulative_expenditure decimal(14,2), physical_progress decimal(6,2)"


def test_only_changed_months_are_written_again(spark, tmp_path):
    from decimal import Decimal as D

    row = lambda code, month, progress: (code, month, None, None, None, D(10), None, D(1), D(progress))
    first = [row("123456", "2001-01", 120), row("123456", "2001-02", 50), row("123456", "2001-03", 130), row("bad", "2001-04", 1)]
    files = lambda: {m: sorted(os.listdir(f"{tmp_path}/warnings/report_month={m}")) for m in ("2001-01", "2001-02", "2001-03", "2001-04") if os.path.isdir(f"{tmp_path}/warnings/report_month={m}")}
    said = lambda: {(r["report_month"], r["rule"], r["checked"]) for r in revalidation.warnings(spark, str(tmp_path)).collect()}
    assert revalidation.revalidated(spark.createDataFrame(first, SCHEMA), str(tmp_path), "one", False) == ["2001-01", "2001-02", "2001-03", "2001-04"]
    before = files()
    assert ("2001-01", "physical_progress_above_100", "one") in said()
    second = [row("123456", "2001-01", 20), row("123456", "2001-02", 50), row("123456", "2001-03", 130)]
    assert revalidation.revalidated(spark.createDataFrame(second, SCHEMA), str(tmp_path), "two", True) == ["2001-01"]
    after = files()
    assert before["2001-02"] == after["2001-02"] and before["2001-03"] == after["2001-03"] and before["2001-01"] != after["2001-01"] and "2001-04" not in after
    assert {x for x in said() if x[0] == "2001-01"} == {("2001-01", "ROWS", "two")}
    assert revalidation.revalidated(spark.createDataFrame(second, SCHEMA), str(tmp_path), "three", True) == []
    with pytest.raises(ValueError):
        revalidation.revalidated(spark.createDataFrame(second, SCHEMA), str(tmp_path), "four", False)


def test_serial_ranges(spark):
    rows = [("m1", k) for k in (1, 2, 4, 4, 900)] + [("m2", k) for k in range(60, 200)] + [("m3", 1), ("m3", None)]
    df = spark.createDataFrame([(m, m, 1, i, k, "grid") for i, (m, k) in enumerate(rows)], "report_month string, source_file string, source_page int, source_row_number int, source_serial_number int, extraction_method string")
    ranges = spark.createDataFrame([("m2", 60, 150), ("m2", 151, 199)], "report_month string, low int, high int")
    out = {r["report_month"]: r for r in serials.checked(df, ranges).collect()}
    pick = lambda m: tuple(out[m][c] for c in ("islands", "gaps", "foreign", "repeated", "overlaps", "without_provenance", "status"))
    assert pick("m1") == (3, 2, 1, 1, 0, 0, "FOREIGN_SERIAL")
    assert pick("m2") == (1, 0, 0, 0, 0, 0, "ACCEPTED")
    assert pick("m3") == (1, 1, 0, 0, 0, 1, "SERIAL_GAP")
    over = serials.checked(df, ranges.unionByName(spark.createDataFrame([("m2", 70, 80)], "report_month string, low int, high int")))
    assert {r["report_month"]: r["status"] for r in over.collect()}["m2"] == "RANGES_OVERLAP"


def test_raw_cells_stay_in_their_buckets(spark, tmp_path):
    raw = spark.createDataFrame([(f"m{m}", p, r, [f"{m}/{p}/{r}"]) for m in range(3) for p in range(4) for r in range(30)], "report_month string, source_page int, source_row_number int, cells array<string>")
    cells = longitudinal.bucketed(raw, "cells_of_test", str(tmp_path / "cells"))
    events = spark.createDataFrame([("x", "m0", 1, 2, "m1", 3, 4), ("y", "m1", 0, 0, "m2", 9, 9)], "project_code string, month_a string, page_a int, row_a int, month_b string, page_b int, row_b int")
    out = longitudinal.with_raw_cells(events, cells)
    got = {r["project_code"]: (r["previous_raw_cells"], r["current_raw_cells"]) for r in out.collect()}
    assert got == {"x": (["0/1/2"], ["1/3/4"]), "y": (["1/0/0"], None)}
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    scans = [i for i, line in enumerate(plan) if "Scan parquet" in line and "cells_of_test" in line]
    assert len(scans) == 2
    for i in scans:  # between a scan of cells and its join there is no exchange
        depth = lambda line: len(line) - len(line.lstrip(" :+-*(0123456789)"))
        above, last = [], depth(plan[i])
        for line in reversed(plan[:i]):
            if depth(line) < last:
                above.append(line)
                last = depth(line)
            if "Join" in line and above and above[-1] is line:
                break
        assert not any("Exchange" in line for line in above), above
    spark.sql("DROP TABLE cells_of_test")
