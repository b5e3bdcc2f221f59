"""Rules that a query and its SQL have to state alike, on rows that the small tables don't hold."""

import duckdb
from pyspark.sql import functions as F

from milepost.operators import reports
from milepost.plans import gates, rawrows, text


def test_brackets_of_a_six_column_state_go_in_query_and_sql(spark):
    cells = ["", "1", f"Canal\n(ABC)\n(N00000012)\n({rawrows.NONE})", "12.00", "(01/2002)", "3.00"]
    row = spark.createDataFrame([("2001-01", "SIX", "project", "Water", None, 4, 1, cells)], "source_file string, layout string, row_class string, sector string, ministry string, raw_sequence int, source_page int, cells array<string>")
    got = reports.completed_records(row.withColumn("report_month", F.col("source_file"))).first()["state"]
    expression = rawrows.LEDGER_STATE.format(NONE=rawrows.NONE)
    want = duckdb.connect().execute(f"SELECT {expression} FROM (SELECT 'SIX' AS lay, NULL::VARCHAR AS state)").fetchone()[0]
    assert got == want == "NONE"


def test_of_moved_months_the_earliest_stays(spark):
    rows = spark.createDataFrame([(f"{m:04}", "LEGACY", "p", "1995-%02d" % m, 43, m, int(m == 1)) for m in range(12, 0, -1)], "x string, regime string, project_code string, report_month string, ent long, mi int, label int").drop("x")
    for parts in (1, 3, 7):
        kept = gates.moved(rows.repartition(parts)).collect()
        assert [(r["report_month"], r["label"], r["mi"]) for r in kept] == [("2031-01", 1, 1)]


def test_a_serial_of_six_digits_counts_as_an_identifier(spark):
    rows = [("1999-01", "NINE", n, "N00000011") for n in (7, 99_999, 100_000, 999_999)]
    cells = spark.createDataFrame(rows, "source_file string, lay string, n long, code string").select("source_file", F.array(F.col("n").cast("string"), F.concat(F.lit("name ("), "code", F.lit(")")), F.lit("300000.00\n(-)")).alias("cells"))
    got = text.raw_ids(cells.withColumn("cells", F.transform("cells", lambda x: F.replace(x, F.lit("300000.00"), F.lit("30000.00"))))).first()
    con = duckdb.connect()
    con.execute("CREATE TABLE p (source_file VARCHAR, lay VARCHAR, n BIGINT, original_cost DECIMAL(14,2), revised_cost DECIMAL(14,2), cumulative_expenditure DECIMAL(14,2))")
    con.executemany("INSERT INTO p VALUES (?, ?, ?, 30000, NULL, 0)", [r[:3] for r in rows])
    want = con.execute(text.RAW_IDS.removeprefix(text.RAW_P)).fetchone()
    assert tuple(got) == want == ("1999-01", 4, 2, 2, 0)
