"""What moves between tasks, by the plan: rows once for what is keyed alike, and nothing for what nobody asks."""

from milepost.plans import catalog, surrogate

SF = "/root/testdata/sf0.001"


def plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_lines_of_a_project_move_once(spark):
    assert plan(surrogate.cells(spark, SF), "executedPlan").count("Exchange hashpartitioning") == 1


def test_availability_asks_who_has_risk_and_ranks_nobody(spark):
    assert "Window" not in plan(catalog.queries()["n22_availability"](spark, SF))


def test_texts_of_the_panel_are_made_after_rows_have_moved(spark):
    last = plan(surrogate.derived(spark, SF)).split("RebalancePartitions")
    assert len(last) == 2 and "report_month" in last[0] and "report_month" not in last[1]


def test_rows_of_a_report_move_once_from_the_panel_to_their_classes(spark):
    from milepost.operators import reports
    from milepost.plans import rawrows

    walked = reports.filled(reports.classified(reports.with_layout(rawrows._raw(spark, SF)), *rawrows._words(spark, SF)))
    assert plan(walked, "executedPlan").count("Exchange") == 1


def test_pieces_of_labels_move_without_their_cells(spark):
    from milepost.operators import reports

    rows = spark.createDataFrame([("f", 1, "project", ["a", "b"]), ("f", 2, "fragment", ["c", ""])], "source_file string, raw_sequence int, row_class string, cells array<string>")
    text = plan(reports.group_labels(rows.repartition(2), (0, "state")), "executedPlan")
    pieces = text[text.index("MapInArrow") :]
    assert "cells" not in pieces[: pieces.index("Exchange", pieces.index("Window"))] and "Exchange" in pieces
