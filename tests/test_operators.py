"""Known answers and invariants."""

import pytest
from pyspark.sql import functions as F

from milepost.functions import months, text
from milepost.operators import labels, longitudinal, metrics, portfolio, validation

PANEL = "project_code string, report_month string, project_name string, agency string, ministry string, sector string, state string, approval_date string, start_date string, original_completion_date string, revised_completion_date string, original_cost decimal(14,2), revised_cost decimal(14,2), cumulative_expenditure decimal(14,2), physical_progress decimal(6,2), mi int, segment string, regime string"


def row(code, month, **kw):
    from decimal import Decimal

    mi = months.index_of(month)
    segment, regime = next(((n, r) for n, r, a, b in months.SEGMENTS if a <= month <= b), (None, None))
    base = dict(project_code=code, report_month=month, project_name=code, agency="A", ministry=None, sector="S", state=None, approval_date=None, start_date=None, original_completion_date="2002-01", revised_completion_date=None, original_cost=None, revised_cost=None, cumulative_expenditure=None, physical_progress=None, mi=mi, segment=segment, regime=regime)
    base |= {k: Decimal(str(v)) if isinstance(v, (int, float)) else v for k, v in kw.items()}
    return tuple(base.values())


@pytest.fixture(scope="module")
def seed(spark):
    """Seven rows of three projects with hand-computed answers."""
    one = lambda c, a, s, st, m, o, r, e, p: row(c, m, agency=a, sector=s, state=st, original_cost=o, revised_cost=r, cumulative_expenditure=e, physical_progress=p)
    rows = [one("P1001", "DFCCIL", "RAILWAYS", "MAHARASHTRA", *x) for x in (("2000-01", 100, 120, 20, 10), ("2000-03", 100, 130, 40, 25), ("2000-06", 100, 140, 60, 40), ("2001-01", 100, 150, 80, 60))]
    rows += [one("P2002", "NHAI", "ROAD TRANSPORT", "GUJARAT", *x) for x in (("2000-02", 200, None, 50, None), ("2000-05", 200, 220, 100, 50))] + [one("P3003", "NHAI", "ROAD TRANSPORT", "MAHARASHTRA", "2000-03", 300, None, 150, 75)]
    risk = spark.createDataFrame([], "project_code string, report_month string, state string, sector string, agency string, risk_probability double, raw_probability double")
    return spark.createDataFrame(rows, PANEL), risk


def test_overview(seed):
    r = portfolio.overview(*seed, portfolio.Scope()).collect()[0]
    assert (r["observation_count"], r["unique_project_count"], r["states_count"], r["agencies_count"], r["sectors_count"], r["missing_progress"]) == (7, 3, 2, 2, 2, 1)
    r = portfolio.overview(*seed, portfolio.Scope("2000-01", "2000-06")).collect()[0]
    assert (r["observation_count"], r["total_sanctioned_cost"], r["total_revised_cost"], r["total_cumulative_expenditure"]) == (6, 600.0, 360.0, 310.0)
    empty = portfolio.overview(*seed, portfolio.Scope("1990-01", "1990-02")).collect()[0]
    assert empty["observation_count"] == 0 and empty["total_sanctioned_cost"] is None and empty["average_physical_progress"] is None


def test_financials_and_progress(seed):
    r = portfolio.financials(seed[0], portfolio.Scope("2000-01", "2000-06")).collect()[0]
    assert (r["original_count"], r["original_total"], r["original_mean"], r["revised_count"], r["revised_total"], r["spent_total"], r["overrun_count"], r["escalation_total"]) == (3, 600.0, 200.0, 2, 360.0, 310.0, 2, 60.0)
    p = portfolio.progress(seed[0], portfolio.Scope("2000-01", "2000-06")).collect()[0]
    assert (p["reporting"], p["missing"], p["mean"], p["median"], p["min"], p["max"]) == (5, 1, 40.0, 40.0, 10.0, 75.0)


def test_geography_order(seed):
    assert [(r["state"], r["unique_project_count"], r["observation_count"]) for r in portfolio.geography(*seed, portfolio.Scope()).collect()] == [("MAHARASHTRA", 2, 5), ("GUJARAT", 1, 2)]


@pytest.mark.parametrize("given, at, want", [
    ([("2000-01", None), ("2000-02", None), ("2000-03", "2002-04"), ("2000-04", None)], "2000-01", ("ELIGIBLE_POSITIVE", "FIRST_REVISION", "2000-03")),
    ([("2000-01", "2002-03"), ("2000-02", "2002-03"), ("2000-03", "2002-06"), ("2000-04", "2002-06")], "2000-01", ("ELIGIBLE_POSITIVE", "SUBSEQUENT_REVISION", "2000-03")),
    ([("2000-01", "2002-03"), ("2000-02", None), ("2000-03", None), ("2000-04", None)], "2000-01", ("FUTURE_REVISION_PERSISTENCE_AMBIGUOUS", None, None)),
    ([("1999-12", "2002-03"), ("2000-01", None), ("2000-02", None), ("2000-03", None), ("2000-04", None)], "2000-01", ("BASELINE_REVISION_PERSISTENCE_AMBIGUOUS", None, None)),
    ([("2000-01", None), ("2000-02", None), ("2000-04", None)], "2000-01", ("PROJECT_DISAPPEARED_OR_MONTH_MISSING", None, None)),
    ([("1998-10", None), ("1998-11", None), ("1999-01", None)], "1998-10", ("STRUCTURAL_GAP_OR_REGIME_BOUNDARY", None, None)),
])
def test_label_decisions(spark, given, at, want):
    panel = spark.createDataFrame([row("C", m, revised_completion_date=r) for m, r in given], PANEL)
    r = labels.labelled(panel).where(F.col("report_month") == at).collect()[0]
    assert (r["reason"], r["extension_type"], r["event_month"]) == want


def test_features_do_not_see_the_future(spark):
    rows = [row("C", f"2000-0{m}", revised_completion_date=r, original_cost=100, revised_cost=c, cumulative_expenditure=10 * m, physical_progress=m) for m, r, c in ((1, None, None), (2, "2002-05", 110), (3, None, None), (4, "2002-07", 120), (5, "2002-06", 90))]
    upto = lambda some: labels.features(spark.createDataFrame(some, PANEL)).where("report_month <= '2000-03'").orderBy("report_month").collect()
    assert upto(rows) == upto(rows[:3])
    last = labels.features(spark.createDataFrame(rows, PANEL)).where("report_month = '2000-05'").collect()[0]
    assert (last["n_prior_schedule_extensions"], last["n_prior_cost_revisions"], last["observed_tenure_months"], last["exp_delta_3m"]) == (2, 2, 5, 30.0)


@pytest.mark.parametrize("change, rules", [
    ({"physical_progress": 101.2}, {"physical_progress_above_100"}), ({"cumulative_expenditure": 0, "physical_progress": 87}, {"zero_expenditure_positive_progress"}), ({"start_date": "2001-12", "cumulative_expenditure": 0, "physical_progress": 10, "original_completion_date": "2003-01", "revised_completion_date": "2003-02"}, {"progress_reported_before_start"}),
    ({"physical_progress": 0}, {"expenditure_with_zero_progress"}), ({"physical_progress": 100}, {"full_progress_still_ongoing"}), ({"cumulative_expenditure": -1}, {"negative_expenditure"}), ({"revised_cost": 10, "original_cost": 10, "cumulative_expenditure": 31}, {"extreme_expenditure_cost_mismatch"}),
    ({"original_cost": 100, "revised_cost": 90, "cumulative_expenditure": 50}, {"revised_cost_below_original"}), ({"start_date": "2000-01", "original_completion_date": "1999-12"}, {"completion_date_before_start_date"}), ({}, set()), ({"project_code": "12X"}, {"invalid_project_code"}), ({"project_code": None}, {"missing_project_code"}),
])
def test_validation_rules(spark, change, rules):
    base = {"start_date": "1998-01", "original_completion_date": "2000-01", "revised_completion_date": "2000-09", "original_cost": 265.91, "revised_cost": 265.91, "cumulative_expenditure": 176.38, "physical_progress": 80}
    code = change.get("project_code", "612786") if "project_code" in change else "612786"
    panel = spark.createDataFrame([row(code, "2000-07", **{k: v for k, v in (base | change).items() if k != "project_code"})], PANEL)
    assert {r["rule"] for r in validation.warnings(panel).collect()} == rules


def test_white_space_changes_count_only_exactly(spark):
    panel = spark.createDataFrame([row("C", "2000-01", sector="A  B", state="X "), row("C", "2000-02", sector="A B", state="X")], PANEL)
    r = longitudinal.identity(longitudinal.pairs(panel)).collect()[0]
    assert (r["sector_changed"], r["sector_changed_normalised"], r["state_changed"], r["state_changed_normalised"]) == (1, 0, 1, 0)


def test_change_classes_sum_to_pairs(spark):
    panel = spark.createDataFrame([row(f"C{i}", f"2000-0{m}", cumulative_expenditure=None if (i + m) % 5 == 0 else (i * m) % 7) for i in range(9) for m in (1, 2, 3)], PANEL)
    for r in longitudinal.changes(longitudinal.pairs(panel)).collect():
        assert sum(r[k] for k in ("increased", "decreased", "unchanged", "missing")) == 9


def test_curve_metrics(spark):
    rows = [("x", f"c{i}", s, y) for i, (s, y) in enumerate([(0.9, 1), (0.8, 1), (0.8, 0), (0.4, 0), (0.4, 1), (0.1, 0)])]
    df = spark.createDataFrame(rows, "fold string, project_code string, score double, label int")
    ap = metrics.average_precision(df, "fold").collect()[0]["average_precision"]
    assert ap == pytest.approx(1 / 3 * 1 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 5)
    pairs = [(0.9, 0.8), (0.9, 0.4), (0.9, 0.1), (0.8, 0.8), (0.8, 0.4), (0.8, 0.1), (0.4, 0.8), (0.4, 0.4), (0.4, 0.1)]
    assert metrics.roc_auc(df, "fold").collect()[0]["roc_auc"] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a, b in pairs) / 9)
    assert metrics.recall_threshold(df, 0.5, "fold").collect()[0]["threshold"] == 0.8
    assert metrics.top_k(df, [2, 50], "fold").orderBy("k").collect()[1]["applied_k"] == 6


def test_parsers(spark):
    one = lambda f, v: spark.createDataFrame([(v,)], "t string").select(f(F.col("t"))).collect()[0][0]
    assert [one(text.number, v) for v in ("1,234.5", "(12)", " 45 %", "N / A", "x", None)] == [1234.5, 12.0, 45.0, None, None, None]
    assert [one(text.month, v) for v in ("03/2021", "3/2021", "13/2021", "03/1821")] == ["2021-03", None, None, None]
    assert [one(text.legacy_month, v) for v in ("3-2021", "Mar-21", "M a r - 2 0 2 1", "13/2021", "Foo-21")] == ["2021-03", "2021-03", "2021-03", None, None]
    assert one(text.banner_month, "Report for April, 2023 (final)") == "2023-04"


def test_an_identity_cell_is_split_once(spark):
    """However often its lines are named, a cell is read once a row."""
    from milepost.functions import cells, text

    df = spark.createDataFrame([("Canal\nPhase 2\n(ABC\nGroup)\n(000012)\n(N00000012) (77)",)], "c string")
    for parse, most in ((cells.project_identity, 1), (cells.six_column_identity, 1), (text.triplet, 1), (text.parenthesized_pair, 1), (text.composite, 1)):
        out = df.select(parse(F.col("c")).alias("x"))
        assert out._jdf.queryExecution().analyzed().toString().count("split(") == most
    assert tuple(df.select(cells.project_identity(F.col("c")).alias("x")).first()["x"]) == ("Canal Phase 2", "ABC Group", "000012", "N00000012", "77")


def test_month_texts_are_not_formatted_row_by_row(spark):
    """Every row of the panel has six of them; format_string took most of the time in which the panel is derived."""
    from milepost.functions.months import index_of, month_text, text_or_null

    want = [f"{y:04}-{m:02}" for y in (1, 987, 1995, 2001, 9999) for m in range(1, 13)]
    df = spark.createDataFrame([(w, index_of(w)) for w in want], "w string, i long").select("w", month_text("i").alias("a"), text_or_null(F.col("i").cast("int")).alias("b"), text_or_null(F.lit(None).cast("int")).alias("none"))
    assert all(r["a"] == r["b"] == r["w"] and r["none"] is None for r in df.collect())
    assert "format_string" not in df._jdf.queryExecution().analyzed().toString()


def test_contributions_are_ordered_without_a_shuffle(spark):
    """Six contributions of a row were sent to a window each; the row holds all of them."""
    from milepost.operators import risk

    weights = {"a": 0.5, "b": -0.25, "c": 1.0, "d": 2.0}
    df = spark.createDataFrame([("p", "2000-01", "MODERN", 2, 4, None, -3), ("q", "2000-01", "MODERN", 0, 0, 0, 0)], "project_code string, report_month string, regime string, a int, b int, c int, d int")
    out = risk.directed(df, weights)
    assert [(r["feature"], r["value"], r["contribution"], r["direction"], r["contribution_rank"]) for r in out.where("project_code = 'p'").collect()] == [("d", -3.0, -6.0, "NEGATIVE", 1), ("a", 2.0, 1.0, "POSITIVE", 2), ("b", 4.0, -1.0, "NEGATIVE", 3), ("c", None, 0.0, "ZERO", 4)]
    top = risk.top_contributors(df, weights, 1)
    assert sorted((r["project_code"], r["direction"], r["nth"], r["feature"], r["contribution"]) for r in top.collect()) == [("p", "NEGATIVE", 1, "d", -6.0), ("p", "POSITIVE", 1, "a", 1.0)]
    assert all("Exchange" not in x._jdf.queryExecution().executedPlan().toString() for x in (out, top))


def test_additivity_and_serials_take_one_grouping(spark):
    from milepost.plans import risk, validation

    long = spark.createDataFrame([("p", "2000-01", n, w) for n, w in risk.WEIGHTS.items()] + [("q", "2000-01", n, -w) for n, w in risk.WEIGHTS.items()], "project_code string, report_month string, feature string, contribution double")
    out = risk._additive(long)
    assert tuple(out.first()) == (2, True)
    months = spark.range(1, 63).select(F.lit("2000-01").alias("report_month"), F.col("id").alias("n")).unionByName(spark.range(1, 29).select(F.lit("2000-02").alias("report_month"), F.col("id").alias("n")))
    gaps = validation.serial_gaps(months)
    assert sorted(map(tuple, gaps.collect())) == [("2000-01", 2, 2), ("2000-02", 0, 0)]
    assert all("Join" not in x._jdf.queryExecution().optimizedPlan().toString() for x in (out, gaps))


def test_label_variants_take_one_pass(spark):
    rows = [("p", "1995-%02d" % (m + 1), 1995 * 12 + m, "SEGMENT_1", "LEGACY", float(m < 2), 5.0 - m, 10.0 + m) for m in range(5)]
    df = spark.createDataFrame(rows, "project_code string, report_month string, mi int, segment string, regime string, cumulative_expenditure double, physical_progress double, revised_cost double")
    out = labels.variants(df)
    got = {(r["horizon"], r["endpoint"]): tuple(r)[3:] for r in out.collect()}
    assert got == {(1, False): (4, 3, 4, 4, 4, 4), (1, True): (4, 3, 4, 4, 4, 4), (3, False): (2, 1, 2, 2, 2, 2), (3, True): (2, 0, 2, 2, 2, 2)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Union" not in plan
