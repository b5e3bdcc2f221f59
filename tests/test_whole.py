"""Queries over every month, against their SQL, which must have no filter that cuts months."""

from pathlib import Path

import duckdb
import pytest
from test_queries import DIR, pd, rows

from milepost.plans import catalog

CUTS = (" WHERE mi % 3 = 2", " WHERE mi % 6 = 5")


def same(spark, name, cuts):
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    sql = catalog.oracles()[name]
    assert not any(c in sql for c in cuts)
    want, got = con.execute(sql).df(), catalog.queries()[name](spark, DIR).toPandas()
    num = lambda df: df.apply(lambda c: c.astype(float) if pd.api.types.is_numeric_dtype(c) and not pd.api.types.is_bool_dtype(c) else c)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(num(got)) == rows(num(want))


@pytest.mark.parametrize("name", ["k08_operational_rank", "l03_direction_rank", "l06_feature_summary", "l07_top_overlap", "m03_contributor_checks", "m04_without_contributors", "m14_hydrated_records", "n03_overview", "n04_trends", "p02_risk_movement"])
def test_every_month_has_risk_and_contributions(spark, name):
    same(spark, name, CUTS)


@pytest.mark.parametrize("name", ["k09_top_k", "k11_alert_caps"])
def test_every_month_has_top_k_and_caps(spark, name):
    assert catalog.queries()[name](spark, DIR).select("report_month").distinct().count() > 2
    same(spark, name, ())
