"""Queries against their DuckDB oracles at the smallest size; the entry module with and without the optional parts."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from milepost.plans import catalog

DIR = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]
SOME = ["n03_overview", "n04_trends", "n19_signals", "p01_concentration", "d13_classified_warnings", "d16_quality_rows", "e04_membership", "f04_monthly_coverage", "f13_horizons", "h06_reappearance", "i03_labels", "i09_features_prior", "j11_point_metrics", "k10_policy_folds", "l06_feature_summary", "m14_hydrated_records", "b04_number", "g02_candidates"]


def rows(df):
    say = lambda v: "~" if not hasattr(v, "__len__") and pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(say(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", SOME)
def test_oracle(spark, name):
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(catalog.oracles()[name]).df()
    got = catalog.queries()[name](spark, DIR).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    num = lambda df: df.apply(lambda c: c.astype(float) if pd.api.types.is_numeric_dtype(c) and not pd.api.types.is_bool_dtype(c) else c)
    assert rows(num(got)) == rows(num(want))


def test_names_are_unique_and_entry_needs_no_optional_parts(tmp_path):
    names = [n for n, _, _ in catalog.entries()]
    assert len(names) == len(set(names))
    import shutil

    shutil.copytree(ROOT / "milepost", tmp_path / "milepost", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    assert int(run.stdout.split()[0]) == len(names)
