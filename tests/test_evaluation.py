"""Distributed ranks, parts, accepted versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from milepost.operators import ranks, snapshots


def test_numbered_and_parts(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), i) for i in range(700)] + [("c", 1, 1)]
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(7)
    out = ranks.numbered(df, ["g"], [F.desc_nulls_last("x"), F.col("i")], lambda t, n: t.persist())
    got = {(r["g"], r["i"]): (r["position"], r["total"], r["part"]) for r in out.withColumn("part", ranks.part_of(F.col("position"), F.col("total"), 10)).collect()}
    for g in ("a", "b", "c", None):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-(r[1] if r[1] is not None else -1), r[2]))
        parts = [k + 1 for k, p in enumerate(np.array_split(np.arange(len(mine)), 10)) for _ in p]
        assert [got[g, r[2]] for r in mine] == [(k, len(mine), parts[k]) for k in range(len(mine))]
    assert len(got) == len(rows)


def test_accepted_versions(spark, tmp_path):
    key = "project_code string, report_month string, regime string, score double"
    old = spark.createDataFrame([("p1", "m", "A", 0.5), ("p2", "m", "A", 0.25), ("p1", "m", "B", 1.0)], key)
    snapshots.accept(old, str(tmp_path), "v1")
    back = snapshots.accepted(spark, str(tmp_path), "v1")
    assert {r["status"] for r in snapshots.reconciled(back, old, 0.0).collect()} == {"ACCEPTED"}
    new = spark.createDataFrame([("p1", "m", "A", 0.5), ("p3", "m", "A", 0.25), ("p1", "m", "B", 0.9)], key)
    out = {r["regime"]: r for r in snapshots.reconciled(back, new, 1e-9).collect()}
    assert (out["A"]["missing"], out["A"]["extra"], out["A"]["status"]) == (1, 1, "KEYS_DIFFER")
    assert out["B"]["status"] == "SCORES_DIFFER" and out["B"]["most"] == pytest.approx(0.1)
    with pytest.raises(Exception, match="exist"):
        snapshots.accept(new, str(tmp_path), "v1")
    new.write.mode("overwrite").parquet(f"{tmp_path}/version=v1/scores")
    with pytest.raises(ValueError, match="not what was accepted"):
        snapshots.accepted(spark, str(tmp_path), "v1")
