"""Hard negatives against brute force: ties, odd rows, small blocks, early stops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from milepost.llm import hard_negatives as op

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, h int"


def plain(rows, is_anchor):
    sound = {(i, l, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, l in rows if i is not None and v is not None and l is not None and len(v) == 3 and all(x is not None and math.isfinite(x) and abs(x) < 1e5 for x in v)}
    out = []
    for a in sound:
        if not is_anchor(a[0]):
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in sound if b != a)
        positives = [x for x in scored if x[2] == a[1]][:5]
        for s, p in {(-x[0], x[1]) for x in positives}:
            inside = [x for x in scored if x[2] != a[1] and 80 * s <= -100 * x[0] <= 100 * s][:5]
            out += [(a[0], p, k + 1, n, s, -t) for k, (t, n, _) in enumerate(inside)]
    return sorted(out)


def made(rng, n):
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]) if i % 3 else rng.gauss(0, 1) for _ in range(3)], rng.choice([0, 0, 0, 1, 2])) for i in range(n)]
    odd = [(1000, None, 1), (1001, [1.0, None, 0.0], 1), (1002, [1.0, math.nan, 0.0], 1), (1003, [math.inf, 0.0, 0.0], 1), (None, [1.0, 1.0, 1.0], 0), (1004, [1.0, 1.0, 1.0], None), (1005, [1.0], 0), (1006, [], 0), (1007, [1e30, 0.0, 0.0], 0), (1010, [0.0, 0.0, 0.0], 7), (1020, [0.0, 0.0, 0.0], 0), (30, [1.0, 0.5, 0.5], 1)]
    return rows + odd + rows[:5]


@pytest.mark.parametrize("block, group, depth", [(2048, 1024, 32), (16, 4, 2)])
def test_against_brute_force(spark, block, group, depth, monkeypatch):
    for name, value in (("BLOCK", block), ("GROUP", group), ("DEPTH", depth)):
        monkeypatch.setattr(op, name, value)
    rows = made(random.Random(1), 150)
    df = spark.createDataFrame([(i, v, l, "x", 1) for i, v, l in rows], SCHEMA)
    got = sorted(tuple(r) for r in op.hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label")).collect())
    want = plain(rows, lambda i: i % 10 == 0)
    assert got == want and len(want) > 100


def test_threshold_stops_early_and_exactly():
    """Clustered rows: the search meets few of them and finds what a full scan finds, ties by id included."""
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.integers(-40, 40, (4000, 8)), rng.integers(200, 203, (40, 8))]).astype(np.int64)
    ids = rng.permutation(len(v)).astype(np.int64)
    q = np.full((1, 8), 200, np.int64)
    windows = np.array([(0, 0, 0, -(2**62), 2**62)], op.WANTED)
    lists = np.ascontiguousarray(np.argsort(v, axis=0, kind="stable").T.astype(np.int32))
    asked = np.ones((1, len(v)), bool)
    got, met = op.searched(q, [np.array([0])], windows, asked, v, ids, lists, 5)
    s = v @ q[0]
    want = sorted(range(len(v)), key=lambda r: (-s[r], ids[r]))[:5]
    assert sorted(got, key=lambda x: (-x[2], ids[x[1]])) == [(0, r, int(s[r])) for r in want]
    assert met < 500


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert op.hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label")).count() == 0
    odd = spark.createDataFrame([(1000, None, 1, "x", 1), (3, [1.0], None, "x", 1)], SCHEMA)
    assert op.hard_negatives(odd, F.col("vec_id") % 10 == 0, F.col("label")).count() == 0
