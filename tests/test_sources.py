"""Writers: text of doubles."""

import hashlib
import math
import random
import struct

from milepost.sources import tables


def test_decimal_text_rounds_the_exact_value(spark):
    rng = random.Random(5)
    values = [91296.13333333335, 0.0, -0.0, 1.0, -2.5, 123456789012345.0, 1234567890123456.0, 1e15, 1e14, 99999999999999.95, 999999999999999.5, 1e-5, 0.0001, 0.00012345678901234565, 2.2250738585072014e-308, 1.7976931348623157e308, 1e22, 1e23, -1e-7, math.inf, -math.inf, math.nan, 0.1, 1 / 3, 100.0, 1e100]
    values += [round(rng.uniform(0, 10 ** rng.randrange(1, 9)), 2) / 3 for _ in range(2000)] + [int(rng.uniform(1e15, 9e15)) / 10 ** rng.randrange(0, 20) for _ in range(2000)]
    values += [x for x in (struct.unpack("d", rng.randbytes(8))[0] for _ in range(2000)) if x == x and abs(x) > 2.3e-308]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*values, None])], "i int, v double")
    got = {r["i"]: r["t"] for r in df.select("i", tables.decimal_text(df["v"]).alias("t")).collect()}
    assert got.pop(len(values)) is None
    assert [got[i] for i in range(len(values))] == ["%.15g" % v for v in values]


def test_contents_are_digests_of_files(spark, tmp_path):
    for folder, name, text in (("a", "one", "x"), ("b", "two", "x"), ("b", "three", "y")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    found = {r["file_name"]: (r["sha256"], r["length"]) for r in tables.contents(spark, str(tmp_path)).collect()}
    assert found["one"] == found["two"] == (hashlib.sha256(b"x").hexdigest(), 1) and found["three"] == (hashlib.sha256(b"y").hexdigest(), 1)
