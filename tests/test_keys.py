"""Keys and likeness of texts against plain Python; discovery of files; the version ledger where labels collide."""

import difflib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from milepost.functions import bands, keys
from milepost.sources import tables

TEXTS = ["Bébé Électrique (BEL) - II", "NATIONAL  Highways Authority of India [NHAI]", "ﬁne ½ Straße", "plain", "A & B Company Ltd - iv", "x-III", "", "[]", "naïve [é] coal - I ", None]


def test_keys(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    t = F.col("t")
    got = {r["i"]: r for r in df.select("i", keys.normal(t).alias("normal"), keys.folded(t).alias("folded"), keys.alnum(t).alias("alnum"), keys.words(t).alias("words"), keys.without_brackets(F.coalesce(t, F.lit(""))).alias("bare"), keys.without_unit(F.coalesce(t, F.lit(""))).alias("unit"),
                                        keys.acronym(keys.folded(t)).alias("acronym"), keys.agency_key(t).alias("agency")).collect()}
    for i, text in enumerate(TEXTS):
        text = text or ""
        plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
        assert got[i]["folded"] == plain
        assert got[i]["normal"] == " ".join(re.findall("[a-z0-9]+", unicodedata.normalize("NFKD", text).casefold()))
        assert got[i]["alnum"] == re.sub("[^a-z0-9]", "", plain.lower())
        assert got[i]["words"] == re.findall("[a-z0-9]+", plain.lower())
    assert [got[i]["bare"] for i in (0, 1, 7)] == ["Bébé Électrique - II", "NATIONAL  Highways Authority of India", ""]
    assert [got[i]["unit"] for i in (0, 4, 5, 8)] == ["Bébé Électrique (BEL)", "A & B Company Ltd - iv", "x", "naïve [é] coal"]
    assert [got[i]["acronym"] for i in (0, 1, 4)] == ["bei", "nhai", "abi"]
    assert [got[i]["agency"] for i in (0, 1, 3, 4, 6, 9)] == ["bel", "nhai", "plain", "abcli", None, None]


def test_keys_of_ascii_only_and_of_no_rows(spark):
    df = spark.createDataFrame([("A (b)",), (None,)], "t string")
    assert [r[0] for r in df.select(keys.normal("t")).collect()] == ["a b", ""]
    assert df.limit(0).select(keys.normal("t"), keys.folded("t")).collect() == []


def test_similarity(spark):
    pairs = [("north bridge road", "bridge north road"), ("abc", "abd"), ("", "abc"), ("same", "same"), ("one two", "three four"), ("a b c d", "d c b a")]
    got = spark.createDataFrame(pairs, "a string, b string").select(keys.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    for (a, b), r in zip(pairs, got):
        x, y = set(a.split()), set(b.split())
        want = max(difflib.SequenceMatcher(None, a.replace(" ", ""), b.replace(" ", "")).ratio(), len(x & y) / len(x | y)) if a and b else 0.0
        assert r["s"] == pytest.approx(want)


def test_depth_bands(spark):
    got = [r[0] for r in spark.range(1, 30).select(bands.depth_band(F.col("id"))).collect()]
    assert got == ["1-2"] * 2 + ["3-5"] * 3 + ["6-11"] * 6 + ["12-17"] * 6 + ["18-26"] * 9 + ["27+"] * 3


def test_discovered(spark, tmp_path):
    for name in ("b/Report_2.csv", "a/Report_1.csv", "a/deep/Report_3.csv", "a/SYNOPSIS_1.csv", "b/other.csv", "b/Report_2.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    found = tables.discovered(spark, str(tmp_path), "*.csv", ["other.csv"], ["synopsis"]).collect()
    assert [r["file_name"] for r in found] == ["Report_1.csv", "Report_3.csv", "Report_2.csv"]
    assert [r["length"] for r in found] == [14, 19, 14]
    assert tables.discovered(spark, str(tmp_path), "*.csv").count() == 5
    with pytest.raises(ValueError, match="no file"):
        tables.discovered(spark, str(tmp_path), "*.csv", (), ["report", "syn", "other"])


def test_ledger_labels_collide(spark):
    old = spark.createDataFrame([("v1", "ACTIVE", 1, 1, ["2020-01"])], "version string, status string, n_rows bigint, n_projects bigint, months array<string>")
    rows = spark.createDataFrame([("a", "2020-03"), ("a", "2020-02"), ("b", "2020-02")], "project_code string, report_month string")
    say = lambda df: sorted((r["version"], r["status"], r["n_rows"], r["n_projects"], r["months"]) for r in df.collect())
    both = ["2020-02", "2020-03"]
    assert say(tables.ledger(old, "v1", rows, F.lit(True), F.lit(77))) == [("v1", "SUPERSEDED", 1, 1, ["2020-01"]), ("v1-77", "ACTIVE", 3, 2, both)]
    assert say(tables.ledger(old, "v1", rows, F.lit(False), replace=True)) == [("v1", "INGESTED_UNVERIFIED", 3, 2, both)]
    assert say(tables.ledger(old, "v2", rows, F.lit(False))) == [("v1", "ACTIVE", 1, 1, ["2020-01"]), ("v2", "INGESTED_UNVERIFIED", 3, 2, both)]
    assert say(tables.ledger(old, "v1", rows.limit(0), F.lit(True), F.lit(78))) == [("v1", "ACTIVE", 1, 1, ["2020-01"]), ("v1-78", "EMPTY", 0, 0, [])]
    assert say(tables.ledger(old.limit(0), "v1", rows, F.lit(True))) == [("v1", "ACTIVE", 3, 2, both)]


def test_ratios_of_many_pairs_are_difflibs():
    """Pairs are compared together; each has difflib's ratio, empty, long and accented texts too."""
    import random
    from difflib import SequenceMatcher

    from milepost.functions.text import repeated_ratios

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randrange(0, 30)))
    a, b = [word() for _ in range(300)] + ["", None, "a" * 210, "x" * 199], [word() for _ in range(300)] + ["", "a", "ab" * 110, "x" * 199]
    assert repeated_ratios(a + a, b + b).tolist() == 2 * [SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)]
