"""Long hosts, ties, large vectors, the language stage, plain scoring of op1 and op7, and op2, op6, op8 and op10 as queries against brute force."""

import base64
import hashlib
import random
import re

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_llm_operators import RANKS, prose, removed_bytes, words

from milepost.llm import language_id, queries, top_k, toxicity, url_filter

DIR = "/root/testdata/sf0.001"


def model_of(spark):
    rng = random.Random(12)
    docs = spark.createDataFrame([(i, prose(rng, 30) + (" idiot" if i % 2 else "")) for i in range(60)], "doc_id bigint, text string")
    return toxicity.fitted(toxicity.sampled(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")))


def tongues(spark):
    rows = [(i, {"en": "the thing and the other", "de": "das ist ein deutsches wort", "fr": "le mot est un peu beau"}[k] * 3, k) for i, k in enumerate(["en", "de", "fr"] * 20)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_language_stage_takes_effect(spark):
    docs = tongues(spark)
    odd_ones = spark.createDataFrame([(100, None, "en"), (101, "12 !", "en"), (102, "das ist ein wort", None)], docs.schema)
    kept = {r["doc_id"]: r["lang"] for r in language_id.accepted(docs.unionByName(odd_ones), ("de",), 0.1).collect()}
    assert kept[102] == "de" and 100 not in kept and 101 not in kept and {i % 3 for i in kept if i < 60} == {1}


def test_url_ties_and_long_hosts(spark):
    rules = spark.createDataFrame([("allow", "a.com", "/x"), ("block", "a.com", "/x"), ("block", "b", "")], "action string, host string, path string")
    pages = spark.createDataFrame([(1, "http://a.com/xy"), (2, "http://" + "a." * 30_000 + "b/"), (3, "http://" + "." * 60_000)], "page_id bigint, url string").withColumn("rule", F.lit("old")).withColumn("_n", F.lit(7))
    got = {r["page_id"]: (r["verdict"], r["rule"], r["_n"]) for r in url_filter.judged(pages, rules).collect()}
    assert got == {1: ("block", "a.com/x", 7), 2: ("block", "b", 7), 3: ("allow", None, 7)}


def test_vectors_that_could_overflow_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (50, [1e9, 2e9]), (51, [1e30, 0.0]), (52, [3e6, 3e6]), (53, [2.0, 1.0])]
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit(1)).withColumn("v", F.lit(1)), F.col("vec_id") % 50 == 0).collect()}
    big = 256 * 3_000_000
    assert got == {(0, 1, 52, 256 * big + 512 * big), (0, 2, 53, 256 * 512 * 2)}


def bucket_of(gram, bits):
    """The bucket of one n-gram, by plain arithmetic."""
    m = (1 << 32) - 1
    codes = [ord(c) for c in gram]
    g = (codes[0] * 0x9E3779B1 + 0x7F4A7C15) & m
    for c in codes[1:]:
        g = (g * 0x85EBCA6B + c) & m
    return (((g ^ (g >> 15)) * (0x2C1B3C6D + 2 * len(gram))) & m) >> (32 - bits)


def grams(text, orders):
    t = f" {text.lower()} "
    return [t[i : i + n] for n in range(orders[0], orders[1] + 1) for i in range(len(t) - n + 1)]


def test_op1_and_op7_against_plain_scoring(spark):
    import numpy as np

    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(40)
    tox, lang = model_of(spark), language_id.fitted(spark.read.parquet(f"{DIR}/documents.parquet"))
    got = {r["doc_id"]: r for r in language_id.predicted(toxicity.scored(docs.drop("lang"), tox).withColumnRenamed("score", "toxic"), lang).collect()}
    for r in docs.collect():
        held = {int(tox.slot[bucket_of(g, toxicity.BITS)]) for g in grams(r["text"], toxicity.ORDERS)} - {-1}
        want = 1 / (1 + np.exp(-(sum(tox.weights[i] for i in held) + tox.intercept)))
        assert got[r["doc_id"]]["toxic"] == pytest.approx(want)
        x = np.zeros(1 << language_id.BITS)
        for g in grams(r["text"], language_id.ORDERS):
            x[bucket_of(g, language_id.BITS)] += 1
        x = np.sqrt(x) / np.linalg.norm(np.sqrt(x))

        def winner(level):
            if len(level.classes) == 1:
                return level.classes[0]
            votes, sums = [0] * len(level.classes), [0.0] * len(level.classes)
            for j, (a, b) in enumerate(level.pairs):
                m = float(x @ level.weights[:, j] + level.intercepts[j])
                votes[a if m > 0 else b] += 1
                sums[a] += m
                sums[b] -= m
            return level.classes[max(range(len(votes)), key=lambda i: (votes[i], sums[i], -i))]

        assert got[r["doc_id"]]["lang_pred"] == winner(lang.within[winner(lang.families)])


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_queries_against_brute_force(spark):
    rows, enc = documents(spark), encoding()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {(i, len(e := enc.encode_ordinary(t or "")), sha(",".join(map(str, e)).encode()), sha((t or "").encode())) for i, t in rows}
    assert {tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in queries.op2_byte_bpe(spark, DIR).collect()} == want
    got = {(str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op8_suffix_dedup(spark, DIR).collect()}
    assert got == removed_bytes(rows)
    pages = duckdb.sql(f"SELECT page_id, html FROM '{DIR}/pages.parquet'").fetchall()
    keeper = {}
    for i, h in pages:
        keeper[h or ""] = max(keeper.get(h or "", i), i)
    want = {(i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if keeper[h or ""] == i else "revisit", None if keeper[h or ""] == i else keeper[h or ""]) for i, h in pages}
    assert {tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in queries.op6_warc(spark, DIR).collect()} == want
    groups = linked(rows)
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in queries.op10_ngram_jaccard(spark, DIR).collect()} == groups


def linked(rows):
    """doc_id, smallest linked doc_id, links, by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    par, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                par[max(find(a), find(b))] = min(find(a), find(b))
    smallest = {}
    for x, (i, _) in enumerate(rows):
        smallest[find(x)] = min(smallest.get(find(x), i), i)
    return {(i, smallest[find(x)], links[x]) for x, (i, _) in enumerate(rows)}


def test_letters_are_those_of_unicode():
    """Digits, fractions and numerals of other scripts are no letters, marks alone neither; one letter of any script is enough."""
    from milepost.llm.language_id import LETTER

    assert not any(LETTER.search(t) for t in ("²", "½", "Ⅷ", "①", "٣", "_", "12 !?", "́", "🙂", ""))
    assert all(LETTER.search(t) for t in ("a", "É", "ж", "日", "ª", "1 x"))


def test_archives_in_a_folder_without_scheme(spark, tmp_path):
    from milepost.llm import warc

    pages = spark.createDataFrame([(1, "http://a.b/", "x" * 40), (2, "http://a.b/c", "x" * 40), (3, None, None)], "page_id bigint, url string, html string")
    archives = warc.write_archives(pages, str(tmp_path / "archives"))
    paths = [r["archive"] for r in archives.collect()]
    assert paths and all(p.startswith("file:///") for p in paths)
    bare = archives.selectExpr("substring(archive, 8) as archive")
    for a in (archives, bare):
        got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.records(warc.read_archives(a)).collect()}
        assert got == {2: ("response", None), 1: ("revisit", 2), 3: ("response", None)}
