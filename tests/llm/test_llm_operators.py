"""Brute-force and edge-case tests: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import base64
import hashlib
import random
import re

import public_tokenizers
import pytest
import tiktoken

from milepost.llm import bpe, decontaminate, language_id, line_dedup, near_duplicates, suffix_dedup, top_k, toxicity, url_filter, warc

DOCS = "doc_id bigint, text string"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").encode().lower())


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_texts(rng):
    return [None, "", " \n ", "ß Ünï 日本語 🙂", "a" * 3000, "don't  stop\t1234 ...", "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF), 10])) for _ in range(500))]


def test_bpe_equals_tiktoken(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = odd_texts(random.Random(1)) + ["x <|endoftext|> y"]
    docs = spark.createDataFrame([(i, t, [7]) for i, t in enumerate(texts)] * 2, DOCS + ", ids array<int>")
    rows = bpe.decoded(bpe.encoded(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        assert r["ids"] == enc.encode_ordinary(t)
        assert bytes(r["decoded"]) == t.encode()


def test_bpe_empty_table(spark):
    assert bpe.encoded(spark.createDataFrame([], DOCS), RANKS, public_tokenizers.PATTERN).count() == 0


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(2)
    common = [f"This line number {i} is long enough to count as one {i}" for i in range(6)]
    rows = [(i, "\n".join(rng.choice(common + [prose(rng, 12), "short", "  " + common[0].upper() + " "]) for _ in range(5))) for i in range(40)] + [(100, None), (101, ""), (None, common[1]), (3, common[2])]
    rows += rows[:3]
    got = sorted((r["doc_id"] is None, r["doc_id"], r["text"] or "") for r in line_dedup.without_repeats(spark.createDataFrame(rows, DOCS)).collect())
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").lower()
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held.setdefault(key(x), set()).add(i)
    drop = {k: max((i for i in v if i is not None)) for k, v in held.items() if len(v) >= 5}
    want = sorted((i is None, i, "\n".join(x for x in (t or "").split("\n") if key(x) not in drop or drop[key(x)] == i)) for i, t in rows)
    assert [str(x) for x in got] == [str(x) for x in want]
    assert line_dedup.without_repeats(spark.createDataFrame([], DOCS), count=True).count() == 0


def test_decontamination_against_brute_force(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, n)) for i, n in enumerate([30, 12, 10, 9, 3, 1, 25])] + [(50, None), (51, "..."), (None, prose(rng, 14))]
    docs = []
    for i in range(60):
        w = prose(rng, rng.randrange(0, 80)).split()
        x = words(items[rng.randrange(7)][1])
        a = rng.randrange(len(x))
        w[len(w) // 2 : len(w) // 2] = [y.decode().upper() for y in x[a : a + rng.randrange(5, 20)]]
        docs.append((i, ", ".join(w)))
    docs += [(90, None), (91, ""), (None, items[0][1]), (5, items[0][1])] + docs[:2]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], str(r["items"])) for r in decontaminate.benchmark_hits(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string")).collect())
    want = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k, q in items:
            x = words(q)
            n = min(10, len(x))
            grams = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)} if n else set()
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in grams:
                    hit |= set(range(j, j + n))
                    found.add("" if k is None else str(k))
        want.append((str(i), len(w), len(hit), str(sorted(found))))
    assert got == sorted(want)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert {r["n_hit"] for r in decontaminate.benchmark_hits(spark.createDataFrame(docs, DOCS), none).collect()} == {0}
    assert decontaminate.benchmark_hits(spark.createDataFrame([], DOCS), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0


def removed_bytes(rows):
    """id, bytes, removed, spans and digest of what is left, by looking at every start."""
    seen, want = set(), set()
    for i, t in sorted(set(rows), key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        want.add((str(i), len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return want


@pytest.mark.parametrize("bucket", [suffix_dedup.BUCKET, 2])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, bucket):
    """Also with buckets so small that all of them are split."""
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    rng = random.Random(4)
    base = [prose(rng, 120, 50) for _ in range(4)]
    rows = []
    for i in range(40):
        t = rng.choice(base)
        a = rng.randrange(len(t))
        rows.append((i, t[a:] + prose(rng, 5) + rng.choice(base)[: rng.randrange(300)] + "é日"))
    rows += [(60, "ab" * 400), (61, None), (62, ""), (63, "x" * 99), (64, "x" * 101), (None, base[0])]
    rows += rows[:2]
    got = {(str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.without_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    want = removed_bytes(rows)
    assert got == want
    assert suffix_dedup.without_repeats(spark.createDataFrame([], DOCS)).count() == 0


def near_fixture():
    rng = random.Random(5)
    base = [prose(rng, 90, 5000).split() for _ in range(8)]
    rows = []
    for i in range(150):
        w = list(base[i % 8])
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows + [(200, None), (201, ""), (202, "one two"), (203, "One, two!"), (204, "..."), (None, " ".join(base[0])), (7, "alone in this text with enough words")] + rows[:2]


def test_near_duplicates_against_brute_force(spark):
    rows = near_fixture()
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    par = list(range(len(rows)))
    find = lambda x: x if par[x] == x else find(par[x])
    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                par[find(a)] = find(b)
    smallest = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            smallest[find(x)] = min(smallest.get(find(x), i), i)
    want = sorted((str(i), str(smallest.get(find(x))), links[x]) for x, (i, _) in enumerate(rows))
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in near_duplicates.near_duplicates(docs).collect()) == want
    kept = near_duplicates.one_of_each(docs)
    assert kept.columns == ["doc_id", "text"]
    assert kept.count() == len({find(x) for x in range(len(rows)) if sets[x]}) + len({rows[x] for x in range(len(rows)) if not sets[x]})
    assert near_duplicates.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_blocks_find_every_link(spark, monkeypatch):
    """Several blocks in one component give what one block gives."""
    docs = spark.createDataFrame(near_fixture(), DOCS)
    one = sorted(map(str, near_duplicates.near_duplicates(docs).collect()))
    monkeypatch.setattr(near_duplicates, "BLOCK", 4)
    assert sorted(map(str, near_duplicates.near_duplicates(docs).collect())) == one


def test_top_k_against_brute_force(spark):
    import math

    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)], 0) for i in range(400)]
    rows += [(i, rows[i % 3][1], 0) for i in range(400, 460)] + [(500, None, 0), (550, [None] + [0.0] * 7, 0), (600, [float("nan")] * 8, 0), (650, [1.0], 0), (None, rows[0][1], 0)]
    rows += rows[:2]
    from pyspark.sql import functions as F

    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int"), F.col("vec_id") % 50 == 0).collect()}
    import numpy as np

    v = {i: [math.floor(256 * float(np.float32(x))) for x in e] for i, e, _ in rows if i is not None and e is not None and len(e) == 8 and all(x is not None and math.isfinite(x) for x in e)}
    want = set()
    for q in v:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in v if i != q)[:5]
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert got == want
    assert top_k.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def test_url_rules(spark):
    urls = ["http://www.Example.com/en/x?q#f", "https://example.com/en/", "http://a.b.example.com/en/p", "http://notexample.com/en/", "http://x.net/es/1", "ftp://net/fr/", "http://com", "http://shop.com/?a", None, "no scheme", "http://h.example.com/en", "http://com/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] * 2, "page_id bigint, url string, host string")
    rules = spark.createDataFrame([("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"), (None, "com", "/")], "action string, host string, path string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judged(pages, rules).collect()}
    assert got[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert [got[i][2:] for i in range(1, 12)] == [("example.com/en/", "block"), ("example.com/en/", "block"), ("com/", "allow"), ("net/es/", "block"), ("net/fr/", "block"), (None, "allow"), ("com/", "allow"), (None, "allow"), (None, "allow"), ("com/", "allow"), ("com/", "allow")]
    assert url_filter.judged(pages, rules).count() == 2 * len(urls)
    assert {r["rule"] for r in url_filter.judged(pages, rules.limit(0)).collect()} == {None}


def test_warc_round_trip(spark):
    rng = random.Random(7)
    pages = [(i, f"http://h/{i}", prose(rng, 40)) for i in range(20)] + [(30, None, None), (31, "http://h/\r\nx", ""), (32, "u", "é" * 100 + "\r\n\r\nWARC/1.1\r\n"), (40, "u", pages_text := "same " * 50), (41, "u", pages_text), (42, "v", pages_text), (None, "w", pages_text)]
    pages += [pages[0]]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    archives = warc.write_archives(df, chunk=64)
    chunks = warc.read_archives(archives, chunk=64)
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"]), r["sound"]) for r in warc.records(chunks).collect())
    keeper = {}
    for i, _, h in pages:
        keeper[h or ""] = max(keeper.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        same = keeper[h or ""] in (-1, i)
        want.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if same else "revisit", "None" if same else str(keeper[h or ""]), True))
    assert got == sorted(want)
    body = {}
    for r in chunks.where("headers['WARC-Type'] = 'response'").orderBy("archive", "record", "chunk").collect():
        body[r["headers"]["WARC-Record-ID"]] = body.get(r["headers"]["WARC-Record-ID"], b"") + bytes(r["data"])
        assert len(r["data"]) <= 64
    assert body["<urn:milepost:page:32>"] == pages[22][2].encode()
    assert warc.records(warc.read_archives(warc.write_archives(df.limit(0)))).count() == 0


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(8)
    parts = {"en": ["the", "ing", "tion", "er", "and", "ly"], "de": ["sch", "ein", "lich", "keit", "ung", "der"], "fr": ["eau", "eux", "tre", "que", "les", "ment"], "es": ["ción", "ado", "los", "ez", "ñ", "que"]}
    make = lambda k: " ".join("".join(rng.choice(parts[k]) for _ in range(3)) for _ in range(30))
    return [(i, make(k), k) for i, k in enumerate(list(parts) * 40)]


def test_language_id_held_out(spark, tongues):
    docs = spark.createDataFrame(tongues, DOCS + ", lang string")
    model = language_id.fitted(docs.where("doc_id % 4 <> 2 or doc_id % 3 = 0"))
    extra = spark.createDataFrame([(900, None, "x"), (901, "", "x"), (902, "12 34 !?", "x"), (903, "ß", None)], DOCS + ", lang string")
    got = {r["doc_id"]: r for r in language_id.predicted(docs.unionByName(extra).drop("lang").selectExpr("*", "'z' as score"), model).collect()}
    assert sum(got[i]["lang_pred"] == k for i, _, k in tongues) >= 0.97 * len(tongues)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] != "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = language_id.fitted(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.predicted(docs, none).collect()} == {"und"}
    assert {r["lang_pred"] for r in language_id.predicted(docs, language_id.fitted(docs.where("lang = 'fr'"))).collect()} == {"fr"}


def test_toxicity_held_out(spark):
    rng = random.Random(9)
    bad = ["idiot", "scum", "moron"]
    rows = []
    for i in range(240):
        w = prose(rng, 40, 200).split()
        if i % 4 == 0:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows + [(900, None), (901, "")] + rows[:1], DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    model = toxicity.fitted(toxicity.sampled(docs, labels.where("doc_id % 5 <> 0")))
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(0, 240, 5))
    assert got[900] == got[901] < 0.5
    one_class = toxicity.fitted(toxicity.sampled(docs, labels.where("toxic = 0")))
    assert {r["score"] for r in toxicity.scored(docs, one_class).collect()} == {0.0}


def test_winnowing_keeps_a_fingerprint_of_every_window():
    import pyarrow as pa

    from milepost.llm.shared import Words

    w = Words(pa.array([prose(random.Random(10), 300), "a b c", None]))
    kept = set(decontaminate.winnowed(w).tolist())
    assert all(kept & set(range(j, j + 6)) for j in range(291))


def test_bayesian_pruning_never_drops_what_is_likely():
    fewest = near_duplicates.fewest_matches(0.8)
    assert fewest == sorted(fewest) and all(m < 0.8 * 15 * (i + 1) for i, m in enumerate(fewest))


def test_toxicity_scores_texts_without_ngrams():
    import numpy as np

    slot = np.full(1 << toxicity.BITS, -1, np.int16)
    slot[next(iter(toxicity.buckets("abc", (3, 3), toxicity.BITS)))[1]] = 0
    model = toxicity.Model(slot, np.array([4.0]), -1.0)
    assert model.score("") == model.score("zzz") == pytest.approx(1 / (1 + np.e))
    assert model.score("abc") == pytest.approx(1 / (1 + np.exp(-3)))
