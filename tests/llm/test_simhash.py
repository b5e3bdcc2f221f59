"""SimHash near-duplicates: fingerprints, keys and classes against plain versions."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from milepost.llm import simhash
from milepost.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"


def plain_print(text):
    t = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(rows):
    """rows: doc_id, print. Smallest reachable id of each row."""
    prints = sorted({p for _, p in rows})
    label = {p: p for p in prints}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, p in enumerate(prints):
        for q in prints[i + 1 :]:
            if (p ^ q).bit_count() <= 4:
                a, b = root(p), root(q)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, p in rows:
        if i is not None:
            least[root(p)] = min(i, least.get(root(p), i))
    return [(i, p, least.get(root(p))) for i, p in rows]


TEXTS = [None, "", " \n\t ", "one", "One TWO three", "a b c d", "A\tB\nC  d", "ß Ünï 日本語 🙂 word", " lead and trail \x0b", "x" * 5000, "É é \xa0 nbsp stays", " ".join(f"w{i % 977}" for i in range(70_000))]


def test_fingerprints():
    for texts in (TEXTS, TEXTS[::-1], ["end", " start of next", "words here stay apart"]):
        got = simhash.fingerprints(pa.array(texts, pa.string()))
        assert got.tolist() == [plain_print(t) for t in texts]
    assert len(simhash.fingerprints(pa.array([], pa.string()))) == 0


def test_keys_meet_within_four_bits():
    """Every pair at most 4 bits apart has a left key of either that is a right key of the other, wherever the bits are."""
    rng = random.Random(1)
    pairs = []
    for _ in range(4000):
        x = rng.getrandbits(64)
        bits = rng.sample(range(64), rng.randrange(5)) if rng.random() < 0.5 else [16 * s + k for s in rng.sample(range(4), 2) for k in rng.sample(range(16), 2)]
        pairs.append((x, x ^ sum(1 << b for b in bits)))
    both = np.array(pairs, np.uint64).T
    sides = []
    for prints in both:
        who, key, left = simhash.keys(prints)
        sides.append(_grouped(who, key, left, len(pairs)))
    for (al, ar), (bl, br) in zip(*sides):
        assert al & br and bl & ar
    assert max(len(a) + len(b) for a, b in sides[0]) <= 84


def _grouped(who, key, left, n):
    out = [(set(), set()) for _ in range(n)]
    for w, k, f in zip(who.tolist(), key.tolist(), left.tolist()):
        out[w][0 if f else 1].add(k)
    return out


def near_rows(rng):
    base = [" ".join(f"v{rng.randrange(3000)}" for _ in range(rng.randrange(40, 160))) for _ in range(25)]
    rows = []
    for i in range(250):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(50)}"
        rows.append((i * 3 % 251, " ".join(w)))
    return rows + [(900 + i, t) for i, t in enumerate(TEXTS)] + [(None, base[0]), (None, "only null here of its own kind"), (5, base[1])] + rows[:4]


@pytest.mark.parametrize("most", [4096, 3])
def test_classes_against_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(simhash, "MOST", most)
    rows = near_rows(random.Random(2))
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id bigint, text string, fp bigint, component_id string")
    got = [(r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    want = plain_classes([(i, plain_print(t)) for i, t in rows])
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert len({c for *_, c in want}) < len(want) - 100


def test_chains_of_prints(spark):
    """Links over several steps, each within 4 bits."""
    rng = random.Random(4)
    prints = []
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            prints.append(x)
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << b
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint")))
    root = {r["a"]: r["b"] for r in found.collect()}
    got = {}
    for s in signed:
        got.setdefault(root.get(s, s), set()).add(s)
    want = {}
    for i, _, c in plain_classes(list(enumerate(prints))):
        want.setdefault(c, set()).add(signed[i])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in QUERIES["op11_simhash"](spark, DIR).collect())
    assert got == sorted((i, f"{p:016x}", c) for i, p, c in plain_classes([(i, plain_print(t)) for i, t in rows]))
