"""Conversation repair against a search over all edits, over one piece and over many."""

import hashlib
import heapq
import random
import re

import pytest

from milepost.llm import conversations as op

SCHEMA = "conv_id bigint, turn bigint, role string, text string, cost string, conv int"


def ordered(rows):
    """Rows of a conversation with their first faults."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, (r[2] if r[2] is not None else " ").encode(), (r[3] if r[3] is not None else " ").encode()))
    out, seen = [], set()
    for _, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        out.append((turn, role, text, "b" if not last else "d" if (role, text) in seen else "t" if last[0] not in ".!?" else ""))
        seen.add((role, text))
    return out


def cheapest(rows):
    """Least (cost, audit) by a search that knows nothing of weights: states are row, pattern and the lines so far."""
    heap, done = [(0, "", 0, "^", ())], set()
    while heap:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if i == len(rows) and last in "^a":
            return cost, audit, lines
        if (i, last) in done:
            continue
        done.add((i, last))
        can = {"^": "su", "s": "u", "u": "a", "a": "u"}[last]
        for c, name in (("u", "user"), ("a", "assistant")):
            if c in can:
                heapq.heappush(heap, (cost + 2, audit + "I", i, c, (*lines, name + ":")))
        if i == len(rows):
            continue
        _, role, text, wrong = rows[i]
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, lines))
        if wrong in ("b", "d"):
            continue
        late = wrong == "t"
        if role[:1] and role[:1] in can:
            heapq.heappush(heap, (cost + late, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
        for c, name in (("u", "user"), ("a", "assistant")):
            if c in can:
                heapq.heappush(heap, (cost + 2 + late, audit + "R", i + 1, c, (*lines, f"{name}:{text}")))


def plain(rows):
    out = []
    for conv in {r[0] for r in rows}:
        told = ordered([r for r in rows if r[0] == conv])
        cost, audit, lines = cheapest(told)
        turns = [t for t, *_ in told if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults = [x for *_, x in told]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(map(str, out))


def made(rng, conversations=60, most=9):
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "admin", "", None, "User"]
    texts = ["Fine.", "What?", "no end", "", " \n\t", None, "Fine.", "É ok!", "two\nlines.", "ends in space. \x0b", "dot. then"]
    rows = []
    for c in range(conversations):
        for t in range(rng.randrange(1, most)):
            rows.append((c if c else None, rng.choice([t, t, t, t + 3, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"said {rng.randrange(1000)}{rng.choice(['.', ''])}"))
    return rows + rows[:6]


def got(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted(str(tuple(r)) for r in op.repaired(df).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect())


@pytest.mark.parametrize("piece", [512, 1, 3])
def test_against_search(spark, piece, monkeypatch):
    monkeypatch.setattr(op, "PIECE", piece)
    rows = made(random.Random(piece))
    assert got(spark, rows) == plain(rows)


def test_long_conversations_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(op, "PIECE", 40)
    rng = random.Random(9)
    rows = made(rng, 3, 4) + [(77, t // 2 if t % 5 else None, rng.choice(["user", "assistant", "tool"]), f"words {t}{rng.choice('.?x')}" if t % 3 else "Again.") for t in range(900)] + [(77, 5, "user", "z" * 200_000)]
    assert got(spark, rows) == plain(rows)


def test_weights_decide_cost_and_audit():
    rng = random.Random(3)
    for _ in range(400):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), f"t{i}", rng.choice(["", "", "t", "b", "d"])) for i in range(rng.randrange(9))]
        cost, audit, lines = cheapest([(0, *r) for r in rows])
        assert op.decided(rows) == (cost, audit)
        assert op.written(rows, audit, op.START) == list(lines)


def test_damage_and_conversations_without_rows(spark):
    from pyspark.sql import functions as F

    rows = [(1, k, "assistant", "A. b! c?") for k in range(5)] + [(2, 0, "user", "gone"), (None, None, None, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    after = op.damaged(df, F.coalesce("turn", F.lit(9)))
    assert sorted((r["conv_id"] or 0, r["turn"] or 0, r["role"], r["text"]) for r in after.collect()) == [(0, 0, " ", " "), (1, 1, "assistant", ""), (1, 2, "assistant", "A b c"), (1, 3, "assistant", "A. b! c?"), (1, 3, "assistant", "A. b! c?"), (1, 4, "user", "A. b! c?")]
    out = {r["conv_id"]: r for r in op.with_all(df, op.repaired(after)).collect()}
    assert set(out) == {1, 2, None}
    assert out[2]["audit"] == "" and out[2]["cost"] == 0 and out[2]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert (out[None]["blank"], out[None]["audit"], out[None]["cost"]) == (1, "D", 3)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert op.with_all(df, op.repaired(df)).count() == 0
