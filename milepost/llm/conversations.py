"""Conversation structure repair by an integer-minimum DP with scalar big-integer weights.

A conversation's rows stand by turn (nulls first), then role and text; equal rows stand together. A row's
first fault counts: blank (nothing but ASCII white space), duplicate (role and text seen earlier), truncated
(its last other character is none of . ! ?). Edits: Keep costs 0, Rerole (to user or assistant) 2, Delete 3
and is the only one for blank and duplicate rows, Insert (an empty user or assistant row, anywhere) 2; truncated rows that
stay cost 1 more. The cheapest edits are wanted after which the roles' initials read (s?(ua)+)?, and
among these the ASCII-least string of the edits' initials, the audit.

The DP runs over a DAG: nodes are a row's number, the state of the pattern (start, after s, after u, after a) and how many rows
were inserted before the row (two at most: a third would close a loop of positive cost). The value of a node is
one integer: its high digits are the cost of the best way from there to the end, its low digits, three bits
each in a field of fixed width, are the letters of that way's audit from the left (D 1, I 2, K 3, R 4) with
zeros behind its end. An edit adds one integer weight to the value of its target, whose letters move one digit to the right; so
the ordinary minimum of integers compares costs first and then audits, shorter ones before their
continuations. Cost and audit of the conversation are read off the value of its first node.

Rows are dealt by ranges of (conversation, turn, role, text), so a conversation of any length is spread over
tasks, and each task walks its rows in order, `PIECE` at a time. A conversation inside one task and piece is
decided there. For every piece of others the DP gives the best way between any two states (two ways of
equal cost are never one the beginning of the other, as both use up the piece's rows and inserting costs);
these 16 ways are joined along the conversation, which fixes the states at its pieces' borders, and then
all pieces write their repaired rows in parallel. The digest of a repaired conversation reads these as a
stream in order. What a task holds of a conversation are its audit and one piece.

Defined cases: a null role or text is one space, a null conversation is one like others; roles count by
their first character (an empty role has none and is neither kept nor legal); repeated rows are duplicates of their first; rows
that share a turn stand by role and text; a conversation without rows gives zeros, an empty audit and the digest of
nothing; very long texts are read one by one; an empty table gives no rows; other columns, of whatever name, are left out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import bound_batches, discard, materialise

REROLE, DELETE, INSERT, LATE = 2, 3, 2, 1
#: Rows and characters of a piece.
PIECE, CHARACTERS = 512, 1 << 22
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The state that the next user or assistant leads to.
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
NAME = {AFTER_U: "user", AFTER_A: "assistant"}
KIND = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}
LEGAL = {"su", "ua", "au"}
WHITE = " \t\n\r\x0b\x0c"
_LETTERS = str.maketrans("1234", "DIKR")


def fault(text: str, seen: bool) -> str:
    """The first fault of a row: b, d, t or nothing."""
    rest = text.rstrip(WHITE)
    return "b" if not rest else "d" if seen else "" if rest[-1] in ".!?" else "t"


def kept_state(state: int, role: str) -> int | None:
    """The state after a kept row, if the pattern allows it."""
    to = KIND.get(role[:1])
    if to == AFTER_S:
        return AFTER_S if state == START else None
    return to if to == NEXT[state] else None


class Weights:
    """Integers of n rows: width of the letters' field, and what each edit adds."""

    def __init__(self, n: int):
        self.digits = 3 * n + 2
        self.bits = 3 * self.digits
        self.low = (1 << self.bits) - 1
        self.none = 1 << (self.bits + 48)  # more than any cost
        edit = lambda cost, digit: (cost << self.bits) + (digit << (self.bits - 3))
        self.delete, self.insert = edit(DELETE, 1), edit(INSERT, 2)
        self.keep, self.rerole = (edit(0, 3), edit(LATE, 3)), (edit(REROLE, 4), edit(REROLE + LATE, 4))

    def moved(self, value: int) -> int:
        """The value with its letters one digit to the right."""
        return (value >> self.bits << self.bits) | ((value & self.low) >> 3)

    def read(self, value: int) -> tuple[int, str] | None:
        """Cost and audit."""
        if value >= self.none:
            return None
        return value >> self.bits, format(value & self.low, f"0{self.digits}o").rstrip("0").translate(_LETTERS)


def ways(rows: list[tuple[str, str, str]], ends: list[int | None], w: Weights) -> list[int]:
    """The value at each state before the rows (role, text, fault), given those behind them (None: not to end there)."""
    v = [w.none if e is None else e for e in ends]
    for role, _, wrong in reversed(rows):
        moved = [w.moved(x) for x in v]
        v = [x + w.delete for x in moved]
        if wrong not in ("b", "d"):
            late = wrong == "t"
            for q in range(4):
                v[q] = min(v[q], moved[NEXT[q]] + w.rerole[late])
                to = kept_state(q, role)
                if to is not None:
                    v[q] = min(v[q], moved[to] + w.keep[late])
        v = inserted(v, w)
    return v


def inserted(v: list[int], w: Weights) -> list[int]:
    """The values with up to two rows inserted first."""
    for _ in range(2):
        v = [min(v[q], w.moved(v[NEXT[q]]) + w.insert) for q in range(4)]
    return v


def decided(rows: list[tuple[str, str, str]]) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    w = Weights(len(rows))
    found = w.read(ways(rows, inserted([0, w.none, w.none, 0], w), w)[START])
    assert found is not None  # all rows may go
    return found


def between(rows: list[tuple[str, str, str]]) -> list[tuple[int, str] | None]:
    """Cost and audit of the best way from each state to each other, at 4 * from + to."""
    w, out = Weights(len(rows)), [None] * 16
    for to in range(4):
        for q, value in enumerate(ways(rows, [0 if t == to else None for t in range(4)], w)):
            out[4 * q + to] = w.read(value)
    return out


def written(rows: list[tuple[str, str, str]], audit: str, state: int) -> list[str]:
    """The lines role:text that the edits of an audit leave, from a state on."""
    lines, at = [], iter(rows)
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            lines.append(f"{NAME[state]}:")
            continue
        role, text, _ = next(at)
        if letter == "K":
            state = kept_state(state, role)
            lines.append(f"{role}:{text}")
        elif letter == "R":
            state = NEXT[state]
            lines.append(f"{NAME[state]}:{text}")
    return lines


def _digest(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()


class _Piece:
    """Rows of a conversation in order, and what counting them gives."""

    def __init__(self):
        self.rows: list[tuple[str, str, str]] = []
        self.size = self.illegal = self.turns = 0
        self.first = self.last = ""
        self.low: int | None = None
        self.high: int | None = None

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        if self.rows:
            self.illegal += self.last + role[:1] not in LEGAL
        else:
            self.first = role[:1]
        self.last = role[:1]
        self.rows.append((role, text, fault(text, seen)))
        self.size += len(text)
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low

    def counts(self) -> dict:
        faults = [x for _, _, x in self.rows]
        return {"blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"), "illegal": self.illegal, "first": self.first, "last": self.last, "low": self.low, "high": self.high, "turns": self.turns}


_COUNTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, low bigint, high bigint, turns bigint"
_WAY = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
_ROWS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("fault", pa.string())]))
_COUNT_FIELDS = [(c, pa.string() if c in ("first", "last") else pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns")]


def _walked(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Of rows in order: conversations that are decided (cost, audit, sha), and pieces of others (ways, rows)."""
    schema = pa.schema([("conv", kind), ("part", pa.int32()), ("piece", pa.int32()), *_COUNT_FIELDS, ("cost", pa.int64()), ("audit", pa.string()), ("sha", pa.string()), ("ways", _WAY), ("rows", _ROWS)])
    part, pieces, first, now, piece = TaskContext.get().partitionId(), 0, True, object(), None
    ready: list[dict] = []

    def out(whole: bool) -> dict:
        nonlocal pieces
        row = {"conv": now, "part": part, "piece": pieces, **piece.counts()}
        pieces += 1
        if whole:
            cost, audit = decided(piece.rows)
            return row | {"cost": cost, "audit": audit, "sha": _digest(written(piece.rows, audit, START)), "ways": None, "rows": None}
        found = [None if x is None else {"cost": x[0], "audit": x[1]} for x in between(piece.rows)]
        return row | {"cost": None, "audit": None, "sha": None, "ways": found, "rows": [dict(zip(("role", "text", "fault"), x)) for x in piece.rows]}

    alone = False  # the conversation began in this task, and has one piece so far
    for batch in batches:
        for conv, turn, role, text, many, seen in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "many", "seen"))):
            if piece is None or conv != now:
                if piece is not None:
                    ready.append(out(alone))
                    first = False
                now, piece, alone = conv, _Piece(), not first  # the first conversation may have begun elsewhere
            for copy in range(many):
                if piece.rows and (len(piece.rows) >= PIECE or piece.size > CHARACTERS):
                    ready.append(out(False))
                    piece, alone = _Piece(), False
                    yield pa.RecordBatch.from_pylist(ready, schema)
                    ready = []
                piece.add(turn, role, text, seen or copy > 0)
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema)
            ready = []
    if piece is not None:
        yield pa.RecordBatch.from_pylist([out(False)], schema)  # the last one may go on elsewhere


_END = {START: (0, ""), AFTER_A: (0, ""), AFTER_U: (INSERT, "I"), AFTER_S: (2 * INSERT, "II")}


def _joined(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Of pieces in order: for each its state and audit (edits), for each conversation its counts, cost and audit."""
    schema = pa.schema([("conv", kind), ("part", pa.int32()), ("piece", pa.int32()), ("state", pa.int32()), ("edits", pa.string()), *_COUNT_FIELDS, ("cost", pa.int64()), ("audit", pa.string())])
    best: list[tuple[int, str] | None] = []
    steps: list[tuple[int, int, list, list]] = []
    total: dict = {}

    def finished() -> Iterator[pa.RecordBatch]:
        cost, audit, state = min((b[0] + _END[q][0], b[1] + _END[q][1], q) for q, b in enumerate(best) if b is not None)
        out = [{**total, "part": None, "piece": None, "state": None, "edits": None, "cost": cost, "audit": audit}]
        tail = _END[state][1]
        for part, piece, before, audits in reversed(steps):
            start = before[state]
            out.append(dict.fromkeys(schema.names) | {"conv": total["conv"], "part": part, "piece": piece, "state": start, "edits": audits[4 * start + state] + tail})
            state, tail = start, ""
        yield from (pa.RecordBatch.from_pylist(out[i : i + 512], schema) for i in range(0, len(out), 512))

    for batch in batches:
        for row in batch.to_pylist():
            if not total or row["conv"] != total["conv"]:
                if total:
                    yield from finished()
                best, steps, total = [(0, ""), None, None, None], [], {"conv": row["conv"], **dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0), "first": None, "last": None, "low": None, "high": None}
            total["illegal"] += total["last"] is not None and total["last"] + row["first"] not in LEGAL
            for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
                total[c] += row[c]
            if row["low"] is not None:
                total["turns"] -= row["low"] == total["high"]
                total["low"], total["high"] = row["low"] if total["low"] is None else total["low"], row["high"]
            total["last"] = row["last"]
            found, before = [None] * 4, [None] * 4
            for q, b in enumerate(best):
                for to in range(4):
                    way = row["ways"][4 * q + to]
                    if b is not None and way is not None and (found[to] is None or (b[0] + way["cost"], b[1] + way["audit"]) < found[to]):
                        found[to], before[to] = (b[0] + way["cost"], b[1] + way["audit"]), q
            best = found
            steps.append((row["part"], row["piece"], before, [x and x["audit"] for x in row["ways"]]))
    if total:
        yield from finished()


def _rewritten(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv", kind), ("part", pa.int32()), ("piece", pa.int32()), ("body", pa.string())])
    for batch in batches:
        for row in batch.to_pylist():
            lines = written([(x["role"], x["text"], x["fault"]) for x in row["rows"]], row["edits"], row["state"])
            yield pa.RecordBatch.from_pylist([{"conv": row["conv"], "part": row["part"], "piece": row["piece"], "body": "\n".join(lines) if lines else None}], schema)


def _hashed(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The digest of each conversation's pieces in order, read as a stream."""
    schema = pa.schema([("conv", kind), ("sha", pa.string())])
    now, digest, empty = object(), None, True
    for batch in batches:
        for conv, body in zip(batch.column("conv").to_pylist(), batch.column("body").to_pylist()):
            if digest is None or conv != now:
                if digest is not None:
                    yield pa.RecordBatch.from_pylist([{"conv": now, "sha": digest.hexdigest()}], schema)
                now, digest, empty = conv, hashlib.sha256(), True
            if body is not None:
                digest.update((b"" if empty else b"\n") + body.encode("utf-8", "surrogatepass"))
                empty = False
    if digest is not None:
        yield pa.RecordBatch.from_pylist([{"conv": now, "sha": digest.hexdigest()}], schema)


def damaged(rows: DataFrame, fault_of: Column) -> DataFrame:
    """conv_id, turn, role, text after faults: 0 drops a row, 1 empties its text, 2 removes . ! ?, 3 repeats it, 4 makes it the user's."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    text = F.when(fault_of == 1, "").when(fault_of == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    kept = rows.where(fault_of != 0).select("conv_id", "turn", F.when(fault_of == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.when(fault_of == 3, 2).otherwise(1).alias("__mp_n"))
    return kept.withColumn("__mp_n", F.explode(F.sequence(F.lit(1), "__mp_n"))).drop("__mp_n")


def repaired(rows: DataFrame) -> DataFrame:
    """rows: conv_id, turn, role, text. One row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    bound_batches(rows.sparkSession)
    told = rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    told = told.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("many"))  # equal rows are one with a count
    told = materialise(told.withColumn("h", F.xxhash64("conv", "role", "text")), "told")
    # what is said again in later turns; most is said once
    again = told.groupBy("h", "conv", "role", "text").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first"), F.bool_or(F.col("turn").isNull()).alias("open")).where("n > 1")
    a, b = told.alias("a"), again.alias("b")
    met = a.join(b.hint("merge"), (F.col("a.h") == F.col("b.h")) & F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.text") == F.col("b.text")), "left")
    seen = F.coalesce(F.when(F.col("open"), F.col("a.turn").isNotNull()).otherwise(F.col("a.turn") > F.col("first")), F.lit(False))
    seen = materialise(met.select("a.conv", "a.turn", "a.role", "a.text", "a.many", seen.alias("seen")), "seen")
    order = ["conv", "turn", "role", "text"]
    ranges = [*order[:3], F.substring("text", 1, 64)]  # the driver samples these; a prefix stands as its texts do
    of, arrow = seen.schema["conv"].dataType.simpleString(), to_arrow_type(seen.schema["conv"].dataType)
    key = f"conv {of}, part int, piece int"
    schema = f"{key}, {_COUNTS}, cost bigint, audit string, sha string, ways array<struct<cost:bigint,audit:string>>, rows array<struct<role:string,text:string,fault:string>>"
    found = materialise(seen.repartitionByRange(*ranges).sortWithinPartitions(*order).mapInArrow(lambda x: _walked(x, arrow), schema), "walked")
    open_ones = found.where("ways is not null")
    pieces = open_ones.drop("rows", "cost", "audit", "sha").repartition("conv").sortWithinPartitions("conv", "part", "piece")
    told_of = materialise(pieces.mapInArrow(lambda x: _joined(x, arrow), f"{key}, state int, edits string, {_COUNTS}, cost bigint, audit string"), "joined")
    bodies = open_ones.select("conv", "part", "piece", "rows").join(told_of.where("piece is not null").select("part", "piece", "state", "edits").hint("merge"), ["part", "piece"])
    bodies = bodies.mapInArrow(lambda x: _rewritten(x, arrow), f"{key}, body string").repartition("conv").sortWithinPartitions("conv", "part", "piece")
    shas = bodies.mapInArrow(lambda x: _hashed(x, arrow), f"conv {of}, sha string").alias("s")
    counts = ["blank", "duplicate", "truncated", "illegal", "low", "high", "turns", "cost", "audit"]
    late = told_of.where("piece is null").alias("t").join(shas.hint("merge"), F.col("t.conv").eqNullSafe(F.col("s.conv"))).select("t.conv", *(f"t.{c}" for c in counts), "s.sha")
    every = found.where("ways is null").select("conv", *counts, "sha").unionByName(late)
    every = materialise(every.select(F.col("conv").alias("conv_id"), F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("bigint")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256")), "repaired")
    discard(told, seen, found, told_of)
    return every


NOTHING = hashlib.sha256(b"").hexdigest()


def with_all(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """found, and a row for each conv_id of conversations that it lacks."""
    ids = conversations.select("conv_id").distinct().alias("i")
    zero = lambda c: F.coalesce(f"f.{c}", F.lit(0).cast("bigint")).alias(c)
    met = ids.join(found.alias("f").hint("merge"), F.col("i.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    return met.select("i.conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("f.audit", F.lit("")).alias("audit"), F.coalesce("f.repaired_sha256", F.lit(NOTHING)).alias("repaired_sha256"))
