"""Byte-level BPE over a block of the corpus at a time: merge replay on its distinct words.

A task gathers documents until a block holds `BLOCK` characters, splits them by the pattern and
keeps every distinct word once. An inverted index leads from each mergeable token pair (named by
the rank of what it makes) to the positions in words where it stands. Merges are taken from the
index in rank order, each at all its positions together; only the pairs to the left and right of a
merge are looked up again and entered under their own rank. Two rules keep this equal to encoding
word by word: a rank made by a merge may be lower than the current one, so the lowest pending rank
is always next, and of several positions in one word only the first is merged at a time.

Words never depend on each other, so blocks need no shuffle and a lost task is simply run again.
Blocks bound the memory; a longer text is a block of its own.

A word list of the whole corpus instead would have to split every text a second time, and most of
its distinct words are rare ones, which are replayed once either way.

Defined cases: null and empty texts have no ids and decode to no bytes; special tokens are
ordinary text; ids out of the vocabulary make decoding fail; repeated rows get equal ids; an empty
table gives no rows; columns ids (encoding) and decoded (decoding) of the input are replaced, other
columns are left alone."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .shared import bound_batches, no_nulls

#: Characters in one block.
BLOCK = 12 << 20


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class Ragged:
    """Rows of different lengths in one flat array."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths = flat, lengths
        self.at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows one after another, and their lengths."""
        n = self.lengths[rows]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.at[rows] - (ends - n), n)], n


class Merges:
    """What two adjacent tokens make, by rank."""

    def __init__(self, tokens: list[bytes]):
        rank = {t: i for i, t in enumerate(tokens) if t}
        self.bytes = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        left, right, made = [], [], []
        for t, r in rank.items():
            for i in range(1, len(t)):
                a, b = rank.get(t[:i]), rank.get(t[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(r)
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(keys)
        self.keys, self.made = np.append(keys[order], np.int64(2**62)), np.append(np.array(made, np.int32)[order], -1)
        of = np.arange(256)
        self.first = self.of(np.repeat(self.bytes, 256), np.tile(self.bytes, 256)).reshape(256, 256)[of]

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        i = np.searchsorted(self.keys, keys)
        return np.where(self.keys[i] == keys, self.made[i], -1).astype(np.int32)


def replay(words: list[bytes], merges: Merges) -> Ragged:
    """The token ids of each word."""
    raw = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(lengths)
    total = len(raw)
    if not total:
        return Ragged(np.zeros(0, np.int32), np.zeros(len(words), np.int64))
    word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    token = merges.bytes[raw]
    after = np.arange(1, total + 1, dtype=np.int32)
    before = np.arange(-1, total - 1, dtype=np.int32)
    after[ends[lengths > 0] - 1] = -1
    before[(ends - lengths)[lengths > 0]] = -1
    makes = np.full(total, -1, np.int32)  # what the token at a position and the next one make
    makes[:-1] = merges.first[raw[:-1], raw[1:]]
    makes[after < 0] = -1
    index: dict[int, list[np.ndarray]] = {}
    pending: list[int] = []

    def enter(at: np.ndarray) -> None:
        rank = makes[at]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        begin = [0, *cut.tolist()]
        for r, a, b in zip(rank[begin].tolist(), begin, [*begin[1:], len(at)]):
            if r in index:
                index[r].append(at[a:b])
            else:
                index[r] = [at[a:b]]
                heapq.heappush(pending, r)

    if len(start := np.flatnonzero(makes >= 0).astype(np.int32)):
        enter(start)
    while pending:
        rank = heapq.heappop(pending)
        parts = index.pop(rank)
        at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        at = at[makes[at] == rank]
        if len(at) > 1:
            own = word[at]
            again = np.concatenate([[False], own[1:] == own[:-1]])
            if again.any():
                index[rank] = [at[again]]
                heapq.heappush(pending, rank)
                at = at[~again]
        if not len(at):
            continue
        gone = after[at]
        token[at], token[gone], makes[gone] = rank, -1, -1
        beyond = after[gone]
        after[at] = beyond
        makes[at] = -1
        more = beyond >= 0
        here, there = at[more], beyond[more]
        before[there] = here
        makes[here] = merges.of(token[here], token[there])
        prior = before[at]
        prior = prior[prior >= 0]
        makes[prior] = merges.of(token[prior], np.full(len(prior), rank))
        touched = np.concatenate([here, prior])
        touched = touched[makes[touched] >= 0]
        if len(touched):
            enter(touched)
    alive = token >= 0
    return Ragged(token[alive], np.bincount(word[alive], minlength=len(words)))


def _encoded(batches: Iterator[pa.RecordBatch], text: str, tokens: list[bytes], pattern: str) -> Iterator[pa.RecordBatch]:
    merges, split = Merges(tokens), regex.compile(pattern).findall

    def block(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {}
        rows: list[list[np.ndarray]] = []
        for batch in held:
            rows.append([])
            for t in no_nulls(batch.column(text)).to_pylist():
                found = split(t)
                rows[-1].append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int32, len(found)))
        ids = replay([w.encode("utf-8", "surrogatepass") for w in numbers], merges)
        for batch, found in zip(held, rows):
            flat, n = ids.take(np.concatenate(found) if found else np.zeros(0, np.int32))
            ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))], names=[*batch.schema.names, "ids"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(text).nbytes
        if size >= BLOCK:
            yield from block(held)
            held, size = [], 0
    yield from block(held)


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with the column ids, array<int>."""
    bound_batches(docs.sparkSession)
    tokens = read_ranks(path)
    schema = StructType([*(f for f in docs.schema.fields if f.name != "ids"), StructField("ids", ArrayType(IntegerType()))])
    return docs.drop("ids").mapInArrow(lambda b: _encoded(b, text, tokens, pattern), schema)


def _decoded(batches: Iterator[pa.RecordBatch], tokens: list[bytes]) -> Iterator[pa.RecordBatch]:
    vocabulary = Ragged(np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens], np.int64))
    for batch in batches:
        ids = batch.column("ids")
        starts = np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat, n = vocabulary.take(ids.flatten().to_numpy(zero_copy_only=False))
        ends = np.concatenate([[0], np.cumsum(n)])[starts]
        data = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])
        yield pa.RecordBatch.from_arrays([*batch.columns, data], names=[*batch.schema.names, "decoded"])


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """rows (with ids) with the column decoded, binary."""
    tokens = read_ranks(path)
    schema = StructType([*(f for f in rows.schema.fields if f.name != "decoded"), StructField("decoded", BinaryType())])
    return rows.drop("decoded").mapInArrow(lambda b: _decoded(b, tokens), schema)
