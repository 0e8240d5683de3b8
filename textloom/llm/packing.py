"""Best-fit packing of documents into sequences of a fixed number of tokens, in bulk-synchronous steps.

Documents become pieces of at most ``capacity`` tokens. Pieces are range-sorted by length and
ranked within it by all tasks at once: each task numbers its own, and the counts of the tasks
before it are added. Then steps follow, each a Spark job that reads the tables which the
step before has written and writes its own. A step takes a range of lengths, longest first (each
range is half the one before), and the gaps that sequences still have, sorted. A sweep matches the pieces with
the successor gaps (the smallest that hold them); who gets which is settled by rank; gaps are
updated and, where pieces of the range fit them again, swept again; pieces that fit none
open sequences. At last every task finds the places of its own pieces by their rank.

Lengths and gaps are whole numbers up to the capacity, so the sorted lists are held as runs: equal
lengths are one run of ranks, equal gaps runs of sequence numbers. A step's tables and the number of steps depend on
the capacity and not on the number of documents, so a step is one task's short sweep; counting, ranking and placing are
everybody's. The driver only starts the steps. The result is that of best fit with decreasing lengths.

Defined results: null text is the end id alone; very long texts are cut into pieces and nothing is dropped; rows that
share a doc_id are packed as documents of their own; ties in length go by task and place; an empty table gives an
empty result; columns named ``sequence_id`` or ``offset`` are replaced, all others pass through.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.encoding import default_path, encoder
from textloom.session import lean, materialize, ship, unused

CAPACITY = 2048
END_ID = 0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass
class Plan:
    """Runs of pieces of one length: ranks from ``rank`` on go to sequences from ``sequence`` on, ``each`` to one, from ``offset``."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int = 0

    @staticmethod
    def of(runs: list[tuple[int, int, int, int, int]], sequences: int = 0) -> Plan:
        return Plan(*np.array(sorted(runs), np.int64).reshape(-1, 5).T, sequences)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces."""
        key = self.length * (1 << 48) + self.rank
        run = np.searchsorted(key, length * (1 << 48) + rank, "right") - 1
        over = rank - self.rank[run]
        return self.sequence[run] + over // self.each[run], self.offset[run] + over % self.each[run] * length


def ranges(capacity: int) -> list[tuple[int, int]]:
    """The ranges of lengths of the steps, longest first, both ends included."""
    out = []
    while capacity:
        out.append((capacity // 2 + 1, capacity))
        capacity //= 2
    return out


def sweep(counts: dict[int, int], gaps: list[tuple[int, int, int]], sequences: int, capacity: int) -> tuple[list[tuple], list[tuple[int, int, int]], int]:
    """One step: runs of ``counts`` pieces by length in the ``gaps`` (gap, first sequence, number) of so many sequences, the gaps after it, and the sequences."""
    held: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for gap, first, n in sorted(gaps, key=lambda g: (g[0], -g[1])):
        held[gap].append((first, n))
    sizes = sorted(held)  # gaps that some sequence has, in order
    runs: list[tuple] = []

    def leave(gap: int, first: int, n: int) -> None:
        if gap:
            if not held[gap]:
                insort(sizes, gap)
            held[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left and (k := bisect_left(sizes, length)) < len(sizes):
            gap = sizes[k]
            first, n = held[gap].pop()
            take = min(n, left)
            if take < n:
                held[gap].append((first + take, n - take))
            if not held[gap]:
                sizes.pop(k)
            runs.append((length, rank, first, 1, capacity - gap))
            leave(gap - length, first, take)
            rank, left = rank + take, left - take
        each = capacity // length
        for many, n in ((each, left // each), (left % each, 1)):
            if many and n:
                runs.append((length, rank, sequences, many, 0))
                leave(capacity - many * length, sequences, n)
                rank, sequences = rank + many * n, sequences + n
    return runs, [(gap, *run) for gap in sizes for run in held[gap]], sequences


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The steps one after the other in this process, for ``counts`` pieces by length."""
    runs, gaps, sequences = [], [], 0
    for low, high in ranges(capacity):
        more, gaps, sequences = sweep({n: c for n, c in counts.items() if low <= n <= high}, gaps, sequences, capacity)
        runs += more
    return Plan.of(runs, sequences)


#: Rows between steps: runs of pieces (kind 0: length, rank, sequence, each, offset), gaps (1: gap, first, number), the sequences so far (2), lengths to place (3: length, number).
_STATE = "kind int, a long, b long, c long, d long, e long"


def steps(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Best fit for ``length, n``: the runs ``length, rank, sequence, each, offset``."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        counts = {a: b for kind, a, b, *_ in rows if kind == 3}
        runs, gaps, sequences = sweep(counts, [(a, b, c) for kind, a, b, c, *_ in rows if kind == 1], sum(r[1] for r in rows if r[0] == 2), capacity)
        out = [(0, *r) for r in runs] + [(1, *g, 0, 0) for g in gaps] + [(2, sequences, 0, 0, 0, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.int64()] * 5), strict=True)], names=[x.split()[0] for x in _STATE.split(", ")])

    rows = lengths.selectExpr("3 as kind", "length as a", "n as b", "0L as c", "0L as d", "0L as e")
    last = max((r[0] for r in lengths.agg(F.max("length")).collect()), default=None) or 0
    least = lengths.agg(F.min("length")).first()[0] or 0
    state, runs = None, None
    for low, high in ranges(capacity):
        if low > last or high < least:
            continue
        some = rows.where(F.col("a").between(low, high))
        some = some if state is None else some.unionByName(state.where("kind in (1, 2)"))
        state = materialize(some.coalesce(1).mapInArrow(lean(step), _STATE), "step")
        runs = state.where("kind = 0") if runs is None else runs.unionByName(state.where("kind = 0"))
    if runs is None:
        runs = rows.limit(0)
    return runs.selectExpr("a as length", "b as rank", "c as sequence", "d as each", "e as offset")


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of the pieces of n tokens; only the first may be shorter than the capacity if there are several."""
    first = n - (n - 1) // capacity * capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Encode ``doc_id, text`` and cut it into pieces; the ids as little-endian 32-bit binary if asked for."""
    tokenizer = tokenizer or default_path()
    ship(docs.sparkSession)
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * with_ids]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            texts, doc_ids = batch.column("text"), batch.column("doc_id").to_pylist()
            rows = []
            for k in range(0, len(doc_ids), 100):
                for doc_id, ids in zip(doc_ids[k : k + 100], enc.encode(texts.slice(k, 100).to_pylist()), strict=True):
                    data = np.append(ids, np.array([end_id], ids.dtype)).astype("<u4").tobytes()
                    for i, (start, n) in enumerate(cut(len(ids) + 1, capacity)):
                        part = data[4 * start : 4 * (start + n)]
                        rows.append((doc_id, i, start, n, zlib.crc32(part), *[part] * with_ids))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInArrow(lean(run), PIECES + ", ids binary" * with_ids)


def pack(rows: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows whose ``length`` is 1 to ``capacity``."""
    spark = rows.sparkSession
    ship(spark)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            n = batch.column(length).to_numpy().astype(np.int64)
            order = np.argsort(n, kind="stable")
            first = np.flatnonzero(np.diff(n[order], prepend=-1))
            rank = np.empty(len(n), np.int64)
            rank[order] = np.arange(len(n)) - np.repeat(first, np.diff(np.append(first, len(n))))
            rank += seen[n]
            seen += np.bincount(n, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), task, np.int32)), pa.array(rank)], names=[*batch.schema.names, task_, rank_])

    own = [f for f in rows.schema if f.name.lower() not in ("sequence_id", "offset")]
    names = [f.name for f in own]
    task_, rank_, n_, before_ = (unused(rows, x) for x in ("task", "rank", "n", "before"))
    rows = materialize(rows.select([F.col(f"`{n}`") for n in names]), "rows")  # numbering and what makes the rows run one after the other
    ranked = T.StructType([*own, T.StructField(task_, T.IntegerType()), T.StructField(rank_, T.LongType())])
    numbered = materialize(rows.mapInArrow(lean(number), ranked), "pieces")

    counts = materialize(numbered.groupBy(F.col(length).alias("length"), F.col(task_).alias("task")).agg(F.count(F.lit(1)).alias("n")), "lengths")
    lengths = materialize(counts.groupBy(F.col("length").cast("long").alias("length")).agg(F.sum("n").alias("n")), "totals")  # a row per length
    # the number of runs has a bound by the capacity, whatever the number of pieces
    places = spark.sparkContext.broadcast(Plan.of([tuple(r) for r in steps(lengths, capacity).collect()]))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select(F.col("length").alias(n_), F.col("task").alias(task_), F.coalesce(before, F.lit(0)).alias(before_))
    joined = numbered.withColumn(n_, F.col(length)).join(before, [n_, task_])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = batch.column(length).to_numpy().astype(np.int64), batch.column(rank_).to_numpy() + batch.column(before_).to_numpy()
            sequence, offset = places.value.place(n, rank) if len(n) else (n, n)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    result = T.StructType([*own, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return joined.select(*(F.col(f"`{x}`") for x in names), rank_, before_).mapInArrow(lean(place), result)
