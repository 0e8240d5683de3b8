"""Whitening of embeddings: projections on the strongest components of the covariance, scaled to unit variance.

Statistics come from each distinct vector once. Every partition computes its count, exact sums, local mean and
centred scatter, batch by batch; two such states merge by Chan's pairwise formula, within a task and between tasks in a
tree reduction. The driver gets one state (a square of the dimension), whose covariance it decomposes. A second pass over the distinct
vectors computes the covariance of what whitening makes of them in the same way, and its distance from the identity.

Entries are whole numbers, floor(scale * entry), so sums are exact in any layout.

Scale: distinct vectors are found by partial aggregation, so a vector that a third of all rows hold is one row per
task; states don't grow with the rows; weights (dimension times components) go with the tasks' code.

Defined results: rows go whose vector is null or has a null or non-finite entry; entries beyond a long become the nearest long; an
empty vector is all zeros, and shorter vectors are as if zeros followed up to the longest; repeated rows are all returned, and counted once in the
statistics; components of equal variance are any that fit; where a component has no variance (fewer distinct vectors than
components, constant tables) its whitened value and share are 0 and the identity isn't asked of it; an empty table gives an empty result; all other
columns pass through, but for those named like a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.session import lean, materialize, ship, unused

SCALE = 256
COMPONENTS = 4
BATCH_ROWS = 4096
#: Variances below this share of the largest are rounding.
LEAST_SHARE = 1e-13


@dataclass
class Moments:
    """Count, exact sums (None where they aren't whole numbers), mean and centred scatter of some vectors."""

    n: int
    total: list[int] | None
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def none(dim: int) -> Moments:
        return Moments(0, [0] * dim, np.zeros(dim), np.zeros((dim, dim)))

    @staticmethod
    def of(rows: np.ndarray) -> Moments:
        """Of the rows of a matrix; sums of whole numbers are exact."""
        total = None
        if rows.dtype.kind == "i":
            fits = not rows.size or int(max(-int(rows.min()), int(rows.max()))) < (1 << 62) // len(rows)
            total = [int(x) for x in (rows.sum(0) if fits else rows.astype(object).sum(0))]
        mean = np.array([t / len(rows) for t in total]) if total is not None else rows.mean(0)
        centred = rows - mean
        return Moments(len(rows), total, mean, centred.T @ centred)


def merge(a: Moments, b: Moments) -> Moments:
    """Moments of both sets: scatters add, with that of the two means about their own."""
    if not a.n or not b.n:
        return a if a.n else b
    n = a.n + b.n
    apart = b.mean - a.mean
    total = None if a.total is None or b.total is None else [x + y for x, y in zip(a.total, b.total, strict=True)]
    return Moments(n, total, a.mean + apart * (b.n / n), a.scatter + b.scatter + np.outer(apart, apart) * (a.n * b.n / n))


@dataclass
class Whitener:
    """``weights`` (dimension by components) of centred vectors; ``variances`` fall; ``identity_error`` is measured on the distinct vectors."""

    n: int
    total: list[int]
    mean: np.ndarray
    weights: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0


def _sound(vector: Column) -> Column:
    number = lambda c: c.cast("double")
    return vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(~F.isnan(number(c)) & (F.abs(number(c)) < float("inf")), F.lit(False)))


def _whole(vector: Column, dim: int) -> Column:
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size(vector)))


def _matrices(batch: pa.RecordBatch, column: str, dim: int) -> Iterator[tuple[int, np.ndarray]]:
    """First row and matrix of the vectors of a batch, some thousand rows at a time."""
    for begin in range(0, batch.num_rows, BATCH_ROWS):
        part = batch.column(column).slice(begin, BATCH_ROWS)
        yield begin, part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), dim)


def _moments(vectors: DataFrame, column: str, dim: int, view=None) -> Moments:
    """Moments of all rows by a tree reduction of the partitions'; ``view`` makes other vectors of them first."""
    out_dim = dim if view is None else view(np.zeros((0, dim))).shape[1]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Moments.none(out_dim)
        for batch in batches:
            for _, rows in _matrices(batch, column, dim):
                state = merge(state, Moments.of(rows if view is None else view(rows)))
        total = None if state.total is None else [str(x) for x in state.total]
        yield pa.RecordBatch.from_arrays(
            [pa.array([state.n]), pa.array([total], pa.list_(pa.string())), pa.array([state.mean.tobytes()]), pa.array([state.scatter.tobytes()])], names=["n", "total", "mean", "scatter"]
        )

    def state(r) -> Moments:
        total = None if r["total"] is None else [int(x) for x in r["total"]]
        return Moments(r["n"], total, np.frombuffer(r["mean"]).copy(), np.frombuffer(r["scatter"]).reshape(out_dim, out_dim).copy())

    states = vectors.select(column).mapInArrow(lean(own), "n long, total array<string>, mean binary, scatter binary").rdd.map(state)
    return states.treeReduce(merge) if states.getNumPartitions() else Moments.none(out_dim)


def decompose(m: Moments, components: int = COMPONENTS) -> Whitener:
    """Unit eigenvectors of the covariance by falling eigenvalue, over the root of it; the largest entry of each is positive."""
    dim = len(m.mean)
    k = min(components, dim)
    if not m.n or not k:
        return Whitener(m.n, m.total, m.mean, np.zeros((dim, k)), np.zeros(k), np.zeros(k))
    covariance = m.scatter / m.n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    trace = float(np.trace(covariance))
    real = values > max(values[0], 0.0) * LEAST_SHARE
    values = np.where(real, values, 0.0)
    weights = np.where(real, vectors / np.sqrt(np.where(real, values, 1.0)), 0.0)
    return Whitener(m.n, m.total, m.mean, weights, values, values / trace if trace > 0 else values)


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitener:
    """A whitener from the distinct sound vectors of a column."""
    ship(rows.sparkSession)
    sound = rows.select(F.col(vector).alias("v")).where(_sound(F.col("v")))
    dim = sound.agg(F.max(F.size("v"))).first()[0] or 0
    distinct = materialize(sound.select(_whole(F.col("v"), dim).alias("x")).distinct(), "distinct")
    out = decompose(_moments(distinct, "x", dim), components)
    mean, weights = out.mean, out.weights
    made = _moments(distinct, "x", dim, lambda x: (x - mean) @ weights)
    if made.n:
        real = np.flatnonzero(out.variances > 0)
        off = (made.scatter / made.n - np.eye(len(out.variances)))[np.ix_(real, real)]
        out.identity_error = float(np.abs(off).max()) if off.size else 0.0
    return out


def deviations(x: np.ndarray, n: int, total: list[int]) -> pa.Array:
    """Exact sums over dimensions of (n * x - total)^2."""
    reach = n * max(-int(x.min(initial=0)), int(x.max(initial=0))) + max(map(abs, total), default=0)
    if reach * reach * max(1, x.shape[1]) < 1 << 63:
        d = n * x - np.array(total, np.int64)
        return pa.array((d * d).sum(1)).cast(pa.decimal128(38, 0))
    d = x.astype(object) * n - np.array(total, object)
    sums = [sum(v * v for v in row) for row in d]
    return pa.array([Decimal(s) if s < 10**38 else None for s in sums], pa.decimal128(38, 0))


def whiten(rows: DataFrame, whitener: Whitener, vector: str = "embedding", deviation: str = "deviation", whitened: str = "whitened") -> DataFrame:
    """Add ``deviation`` (null if it has over 38 digits) and ``whitened``, a value per component, to rows with sound vectors; others go."""
    ship(rows.sparkSession)
    dim = len(whitener.mean)
    x = unused(rows, "x")
    dropped = {deviation.lower(), whitened.lower()}
    kept = [F.col(f"`{f.name}`") for f in rows.schema if f.name.lower() not in dropped]
    sound = rows.where(_sound(F.col(vector)) & (F.size(vector) <= dim))
    sound = sound.select(F.struct(*kept).alias(unused(rows, "row")), _whole(F.col(vector), dim).alias(x))
    row = unused(rows, "row")
    model = whitener

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, values in _matrices(batch, x, dim):
                flat = ((values - model.mean) @ model.weights).ravel()
                k = model.weights.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * k), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(row).slice(begin, BATCH_ROWS), deviations(values, model.n, model.total), lists], names=[row, deviation, whitened])

    schema = T.StructType([sound.schema[row], T.StructField(deviation, T.DecimalType(38, 0)), T.StructField(whitened, T.ArrayType(T.DoubleType()))])
    return sound.mapInArrow(lean(run), schema).select(f"{row}.*", deviation, whitened)
