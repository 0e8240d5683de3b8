"""Multinomial logistic regression over hashed character n-grams: language, quality and harm labels with a probability.

A text's features are its lower-cased character n-grams of all ORDERS, hashed to 2^BITS buckets; a bucket's value is the root of its count, and a
text's values have length one. Features are computed once and stored: the buckets of a text, those of one count together, and each count once. Each
step sends the weights to the tasks, every partition sums loss and gradient over its rows, some tasks add these sums up, and the driver makes a step
by AdaGrad. So training covers every labelled row, nothing but weights and gradients (classes times buckets) reaches the driver, and a lost executor
costs its partitions' sums. As probabilities add up to one, the last class is the others' complement in both directions of a step.

Defined results: null and empty texts have no features and get the labels' shares by the intercepts; very long texts count whole, a part at a time;
rows without a label don't train; ties between labels go to the first by name; without any labelled row there is no model (ValueError); texts to
score keep all their columns but those named like a result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.session import lean, materialize, ship

BITS = 16
ORDERS = (1, 2, 3, 4)
STEPS, RATE, SHRINK = 30, 0.5, 1e-6
#: Classes of a model; its weights are MAX_CLASSES * 2^BITS numbers at most.
MAX_CLASSES = 256
#: Characters whose n-grams are hashed at a time, texts that are taken out of a batch, and their features that a step works on; all bound a worker's memory.
GROUP_CHARS, GROUP_TEXTS, GROUP_FEATURES = 1 << 14, 64, 1 << 17
#: Partitions of a step for each core: each sends a gradient.
WAVES = 2
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    return x ^ (x >> np.uint64(29))


def _hashes(code: np.ndarray, starts: int, bits: int, orders: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """Each order with the buckets of its n-grams that begin at the first ``starts`` places."""
    h = np.zeros(len(code), np.uint64)
    for n in range(1, max(orders) + 1):
        rest = len(code) - n + 1
        if rest <= 0:
            break
        h = _spread(h[:rest] * _ODD + code[n - 1 :] + np.uint64(n))
        if n in orders:
            yield n, h[:starts] >> np.uint64(64 - bits)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)


def _counts(texts: list[str | None], bits: int, orders: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For groups of texts in order: how many they are, ``text number << bits | bucket`` ascending, and counts."""
    at = 0
    while at < len(texts):
        stop, chars = at, 0
        while stop < len(texts) and (stop == at or chars + len(texts[stop] or "") <= GROUP_CHARS):
            chars += len(texts[stop] or "")
            stop += 1
        group = [(t or "").lower() for t in texts[at:stop]]
        at = stop
        if len(group) == 1 and len(group[0]) > GROUP_CHARS:
            every = np.zeros(1 << bits, np.int64)
            for begin in range(0, len(group[0]), GROUP_CHARS):
                for _, bucket in _hashes(_codes(group[0][begin : begin + GROUP_CHARS + max(orders) - 1]), GROUP_CHARS, bits, orders):
                    every += np.bincount(bucket.astype(np.int64), minlength=1 << bits)
            key = np.flatnonzero(every)
            yield 1, key, every[key]
            continue
        code = _codes("".join(group))
        kind = np.uint32 if len(group) << bits <= 1 << 32 else np.int64  # the narrow one sorts faster
        owner = np.repeat(np.arange(len(group)), [len(t) for t in group])
        number = owner.astype(kind) << kind(bits)
        keys = []
        for n, bucket in _hashes(code, len(code), bits, orders):
            rest = len(bucket)
            key = number[:rest] | bucket.astype(kind)
            keys.append(key if len(group) == 1 else key[owner[:rest] == owner[n - 1 :]])
        key = np.concatenate(keys) if keys else np.zeros(0, kind)
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        yield len(group), key[first].astype(np.int64), np.diff(first, append=len(key))


def features(texts: list[str | None], bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and values of each text."""
    for size, key, count in _counts(texts, bits, orders):
        ends = np.searchsorted(key >> bits, np.arange(size + 1))
        for a, b in zip(ends[:-1], ends[1:]):
            yield key[a:b] & ((1 << bits) - 1), np.sqrt(count[a:b] / max(count[a:b].sum(), 1))


@dataclass
class LinearModel:
    """``weights`` is classes by buckets."""

    labels: list[str]
    weights: np.ndarray
    intercept: np.ndarray
    bits: int = BITS

    def contrasts(self) -> np.ndarray:
        """Weights of all classes but the last, less those of the last."""
        return self.weights[:-1] - self.weights[-1]

    def probabilities(self, bucket: np.ndarray, value: np.ndarray, sizes: np.ndarray, contrasts: np.ndarray) -> np.ndarray:
        """Texts by classes, from all texts' features and their numbers."""
        some = np.flatnonzero(sizes)
        begins = (np.cumsum(sizes) - sizes)[some]
        scores = np.zeros((len(sizes), len(self.labels)))
        work = np.empty(len(bucket))
        for c, weights in enumerate(contrasts if len(some) else []):
            np.take(weights, bucket, out=work, mode="clip")
            np.multiply(work, value, out=work)
            scores[some, c] = np.add.reduceat(work, begins)
        scores += self.intercept
        p = np.exp(scores - scores.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _pieces(column: pa.Array) -> Iterator[list]:
    for begin in range(0, len(column), GROUP_TEXTS):
        yield column.slice(begin, GROUP_TEXTS).to_pylist()


def _packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Bytes of the values, so many for each row."""
    ends = np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])


def _unpacked(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All rows' values, and where each row ends, from 0."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    values = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(kind)
    return values, (ends - ends[0]) // values.itemsize


def _kind(bits: int) -> str:
    return "<u2" if bits <= 16 else "<u4"


def _feature_rows(rows: DataFrame, bits: int) -> DataFrame:
    """``y, bucket, count, run`` of ``y, text``: buckets by count, each count that the text has and its number of buckets; arrays as bytes."""
    names = ["y", "bucket", "count", "run"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("y")
            at = 0
            for texts in _pieces(batch.column("text")):
                for size, key, count in _counts(texts, bits, ORDERS):
                    most = int(count.max(initial=0)) + 1
                    by_count = (key >> bits) * most + count << bits | key & ((1 << bits) - 1)
                    by_count.sort()
                    kinds = by_count >> bits  # text and count
                    first = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]])) if len(kinds) else np.zeros(0, np.int64)
                    of_run, counts = np.divmod(kinds[first], most)
                    runs = np.bincount(of_run, minlength=size)
                    buckets = np.bincount(key >> bits, minlength=size)
                    columns = [_packed((by_count & ((1 << bits) - 1)).astype(_kind(bits)), buckets), _packed(counts.astype("<u4"), runs), _packed(np.diff(first, append=len(kinds)).astype("<u4"), runs)]
                    yield pa.RecordBatch.from_arrays([y.slice(at, size), *columns], names=names)
                    at += size

    return rows.select("y", "text").mapInArrow(lean(run), "y int, bucket binary, count binary, run binary")


def _stored(batch: pa.RecordBatch, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``y``, buckets, values and numbers of features of texts that have GROUP_FEATURES together, or of one."""
    y = batch.column("y").to_numpy()
    bucket, ends = _unpacked(batch.column("bucket"), _kind(bits))
    count, run_ends = _unpacked(batch.column("count"), "<u4")
    run, _ = _unpacked(batch.column("run"), "<u4")
    at = 0
    while at < len(y):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + GROUP_FEATURES, "right")) - 1)
        part = slice(run_ends[at], run_ends[stop])
        number, times = count[part].astype(np.float64), run[part].astype(np.int64)
        of_run = np.repeat(np.arange(stop - at), np.diff(run_ends[at : stop + 1]))
        total = np.bincount(of_run, weights=number * times, minlength=stop - at)
        yield y[at:stop], bucket[ends[at] : ends[stop]].astype(np.int64), np.repeat(np.sqrt(number / total[of_run]), times), np.diff(ends[at : stop + 1])
        at = stop


_SUMS = "part int, n long, slope binary, slopes binary"


def _sums(part: int, n: int, slope: np.ndarray, slopes: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([slope.tobytes()]), pa.array([slopes.tobytes()])]
    return pa.RecordBatch.from_arrays(columns, names=["part", "n", "slope", "slopes"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of a partition's rows."""
    part, n, slope, slopes = 0, 0, 0.0, 0.0
    for batch in batches:
        for k in range(batch.num_rows):
            part, n = batch.column("part")[k].as_py(), n + batch.column("n")[k].as_py()
            slope = slope + np.frombuffer(batch.column("slope")[k].as_buffer())
            slopes = slopes + np.frombuffer(batch.column("slopes")[k].as_buffer())
    if n:
        yield _sums(part, n, slope, slopes)


def train(docs: DataFrame, labels: DataFrame, steps: int = STEPS, rate: float = RATE, bits: int = BITS) -> LinearModel:
    """A model from ``doc_id, text`` and ``doc_id, label``."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.where("label is not null").select("doc_id", F.col("label").cast("string").alias("label"))
    shares = known.groupBy("label").count().orderBy("label").limit(MAX_CLASSES + 1).collect()
    if not shares or len(shares) > MAX_CLASSES:
        raise ValueError(f"a model has 1 to {MAX_CLASSES} labels")
    names = [r["label"] for r in shares]
    number = F.array_position(F.array(*map(F.lit, names)), F.col("label")) - 1
    rows = materialize(_feature_rows(docs.select("doc_id", "text").join(known.withColumn("y", number.cast("int")), "doc_id"), bits), "features")
    model = LinearModel(names, np.zeros((len(names), 1 << bits)), np.log(np.array([float(r["count"]) for r in shares]) / sum(r["count"] for r in shares)), bits)
    squares = [np.zeros_like(model.weights), np.zeros_like(model.intercept)]
    few = WAVES * spark.sparkContext.defaultParallelism
    for _ in range(steps):
        shared = spark.sparkContext.broadcast((model.weights, model.intercept))

        def gradient(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now = LinearModel(names, *shared.value, bits)
            contrasts = now.contrasts()
            slope, slopes, n = np.zeros_like(now.weights), np.zeros_like(now.intercept), 0
            for batch in batches:
                for y, bucket, value, sizes in _stored(batch, bits):
                    off = now.probabilities(bucket, value, sizes, contrasts)
                    off[np.arange(len(y)), y] -= 1
                    for c in range(len(contrasts)):
                        weight = np.repeat(off[:, c], sizes)
                        weight *= value
                        slope[c] += np.bincount(bucket, weights=weight, minlength=1 << bits)
                    slopes += off.sum(0)
                    n += len(y)
            slope[-1] = -slope[:-1].sum(0)
            if n:
                yield _sums(TaskContext.get().partitionId(), n, slope, slopes)

        sums = rows.coalesce(few).mapInArrow(lean(gradient), _SUMS).repartition(max(1, math.isqrt(few)), "part").mapInArrow(lean(_added), _SUMS)
        n, slope, slopes = 0, np.zeros(model.weights.size), np.zeros(len(names))
        for r in sums.collect():
            n, slope, slopes = n + r["n"], slope + np.frombuffer(r["slope"]), slopes + np.frombuffer(r["slopes"])
        shared.unpersist()
        if not n:
            break
        for values, slope_of, square in ((model.weights, slope.reshape(model.weights.shape) / n + SHRINK * model.weights, squares[0]), (model.intercept, slopes / n, squares[1])):
            square += slope_of * slope_of
            values -= rate * slope_of / np.sqrt(square + 1e-12)
    return model


def classify(docs: DataFrame, model: LinearModel, text: str = "text", label: str = "label", score: str = "score") -> DataFrame:
    """Replace the text by the likeliest label and its probability."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    gone = {text.lower(), label.lower(), score.lower()}
    keep = [f for f in docs.schema if f.name.lower() not in gone]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        contrasts, mask = own.contrasts(), (1 << own.bits) - 1
        for batch in batches:
            found, best = [], []
            for texts in _pieces(batch.column(text)):
                for size, key, count in _counts(texts, own.bits, ORDERS):
                    owner, count = key >> own.bits, count.astype(np.float64)
                    total = np.bincount(owner, weights=count, minlength=size)
                    p = own.probabilities(key & mask, np.sqrt(count / total[owner]), np.bincount(owner, minlength=size), contrasts)
                    found += [own.labels[k] for k in p.argmax(1)]
                    best += p.max(1).tolist()
            columns = [batch.column(n) for n in batch.schema.names if n.lower() not in gone]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string()), pa.array(best, pa.float64())], names=[*(f.name for f in keep), label, score])

    return docs.mapInArrow(lean(run), T.StructType([*keep, T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())]))
