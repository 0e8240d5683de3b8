"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, of neighbouring pairs and triples,
and of pairs with one or two words between, into 2^BITS buckets. FTRL-proximal keeps a rate per
coordinate and an L1 threshold that leaves most weights exactly zero, so the model is a
short list of buckets and weights, and its size has a bound: 2^BITS entries.

Training reads at most MAX_SAMPLE labelled documents (the least by a hash of doc_id; of rows that share a
doc_id the least text). Their features are written once and one task learns from them in EPOCHS passes, in a fixed
order; the bound keeps that task small whatever the corpus. Scoring is one pass over all
texts with the weights broadcast: no shuffle, memory is one group of texts.

Defined results: null or empty text has no features and scores by the intercept; labels
that are null are not learned; without labels of both kinds every score is the share of
the one kind; very long texts are scored whole; repeated rows score alike; an empty table gives an empty table; extra columns pass
through, but one with the name of the result (``score``, or any other that is asked for), which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.wordhash import Words, combine, letters
from textloom.llm.wordhash import words as words_of
from textloom.session import lean, materialize, ship

BITS = 22
MAX_SAMPLE = 10_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 1.0


@dataclass(frozen=True)
class Model:
    """Buckets with a weight other than zero, their weights, and the intercept."""

    index: np.ndarray
    weight: np.ndarray
    intercept: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.index] = self.weight
        return out


def occurrences(group: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every feature, with repeats."""
    h, doc = group.hashes, group.doc
    parts, docs = [combine([h], 1)] if len(h) else [], [doc] if len(h) else []
    for tag, places in ((2, (0, 1)), (3, (0, 1, 2)), (4, (0, 2)), (5, (0, 3))):
        last = places[-1]
        if len(h) > last:
            whole = np.flatnonzero(doc[: len(doc) - last] == doc[last:])
            parts.append(combine([h[whole + k] for k in places], tag))
            docs.append(doc[whole])
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs), (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)


def distinct(doc: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature of a text once, sorted by text and bucket."""
    both = np.unique(doc << BITS | bucket)
    return both >> BITS, both & ((1 << BITS) - 1)


def features(group: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every feature, distinct and sorted by both."""
    return distinct(*occurrences(group))


@dataclass
class Ftrl:
    """State of FTRL-proximal; the last coordinate is the intercept, which L1 doesn't touch."""

    z: np.ndarray
    n: np.ndarray

    @staticmethod
    def start() -> Ftrl:
        return Ftrl(np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1))

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 1 << BITS, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g

    def model(self) -> Model:
        seen = np.flatnonzero(self.n)
        w = self.weights(seen)
        keep = (w != 0) & (seen < 1 << BITS)
        return Model(seen[keep], w[keep], float(self.weights(np.array([1 << BITS]))[0]))


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column | None = None, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """Features of at most ``max_sample`` labelled documents: ``doc_id, label, at`` (buckets as 32-bit binary)."""
    ship(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.where(usable) if usable is not None else known
    few = known.groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_sample)
    # at most max_sample pairs of numbers are broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for group in words_of(batch.column("text"), separators=letters):
                doc, bucket = features(group)
                ends = np.cumsum(np.bincount(doc, minlength=group.last - group.first)) * 4
                raw = bucket.astype("<u4").tobytes()
                data += [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label").cast(pa.int32()), pa.array(data, pa.binary())], names=["doc_id", "label", "at"])

    return texts.select("doc_id", "label", "text").mapInArrow(lean(run), "doc_id long, label int, at binary")


def train(rows: DataFrame) -> Model:
    """Train on rows of :func:`sample`, whose number has a bound."""
    rows = materialize(rows, "features")
    by_label = {r[0]: r[1] for r in rows.groupBy("label").agg(F.count(F.lit(1))).collect()}
    good, bad = by_label.get(0, 0), sum(n for label, n in by_label.items() if label)
    if not good or not bad:
        share = (bad + 0.5) / (good + bad + 1)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, known = Ftrl.start(), []  # at most the sample
        for batch in batches:
            known += zip(*(batch.column(c).to_pylist() for c in ("orders", "doc_id", "label", "at")), strict=True)
        for epoch in range(EPOCHS):
            for _, _, label, at in sorted(known, key=lambda r: (r[0][epoch], r[1])):
                state.learn(np.append(np.frombuffer(at, "<u4").astype(np.int64), 1 << BITS), int(label > 0))
        m = state.model()
        yield pa.RecordBatch.from_arrays([pa.array([m.index.astype("<u4").tobytes()]), pa.array([m.weight.tobytes()]), pa.array([m.intercept])], names=["at", "weight", "intercept"])

    orders = F.array(*(F.xxhash64("doc_id", F.lit(epoch)) for epoch in range(1, EPOCHS + 1)))
    found = rows.select(orders.alias("orders"), "doc_id", "label", "at").repartition(1).mapInArrow(lean(run), "at binary, weight binary, intercept double").first()
    return Model(np.frombuffer(found["at"], "<u4").astype(np.int64), np.frombuffer(found["weight"]), found["intercept"])


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = False, name: str = "score") -> DataFrame:
    """Add the score, 0 to 1, as column ``name``; the text goes unless it is to be kept, the other columns pass through, whatever their names."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    gone = {name.lower()} if keep_text else {name.lower(), text.lower()}
    quoted = {c: "`" + c.replace("`", "``") + "`" for c in docs.columns if c.lower() != name.lower()}
    place = [c.lower() for c in quoted].index(text.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = shared.value.dense()
        for batch in batches:
            scores = [np.zeros(0)]
            for group in words_of(batch.column("row").field(place), separators=letters):
                doc, bucket = occurrences(group)
                known = dense[bucket] != 0  # few, so that only they need sorting
                doc, bucket = distinct(doc[known], bucket[known])
                total = np.bincount(doc, weights=dense[bucket], minlength=group.last - group.first) + shared.value.intercept
                scores.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.concatenate(scores))], names=["row", "score"])

    rows = docs.select(F.struct(*(F.col(q) for q in quoted.values())).alias("row"))
    scored = rows.mapInArrow(lean(run), T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))
    return scored.select(*(F.col(f"row.{q}").alias(c) for c, q in quoted.items() if c.lower() not in gone), F.col("score").alias(name))
