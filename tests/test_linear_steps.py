"""Training of linear models: what is stored of a text, and what a step holds of it."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.operators import linear


def test_features_are_stored_small_and_come_back_whole(spark, monkeypatch):
    """Buckets take two bytes; groups of few features, texts without any among them, and batches that begin elsewhere."""
    texts = ["abc abd " * 40, None, "", "x", "zz " * 9, "word " * 300, "the quick brown fox jumps over the lazy dog"]
    want = [(k, *f) for k, f in enumerate(linear.features(texts))]
    df = spark.createDataFrame(list(enumerate(texts)), "y int, text string")
    rows = linear._feature_rows(df.coalesce(1), linear.BITS).orderBy("y").toArrow().combine_chunks()
    stored = sum(rows[c].combine_chunks().nbytes for c in ("bucket", "count", "run"))
    assert stored <= 4 * sum(len(b) for _, b, _ in want)
    for group in (1, 40, 1 << 17):
        monkeypatch.setattr(linear, "GROUP_FEATURES", group)
        for begin in (0, 2):
            found = []
            for batch in rows.to_batches():
                for y, bucket, value, sizes in linear._stored(batch.slice(begin), linear.BITS):
                    assert len(y) == 1 or len(bucket) <= group
                    found += zip(y.tolist(), np.split(bucket, np.cumsum(sizes)[:-1]), np.split(value, np.cumsum(sizes)[:-1]))
            assert [k for k, _, _ in found] == [k for k, _, _ in want[begin:]]
            for (_, b, v), (_, bucket, value) in zip(found, want[begin:]):
                order = np.argsort(b)
                assert b[order].tolist() == bucket.tolist() and v[order].tolist() == pytest.approx(value.tolist())


def test_a_long_text_is_hashed_in_parts(monkeypatch):
    """No array of a part is longer than the part, and the counts are those of the whole."""
    text = " ".join(f"w{i % 97} {i}" for i in range(3000))
    whole = next(iter(linear.features([text])))
    lengths = []
    hashes = linear._hashes
    monkeypatch.setattr(linear, "_hashes", lambda code, *a: lengths.append(len(code)) or hashes(code, *a))
    monkeypatch.setattr(linear, "GROUP_CHARS", 500)
    found = next(iter(linear.features([text])))
    assert max(lengths) <= 503 and found[0].tolist() == whole[0].tolist() and found[1].tolist() == pytest.approx(whole[1].tolist())


def test_a_step_is_that_of_plain_softmax(spark):
    """Three labels and two against dense arithmetic, over more partitions than a step has."""
    words = ["der", "und", "the", "and", "les", "des"]
    for labels in (("de", "en", "fr"), ("en", "fr")):
        rows = [(k, " ".join(words[2 * (k % len(labels)) + (j * k) % 2] for j in range(8)) if k % 9 else "", labels[k % len(labels)]) for k in range(60)]
        df = spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(20)
        model = linear.train(df, df.select("doc_id", F.col("label")), steps=5, bits=8)
        x = np.zeros((60, 256))
        for k, (bucket, value) in enumerate(linear.features([r[1] for r in rows], bits=8)):
            x[k, bucket] = value
        y = np.eye(len(labels))[[k % len(labels) for k in range(60)]]
        w, b = np.zeros((len(labels), 256)), np.log(y.mean(0))
        squares = [np.zeros_like(w), np.zeros_like(b)]
        for _ in range(5):
            s = x @ w.T + b
            p = np.exp(s - s.max(1, keepdims=True))
            off = p / p.sum(1, keepdims=True) - y
            for values, slope, square in ((w, off.T @ x / 60 + linear.SHRINK * w, squares[0]), (b, off.mean(0), squares[1])):
                square += slope * slope
                values -= linear.RATE * slope / np.sqrt(square + 1e-12)
        assert np.allclose(model.weights, w, atol=1e-6) and np.allclose(model.intercept, b, atol=1e-6)


def test_packed_rows():
    column = linear._packed(np.array([1, 2, 3], "<u2"), np.array([2, 0, 1]))
    assert column.to_pylist() == [b"\x01\0\x02\0", b"", b"\x03\0"]
    values, ends = linear._unpacked(pa.chunked_array([column]).combine_chunks().slice(1), "<u2")
    assert values.tolist() == [3] and ends.tolist() == [0, 0, 1]
