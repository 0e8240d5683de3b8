"""Blocks of token streams, encoding by distinct words, training by an index of pairs, attention by mergeable states."""

import math
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.operators import bpe, model_math, tokens


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_windows_over_blocks(spark, size):
    """Blocks hold the stream in order, whatever the lengths of rows, and windows are those of the plain list."""
    rng = random.Random(size)
    rows = [(k * 2, [rng.randrange(50) for _ in range(rng.choice([0, 1, 3, 10, 200]))]) for k in range(40)] + [(-5, None)]
    stream = [t for _, ids in sorted(rows, key=lambda r: r[0]) for t in ids or []]
    found = tokens.blocks(spark.createDataFrame(rows, "doc_id long, ids array<int>").repartition(5), size)
    blocks = {r["block"]: r["ids"] for r in found.collect()}
    assert blocks == {b: stream[b * size : (b + 1) * size] for b in range(-(-len(stream) // size))}
    starts = tokens.random_starts(spark, 200, len(stream), 9, seed=2).unionByName(spark.range(1).select((F.col("id") + 900).alias("sample"), F.lit(len(stream) - 10).cast("long").alias("start")))
    out = tokens.block_windows(found, starts, 9, size).collect()
    assert len(out) == 201
    for r in out:
        assert r["x"] == stream[r["start"] : r["start"] + 9] and r["y"] == stream[r["start"] + 1 : r["start"] + 10]


def plain_merge(word, rank):
    while len(word) > 1:
        best = min(zip(word, word[1:]), key=lambda p: rank.get(p, 1 << 62))
        if best not in rank:
            break
        word = bpe.merge_once(word, best)
    return word


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=40), st.randoms(use_true_random=False))
def test_merging_by_heap(word, rng):
    """Any table of ranks, also ones that training never makes: pairs with one result, later pairs of less rank, repeated letters."""
    parts = [b"a", b"b", b"c", b"d", b"aa", b"ab", b"bc", b"abc", b"cd", b"aaaa"]
    ids = {p: k for k, p in enumerate(rng.sample(parts, len(parts)))}
    pairs = [(x, y) for x in parts for y in parts if x + y in ids]
    rank = {p: ids[p[0] + p[1]] for p in rng.sample(pairs, rng.randint(0, len(pairs)))}
    want = plain_merge(list(word), rank)
    assert bpe.merge_word(list(word), rank) == want
    tokenizer = bpe.Tokenizer({k: p for p, k in ids.items()}, list(rank))
    other = b"ab" * (len(word) % 4)
    found = tokenizer._arrays.merged([b"".join(word), other, b"", b"".join(word[:7])])
    assert [[tokenizer.vocab[i] for i in x] for x in found] == [want, plain_merge([bytes([b]) for b in other], rank), [], plain_merge(list(word[:7]), rank)]


def test_long_words(spark):
    """A word of 100,000 bytes takes a moment and gives what the plain way gives on a part of it."""
    rng = random.Random(3)
    text = "".join(rng.choice("abcd") for _ in range(100_000))
    merges = bpe.train_local({text[:5000].encode(): 1}, 80)
    tokenizer = bpe.Tokenizer({i: bytes([i]) for i in range(256)} | {256 + k: a + b for k, (a, b) in enumerate(merges)}, merges)
    began = time.time()
    ids = tokenizer.encode(text)
    assert time.time() - began < 10 and tokenizer.decode(ids) == text
    rank = tokenizer.rank
    assert [tokenizer.vocab[i] for i in tokenizer.encode(text[:2000])] == plain_merge([bytes([b]) for b in text[:2000].encode()], rank)
    found = bpe.encode(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, text)], "doc_id long, text string"), tokenizer)
    assert {r["doc_id"]: r["ids"] for r in found.collect()} == {1: ids, 2: [], 3: [], 4: ids}


def test_encoding_of_odd_texts(spark):
    """White space and controls of all kinds, marks, specials and clashing names, as the tokenizer alone encodes them."""
    texts = ["a b c　", "x\x1cy\x1f z\x85w", "é ​﻿", "1٢½Ⅷ", "<s>a<s><s>b", "don't we'll I'VE", "\n\n \t x  y   ", "\U0001f600 \U00020000字", "_‿_ ͅ"]
    tokenizer = bpe.Tokenizer({i: bytes([i]) for i in range(256)} | {256: b" a", 257: b"th"}, [(b" ", b"a"), (b"t", b"h")], ["<s>"])
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, _words string")
    found = bpe.encode(df, tokenizer).collect()
    assert {r["doc_id"]: r["ids"] for r in found} == {k: tokenizer.encode(t) for k, t in enumerate(texts)}
    assert {r["_words"] for r in found} == {"clash"}


@pytest.mark.parametrize("every", [1, 100])
def test_training_by_pair_index(spark, every):
    """Words with repeated letters, equal counts and merges that meet, with and without writing the index anew."""
    rng = random.Random(7)
    table = {"".join(rng.choice("aab cd") for _ in range(rng.randint(1, 9))): rng.randint(1, 6) for _ in range(150)}
    counts = spark.createDataFrame(list(table.items()), "pretoken string, n long")
    assert bpe.train_distributed(counts, 12, every=every) == bpe.train_local({w.encode(): n for w, n in table.items()}, 12)


def test_training_beyond_the_driver(spark, monkeypatch, sf):
    """The driver's bound decides where merges are found, not which."""
    counts = bpe.pretoken_counts(spark.read.parquet(f"{sf}/documents.parquet").limit(20))
    here = bpe.train(counts, 256 + 12)
    monkeypatch.setattr(bpe, "DRIVER_BYTES", 0)
    assert bpe.train(counts, 256 + 12).merges == here.merges and len(here.merges) == 12
    assert bpe.train_distributed(counts.limit(0), 5) == []


def plain_attention(q, k, v, causal):
    s = q @ k.T / math.sqrt(q.shape[1])
    if causal:
        s[np.triu_indices(len(q), 1)] = -np.inf
    m = s.max(1, keepdims=True)
    p = np.exp(s - m)
    return (m + np.log(p.sum(1, keepdims=True)))[:, 0], p @ v / p.sum(1, keepdims=True)


@pytest.mark.parametrize("causal", [True, False])
@pytest.mark.parametrize("size", [1, 5, 64])
def test_block_attention(spark, size, causal):
    """Sequences shorter and longer than blocks, with scores so far apart that only relative sums are finite."""
    rng = np.random.default_rng(size)
    lengths, rows, want = {"a": 1, "b": 33, "c": 70}, [], {}
    for name, n in lengths.items():
        q, k, v = (rng.normal(size=(n, d)) * 30 for d in (6, 6, 4))
        lse, out = plain_attention(q, k, v, causal)
        for p in range(n):
            rows.append((name, p, q[p].tolist(), k[p].tolist(), v[p].tolist()))
            want[name, p] = (lse[p], out[p])
    df = spark.createDataFrame(rows, "seq string, pos long, q array<double>, k array<double>, v array<double>").repartition(3)
    found = model_math.block_attention(df, ["seq"], size=size, causal=causal).collect()
    assert len(found) == len(want)
    for r in found:
        lse, out = want[r["seq"], r["pos"]]
        assert r["lse"] == pytest.approx(lse, rel=1e-9) and r["out"] == pytest.approx(out.tolist(), rel=1e-7, abs=1e-9)


def test_states_merge_in_any_order():
    rng = np.random.default_rng(4)
    q, k, v, at = rng.normal(size=(3, 4)), rng.normal(size=(9, 4)) * 40, rng.normal(size=(9, 2)), np.arange(3)
    parts = [model_math.block_state(q, k[i : i + 3], v[i : i + 3], at, np.arange(i, i + 3), False) for i in (0, 3, 6)]
    whole = model_math.block_state(q, k, v, at, np.arange(9), False)
    for x, y, z in ((0, 1, 2), (2, 0, 1), (1, 2, 0)):
        for state in (model_math.merge_states(model_math.merge_states(parts[x], parts[y]), parts[z]), model_math.merge_states(parts[x], model_math.merge_states(parts[y], parts[z]))):
            assert all(np.allclose(a, b, rtol=1e-12, atol=1e-300) for a, b in zip(state, whole))
    nothing = (np.full(3, -np.inf), np.zeros(3), np.zeros((3, 2)))
    assert all(np.array_equal(a, b) for a, b in zip(model_math.merge_states(nothing, whole), whole))
