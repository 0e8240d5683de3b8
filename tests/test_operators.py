import math
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.operators import bpe, dedup, model_math, runs, tokens
from textloom.operators.components import components


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_line_removal_takes_every_copy(spark):
    out = dedup.remove_repeated_lines(docs(spark, ["a\nb", "b\nc\nc", "b", None])).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == ["a", "", "", ""]


def test_line_removal_ignores_layout(spark):
    texts = [f"x{i % 3}\ny{i}" for i in range(20)]
    a = dedup.remove_repeated_lines(docs(spark, texts).repartition(1)).collect()
    b = dedup.remove_repeated_lines(docs(spark, texts).repartition(7)).collect()
    assert sorted(a) == sorted(b)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    found = {r["node"]: r["label"] for r in components(edges).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_components_without_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fuzzy_clusters(spark):
    base = [f"w{i}" for i in range(40)]
    near = [*base[:-1], "other"]
    rows = docs(spark, [" ".join(base), " ".join(near), "something else entirely here now", "", None, " ".join(base)])
    grams = dedup.gram_rows(rows, 5)
    pairs = dedup.jaccard_pairs(grams).select("l", "r").unionByName(dedup.empty_pairs(rows, grams))
    found = {r["doc_id"]: r["component"] for r in dedup.clusters(rows, pairs).collect()}
    assert found == {0: 0, 1: 0, 5: 0, 2: 2, 3: 3, 4: 3}


def test_bands_leave_out_the_rest(spark):
    signatures = spark.createDataFrame([(0, [1, 2, 3, 4, 5]), (1, [1, 2, 9, 9, 5])], "doc_id long, signature array<long>")
    assert dedup.candidate_pairs(dedup.bands(signatures, 2, 5)).collect() == [(0, 1)]
    assert dedup.candidate_stars(dedup.bands(signatures, 2, 5)).collect() == [(0, 1)]


def test_merges_prefer_the_greatest(spark):
    counts = spark.createDataFrame([("ab", 2), ("cd", 2), ("aaa", 1)], "pretoken string, n long")
    local = bpe.train_local({b"ab": 2, b"cd": 2, b"aaa": 1}, 10)
    assert bpe.train_distributed(counts, 10) == local
    assert local[0] == (b"c", b"d")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text(alphabet="abé", min_size=1, max_size=7), st.integers(1, 5), min_size=1, max_size=8))
def test_local_merges_follow_the_definition(table):
    words = {w.encode(): n for w, n in table.items()}
    state = [([bytes([b]) for b in w], n) for w, n in words.items()]
    want = []
    for _ in range(6):
        totals = {}
        for t, n in state:
            for pair in zip(t, t[1:]):
                totals[pair] = totals.get(pair, 0) + n
        if not totals:
            break
        best = max(totals, key=lambda p: (totals[p], p))
        want.append(best)
        state = [(bpe.merge_once(t, best), n) for t, n in state]
    assert bpe.train_local(words, 6) == want


def small_tokenizer():
    merges = [(b"t", b"h"), (b"th", b"e"), (b" ", b"the")]
    vocab = {i: bytes([i]) for i in range(256)} | {256: b"<|e|>", 257: b"th", 258: b"the", 259: b" the"}
    return bpe.Tokenizer(vocab, merges, ["<|e|>", "<|e|><|e|>"])


@settings(max_examples=100, deadline=None)
@given(st.text())
def test_decode_undoes_encode(text):
    t = small_tokenizer()
    assert t.decode(t.encode(text)) == text
    assert list(t.encode_iterable([text, text])) == t.encode(text) * 2


def test_specials(spark):
    t = small_tokenizer()
    assert t.encode("") == []
    assert t.encode("the<|e|> the<|e|><|e|>") == [258, 256, 259, 260]
    assert t.longest() == (260, b"<|e|><|e|>")
    with pytest.raises(KeyError):
        t.decode([9999])
    assert t.decode([0xFF]) == "�"
    found = docs(spark, ["a<|e|><|e|>b!<|e|>"]).select(bpe.pretokens(F.col("text"), ["<|e|>", "<|e|><|e|>"]).alias("p")).first()["p"]
    assert found == ["a", "<|e|><|e|>", "b", "!", "<|e|>"]
    assert docs(spark, ["a<|e|>b!<|e|>"]).select(bpe.pretokens(F.col("text"), ["<|e|>"]).alias("p")).first()["p"] == ["a", "<|e|>", "b", "!", "<|e|>"]


def test_distributed_encode(spark):
    t = small_tokenizer()
    out = bpe.decode(bpe.encode(docs(spark, ["the the", None, "ümlaut"]), t), t).orderBy("doc_id").collect()
    assert [r["decoded"] for r in out] == ["the the", "", "ümlaut"]
    assert out[0]["ids"] == t.encode("the the")


def test_offsets_in_any_layout(spark):
    rows = spark.range(100).select("id", (F.col("id") % 7).alias("n"))
    want, total = {}, 0
    for i in range(100):
        want[i] = total
        total += i % 7
    for parts in (1, 5):
        found = tokens.running_offsets(rows.repartition(parts), "id", "n")
        assert {r["id"]: r["offset"] for r in found.collect()} == want


def test_windows_move_by_one(spark):
    stream = spark.range(100).select(F.col("id").alias("pos"), F.col("id").alias("token"))
    starts = tokens.random_starts(spark, 500, 100, 7, seed=3)
    out = tokens.windows(stream, starts, 7).collect()
    assert len(out) == 500
    assert all(r["x"] == list(range(r["start"], r["start"] + 7)) and r["y"] == [v + 1 for v in r["x"]] for r in out)
    assert {r["start"] for r in out} <= set(range(93)) and len({r["start"] for r in out}) > 80
    with pytest.raises(ValueError, match="window"):
        tokens.random_starts(spark, 1, 7, 7)


def test_range_check(spark):
    ids = spark.createDataFrame([(0,), (9,)], "id int")
    assert ids.select(tokens.check_range(F.col("id"), 10)).count() == 2
    with pytest.raises(Exception, match="out of range"):
        ids.select(tokens.check_range(F.col("id"), 9).alias("id")).collect()


def test_nucleus_bounds(spark):
    rows = spark.createDataFrame([(0, i, p) for i, p in enumerate((0.5, 0.3, 0.2))], "r long, i int, p double")
    keep = lambda top: {r["i"]: round(r["p"], 6) for r in model_math.nucleus(rows, "r", "i", "p", top).collect() if r["p"] > 0}
    assert keep(1.0) == {0: 0.5, 1: 0.3, 2: 0.2}
    assert keep(0.0) == {0: 1.0}
    assert keep(0.6) == {0: 0.625, 1: 0.375}


@pytest.mark.parametrize(("limit", "want"), [(10, [0, 0, 1, 2]), (0, [0, 1, 2, 3]), (None, [0, 0, 0, 0])])
def test_buckets(spark, limit, want):
    sizes = spark.createDataFrame(list(enumerate((4, 6, 8, 5))), "idx long, bytes long")
    assert [r["bucket"] for r in model_math.buckets(sizes, limit).orderBy("idx").collect()] == want


def test_power_law(spark):
    rows = spark.createDataFrame([(10.0**k, int(3 * 10 ** (k / 2))) for k in range(4, 16, 2)], "compute_budget double, parameters long")
    assert math.isclose(runs.power_law(rows).first()["exponent"], 0.5, abs_tol=1e-6)


def test_release_deletes_tables(spark):
    from textloom import session

    df = session.materialize(spark.range(3).toDF("id"), "some")
    path = session._made[-1].removeprefix("file://")
    assert df.count() == 3 and os.path.exists(path)
    session.release(spark)
    assert not os.path.exists(path) and not session._made


def test_all_candidates_of_a_bucket(spark):
    """Every pair of different sets in a bucket, not those with the least document alone; copies come once."""
    grams = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "c")], "doc_id long, gram string")
    keys = lambda g: g.selectExpr("doc_id", "0 as band", "'k' as key")
    found = {tuple(r) for r in dedup.all_candidates(grams, keys).collect()}
    assert found == {(1, 2, False), (1, 3, False), (2, 3, False), (3, 4, True)}


def test_arithmetic_covers_every_embedding(spark, sf):
    from textloom.plans import maths

    ids = {r["vec_id"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    assert {r["vec_id"] for r in maths.swiglu_all_rows(spark, sf).select("vec_id").distinct().collect()} == ids
    assert {r["vec_id"] for r in maths.embedding_lookup_all(spark, sf).collect()} == ids
    assert "WHERE vec_id <" not in maths.SWIGLU_ALL
