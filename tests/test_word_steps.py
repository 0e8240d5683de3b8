"""Words of texts: what a pass over them finds at once, and what never gathers by text."""

import math
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.functions import text
from textloom.operators import classify, dedup

ODD = ["Grüße, ﬁne CAFÉ", "é̂" * 3 + " x", "".join(chr(c) for c in range(0x300, 0x330)) + "a", "  \t\n", "İstanbul ſ K", "한국어 text_1 ½", "plain_ASCII a-b\x1fc\x00d 12", "", None, "日本   word"]


def test_marks_go():
    for t in ODD:
        assert text.strip_marks(t or "") == "".join(c for c in unicodedata.normalize("NFKD", t or "") if not unicodedata.combining(c))


def test_words_of_folded_texts_are_those_of_canonical_ones(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "k int, text string")
    c = df.select("k", text.canonical(F.col("text")).alias("c"), text.folded(F.col("text")).alias("f"))
    for r in c.select("k", text.tokens(F.col("c")).alias("a"), text.tokens(F.col("f")).alias("b"), F.regexp_extract_all("c", F.lit(r"(?U)(\w+)"), F.lit(1)).alias("want")).collect():
        assert r["a"] == r["b"] == r["want"], ODD[r["k"]]


def test_texts_without_a_word_come_out_of_the_same_pass(spark):
    rows = [*enumerate(ODD), (20, "same text of seven words here now"), (21, "same text of seven words here now"), (22, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = dedup.similar_sets(df)
    assert {r["doc_id"] for r in found.empty.collect()} == {3, 7, 8}
    assert {r["doc_id"] for r in found.sets.collect()} == {20, 21}
    got = {r["doc_id"]: r["component"] for r in dedup.clusters(df, dedup.document_links(df)).collect()}
    assert got == {k: {7: 3, 8: 3, 21: 20}.get(k, k) for k, _ in rows}


@pytest.mark.parametrize("kind", ["string", "int"])
def test_labels_meet_texts_before_words_are_counted(spark, monkeypatch, kind):
    """Training has no row per text and word; scores are those of plain naive Bayes, also where a doc_id has two rows or no known word."""
    rows = [(0, "a a b"), (1, "b c"), (1, "c d"), (2, "D e!"), (3, None), (4, "f"), (5, "a c zz"), (6, "zz"), (7, ""), (8, "d d e"), (8, "a")]
    labels = {0: 1, 1: 2, 2: 2, 3: 1}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels.items(), (4, None)], "doc_id long, label int").withColumn("label", F.col("label").cast(kind))
    with monkeypatch.context() as m:
        m.setattr(classify, "word_rows", None)
        model = classify.train(docs, known)
    words = {v: Counter() for v in (1, 2)}
    n = Counter()
    for k, t in rows:
        if k in labels:
            words[labels[k]].update(w.strip("!") for w in (t or "").lower().split())
            n[labels[k]] += 1
    every = set(words[1]) | set(words[2])
    got = {r["doc_id"]: (int(r["label"]), r["score"]) for r in classify.classify(docs, model).collect()}
    for k in {k for k, _ in rows}:
        own = [w.strip("!") for i, t in rows if i == k for w in (t or "").lower().split()]
        s = {v: math.log(n[v]) + sum(math.log((words[v][w] + 1) / (words[v].total() + len(every))) for w in own if w in every) for v in (1, 2)}
        best = max(s, key=lambda v: (s[v], v))
        assert got[k] == (best, pytest.approx(math.exp(s[best]) / sum(map(math.exp, s.values())))), k
