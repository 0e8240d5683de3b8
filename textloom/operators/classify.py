"""Multinomial naive Bayes over words, as aggregates and joins: language, quality and harm labels with a score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.session import materialize


def _words(text: str = "text") -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))


def word_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, word, n``: words of lower-case letters and their counts, within each row's own text."""
    # not explode: the filter that Spark derives from it would find the words twice
    rows = docs.select("doc_id", F.explode_outer(_words()).alias("word")).where("word is not null")
    return rows.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class NaiveBayes:
    """``words``: word, label, n (also zero) for known words; ``labels``: label, documents, words in all, known words."""

    words: DataFrame
    labels: DataFrame


def train(docs: DataFrame, labels: DataFrame) -> NaiveBayes:
    """Counts of words by label from ``doc_id, text`` and ``doc_id, label``; the labels are few, the words a table.

    Texts are dealt out once to meet their labels; what words they have is then counted where they are, and never by text.
    """
    labels = labels.where(F.col("label").isNotNull())
    rows = docs.select("doc_id", "text").join(labels.select("doc_id", "label"), "doc_id").select("label", F.explode_outer(_words()).alias("word")).where("word is not null")
    counts = materialize(rows.groupBy("word", "label").agg(F.count(F.lit(1)).alias("n")), "words")
    known = counts.agg(F.count_distinct("word")).first()[0]
    totals = labels.join(docs.select("doc_id"), "doc_id").groupBy("label").agg(F.count(F.lit(1)).alias("docs"))
    totals = totals.join(counts.groupBy("label").agg(F.sum("n").alias("total")), "label", "left")
    totals = materialize(totals.select("label", "docs", F.coalesce("total", F.lit(0)).alias("total"), F.lit(known).cast("long").alias("known")), "labels")
    return NaiveBayes(counts, totals)


def classify(docs: DataFrame, model: NaiveBayes) -> DataFrame:
    """``doc_id, label, score``: the likeliest label and its probability; of equals the greatest label.

    With Laplace smoothing a label's log probability is that of a text of unseen words plus a
    correction for each word that the label has, so only matching words are joined: once, with all labels of a word, and
    with no label for the number of known words.
    """
    known = model.words.groupBy("word").agg(F.collect_list(F.struct("label", "n")).alias("by"))  # as many as there are labels
    none = F.struct(F.lit(None).cast(model.words.schema["label"].dataType).alias("label"), F.lit(0).cast("long").alias("n"))
    found = word_rows(docs).withColumnRenamed("n", "k").join(known, "word").select("doc_id", "k", F.explode(F.concat(F.array(none), "by")).alias("of"))
    found = found.groupBy("doc_id", "of.label").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.log(F.col("of.n") + 1.0)).alias("plus"))
    entry = F.when(F.col("label").isNotNull(), F.struct("label", "plus"))
    found = found.groupBy("doc_id").agg(F.max(F.when(F.col("label").isNull(), F.col("m"))).alias("m"), F.map_from_entries(F.collect_list(entry)).alias("plus"))
    every = docs.select("doc_id").distinct().join(found, "doc_id", "left")
    labels = model.labels.agg(F.collect_list(F.struct("label", "docs", "total", "known"))).scalar()

    def likelihood(row: Column) -> Column:
        unseen = F.log(row["docs"].cast("double")) - F.coalesce("m", F.lit(0)) * F.log((row["total"] + row["known"]).cast("double"))
        return F.struct((unseen + F.coalesce(F.try_element_at("plus", row["label"]), F.lit(0.0))).alias("s"), row["label"].alias("label"))

    scored = every.withColumn("labels", labels).select("doc_id", F.transform("labels", likelihood).alias("all")).where(F.size("all") > 0).select("doc_id", "all", F.array_max("all").alias("top"))
    return scored.select("doc_id", F.col("top.label").alias("label"), (1 / F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x["s"] - F.col("top.s")))).alias("score"))


def confusion(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    """``label, predicted, n``."""
    joined = labels.join(predicted.select("doc_id", F.col("label").alias("predicted")), "doc_id")
    return joined.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))
