"""A training corpus from ``documents`` in five stages; each is written as Parquet and read again as the next one's input.

toxicity        documents scored 0.5 or more go (model learned from the labels that aren't held out)
quality         documents go that fail a rule, or whose source is rejected
near duplicates of each component of linked 5-word shingle sets (Jaccard 0.8) the least doc_id stays
mixing          documents are repeated, or left out, as the words that the mix takes of them say
packing         pieces of at most 2048 tokens are placed in sequences

Defined results, in all stages: null and empty texts score by the model's intercept, fail the rules and so go at the second stage;
a stage that gets one by itself takes it as an empty text, which has no near duplicates, is mixed in once and packs as one end id. Very long
texts are worked on whole. A null source is a source like any other. Rows without a doc_id are kept apart from all others, but for equal texts;
rows that share a doc_id are one document: near duplicates keep each of its texts once, mixing repeats them
alike. Ties go to the least doc_id. An empty table gives an empty table. Extra columns are carried to the last stage
whatever their names (``host``, ``score``, ``_id`` and the like); the last returns pieces only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import mixing, ngram_join, packing, quality_rules, queries, toxicity
from textloom.session import materialize, unused
from textloom.sources.tables import table

#: Near duplicates of the stage: 5-word shingles, a Jaccard similarity of 0.8 or more. op1's own query has other values.
NEAR = ngram_join.JoinSpec(n=5, num=80, den=100)


def columns(docs: DataFrame) -> list[Column]:
    """All columns, whatever is in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = queries.toxicity_model(docs, table(spark, sf_dir, "labels"))
    name = unused(docs, "score")
    return toxicity.score(docs, model, keep_text=True, name=name).where(F.col(name) < 0.5).select(columns(docs))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The figures are computed once: the rules' results are written beside the rows, then counted and filtered."""
    failed, host = unused(docs, "failed"), unused(docs, "host")
    judged = quality_rules.with_figures(docs.select("source", "text", F.struct(*columns(docs)).alias(unused(docs, "row"))))
    judged = materialize(judged.select(F.col(unused(docs, "row")), "source", "base_failed", "symbols_failed"), "judged")
    hosts = materialize(quality_rules.host_counts(judged), "hosts")
    rejected = quality_rules.host_verdicts(hosts, quality_rules.fit_prior(hosts)).where("host_rejected").select(F.col("host").alias(host))
    good = judged.where("not base_failed and not symbols_failed").select(F.col(f"{unused(docs, 'row')}.*"))
    return good.join(rejected, F.col("source").eqNullSafe(F.col(host)), "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_components(docs, NEAR)
    key = unused(docs, "id")
    kept = found.where("component_id = doc_id").select(F.col("doc_id").alias(key)).distinct()
    once = docs.join(kept, F.col("doc_id") == F.col(key), "left_semi").unionByName(docs.where("doc_id is null"))
    return once.dropDuplicates(["doc_id", "text"]).select(columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key, times, time = unused(docs, "id"), unused(docs, "times"), unused(docs, "time")
    taken = mixing.taken(docs.select("doc_id", "source", "text")).select("doc_id", "size", "taken")
    some = taken.groupBy(F.col("doc_id").alias(key)).agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"))
    some = some.select(key, F.expr("if(size = 0, 1, cast(round(taken / size) as int))").alias(times)).where(F.col(times) > 0)
    out = docs.join(some, F.col("doc_id").eqNullSafe(F.col(key)))
    return out.withColumn(time, F.explode(F.sequence(F.lit(1), F.col(times)))).select(columns(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs.select("doc_id", "text")))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Learned scores, hashes and a tokenizer are not for SQL; the tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
