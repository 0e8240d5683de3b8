"""Held-out evaluations of the label classifiers, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import classify, linear
from textloom.sources.tables import table

#: Documents with this remainder by five are held out.
HELD_OUT = 0


def _evaluation(label: str, source: str, by=classify):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents").select("doc_id", "text")
        labels = table(spark, sf_dir, source).select("doc_id", F.col(label).cast("string").alias("label"))
        held = F.col("doc_id") % 5 == HELD_OUT
        model = by.train(docs, labels.where(~held))
        known = labels.where(held)
        return classify.confusion(by.classify(docs.join(known.select("doc_id"), "doc_id", "left_semi"), model), known)

    return query


def _sql(label: str, source: str) -> str:
    return rf"""
WITH lb AS (SELECT doc_id, {label}::VARCHAR AS label FROM {source}),
w AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}+')) AS word FROM documents) GROUP BY ALL),
c AS (SELECT word, label, sum(n) AS n FROM w JOIN lb USING (doc_id) WHERE doc_id % 5 <> {HELD_OUT} GROUP BY ALL),
v AS (SELECT count(DISTINCT word) AS known FROM c),
t AS (SELECT label, count(*) AS docs FROM lb WHERE doc_id % 5 <> {HELD_OUT} GROUP BY label),
u AS (SELECT label, docs, coalesce(total, 0) AS total, known FROM t LEFT JOIN (SELECT label, sum(n) AS total FROM c GROUP BY label) USING (label), v),
m AS (SELECT doc_id, sum(n) AS m FROM w WHERE word IN (SELECT word FROM c) GROUP BY doc_id),
p AS (SELECT doc_id, c.label, sum(w.n * ln(c.n + 1.0)) AS plus FROM w JOIN c USING (word) GROUP BY doc_id, c.label),
s AS (SELECT lb.doc_id, lb.label AS truth, u.label, ln(docs) - coalesce(m, 0) * ln(total + known) + coalesce(plus, 0) AS s
      FROM lb CROSS JOIN u LEFT JOIN m ON m.doc_id = lb.doc_id LEFT JOIN p ON p.doc_id = lb.doc_id AND p.label = u.label WHERE lb.doc_id % 5 = {HELD_OUT}),
b AS (SELECT doc_id, truth, arg_max(label, (s, label)) AS predicted FROM s GROUP BY doc_id, truth)
SELECT truth AS label, predicted, count(*) AS n FROM b GROUP BY truth, predicted"""


QUERIES = {
    "lang_classifier_eval": (_evaluation("lang", "documents"), _sql("lang", "documents")),
    "quality_classifier_eval": (_evaluation("quality", "labels"), _sql("quality", "labels")),
    "toxic_classifier_eval": (_evaluation("toxic", "labels"), _sql("toxic", "labels")),
    "lang_ngram_model_eval": (_evaluation("lang", "documents", linear), None),
    "quality_ngram_model_eval": (_evaluation("quality", "labels", linear), None),
    "toxic_ngram_model_eval": (_evaluation("toxic", "labels", linear), None),
}
