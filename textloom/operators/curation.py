"""The document filter: first failing rule, masking, duplicates and a cap per domain, and their statistics."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import rules, text
from textloom.functions.pii import mask_all
from textloom.session import materialize, unused

#: Reasons in the order in which rules are tried.
REASONS = ("missing_uri", "empty_text", "too_short", "blocked_topic", "parked_domain", "non_english", "low_gopher_quality", "boilerplate", "nsfw", "toxic", "exact_duplicate", "domain_cap")


@dataclass(frozen=True)
class FilterConfig:
    min_chars: int = 200
    min_words: int = 50
    min_lang_score: float = 0.80
    max_nsfw_score: float = 0.95
    max_toxic_score: float = 0.98
    max_per_domain: int = 50


def harm(nsfw_label: Column, nsfw_score: Column, toxic_label: Column, toxic_score: Column, config: FilterConfig) -> Column:
    """``nsfw``, ``toxic`` or null: only high scores count, and the first comes first."""
    nsfw = (nsfw_label != "non-nsfw") & (nsfw_score >= config.max_nsfw_score)
    toxic = (toxic_label != "non-toxic") & (toxic_score >= config.max_toxic_score)
    return F.when(nsfw, "nsfw").when(toxic, "toxic")


def first_failure(docs: DataFrame, lang: Column, lang_score: Column, harmful: Column, config: FilterConfig | None = None) -> DataFrame:
    """Add ``normalized`` and ``reason`` (null: passed) to rows of ``uri, text``; one projection, cheap rules first."""
    config = config or FilterConfig()
    def tried(one: Column, words: Column) -> Column:
        return (
            F.when(F.col("uri").isNull(), "missing_uri")
            .when(one == "", "empty_text")
            .when((F.length(one) < config.min_chars) | (F.size(words) < config.min_words), "too_short")
            .when(rules.keyword_hits(F.col("uri"), one) >= 2, "blocked_topic")
            .when(rules.is_parked(one), "parked_domain")
            .when((lang != "en") | (lang_score < config.min_lang_score), "non_english")
            .when(~rules.gopher(words, F.array(one)).getField("keep"), "low_gopher_quality")
            .when(~rules.boilerplate(text.lines(F.col("text")), one).getField("keep"), "boilerplate")
            .otherwise(harmful)
        )

    def judge(one: Column) -> Column:
        return rules.bind(text.words(one), lambda words: F.struct(one.alias("normalized"), tried(one, words).alias("reason")))

    judged = docs.withColumn("_judged", rules.bind(text.normalize(F.col("text")), judge))
    return judged.withColumns({"normalized": F.col("_judged.normalized"), "reason": F.col("_judged.reason")}).drop("_judged")


def curate(judged: DataFrame, domain: Column, scope: Iterable[str], order: str = "doc_id", config: FilterConfig | None = None) -> DataFrame:
    """Mask what passed, drop exact duplicates (the first stays), cap domains; ``scope`` limits both to a file or other columns.

    One rule after the other equals a loop over records: a duplicate of a capped
    document is a duplicate, and capped documents don't count towards the cap. Both work on keys and
    not on texts: the first of a digest is a partial minimum, and a domain's first records are a
    rank with a limit, which each task applies before rows travel; so no domain or text is one task's load.
    """
    config, scope = config or FilterConfig(), list(scope)
    passed = mask_all(judged.where("reason is null"), "normalized").withColumn("domain", domain)
    row, least = unused(passed, "row"), unused(passed, "least")
    passed = materialize(passed.withColumn("digest", text.digest(F.col("masked"))).withColumn(row, F.monotonically_increasing_id()), "passed")
    place = F.struct(F.col(order).alias("o"), F.col(row).alias("r"))
    keys = passed.select(*scope, "domain", "digest", place.alias("place"))
    first = keys.groupBy(*scope, "digest").agg(F.min("place").alias(least))
    firsts = first.select(F.col(f"{least}.r").alias(row)).withColumn(least, F.lit(True))
    once = keys.join(first.select(F.col(f"{least}.r").alias("r")), F.col("place.r") == F.col("r"), "left_semi")
    nth = F.row_number().over(Window.partitionBy(*scope, "domain").orderBy("place"))
    capped = once.withColumn("nth", nth).where(F.col("nth") <= config.max_per_domain).select(F.col("place.r").alias(row), F.lit(True).alias("nth"))
    verdict = firsts.join(capped, row, "left").select(row, F.when(F.col("nth").isNull(), "domain_cap").otherwise("kept").alias(least))
    out = passed.join(verdict, row, "left").withColumn("reason", F.coalesce(least, F.lit("exact_duplicate")))
    return out.withColumn("reason", F.nullif("reason", F.lit("kept"))).drop(row, least)


def failure_counts(reasons: DataFrame) -> DataFrame:
    """``reason, n`` for all reasons, also those without a record."""
    spark = reasons.sparkSession
    every = spark.createDataFrame([(r,) for r in REASONS], "reason string")
    found = reasons.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return every.join(found, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


def first_records(docs: DataFrame, file: str, position: str, n: int) -> DataFrame:
    """The first ``n`` records of each file, by position."""
    name = unused(docs, "nth")
    nth = F.row_number().over(Window.partitionBy(file).orderBy(position))
    return docs.withColumn(name, nth).where(F.col(name) <= n).drop(name)
