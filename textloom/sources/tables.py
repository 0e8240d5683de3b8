"""Readers for the Parquet tables that queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` under ``sf_dir``; the path may be of any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_texts(spark: SparkSession, path: str | list[str], kind: str = "parquet", text: str = "text", max_documents: int | None = None) -> DataFrame:
    """Rows of a dataset's files (``parquet`` or ``json``) whose text isn't blank; at most so many of these, if asked for."""
    rows = spark.read.format(kind).load(path).where(F.trim(F.regexp_replace(text, r"\s", " ")) != "")
    return rows if max_documents is None else rows.limit(max_documents)
