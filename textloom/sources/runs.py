"""Input paths, statistics as JSON, and run logs."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUNS = "parameters long, compute_budget double, final_loss double"


def expand_paths(spark: SparkSession, patterns: Iterable[str]) -> list[str]:
    """Paths that match, once each and sorted; a pattern without a match stays as it is, and fails when opened."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = set()
    for pattern in patterns:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        found = path.getFileSystem(conf).globStatus(path)
        out.update([f.getPath().toString() for f in found] if found else [pattern])
    return sorted(out)


def write_stats(stats: DataFrame, folder: str, by: str | None = None) -> None:
    """Rows as JSON, a folder per value of a column if named; Spark commits them as a whole."""
    (stats.write.partitionBy(by) if by else stats.coalesce(1).write).mode("overwrite").json(folder)


def write_file_stats(stats: DataFrame, folder: str, file: str = "file") -> None:
    """Statistics by input file, a folder ``name=<input's name>.stats`` of JSON each, and their sums in ``summary``."""
    base = F.regexp_replace(F.substring_index(file, "/", -1), r"\.gz$", "")
    write_stats(stats.withColumn("name", F.concat(base, F.lit(".stats"))).drop(file), f"{folder}/files", "name")
    numbers = [f.name for f in stats.schema if f.name != file and isinstance(f.dataType, T.NumericType)]
    write_stats(stats.agg(F.count(F.lit(1)).alias("files"), *(F.sum(n).alias(n) for n in numbers)), f"{folder}/summary")


def write_times(steps: DataFrame, folder: str, value: str = "ms", order: str = "step") -> None:
    """One number per line, in the order of a column."""
    steps.orderBy(order).select(F.col(value).cast("double").cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(folder)


def unique_path(spark: SparkSession, folder: str, name: str, stamp: str) -> str:
    """``folder/name``, with the time stamp before its ending where that exists, and a number where that does too."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    stem, dot, ending = name.rpartition(".") if "." in name else (name, "", "")
    for k in count(-1):
        tried = name if k < 0 else f"{stem}-{stamp}{f'-{k}' if k else ''}{dot}{ending}"
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{tried}")
        if not path.getFileSystem(conf).exists(path):
            return f"{folder}/{tried}"
    raise AssertionError


def read_runs(spark: SparkSession, path: str, schema: str = RUNS) -> DataFrame:
    """A JSON array of runs."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Nested run logs, a document per file, with the file's name."""
    return spark.read.option("multiLine", True).json(path).withColumn("file", F.input_file_name())
