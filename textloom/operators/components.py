"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import discard, materialize


def _print_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, label)`` for every node of an edge table of longs; label is the least node of its component.

    Each step moves neighbours to the least node seen, so the number of steps grows with the
    logarithm of the longest path. Every step is written to the shared folder. A node with very
    many neighbours costs one partial minimum per task and a join that adaptive execution splits.
    """
    least, most = F.least(a, b), F.greatest(a, b)
    now = edges.where(F.col(a) != F.col(b)).select(most.alias("a"), least.alias("b")).distinct()
    now = materialize(now, "edges")
    seen = _print_of(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        mins = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(mins, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step = materialize(moved.unionByName(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(now)
        now = step
        last, seen = seen, _print_of(now)
        if last == seen:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
