"""Rows in order by ranges of their keys, and every row's place within its group, without a task that sees a whole group.

Rows are dealt by ranges of the group, then the order, and sorted in each range; a range with a share of a large
group holds a run of it. Runs are counted by range and group, and the counts of the ranges before give
each run's first place. The last key numbers the rows, so equal rows are split between ranges like all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range; more rows make more ranges.
RANGE_ROWS = 1 << 18


def in_ranges(rows: DataFrame, group: str, order: list[str], count: int, at: str = "at") -> DataFrame:
    """``rows`` dealt and sorted by ``group`` and ``order``, with ``at``: its range, and from bit 33 down its place there."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-count // RANGE_ROWS))
    rows = rows.withColumn(at, F.monotonically_increasing_id())
    return rows.repartitionByRange(parts, group, *order, at).sortWithinPartitions(group, *order, at).withColumn(at, F.monotonically_increasing_id())


def part(at: str = "at") -> Column:
    return F.shiftright(at, 33)


def runs(sorted_rows: DataFrame, group: str, at: str = "at") -> DataFrame:
    """``part, <group>, first, start, n, of``: a run's first place in its range and in its group, its rows and its group's.

    A row per range and group; a window's task holds the ranges of one group, not its rows.
    """
    place = F.col(at).bitwiseAND((1 << 33) - 1)
    each = sorted_rows.groupBy(part(at).alias("part"), group).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(group)
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return each.select("part", group, "first", F.coalesce(before, F.lit(0)).alias("start"), "n", F.sum("n").over(whole).alias("of"))


def index(at: str = "at") -> Column:
    """A row's place in its group, beside the columns of its run."""
    return F.col(at).bitwiseAND((1 << 33) - 1) - F.col("first") + F.col("start")
