"""Token streams: offsets of documents laid end to end, fixed windows, range checks and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import materialize


def running_offsets(rows: DataFrame, order: str, value: str, out: str = "offset") -> DataFrame:
    """Add the sum of ``value`` over all rows before, in the order of a column.

    Rows are dealt by ranges of the column; each range sums its own and adds the totals of the
    ranges before, so no task sees all rows.
    """
    dealt = materialize(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_part").agg(F.sum(value).alias("_total"))  # a row per range
    before = F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.sum(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    joined = dealt.withColumn("_own", F.coalesce(own, F.lit(0))).join(totals, "_part")
    return joined.withColumn(out, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def packed(rows: DataFrame, length: int, offset: str = "offset", n: str = "tokens") -> DataFrame:
    """Add the first and last of the sequences of ``length`` tokens that a document lies in."""
    return rows.withColumn("first_seq", F.expr(f"{offset} div {length}")).withColumn("last_seq", F.expr(f"({offset} + {n} - 1) div {length}"))


def check_range(ids: Column, vocab_size: int) -> Column:
    """The id itself, or an error if the vocabulary has no such id."""
    bad = (ids < 0) | (ids >= vocab_size)
    return F.when(bad, F.raise_error(F.concat(F.lit("token id out of range: "), ids.cast("string")))).otherwise(ids)


def windows(tokens: DataFrame, starts: DataFrame, length: int) -> DataFrame:
    """``sample, start, x, y`` from ``pos, token`` and ``sample, start``: y is x moved on by one.

    Positions are exploded per sample and joined on equality, so work is samples times length
    and not a range join.
    """
    wanted = starts.select("sample", "start", F.posexplode(F.sequence("start", F.col("start") + length)).alias("k", "pos"))
    found = wanted.join(tokens, "pos").groupBy("sample", "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "token"))), lambda r: r["token"]).alias("t"))
    return found.select("sample", "start", F.slice("t", 1, length).alias("x"), F.slice("t", 2, length).alias("y"))


def blocks(rows: DataFrame, size: int, order: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``block, ids``: the ids of all rows laid end to end in the order of a column and cut every ``size``; the last block can be shorter.

    A row is sent as the slices that its blocks take of it, so a block gathers at most ``size`` ids, however short or long rows are.
    """
    counted = rows.select(order, F.col(ids).alias("ids"), F.size(ids).cast("long").alias("n")).where("n > 0")
    placed = running_offsets(counted, order, "n", "at")
    first, past = f"greatest(0, b * {size} - at)", f"least(n, (b + 1) * {size} - at)"
    slices = f"transform(sequence(at div {size}, (at + n - 1) div {size}), b -> struct(b as block, at + {first} as at, slice(ids, int({first}) + 1, int({past} - {first})) as ids))"
    pieces = placed.select(F.inline(F.expr(slices)))
    return pieces.groupBy("block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda r: r["ids"])).alias("ids"))


def block_windows(stream: DataFrame, starts: DataFrame, length: int, size: int) -> DataFrame:
    """``sample, start, x, y`` from :func:`blocks` and ``sample, start``: y is x moved on by one.

    A window asks for the numbers of the blocks that it lies in, and of each only its own slice moves on.
    """
    wanted = starts.select("sample", "start", F.explode(F.expr(f"sequence(start div {size}, (start + {length}) div {size})")).alias("block"))
    first = f"greatest(0, start - block * {size})"
    own = F.expr(f"slice(ids, int({first}) + 1, int(least({size}, start + {length} + 1 - block * {size}) - {first}))")
    found = wanted.join(stream, "block").select("sample", "start", F.struct("block", own.alias("ids")).alias("part"))
    found = found.groupBy("sample", "start").agg(F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda r: r["ids"])).alias("t"))
    return found.select("sample", "start", F.slice("t", 1, length).alias("x"), F.slice("t", 2, length).alias("y"))


def random_starts(spark, samples: int, tokens: int, length: int, seed: int = 0) -> DataFrame:
    """``sample, start`` uniform on [0, tokens - length), with repeats; the same for a seed whatever the layout."""
    if tokens <= length:
        raise ValueError("fewer tokens than a window")
    chance = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(tokens - length))
    return spark.range(samples).select(F.col("id").alias("sample"), chance.alias("start"))


def line_ids(lines: DataFrame, encode, end_id: int, keep_empty: bool = False, text: str = "text", out: str = "ids") -> DataFrame:
    """Ids of each line and the end id; a trailing line feed isn't text. Empty lines go, or count as the end id alone."""
    rows = lines.withColumn(text, F.regexp_replace(F.coalesce(text, F.lit("")), "\n$", ""))
    rows = rows if keep_empty else rows.where(F.col(text) != "")
    return encode(rows).withColumn(out, F.concat(F.col(out), F.array(F.lit(end_id))))


def count_ids(rows: DataFrame, ids: str = "ids") -> DataFrame:
    """One row: documents and ids."""
    return rows.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.size(ids)), F.lit(0)).alias("tokens"))
