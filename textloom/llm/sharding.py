"""Shards by jump consistent hashing, as files with gapless places.

A row's shard is a function of its key and the number of shards alone, without a table of the ring: a linear
congruential sequence from the key's hash says at which numbers of shards the row jumps, always into
the shard just added, and the last jump within the number counts. So with one more shard a row stays or goes to the new one.

``write`` deals rows by ranges of (shard, key), so a shard is as many tasks' and files' as it needs, and notes per
range and shard how many rows there are; a row's slot is its place in its range and the rows of the ranges before.
``read`` joins these few numbers to the files' rows.

Scale: rows move once, whole; the sampling for the ranges reads keys only. A key that holds a third of all rows keeps one shard, as the
law has it, but is split over tasks by row number. No driver or task sees more than a range.

Defined results: a null key is a key of its own; null text counts no bytes; very long texts move whole; rows with the same key share a shard and
have slots of their own; an empty table writes no shard and reads as no rows; all columns are stored in one struct, so
names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import ranges
from textloom.session import ship

#: The sequence's multiplier, and the bits that its numbers drop.
MULTIPLIER, DROPPED = 2862933555777941757, 33
SHARDS = 40
#: Bytes that a row counts besides its text.
ROW_BYTES = 16
#: Hash of a null key.
NO_KEY = -1


def key_hash(key: Column) -> Column:
    """60 bits of the MD5 of the key's text: the same in every session, language and layout."""
    return F.coalesce(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(NO_KEY))


def jump(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each hash."""
    state = hashes.astype(np.int64).view(np.uint64).copy()
    shard, at = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    going = np.arange(len(state))
    while len(going):
        shard[going] = at[going]
        state[going] = state[going] * np.uint64(MULTIPLIER) + np.uint64(1)
        chance = (state[going] >> np.uint64(DROPPED)).astype(np.float64) + 1
        at[going] = ((shard[going] + 1) * (float(1 << 31) / chance)).astype(np.int64)
        going = going[at[going] < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    if shards < 1:
        raise ValueError("a row needs a shard")

    @F.pandas_udf("int")
    def placed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for hashes in batches:
            yield pd.Series(jump(hashes.to_numpy(), shards).astype(np.int32))

    return placed(key_hash(key))


def size_bytes(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def moves(rows: DataFrame, key: str, old: int, new: int) -> DataFrame:
    """Rows that go to another shard when the number of shards changes, with ``from_shard`` and ``to_shard``."""
    ship(rows.sparkSession)
    placed = rows.withColumns({"from_shard": shard_of(F.col(key), old), "to_shard": shard_of(F.col(key), new)})
    return placed.where("from_shard != to_shard")


def write(rows: DataFrame, folder: str, key: str = "doc_id", shards: int = SHARDS) -> None:
    """Write ``rows`` to ``folder``: Parquet files by shard, and the index of their runs."""
    spark = rows.sparkSession
    ship(spark)
    dealt = rows.select(shard_of(F.col(key), shards).alias("shard"), F.col(key).alias("key"), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"))
    dealt = ranges.in_ranges(dealt, "shard", ["key"], rows.count()).drop("key")
    dealt.write.partitionBy("shard").parquet(f"{folder}/shards")
    stored = _stored(spark, folder, dealt.schema["row"].dataType)
    ranges.runs(stored.select("shard", "at"), "shard").write.parquet(f"{folder}/index")


def _stored(spark: SparkSession, folder: str, row=None) -> DataFrame:
    reader = spark.read
    if row is not None:  # files of an empty table say nothing of its columns
        from pyspark.sql import types as T

        reader = reader.schema(T.StructType([T.StructField("row", row), T.StructField("at", T.LongType()), T.StructField("shard", T.IntegerType())]))
    return reader.parquet(f"{folder}/shards")


def read(spark: SparkSession, folder: str, schema=None) -> DataFrame:
    """``row, shard, slot`` of a folder of :func:`write`; ``schema`` is the rows' (needed only where the folder is of an empty table)."""
    found = spark.read.parquet(f"{folder}/index")
    stored = _stored(spark, folder, schema).withColumn("part", ranges.part())
    return stored.join(found, ["part", "shard"]).select("row", "shard", ranges.index().alias("slot"))


def oracle(shards: int = SHARDS) -> str:
    """DuckDB SQL of the query's rows."""
    table = "SELECT list_reduce(list_concat([k], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS v, k FROM range(0, 256) r(k)"
    crc = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"

    def walk(name: str, n: int) -> str:
        state = f"(state * {MULTIPLIER} + 1) % 18446744073709551616::HUGEINT"
        to = f"floor((following + 1)::DOUBLE * (2147483648::DOUBLE / (((({state}) >> {DROPPED}) + 1)::DOUBLE)))::BIGINT"
        return f"""{name} AS (SELECT rid, h AS state, 0::BIGINT AS shard, 0::BIGINT AS following FROM d UNION ALL
  SELECT rid, {state}, following, {to} FROM {name} WHERE following < {n}),
{name}_of AS (SELECT rid, max(shard)::INT AS shard FROM {name} GROUP BY rid)"""

    return f"""
WITH RECURSIVE tb AS (SELECT list(v ORDER BY k) AS tab FROM ({table})),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(('0x' || md5(doc_id::VARCHAR)[1:15])::HUGEINT, 18446744073709551615::HUGEINT) AS h FROM documents),
{walk('a', shards)},
{walk('b', shards + 1)}
SELECT doc_id, (strlen(t) + {ROW_BYTES})::BIGINT AS size, {crc} AS text_crc32, 'key' AS law, a_of.shard AS shard,
       row_number() OVER (PARTITION BY a_of.shard ORDER BY doc_id NULLS FIRST) - 1 AS slot, b_of.shard AS grown_shard
FROM d JOIN a_of USING (rid) JOIN b_of USING (rid), tb"""
