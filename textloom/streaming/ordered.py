"""The first rows of each key by event time, over a stream whose rows come in any order within a delay.

Rows wait in keyed state until the watermark has passed their time, when none that belongs before them can come any more; then they
leave in the order of time and content, as long as the key has had fewer than ``most``. So duplicates (most = 1) and caps per
domain are decided as over the finished table, whatever the arrival. What a key has had is one number, kept for ``keep`` (processing
time) after it last changed, so keys that have gone quiet are forgotten; without ``keep`` it is kept for ever.

Defined results: rows later than the delay are dropped, as everywhere behind a watermark; repeated rows count one by one; rows
with a null time never leave; a null key is a key; rows pass with all their columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from textloom.session import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAITING, OUT = "at long, content string", "content string"


class FirstByTime(StatefulProcessor):
    def __init__(self, most: int, keep_ms: int | None) -> None:
        self.most, self.keep_ms = most, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.seen = handle.getValueState("seen", "n long", self.keep_ms) if self.keep_ms else handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            new = [(int(at), content) for at, content in zip(batch["at"], batch["content"])]
            self.waiting.appendList(new)
            for at in {at for at, _ in new}:
                self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs()
        rows = [(r[0], r[1]) for r in self.waiting.get()]
        ready = sorted(r for r in rows if r[0] <= passed)
        if ready:
            rest = [r for r in rows if r[0] > passed]
            self.waiting.put(rest) if rest else self.waiting.clear()
            had = self.seen.get()[0] if self.seen.exists() else 0
            out = [content for _, content in ready[: max(0, self.most - had)]]
            if out:
                self.seen.update((had + len(out),))
                yield pd.DataFrame({"content": out})

    def close(self) -> None:
        pass


def use_state(spark: SparkSession) -> None:
    """State with timers and lists needs the store that can hold it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


#: Rows wait as JSON that keeps microseconds and nulls.
FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def _content(rows: DataFrame) -> Column:
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), FORMATS)


def first_by_time(stream: DataFrame, key: Column, time: str, most: int, delay: str = "1 hour", keep_ms: int | None = None) -> DataFrame:
    """The first ``most`` rows of each key in the order of a timestamp column (of equal times, of the rows as JSON)."""
    ship(stream.sparkSession)
    use_state(stream.sparkSession)
    rows = stream.withWatermark(time, delay)
    rows = rows.select(F.col(time), key.alias("key"), F.unix_millis(time).alias("at"), _content(stream).alias("content"))
    kept = rows.where("at is not null").groupBy("key").transformWithStateInPandas(FirstByTime(most, keep_ms), OUT, "Append", "EventTime")
    return kept.select(F.from_json("content", stream.schema, FORMATS).alias("row")).select("row.*")


def first_by_time_of_table(table: DataFrame, key: Column, time: str, most: int) -> DataFrame:
    """What :func:`first_by_time` gives over a finished table."""
    from pyspark.sql import Window

    order = Window.partitionBy("_key").orderBy(F.col("_at"), F.col("_content"))
    rows = table.select(F.struct("*").alias("row"), key.alias("_key"), F.unix_millis(time).alias("_at"), _content(table).alias("_content"))
    return rows.where("_at is not null").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select("row.*")
