"""The document filter over streams: the rules are stateless, duplicates and the cap per domain keep state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.functions import text
from textloom.functions.pii import mask_all
from textloom.operators.curation import FilterConfig, first_failure


def passing(stream: DataFrame, config: FilterConfig | None = None) -> DataFrame:
    """Rows of ``uri, text`` that fail no rule, with the masked text and its digest."""
    judged = first_failure(stream, F.lit("en"), F.lit(1.0), F.lit(None).cast("string"), config)
    return mask_all(judged.where("reason is null"), "normalized").withColumn("digest", text.digest(F.col("masked")))


def without_duplicates(stream: DataFrame, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first row of each digest. With an event time, state is kept only as long as rows may be late; without one, every digest is kept for ever,
    so a stream without end needs one (or :func:`textloom.streaming.ordered.first_by_time` with ``keep_ms``)."""
    if time is None:
        return stream.dropDuplicates(["digest"])
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["digest"])


def capped(stream: DataFrame, domain: Column, most: int) -> DataFrame:
    """At most ``most`` rows of each domain over the whole stream; the state is one number per domain."""
    rows = stream.withColumn("domain", domain)

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (seen,) = state.get if state.exists else (0,)
        for batch in batches:
            some = batch.iloc[: max(0, most - seen)]
            seen += len(some)
            yield some
        state.update((seen,))

    return rows.groupBy("domain").applyInPandasWithState(keep, rows.schema, "seen long", "append", GroupStateTimeout.NoTimeout)


def counts_by_window(events: DataFrame, time: str, by: str, width: str = "10 minutes", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows per window and key; windows close when the watermark passes them, later rows are dropped."""
    over = F.window(time, width, slide) if slide else F.window(time, width)
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return timed.groupBy(over, by).agg(F.count(F.lit(1)).alias("n"))
