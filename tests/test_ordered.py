"""First rows by event time over streams in any order, against the finished table."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from textloom.streaming import ordered

SCHEMA = "ts timestamp, domain string, doc_id long, `meta.n` double"
START = dt.datetime(2024, 1, 1)


def streamed(spark, tmp_path, batches, most, delay):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part={k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(*[str(tmp_path / "in" / "part=*")])
    out = ordered.first_by_time(stream.select("ts", "domain", "doc_id", "`meta.n`"), F.col("domain"), "ts", most, delay)
    query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "notes")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return sorted(map(tuple, spark.read.schema(SCHEMA).parquet(str(tmp_path / "out")).collect()), key=repr)


@pytest.mark.parametrize("most", [1, 3])
def test_streams_out_of_order(spark, tmp_path, most):
    """Late and repeated rows within the delay: the same rows as over the table, whatever the order of arrival."""
    rng = random.Random(most)
    rows = [(START + dt.timedelta(minutes=rng.randrange(300), microseconds=rng.randrange(5)), rng.choice(["a", "b", None, "c"]), k, k / 4) for k in range(120)]
    rows += rows[:20]
    rng.shuffle(rows)
    rows.sort(key=lambda r: (r[0] - START).seconds // 3600 + rng.random() * 2)  # disorder of some hours
    end = [(START + dt.timedelta(days=2), "end", 999, 0.0)]
    batches = [rows[:70], rows[70:], end]
    found = streamed(spark, tmp_path, batches, most, "6 hours")
    want = ordered.first_by_time_of_table(spark.createDataFrame(rows, SCHEMA), F.col("domain"), "ts", most)
    assert found == sorted(map(tuple, want.collect()), key=repr) and len(found) == 4 * most


def test_rows_after_the_delay_go(spark, tmp_path):
    at = lambda h: START + dt.timedelta(hours=h)
    batches = [[(at(1), "a", 1, 0.0)], [(at(40), "x", 2, 0.0)], [(at(0), "a", 3, 0.0), (at(39.5), "a", 4, 0.0)], [(at(90), "x", 5, 0.0)]]
    assert sorted(r[2] for r in streamed(spark, tmp_path, batches, 9, "1 hour")) == [1, 2, 4]
