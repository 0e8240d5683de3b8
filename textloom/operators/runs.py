"""Statistics of benchmark runs and scaling-law data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def step_stats(steps: DataFrame, by: list[str], warmup: int) -> DataFrame:
    """Mean and sample deviation (0 for one step) of the steps after the warm-up."""
    kept = steps.where(F.col("step") >= warmup)
    return kept.groupBy(*by).agg(F.count(F.lit(1)).alias("steps"), F.avg("ms").alias("mean_ms"), F.coalesce(F.stddev_samp("ms"), F.lit(0.0)).alias("std_ms"))


def slowest_rank(steps: DataFrame, by: list[str], warmup: int) -> DataFrame:
    """A step takes as long as its slowest rank; the mean over steps."""
    kept = steps.where(F.col("step") >= warmup).groupBy(*by, "step").agg(F.max("ms").alias("ms"))
    return kept.groupBy(*by).agg(F.avg("ms").alias("step_ms"))


def throughput(stats: DataFrame, tokens: int) -> DataFrame:
    """Tokens a second; null where no time passed."""
    return stats.withColumn("tokens_s", F.try_divide(F.lit(tokens * 1000.0), F.col("step_ms")))


def latency(steps: DataFrame, warmup: int) -> DataFrame:
    """Slowest rank's mean time and GiB a second, by size and ranks."""
    kept = steps.where(F.col("step") >= warmup).groupBy("mb", "world", "rank").agg(F.avg("ms").alias("ms"))
    worst = kept.groupBy("mb", "world").agg(F.max("ms").alias("latency_ms"))
    return worst.withColumn("gib_s", F.try_divide(F.col("mb") / 1024.0, F.col("latency_ms") / 1000.0))


def speedup(results: DataFrame, by: str, baseline: str) -> DataFrame:
    """Best variant of each group against the baseline's time; a group without a baseline keeps null."""
    best = results.where("status = 'ok'").groupBy(by, "impl").agg(F.min_by("variant", F.struct("ms", "variant")).alias("variant"), F.min("ms").alias("ms"))
    base = best.where(F.col("impl") == baseline).select(by, F.col("ms").alias("base_ms"))
    return best.join(base, by, "left").withColumn("speedup", F.try_divide(F.col("base_ms"), F.col("ms")))


def sweep(impls: DataFrame, sizes: DataFrame, worlds: DataFrame, bucketed: str, buckets: list[int]) -> DataFrame:
    """Every combination of small parameter lists; bucket sizes only for one implementation."""
    grid = impls.crossJoin(sizes).crossJoin(worlds)
    options = F.when(F.col("impl") == bucketed, F.array(*map(F.lit, buckets))).otherwise(F.array(F.lit(None).cast("int")))
    return grid.withColumn("bucket_mb", F.explode(options))


def best_per_budget(runs: DataFrame) -> DataFrame:
    """The run with the least loss at each compute budget."""
    return runs.groupBy("compute_budget").agg(F.min_by("parameters", F.struct("final_loss", "parameters")).alias("parameters"), F.min("final_loss").alias("final_loss"))


def power_law(best: DataFrame) -> DataFrame:
    """Least squares of log parameters on log budget: N = exp(intercept) * C^exponent."""
    x, y = F.log("compute_budget"), F.log(F.col("parameters").cast("double"))
    return best.agg(F.regr_slope(y, x).alias("exponent"), F.regr_intercept(y, x).alias("intercept"))


def peak(steps: DataFrame, by: list[str], warmup: int) -> DataFrame:
    """Mean time (all that passed over all iterations) and peak bytes of the steps after the warm-up."""
    kept = steps.where(F.col("step") >= warmup)
    return kept.groupBy(*by).agg((F.sum("ms") / F.count(F.lit(1))).alias("mean_ms"), F.max("bytes").alias("peak_bytes"))


def memory_deltas(events: DataFrame, by: list[str]) -> DataFrame:
    """``event``'s bytes and what they grew by since the rank's event before (by ``at``), each the most over all ranks."""
    before = F.lag("bytes").over(Window.partitionBy(*by, "rank").orderBy("at"))
    grown = events.withColumn("delta", F.col("bytes") - F.coalesce(before, F.lit(0)))
    return grown.groupBy(*by, "at", "event").agg(F.max("bytes").alias("bytes"), F.max("delta").alias("delta"))
