"""Summaries of light curves, of period methods and of timed runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lyraflux.constants import N_BUCKET_EDGES


def summary(counts: DataFrame) -> DataFrame:
    """Numbers of light curves, valid and skipped, by band, with the spread of n_obs of the valid ones."""
    n = F.when(F.col("valid"), F.col("n_obs"))
    return counts.groupBy("band").agg(
        F.count(F.lit(1)).alias("light_curves"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("skipped"),
        F.min(n).alias("least"), F.percentile(n, 0.5).alias("median"), F.avg(n).alias("mean"), F.max(n).alias("most"),
    )


def size_buckets(counts: DataFrame, edges: tuple[int, ...] = N_BUCKET_EDGES) -> DataFrame:
    """Light curves by number of observations: bucket k lies from edge k to the next, the last is open; below the first is -1."""
    bucket = F.lit(-1)
    for k, low in enumerate(edges):
        bucket = F.when(F.col("n_obs") >= low, k).otherwise(bucket)
    rows = counts.withColumn("bucket", bucket).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("n_obs").alias("observations"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def algorithm_shares(found: DataFrame) -> DataFrame:
    """Rows by the method whose period was adopted; none where there is no period."""
    name = F.when(F.col("period").isNull() | F.isnan("period") | (F.col("period_algorithm") == ""), "none").otherwise(F.col("period_algorithm"))
    return found.groupBy(name.alias("algorithm")).agg(F.count(F.lit(1)).alias("n"))


def best_of_trials(runs: DataFrame) -> DataFrame:
    """For each number of cores the least seconds of its trials, with speed-up and efficiency against one core."""
    best = runs.groupBy("cores").agg(F.min("seconds").alias("seconds"))
    one = F.max(F.when(F.col("cores") == 1, F.col("seconds"))).over(Window.partitionBy())
    best = best.withColumn("speedup", one / F.col("seconds"))
    return best.withColumn("efficiency", F.col("speedup") / F.col("cores"))


def amdahl(best: DataFrame) -> DataFrame:
    """The serial share of least squares and the speed-up that it allows, from the best seconds of each number of cores."""
    one = F.max(F.when(F.col("cores") == 1, F.col("seconds"))).over(Window.partitionBy())
    x, y = 1 - 1 / F.col("cores"), F.col("seconds") / one - 1 / F.col("cores")
    rows = best.select(x.alias("x"), y.alias("y")).where("x > 0")
    serial = F.least(F.greatest(F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x")), F.lit(0.0)), F.lit(1.0))
    return rows.agg(serial.alias("serial_fraction")).withColumn("max_speedup", F.try_divide(F.lit(1.0), F.col("serial_fraction")))


def throughput(workers: DataFrame) -> DataFrame:
    """Median over trials of light curves by the slowest worker's seconds; ``workers`` has gpus, trial, n, seconds."""
    each = workers.groupBy("gpus", "trial").agg((F.sum("n") / F.max("seconds")).alias("rate"))
    return each.groupBy("gpus").agg(F.percentile("rate", 0.5).alias("rate"))
