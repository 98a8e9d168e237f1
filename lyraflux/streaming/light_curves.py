"""Light curves that arrive over time: Structured Streaming forms of ingest, cadence filter and epoch counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from lyraflux.operators.lightcurves import KEY

EPOCH = "source_id string, band string, t double, mag double, mag_err double, ord long"


def files(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_a_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files of ``folder`` whose names fit ``pattern``, also of those still to come, at most ``files_a_batch`` at once."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (reader if files_a_batch is None else reader.option("maxFilesPerTrigger", files_a_batch)).parquet(folder)


def cadence_filtered(obs: DataFrame, min_days: float) -> DataFrame:
    """Epochs at least ``min_days`` after the last one kept, which is remembered for each light curve between batches.

    A batch is gone through by time. What arrives after a later epoch was kept is dropped, as are
    epochs without a time. The state of a light curve is one number.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).dropna(subset=["t"]).sort_values(["t", "ord"], kind="stable")
        t, last, kept = rows["t"].to_numpy(), state.get[0] if state.exists else -np.inf, []
        for at, now in enumerate(t):
            if now - last >= min_days:
                kept.append(at)
                last = float(now)
        if kept:
            state.update((last,))
        yield rows.iloc[kept][[c.split()[0] for c in EPOCH.split(", ")]]

    return obs.groupBy(*KEY).applyInPandasWithState(step, EPOCH, "last double", "append", GroupStateTimeout.NoTimeout)


def epoch_counts(obs: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Epochs and mean magnitude of each band by windows of ``width``; a window is final once ``late`` has passed since its end."""
    time = F.timestamp_micros(F.round((F.col("t") - 2440587.5) * 86400e6).cast("long"))
    rows = obs.withColumn("time", time).withWatermark("time", late)
    return rows.groupBy(F.window("time", width), "band").agg(F.count(F.lit(1)).alias("n"), F.avg("mag").alias("mean_mag"))


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """All that is there now, run through ``stream`` into ``folder``, whose checkpoint continues at the next call; the rows so far."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


#: Epochs are kept in so many parts by light curve, of which a batch reads those that it touches.
PARTS = 64


def keep_features(obs: DataFrame, folder: str, build: Callable[[DataFrame], DataFrame], parts: int = PARTS) -> DataFrame:
    """Runs all epochs of the stream that are there now through ``build`` (observations to a row a light curve); the features so far.

    A batch adds its epochs to ``folder``, then features are made anew of all epochs of the light curves it touches, so
    a late epoch re-opens its light curve, and the features equal those of one batch after any order of files. Epochs without a
    source or band take no part. A batch writes under its number and replaces what a failed try left; it reads
    no later one. The next call goes on where this one stopped. ``parts`` is fixed for a folder. ``build`` may predict too.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64(*KEY), F.lit(parts)).cast("int")
        rows = batch.dropna(subset=KEY).withColumn("part", part)
        rows.repartition("part", F.pmod(F.xxhash64(*KEY, "t"), F.lit(8))).write.mode("overwrite").partitionBy("part").parquet(f"{folder}/epochs/batch={number}")
        known = spark.read.schema(f"{EPOCH}, batch long, part int").parquet(f"{folder}/epochs").where(F.col("batch") <= number)
        touched = known.where(F.col("batch") == number).select("part", *KEY).distinct()
        at = [r["part"] for r in touched.select("part").distinct().collect()]  # at most ``parts`` numbers
        own = known.where(F.col("part").isin(at)).join(touched, ["part", *KEY], "left_semi").drop("batch", "part")
        build(own).write.mode("overwrite").parquet(f"{folder}/features/batch={number}")

    query = obs.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return kept_features(obs.sparkSession, folder)


def kept_features(spark: SparkSession, folder: str) -> DataFrame:
    """Of each light curve the features of the last batch that touched it."""
    found = spark.read.option("mergeSchema", "true").parquet(f"{folder}/features")
    names = [c for c in found.columns if c not in (*KEY, "batch")]
    last = found.groupBy(*KEY).agg(F.max_by(F.struct(*names), "batch").alias("last"))
    return last.select(*KEY, "last.*")
