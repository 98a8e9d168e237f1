"""Shape of light curves: nesting, cadence, baseline, validity, primary band, epoch offset."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["source_id", "band"]


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def nested(obs: DataFrame) -> DataFrame:
    """One row a light curve: n_obs and its epochs as arrays t, mag, mag_err, by time and then ``ord``."""
    epochs = F.sort_array(F.collect_list(F.struct("t", "ord", "mag", "mag_err")))
    rows = obs.groupBy(*KEY).agg(F.count(F.lit(1)).cast("int").alias("n_obs"), epochs.alias("obs"))
    return rows.select(*KEY, "n_obs", *[F.col(f"obs.{c}").alias(c) for c in ("t", "mag", "mag_err", "ord")])


def kept_flags(times: list[float | None], min_days: float) -> list[bool]:
    """Which of the times in order are at least ``min_days`` after the last one that was kept; unknown ones are kept."""
    out, last = [], None
    for t in times:
        keep = t is None or last is None or not t - last < min_days
        last = t if keep else last
        out.append(keep)
    return out


def spaced(epochs: Column, min_days: float) -> Column:
    """Of an array of epochs with ``t``, in order, those at least ``min_days`` after the last one that was kept: one pass."""

    @F.arrow_udf("array<boolean>")
    def flags(times: pa.Array) -> pa.Array:
        return pa.array([None if x is None else kept_flags(x, min_days) for x in times.to_pylist()], pa.list_(pa.bool_()))

    marked = F.zip_with(epochs, flags(F.transform(epochs, lambda e: e["t"])), lambda e, keep: F.struct(e.alias("e"), keep.alias("keep")))
    return F.transform(F.filter(marked, lambda x: x["keep"]), lambda x: x["e"])


def cadence_filtered(obs: DataFrame, min_days: float) -> DataFrame:
    """Epochs at least ``min_days`` after the last one that was kept; 0 or less keeps all."""
    if min_days <= 0:
        return obs
    epochs = F.sort_array(F.collect_list(F.struct("t", "ord", "mag", "mag_err")))
    rows = obs.groupBy(*KEY).agg(epochs.alias("obs")).withColumn("obs", spaced(F.col("obs"), min_days))
    return rows.select(*KEY, F.explode("obs").alias("e")).select(*KEY, "e.t", "e.mag", "e.mag_err", "e.ord")


def longest_baseline(obs: DataFrame) -> DataFrame:
    """The longest time between first and last epoch of a light curve of two or more, by finite times; 1 day if none is positive."""
    t = F.when(finite(F.col("t")), F.col("t"))
    spans = obs.groupBy(*KEY).agg((F.max(t) - F.min(t)).alias("span"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    most = F.max("span")
    return spans.agg(F.when(most > 0, most).otherwise(F.lit(1.0)).alias("baseline"))


def zero_offset(obs: DataFrame) -> DataFrame:
    """``obs`` with t0: time since the light curve's first finite epoch, taken in double and then cast to float."""
    first = F.min(F.when(finite(F.col("t")), F.col("t"))).over(Window.partitionBy(*KEY))
    return obs.withColumn("t0", (F.col("t") - first).cast("float"))


def counted(obs: DataFrame, min_observations: int = 50) -> DataFrame:
    """n_obs of every light curve and whether it is long enough for features; short ones stay."""
    rows = obs.groupBy(*KEY).agg(F.count(F.lit(1)).cast("int").alias("n_obs"))
    return rows.withColumn("valid", F.col("n_obs") >= min_observations)


def primary_bands(obs: DataFrame) -> DataFrame:
    """Each source's band of most observations; of equal ones the band that was observed first."""
    rows = obs.groupBy(*KEY).agg(F.count(F.lit(1)).cast("int").alias("n_obs"), F.min(F.struct("t", "ord")).alias("first"))
    order = Window.partitionBy("source_id").orderBy(F.desc("n_obs"), "first", "band")
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").select(*KEY, "n_obs")
