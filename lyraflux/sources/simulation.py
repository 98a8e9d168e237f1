"""Simulated light curves: a model, irregular epochs and noise for every row of a table of sources."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SimulationConfig:
    epochs: int = 100
    start: float = 2459000.0
    span: float = 100.0
    min_period: float = 0.5
    max_period: float = 5.0
    amplitude: float = 0.4
    noise: float = 0.03
    eclipsing_share: float = 0.25
    eclipse_width: float = 0.1
    seed: int = 42


def uniform(seed: int, *of: Column | str) -> Column:
    """A number from 0 up to 1 that depends on the seed and ``of`` alone, not on partitions."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11) / F.lit(2.0**53)


def simulated(sources: DataFrame, config: SimulationConfig | None = None, band: str = "r") -> DataFrame:
    """Observations of each row of ``sources`` (source_id, ra, dec), with its true kind and period.

    Epochs stand in equal cells of the span, each anywhere in its own. A sine varies about the
    mean, an eclipse dims by the amplitude for a share of the period; Gaussian noise is added.
    """
    c = config or SimulationConfig()
    own = lambda k: uniform(c.seed + k, "source_id")
    each = lambda k: uniform(c.seed + k, "source_id", "ord")
    rows = sources.select(
        "source_id", F.lit(band).alias("band"), F.lit("simulated").alias("survey"), "ra", "dec",
        F.when(own(1) < c.eclipsing_share, "eclipse").otherwise("sine").alias("kind"), (c.min_period * F.pow(F.lit(c.max_period / c.min_period), own(2))).alias("true_period"),
        (15 + 4 * own(3)).alias("mean"), own(4).alias("shift"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c.epochs - 1).cast("long"))).alias("ord"),
    )
    rows = rows.withColumn("t", c.start + (F.col("ord") + each(5)) * (c.span / c.epochs))
    phase = F.pmod((F.col("t") - c.start) / F.col("true_period") + F.col("shift"), F.lit(1.0))
    shape = F.when(F.col("kind") == "sine", F.sin(2 * np.pi * phase)).otherwise((phase < c.eclipse_width).cast("double"))
    normal = F.sqrt(-2 * F.log(1 - each(6))) * F.cos(2 * np.pi * each(7))
    rows = rows.withColumns({"mag": F.col("mean") + c.amplitude * shape + c.noise * normal, "mag_err": F.lit(c.noise)})
    return rows.select("source_id", "band", "survey", "ra", "dec", "t", "mag", "mag_err", "ord", "kind", "true_period")
