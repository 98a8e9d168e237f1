"""Light curves that close once they have been quiet, by state with timers.

The state of a light curve is about twenty numbers, moments that merge, however many epochs it has. A timer
on the time of arrival closes it; an epoch that comes later, of whatever time, opens it again, and it closes
with one version more. The statistics equal those of one batch after any order of arrival.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lyraflux.operators.lightcurves import KEY
from lyraflux.operators.statistics import LEAST_OBSERVATIONS
from lyraflux.streaming.light_curves import drained

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Timers need a store that keeps several columns of state.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATISTICS = ("wmean", "chi2red", "wstd", "norm_peak_to_peak_amp", "norm_excess_var", "skew", "small_kurt")
CLOSED = "source_id string, band string, version int, closed timestamp, n_obs int, t_first double, t_last double, " + ", ".join(f"{c} double" for c in STATISTICS)

#: Weight, mean and central sums of the second to fourth power of nothing.
NONE = (0.0, 0.0, 0.0, 0.0, 0.0)


def moments(x: np.ndarray, w: np.ndarray) -> tuple[float, ...]:
    """Weight, mean, and weighted sums of the second to fourth power about it."""
    if not len(x):
        return NONE
    total = w.sum()
    mean = (w * x).sum() / total
    d = x - mean
    return tuple(map(float, (total, mean, (w * d**2).sum(), (w * d**3).sum(), (w * d**4).sum())))


def merged(a: tuple[float, ...], b: tuple[float, ...]) -> tuple[float, ...]:
    """``moments`` of two sets together."""
    if not a[0] or not b[0]:
        return b if not a[0] else a
    (u, p, a2, a3, a4), (v, q, b2, b3, b4) = a, b
    n, d = u + v, q - p
    return (
        n, p + d * v / n, a2 + b2 + d**2 * u * v / n,
        a3 + b3 + d**3 * u * v * (u - v) / n**2 + 3 * d * (u * b2 - v * a2) / n,
        a4 + b4 + d**4 * u * v * (u * u - u * v + v * v) / n**3 + 6 * d**2 * (u * u * b2 + v * v * a2) / n**2 + 4 * d * (u * b3 - v * a3) / n,
    )


MOMENTS = ("weight", "mean", "second", "third", "fourth")
SUMS = (
    "version int, timer long, is_open boolean, n long, m_ok boolean, e_ok boolean, t_first double, t_last double, low double, high double, squares double, "
    + ", ".join(f"{side}_{x} double" for side in ("plain", "weighted") for x in MOMENTS)
)
NEW = (0, 0, False, 0, True, True, math.inf, -math.inf, -math.inf, math.inf, 0.0, *NONE, *NONE)


def added(state: tuple, rows: pd.DataFrame) -> tuple:
    """The sums of a light curve with more epochs; one that can't be used is counted and leaves a mark."""
    version, timer, is_open, n, m_ok, e_ok, first, last, low, high, squares, *both = state
    t, m, e = (rows[c].to_numpy(float, na_value=np.nan) for c in ("t", "mag", "mag_err"))
    good_m, good_e = np.isfinite(m), np.isfinite(e) & (e > 0)
    use, known = good_m & good_e, t[np.isfinite(t)]
    plain = merged(tuple(both[:5]), moments(m[good_m], np.ones(int(good_m.sum()))))
    weighted = merged(tuple(both[5:]), moments(m[use], 1 / e[use] ** 2))
    return (
        version, timer, is_open, n + len(rows), m_ok and bool(good_m.all()), e_ok and bool(good_e.all()), min(first, known.min(initial=math.inf)), max(last, known.max(initial=-math.inf)),
        max(low, (m - e)[use].max(initial=-math.inf)), min(high, (m + e)[use].min(initial=math.inf)), squares + float((e[use] ** 2).sum()), *plain, *weighted,
    )


def over(a: float, b: float) -> float | None:
    return a / b if b else None


def closed_statistics(state: tuple) -> list[float | None]:
    """STATISTICS from the sums, as ``operators.statistics`` defines them: null for a quotient by zero, and where epochs can't be used."""
    _, _, _, n, m_ok, e_ok, _, _, low, high, squares, *both = state
    (_, _, m2, _, m4), (w, mean, s2, s3, _) = both[:5], both[5:]
    out: list[float | None] = [None] * len(STATISTICS)
    if m_ok and m2:
        out[6] = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (n * m4 / m2**2 - 3) + 6)
    if m_ok and e_ok and w:
        wstd = math.sqrt(s2 / w)
        out[:6] = [mean, s2 / (n - 1), wstd, over(low - high, low + high), over((m2 - squares) / n, mean * mean), over(s3 / w, wstd**3)]
    return out


class Settling(StatefulProcessor):
    """Sums of a light curve, and one timer: it closes the light curve, or, where ``forget`` is given, drops what a closed one left."""

    def __init__(self, quiet: int, forget: int | None) -> None:
        self.quiet, self.forget = quiet, forget

    def init(self, handle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", SUMS)

    def wait(self, state: tuple, until: int, is_open: bool) -> None:
        if state[1]:
            self.handle.deleteTimer(state[1])
        self.handle.registerTimer(until)
        self.sums.update((state[0], until, is_open, *state[3:]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.sums.get()) if self.sums.exists() else NEW
        until = state[1] if state[2] else 0
        for part in rows:
            state = added(state, part)
            until = max(until, int(part["arrived_ms"].max()) + self.quiet)
        self.wait(state, until, True)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, now = tuple(self.sums.get()), expiredTimerInfo.getExpiryTimeInMs()
        if not state[2]:
            self.sums.clear()
            return
        state = (state[0] + 1, 0, False, *state[3:])
        if self.forget is None:
            self.sums.update(state)
        else:
            self.wait(state, now + self.forget, False)
        if state[3] >= LEAST_OBSERVATIONS:
            first, last = (x if math.isfinite(x) else None for x in state[6:8])
            row = [*key, state[0], pd.Timestamp(now, unit="ms"), state[3], first, last, *closed_statistics(state)]
            yield pd.DataFrame([row], columns=[x.split()[0] for x in CLOSED.split(", ")])


def settled(obs: DataFrame, quiet_seconds: float, late_seconds: float, forget_seconds: float | None = None) -> DataFrame:
    """A row (CLOSED) each time that a light curve of the stream has had no epoch for ``quiet_seconds`` of the clock of ``arrived``.

    ``obs`` has epochs and the timestamp ``arrived``, by which the stream may be up to ``late_seconds`` out of order; what arrives later than
    that, or with no time of arrival, is left out. A light curve whose next epoch comes in the batch that would have closed it stays open, so the
    number of closings depends on how the stream is cut into batches; the last one doesn't. Times of epochs may come in any order. Light curves of fewer than four epochs close
    without a row. With ``forget_seconds`` a light curve that stays closed so long is forgotten, and starts anew at version 1.
    """
    rows = obs.where(F.col("arrived").isNotNull()).select(*KEY, "t", "mag", "mag_err", F.unix_millis("arrived").alias("arrived_ms"), "arrived")
    rows = rows.withWatermark("arrived", f"{round(late_seconds * 1000)} milliseconds")
    made = Settling(round(quiet_seconds * 1000), None if forget_seconds is None else round(forget_seconds * 1000))
    return rows.groupBy(*KEY).transformWithStateInPandas(made, CLOSED, "append", "EventTime")


@contextmanager
def timers(spark: SparkSession):
    """Streams that start inside keep their state where timers can be kept."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, STORE)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def drained_settled(obs: DataFrame, folder: str, quiet_seconds: float, late_seconds: float, forget_seconds: float | None = None) -> DataFrame:
    """All closings so far after what is there now, kept in ``folder``; the next call goes on with its state and timers."""
    with timers(obs.sparkSession):
        return drained(settled(obs, quiet_seconds, late_seconds, forget_seconds), folder)


def last_closed(rows: DataFrame) -> DataFrame:
    """Of each light curve its last closing."""
    names = [c for c in rows.columns if c not in KEY]
    return rows.groupBy(*KEY).agg(F.max_by(F.struct(*names), "closed").alias("last")).select(*KEY, "last.*")
