"""Light curves that close by a timer: equal to the batch after any order, opened again by late epochs, forgotten."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lyraflux.operators import statistics
from lyraflux.plans import views
from lyraflux.streaming import light_curves as streams
from lyraflux.streaming import settled

SF = "/root/testdata/sf0.001"
SCHEMA = streams.EPOCH + ", arrived timestamp"
START = datetime(2024, 1, 1)


@pytest.mark.parametrize("cut", [0, 1, 7, 40])
def test_moments_merge(cut):
    rng = np.random.default_rng(cut)
    x, w = rng.normal(15, 2, 40), rng.uniform(0.1, 3, 40)
    got = settled.merged(settled.moments(x[:cut], w[:cut]), settled.moments(x[cut:], w[cut:]))
    assert np.allclose(got, settled.moments(x, w), rtol=1e-12)


def written(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, out, **more):
    schema = spark.createDataFrame([], SCHEMA).schema
    return settled.drained_settled(streams.files(spark, folder, schema, files_a_batch=1), out, 600, 60, **more)


def epoch(source, t, arrived, mag=15.0, err=0.1):
    return (source, "r", float(t), mag + 0.1 * (t % 3), err, int(t), START + timedelta(seconds=arrived))


def test_any_order_of_arrival_gives_the_batch_statistics(spark, tmp_path):
    obs = views.lc_awkward(spark, SF)
    all_ = obs.collect()
    random.Random(4).shuffle(all_)
    into, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(3):  # far apart, so that all light curves close between files and are opened again
        written(spark, into, [(*r, START + timedelta(seconds=5000 * n + i % 50)) for i, r in enumerate(all_[n::3])])
        run(spark, into, out)
        written(spark, into, [epoch("clock", 1, 5000 * n + 3000)])
        rows = run(spark, into, out)
    got = {(r["source_id"], r["band"]): r for r in settled.last_closed(rows).collect()}
    want = {(r["source_id"], r["band"]): r for r in statistics.statistics(obs).collect()}
    assert got.keys() == want.keys() and rows.agg(F.max("version")).head()[0] == 3
    for key, r in want.items():
        for f in ("n_obs", *settled.STATISTICS):
            assert got[key][f] == (r[f] if r[f] is None else pytest.approx(r[f], rel=1e-9, abs=1e-9)), (key, f)


def test_late_epochs_open_a_light_curve_again(spark, tmp_path):
    into, out = str(tmp_path / "in"), str(tmp_path / "out")
    written(spark, into, [epoch("a", t, t) for t in range(10, 16)] + [epoch("few", t, 0) for t in range(3)] + [epoch("b", t, 900 + t) for t in range(5)])
    assert {(r["source_id"], r["version"], r["n_obs"]) for r in run(spark, into, out).collect()} == {("a", 1, 6)}
    # an epoch before all others, and one more for a light curve that is still open
    written(spark, into, [epoch("a", 1, 1000), epoch("b", 9, 1100), epoch("few", 9, 1100)])
    written(spark, into, [epoch("clock", 1, 9000)])
    rows = {(r["source_id"], r["version"]): r for r in run(spark, into, out).collect()}
    assert {k: r["n_obs"] for k, r in rows.items()} == {("a", 1): 6, ("a", 2): 7, ("b", 1): 6, ("few", 2): 4}
    assert rows["a", 2]["t_first"] == 1.0 and rows["a", 2]["t_last"] == 15.0
    assert rows["a", 2]["closed"] == START + timedelta(seconds=1600)
    assert spark.conf.get(settled.PROVIDER) != settled.STORE


def test_forgotten_light_curves_start_anew(spark, tmp_path):
    into, out = str(tmp_path / "in"), str(tmp_path / "out")
    for base in (0, 20000):
        written(spark, into, [epoch("a", t, base + t) for t in range(5)])
        written(spark, into, [epoch("clock", 1, base + 2000)])
        written(spark, into, [epoch("clock", 1, base + 9000)])
        rows = run(spark, into, out, forget_seconds=3000)
    assert [(r["version"], r["n_obs"]) for r in rows.where("source_id = 'a'").orderBy("closed").collect()] == [(1, 5), (1, 5)]


def test_an_empty_stream_closes_nothing(spark, tmp_path):
    written(spark, str(tmp_path / "in"), [])
    assert run(spark, str(tmp_path / "in"), str(tmp_path / "out")).count() == 0
