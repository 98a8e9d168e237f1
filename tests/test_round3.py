import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

import __spark_entry__
from lyraflux.config import HistogramConfig
from lyraflux.functions import kernels
from lyraflux.llm import negatives
from lyraflux.operators import histogram, models
from lyraflux.sources import survey

duckdb = pytest.importorskip("duckdb")


def against_sql(spark, folder, name, **tables):
    """Rows of a query and of its SQL over small tables (rows of dicts), in one order."""
    with duckdb.connect() as db:
        for table, rows in tables.items():
            spark.createDataFrame(rows).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
            db.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
        found = db.sql(__spark_entry__.oracle_sql()[name])
        made = __spark_entry__.queries()[name](spark, str(folder)).select(*found.columns)
        return sorted(map(tuple, made.collect()), key=str), sorted(found.fetchall(), key=str)


def event(event_id, user, minutes, k, value=10.0, kind="view"):
    return {"event_id": event_id, "user_id": user, "ts": datetime(2024, 1, 1) + timedelta(minutes=minutes), "event_type": kind, "value": value, "props": json.dumps({"k": k})}


@pytest.mark.parametrize("name", ["ingest_documents", "ingest_with_cadence", "ingest_time_cutoff", "ingest_epoch_cutoff", "variant_responses"])
def test_documents_without_an_allowed_programme_are_left_out_by_query_and_sql(spark, tmp_path, name):
    # user 2's epochs have no programme (k % 5 == 0) and pass the flags only by k = 5; user 3 has epochs at one time
    rows = [event(0, 2, 0, 5), event(1, 2, 900, 15), event(2, 3, 0, 12, 30.0), event(3, 3, 0, 12, 20.0), event(4, 3, 800, 5)]
    made, wanted = against_sql(spark, tmp_path, name, events=rows)
    assert made == wanted
    assert {r[0] for r in made} == {"17"}
    assert made[0][2] == 2 and made[0][3] == pytest.approx(30.3)


def test_links_of_equal_positions_are_counted_for_every_row(spark, tmp_path):
    rows = [{"c_custkey": k} for k in range(1500)]
    made, wanted = against_sql(spark, tmp_path, "sky_links", customer=rows)
    assert made == wanted and len(made) == 1500
    # as many as there are pairs of rows on sf0.01, which has these keys
    assert sum(r[2] for r in made) == 28047
    one = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 2.0), ("c", 50.0, 2.0), ("d", None, 2.0)], "source_id string, ra double, dec double")
    other = spark.createDataFrame([(5, 1.0, 2.0), (4, 1.0, 2.0), (9, 1.0, 2.0001)], "gid long, ra double, dec double")
    found = {r["source_id"]: tuple(r)[1:] for r in survey.linked(one, other, 2.0).collect()}
    assert found == {"a": ("a", 3, 2, 4, 0.0, 0.36), "b": ("a", 3, 2, 4, 0.0, 0.36), "c": ("c", 0, 0, None, None, None), "d": ("d", 0, 0, None, None, None)}


def test_block_pairs_send_only_cells_with_a_pair(spark):
    rng = np.random.default_rng(3)
    rows = [(str(s), "r", float(t), float(m), 0.1, k) for s in range(300) for k, (t, m) in enumerate(zip(np.sort(rng.random(30) * 20), 15 + rng.random(30), strict=True))]
    rows += [("none", "r", 1.0, 15.0, 0.1, k) for k in range(4)]
    obs = spark.createDataFrame(rows, "source_id string, band string, t double, mag double, mag_err double, ord int").repartition(1)
    blocks, whole = (histogram.dmdt(obs, long_epochs=n, block_epochs=10) for n in (2, 1000))
    made, wanted = ({r["source_id"]: (r["counts"], r["dmdt"]) for r in df.collect()} for df in (blocks, whole))
    assert made == wanted and len(made) == 301
    assert not any(made["none"][0]) and len(made["none"][0]) == len(made["0"][0])
    # block pairs leave their task as cells with a pair, not as whole histograms
    plan = histogram.long_counts(obs, histogram.float_edges(HistogramConfig()), 10)._jdf.queryExecution().analyzed().toString()
    assert "cell#" in plan and "explode" not in plan.split("MapInArrow")[1]


def test_folds_of_a_light_curve_share_their_arrays_and_waves_their_powers():
    rng = np.random.default_rng(5)
    t, m, e, f = np.sort(rng.random(66)) * 30, rng.random(66), 0.02 + rng.random(66), np.linspace(1, 9, 400)
    room = kernels.Room(t, 150)
    for k in range(0, 400, 150):
        own, shared = kernels.Fold(t, f[k : k + 150], 20), kernels.Fold(t, f[k : k + 150], 20, room)
        assert shared.place.base is room.place
        for method in (kernels.analysis_of_variance, kernels.conditional_entropy, kernels.folded_power):
            assert method(t, m, e, own).tolist() == method(t, m, e, shared).tolist()
    phase = t * f[7] - np.floor(t * f[7])
    assert kernels.Fold(t, f[7:8], 20).sums(m, "m")[0] == pytest.approx(np.bincount((phase * 20).astype(int), m, 20))
    waves = kernels.Waves(t, f)
    assert waves.power(6) is waves.power(6)
    for k in range(1, 8):
        assert waves.sums(m, k) == pytest.approx(np.exp(2j * np.pi * k * np.multiply.outer(f, t)) @ m, abs=1e-9)


@pytest.mark.parametrize("same", [True, False])
def test_queries_that_go_through_a_tree_together_find_what_each_finds_alone(same):
    rng = np.random.default_rng(8)
    points = rng.integers(-80, 80, (700, 8)).astype(float)
    points[:60] = points[60:120]
    norms, labels, keys = (points**2).sum(axis=1), rng.integers(0, 3, 700), np.arange(700)
    ids = [sorted(rng.integers(0, 2000, 1 + i % 3).tolist()) for i in range(700)]
    tree = negatives.Tree(points, norms, labels, ids, keys, float(norms.max()))
    assert len(tree.nodes) > 10
    owner = np.repeat(np.arange(90), 2)
    caps = rng.integers(2000, 12000, 180).astype(float)
    lows, highs = np.ceil(caps * 0.5), np.floor(caps * 0.95)
    lows[::5], highs[::5] = -np.inf, np.inf
    made = negatives.Batch(tree, points[:90], norms[:90], labels[:90], owner, lows, highs).nearest(4, same)
    for w, i in enumerate(owner):
        window = (None, None) if w % 5 == 0 else (int(lows[w]), int(highs[w]))
        assert made[w] == tree.query(points[i], norms[i]).nearest(4, int(labels[i]), same, *window)
    assert sum(map(len, made)) > 200


def test_a_fitted_model_predicts_in_tasks_after_an_observation(spark, tmp_path):
    rows = spark.range(200).select(F.array((F.col("id") % 7).cast("float"), (F.col("id") % 11).cast("float")).alias("x"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    watch = Observation()
    assert rows.observe(watch, F.count(F.lit(1)).alias("n")).count() == 200 and watch.get == {"n": 200}
    model = models.fit(rows)
    models.predict(model, rows).write.parquet(f"{tmp_path}/scored")
    weights, intercept = np.array(model.stages[-1].coefficients), model.stages[-1].intercept
    assert weights.any()
    for r in spark.read.parquet(f"{tmp_path}/scored").collect():
        assert r["probability"] == pytest.approx(1 / (1 + np.exp(-(np.array(r["x"]) @ weights + intercept))), abs=1e-6)
