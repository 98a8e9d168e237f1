"""Features kept up to date: any order of files, late epochs, a batch that is tried again, predictions."""

import random

import numpy as np
from pyspark.sql import functions as F

from lyraflux.operators import models, statistics
from lyraflux.plans import views
from lyraflux.streaming import light_curves as streams

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect())


def test_any_order_of_files_gives_the_batch_features(spark, tmp_path):
    obs = views.lc_events(spark, SF).where(F.col("source_id").cast("int") < 12)
    want, all_ = rows(statistics.statistics(obs)), obs.collect()
    parts = [all_[i::4] for i in range(4)]
    random.Random(2).shuffle(parts)
    into, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n, part in enumerate(parts):  # two files before the first call, then one each
        spark.createDataFrame(part, obs.schema).coalesce(1).write.mode("append").parquet(into)
        if n:
            got = streams.keep_features(streams.files(spark, into, obs.schema, files_a_batch=1), out, statistics.statistics, 4)
    assert rows(got) == want
    # nothing new: nothing changes
    assert rows(streams.keep_features(streams.files(spark, into, obs.schema, files_a_batch=1), out, statistics.statistics, 4)) == want


def test_only_touched_light_curves_are_made_again_and_a_failed_batch_is_tried_again(spark, tmp_path):
    into, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame([], streams.EPOCH).schema
    add = lambda *r: spark.createDataFrame(list(r), schema).coalesce(1).write.mode("append").parquet(into)
    made, fail = [], [False]

    def build(obs):
        got = obs.groupBy("source_id", "band").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("last"))
        made.append(got.select("source_id").toPandas()["source_id"].tolist())
        if fail[0]:
            fail[0] = False
            raise RuntimeError("lost")
        return got

    run = lambda: {r["source_id"]: (r["n"], r["last"]) for r in streams.keep_features(streams.files(spark, into, schema), out, build, 4).collect()}
    add(("a", "r", 5.0, 1.0, 0.1, 1), ("b", "r", 1.0, 1.0, 0.1, 1), (None, "r", 1.0, 1.0, 0.1, 1))
    assert run() == {"a": (1, 5.0), "b": (1, 1.0)}
    add(("a", "r", 2.0, 1.0, 0.1, 2))  # late
    fail[0] = True
    try:
        run()
        raise AssertionError("the failure was lost")
    except Exception as why:
        assert "lost" in str(why) and "the failure was lost" not in str(why)
    assert run() == {"a": (2, 5.0), "b": (1, 1.0)}
    assert made[-1] == ["a"]


def test_predictions_are_kept(spark, tmp_path):
    obs = views.lc_events(spark, SF).where(F.col("source_id").cast("int") < 5)
    model = models.linear_model(spark, np.array([0.3]), -4.5)
    x = lambda o: o.groupBy("source_id", "band").agg(F.array(F.avg("mag")).alias("x"))
    predict = lambda o: models.predict(model, x(o)).drop("x")
    obs.repartition(2).write.parquet(str(tmp_path / "in"))
    got = streams.keep_features(streams.files(spark, str(tmp_path / "in"), obs.schema, files_a_batch=1), str(tmp_path / "out"), predict, 4)
    want = {r["source_id"]: 1 / (1 + np.exp(4.5 - 0.3 * r["x"][0])) for r in x(obs).collect()}
    found = {r["source_id"]: r["probability"] for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-6 for k in want)
