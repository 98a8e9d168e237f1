"""Sources, streams and storage on small tables; queries without SQL against plain loops."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from lyraflux.config import Config, IngestConfig, PeriodConfig
from lyraflux.functions import kernels
from lyraflux.operators import features, histogram, lightcurves, models, periods, statistics
from lyraflux.plans import catalog, views
from lyraflux.sources import simulation, storage, survey
from lyraflux.streaming import light_curves as streams

SF = "/root/testdata/sf0.001"
DOCUMENT = "_id long, filter int, ra double, dec double, data array<struct<hjd:double,mag:double,magerr:double,catflags:int,programid:int>>"


def document(i, ra=10.0, dec=0.0, epochs=((1.0, 1),)):
    return (i, 2, ra, dec, [(t, 15.0, 0.1, 0, p) for t, p in epochs])


def test_ids_that_are_no_numbers_find_nothing(spark):
    docs = spark.createDataFrame([document(1), document(2)], DOCUMENT)
    ids = spark.createDataFrame([("1",), ("x",), (None,), ("7",), ("1",)], "source_id string")
    assert [r["source_id"] for r in survey.by_ids(docs, ids).collect()] == ["1"]


def test_region_and_position(spark):
    far = [(float(t), 1) for t in range(1, 6)]
    docs = spark.createDataFrame([document(1, epochs=far), document(2, dec=0.0004, epochs=[(9.0, None)]), document(3, dec=5.0, epochs=far)], DOCUMENT)
    ids, obs = survey.by_region(docs, 10.0, 0.0, 3.0, IngestConfig(min_nobs=3))
    assert [r["source_id"] for r in ids.collect()] == ["1"] and obs.count() == 5
    # a cone has no filters of whole documents: the lone epoch without a programme is found, beyond the time limit too
    assert {r["source_id"] for r in survey.by_position(docs, 10.0, 0.0, config=IngestConfig(max_time=2.0)).collect()} == {"1", "2"}
    assert survey.by_region(docs, 200.0, 80.0, 3.0)[1].count() == 0


def test_epochs_too_near_the_last_kept_one_go(spark):
    minutes = [9.0, 0.0, 3.0, 6.0, 12.0, 15.0]
    epochs = [(t / 1440, 1) for t in minutes]
    docs = spark.createDataFrame([document(1, epochs=epochs), (2, 2, 10.0, 0.0, None), document(3, epochs=())], DOCUMENT)
    ids = spark.createDataFrame([("1",)], "source_id string")
    at = lambda obs: sorted((round(r["t"] * 1440), r["ord"], r["ra"], r["survey"]) for r in obs.collect())
    kept = [(0, 1, 10.0, "ztf"), (6, 3, 10.0, "ztf"), (12, 4, 10.0, "ztf")]
    assert at(survey.light_curves(docs)) == at(survey.by_ids(docs, ids)) == at(survey.by_position(docs, 10.0, 0.0)) == kept
    assert at(survey.by_region(docs, 10.0, 0.0, 3.0, IngestConfig(min_nobs=3))[1]) == kept
    assert len(at(survey.light_curves(docs, IngestConfig(min_cadence_days=0.0)))) == 6


def test_cone_responses_without_a_center_are_empty(spark):
    rows = [("success", {"a": {"center": [(1,)]}, "b": {"center": None}}), ("success", {"a": {}}), ("success", None), ("error", None), (None, None)]
    good, bad = survey.unwrap_cones(spark.createDataFrame([(s, "no", d) for s, d in rows], "status string, message string, data map<string,map<string,array<struct<i:int>>>>"))
    assert [r["i"] for r in good.collect()] == [1] and bad.count() == 2


def test_simulated_periods_are_found_and_do_not_depend_on_partitions(spark):
    sources = spark.range(12).select(F.col("id").cast("string").alias("source_id"), F.lit(1.0).alias("ra"), F.lit(2.0).alias("dec"))
    c = simulation.SimulationConfig(epochs=150, span=40.0, min_period=1.2, max_period=3.0, eclipsing_share=0.0)
    obs = simulation.simulated(sources, c)
    assert obs.exceptAll(simulation.simulated(sources.repartition(5), c)).count() == 0 and obs.count() == 12 * 150
    top = periods.search(obs, PeriodConfig(algorithms=("LS",), min_period=1.0, max_period=5.0, top_n=1)).join(obs.select("source_id", "true_period").distinct(), "source_id")
    assert top.where(F.abs(F.col("period") / F.col("true_period") - 1) < 0.02).count() == 12
    eclipses = simulation.simulated(sources, simulation.SimulationConfig(eclipsing_share=1.0, noise=0.0))
    assert eclipses.where("kind = 'eclipse'").agg(F.countDistinct(F.round("mag", 6), "source_id")).first()[0] <= 24


def test_streamed_cadence_goes_on_where_it_stopped(spark, tmp_path):
    rows = [("s", "r", t, 15.0, 0.1, i) for i, t in enumerate([0.0, 0.1, 1.0, 1.05, 2.0, 2.4, 2.6])] + [("u", "r", None, 15.0, 0.1, 0)]
    all_ = spark.createDataFrame(rows, streams.EPOCH)
    into = str(tmp_path / "in")
    run = lambda: streams.drained(streams.cadence_filtered(streams.files(spark, into, all_.schema), 0.5), str(tmp_path / "out"))
    all_.where("ord < 4 or t is null").coalesce(1).write.mode("append").parquet(into)
    assert sorted(r["t"] for r in run().collect()) == [0, 1]
    all_.where("ord >= 4").coalesce(1).write.mode("append").parquet(into)
    batch = lightcurves.cadence_filtered(all_.where("t is not null"), 0.5)
    assert sorted(r["t"] for r in run().collect()) == sorted(r["t"] for r in batch.collect()) == [0, 1, 2, 2.6]


def test_cache_is_kept_by_settings(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    for settings in ({"a": 1, "b": 2}, {"b": 2, "a": 1}, {"a": 2}):
        assert storage.cached(spark, build, str(tmp_path), settings).count() == 3
    assert len(made) == 2


def test_latest_model(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        models.latest(str(tmp_path))
    with pytest.raises(FileNotFoundError):
        models.load(str(tmp_path / "none"))
    rows = spark.createDataFrame([([float(i)], int(i > 4 or i == 2)) for i in range(10)], "x array<float>, label int")
    for name in ("b", "a"):
        models.save(models.fit(rows), str(tmp_path / name), {"name": name})
    # files carry milliseconds, so the second save is later
    assert models.load(models.latest(str(tmp_path)))[1] == {"name": "a"}


def test_extra_extractors_add_and_replace_columns(spark):
    obs = views.lc_events(spark, SF)
    brightest = lambda rows: rows.where("source_id <> '3'").groupBy("source_id", "band").agg(F.min("mag").alias("brightest"), F.lit(-1.0).alias("median"))
    c = Config(period=PeriodConfig(algorithms=("LS",), min_period=1.0, max_period=5.0, samples_per_peak=2, top_n=2), min_observations=5)
    made = features.build_features(obs, c, with_dmdt=False, extra=(brightest,))
    assert made.count() == obs.select("source_id").distinct().count() and made.columns.count("median") == 1
    assert made.where("source_id <> '3' and n_obs >= 5 and (median <> -1 or isnan(brightest))").count() == 0


def curves(spark):
    rows = views.lc_events(spark, SF).orderBy("t", "ord").collect()
    out = {}
    for r in rows:
        out.setdefault(r["source_id"], []).append((r["t"], r["mag"], r["mag_err"]))
    return {s: tuple(np.array(v) for v in zip(*x, strict=True)) for s, x in out.items() if len(x) >= 4}


def test_multi_harmonic_equals_normal_equations(spark):
    found = {(r["source_id"], r["k"]): r["value"] for r in catalog.queries()["mhf_periodogram"](spark, SF).collect()}
    for source, (t, m, e) in curves(spark).items():
        t, m, w = t - t.min(), (m - m.min()) / (m.max() - m.min()), 1 / (e * e)
        chi0 = (w * (m - (w @ m) / w.sum()) ** 2).sum()
        for k, f in enumerate(catalog.FREQUENCIES):
            fits = []
            for h in (1, 2, 3):
                x = np.stack([np.ones_like(t), *(g(2 * math.pi * j * f * t) for j in range(1, h + 1) for g in (np.sin, np.cos))], axis=1)
                if x.shape[1] < len(t):
                    beta = np.linalg.solve(x.T @ (w[:, None] * x), x.T @ (w * m))
                    chi = (w * (m - x @ beta) ** 2).sum()
                    fits.append((chi + x.shape[1] * math.log(len(t)), (chi0 - chi) / chi0))
            assert abs(min(fits)[1] - found[source, k]) < 1e-5


def test_fourier_shape_equals_its_own_model(spark):
    shape = {r["source_id"]: r for r in catalog.queries()["fourier_shape"](spark, SF).collect()}
    for source, (t, m, e) in curves(spark).items():
        r, t, w = shape[source], t - t.min(), 1 / (e * e)
        x = np.stack([np.ones_like(t), t], axis=1)
        beta = np.linalg.solve(x.T @ (w[:, None] * x), x.T @ (w * m))
        chi0 = (w * (m - x @ beta) ** 2).sum()
        model = r["f1_offset"] + r["f1_slope"] * t
        for h in range(1, 6):
            amp = r["f1_amp"] * (1.0 if h == 1 else r[f"f1_relamp{h - 1}"])
            if amp > 0 and not math.isnan(amp):
                phase = h * (r["f1_phi0"] + (0.0 if h == 1 else 2 * math.pi / h * r[f"f1_relphi{h - 1}"]))
                model = model + amp * np.cos(2 * math.pi * h * t / 3.7 - (math.pi / 2 - phase))
        chi = (w * (m - model) ** 2).sum()
        assert abs((chi0 - chi) / chi0 - r["f1_power"]) < 1e-3


def test_anderson_darling_equals_its_sum(spark):
    found = {(r["source_id"], r["band"]): r["anderson_darling"] for r in catalog.queries()["normality"](spark, SF).collect()}
    rows = {}
    for r in views.lc_lineitem(spark, SF).collect():
        rows.setdefault((r["source_id"], r["band"]), []).append(r["mag"])
    for key, m in rows.items():
        if len(m) >= 4:
            z, n = (np.sort(m) - np.mean(m)) / np.std(m, ddof=1), len(m)
            p = [NormalDist().cdf(v) for v in z]
            a2 = -n - sum((2 * i + 1) * (math.log(p[i]) + math.log(1 - p[n - 1 - i])) for i in range(n)) / n
            assert abs(a2 - found[key]) < 1e-4


def test_registered_search_is_the_whole_one(spark, tmp_path):
    # one source of a period of 50 minutes, two days long
    rng = np.random.default_rng(4)
    at = np.sort(rng.choice(2 * 86400, 40, replace=False))
    rows = [(i, 7, int(s), float(100 + 50 * math.sin(2 * math.pi * s / 3000))) for i, s in enumerate(at)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s long, value double").withColumn("ts", F.timestamp_seconds("s"))
    df.write.parquet(f"{tmp_path}/events.parquet")
    found = {(r["algo"], r["rank"]): (r["period"], r["significance"]) for r in catalog.queries()["period_search"](spark, str(tmp_path)).collect()}
    assert {a for a, _ in found} == {"CE", "AOV", "LS", "MHF", "FPW"} and len(found) == 50
    t = np.array([r["t"] for r in views.lc_events(spark, str(tmp_path)).orderBy("t").collect()])
    m, e, t, span = np.array([15 + r[3] / 100 for r in rows]), np.array([0.02 + r[0] % 7 * 0.01 for r in rows]), t - t[0], t[-1] - t[0]
    f = np.arange(max(2 / span, 0.1), 1 / 0.003472, 1 / (10 * span))[::-1]  # periods ascend
    for name in ("CE", "AOV", "LS", "MHF", "FPW"):
        v = kernels.periodogram(name, t, m, e, f)
        z, size = (v - v.mean()) / v.std() * (-1 if name == "CE" else 1), len(f) // 30
        best = sorted((z[k * size : (k + 1) * size if k < 30 else None].max() for k in range(31)), reverse=True)[:10]
        assert np.allclose(best, [found[name, r][1] for r in range(10)], atol=1e-5)
    assert abs(found["LS", 0][0] - 3000 / 86400) < 1e-4


def test_searched_peaks_equal_a_plain_loop(spark):
    c = PeriodConfig(algorithms=("AOV", "BLS"), min_period=0.8, max_period=6.0, samples_per_peak=4, top_n=3)
    mine = curves(spark)
    span = max(t.max() - t.min() for t, _, _ in mine.values())
    f = kernels.frequency_grid(span, c.min_period, c.max_period, c.samples_per_peak)
    found = {(r["source_id"], r["algo"], r["rank"]): r["significance"] for r in periods.search(views.lc_events(spark, SF), c).collect()}
    for source, (t, m, e) in mine.items():
        for name in c.algorithms:
            v = kernels.periodogram(name, t - t.min(), m, e, f)
            z, size = (v - v.mean()) / v.std(), len(f) // 9
            best = sorted((z[k * size : (k + 1) * size if k < 8 else None].max() for k in range(9)), reverse=True)[:3]
            assert np.allclose(best, [found[source, name, r] for r in range(3)])


def test_positions_meet_across_zero_and_at_the_poles(spark):
    rng = np.random.default_rng(6)
    ra = np.concatenate([rng.uniform(-0.01, 0.01, 60) % 360, rng.uniform(0, 360, 120), rng.uniform(100, 100.02, 40)])
    dec = np.concatenate([rng.uniform(-0.01, 0.01, 60), 90 - rng.uniform(0, 0.01, 60), -90 + rng.uniform(0, 0.01, 60), rng.uniform(59.99, 60.01, 40)])
    rows = [(str(i), float(a), float(d)) for i, (a, d) in enumerate(zip(ra, dec, strict=True))] + [("x", None, 1.0), ("y", math.nan, 1.0)]
    df = spark.createDataFrame(rows, "source_id string, ra double, dec double")
    found = {(r["source_id"], r["gid"]) for r in survey.within_radius(df, df.withColumnRenamed("source_id", "gid"), 12.0).collect()}
    x = np.stack([np.cos(np.radians(dec)) * np.cos(np.radians(ra)), np.cos(np.radians(dec)) * np.sin(np.radians(ra)), np.sin(np.radians(dec))])
    apart = 2 * np.arcsin(np.linalg.norm(x[:, :, None] - x[:, None, :], axis=0) / 2)
    assert found == {(str(i), str(j)) for i, j in np.argwhere(np.degrees(apart) * 3600 <= 12.0)} and len(found) > 500


def test_a_cut_region_warns(spark):
    docs = spark.createDataFrame([document(i, epochs=[(1.0, 1)]) for i in range(5)], DOCUMENT)
    with pytest.warns(UserWarning, match="probably cut"):
        survey.by_region(docs, 10.0, 0.0, 3.0, IngestConfig(min_nobs=1), limit=3)


def test_nameless_targets_are_numbered(spark, tmp_path):
    (tmp_path / "t.csv").write_text("ra,dec,obj_id\n" + "\n".join(f"{i},0,{'own' if i == 2 else ''}" for i in range(5)))
    assert [r["name"] for r in survey.target_catalogue(spark, str(tmp_path / "t.csv")).orderBy("ra").collect()] == ["src_0", "src_1", "own", "src_3", "src_4"]


def test_failing_extractors_cost_their_own_columns(spark):
    obs = views.lc_events(spark, SF)
    c = Config(period=PeriodConfig(algorithms=("LS",), min_period=1.0, max_period=5.0, samples_per_peak=2, top_n=2), min_observations=5)

    def broken(rows):
        return rows.groupBy("source_id", "band").agg(F.raise_error(F.lit("no")).alias("bad"))

    def twice(rows):
        return rows.select("source_id", "band", F.lit(1).alias("many"))

    made = features.build_features(obs, c, extra=(broken, twice))
    assert made.columns == [*features.FIELDS, *features.HISTOGRAM] and made.where("n_obs >= 5 and period > 0").count() > 0
    short = features.build_features(obs, Config(period=c.period, min_observations=10**6)).first()
    assert short["n_obs"] > 0 and math.isnan(short["period"]) and (short["period_n_total_pairs"], short["period_family_algorithm"], short["period_top"], short["gaia_parallax"]) == (0, "", {}, None)


def test_the_feature_table_holds_what_its_parts_say(spark):
    obs = views.lc_events(spark, SF)
    c = Config(period=PeriodConfig(min_period=0.8, max_period=6.0, samples_per_peak=4, top_n=3), min_observations=5)
    made = {r["source_id"]: r for r in features.build_features(obs, c).where("n_obs >= 5").collect()}
    peaks = periods.search(obs, c.period).cache()
    found = periods.adopted(peaks, lightcurves.KEY).cache()
    for part in (found, periods.fourier(obs, found).drop("f1_offset", "f1_slope"), statistics.normality(obs), statistics.statistics(obs), histogram.dmdt(obs).drop("counts")):
        for r in part.collect():
            own = made[r["source_id"]]
            for k, v in r.asDict().items():
                assert own[k] == v or (isinstance(v, float) and (abs(own[k] - v) < 1e-9 or (math.isnan(v) and math.isnan(own[k])))) or (v is None and math.isnan(own[k])), k


def test_a_finished_run_leaves_its_result_only(spark, tmp_path):
    rows = spark.range(20).withColumn("k", F.col("id") % 7)
    built = []

    def build(df):
        built.append(1)
        return df.groupBy("k").agg(F.sum("id").alias("s"))

    storage.run_in_chunks(rows, ["k"], build, str(tmp_path / "run"), 4)
    done = storage.run_in_chunks(rows, ["k"], build, str(tmp_path / "run"), 4, into=str(tmp_path / "out"))
    assert len(built) == 4 and {r["k"]: r["s"] for r in done.collect()} == {k: sum(range(k, 20, 7)) for k in range(7)}
    assert not (tmp_path / "run").exists()


def test_bands_of_a_source_stay_together(spark):
    from lyraflux.operators import dataset

    rows = spark.range(60).select((F.col("id") % 20).alias("source_id"), F.col("id").alias("band"))
    parts = dataset.split_by(rows, ["source_id"]).groupBy("source_id").agg(F.collect_set("part").alias("p"), F.count(F.lit(1)).alias("n")).collect()
    assert all(len(r["p"]) == 1 and r["n"] == 3 for r in parts) and {p for r in parts for p in r["p"]} == {"test", "validation", "train"}
