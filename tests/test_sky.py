"""Tables by sky cell: covers hold their cones, cones prune, bucketed tables join without a shuffle."""

import math
import random
import uuid
import warnings

import pytest
from pyspark.sql import functions as F

from lyraflux.plans import views
from lyraflux.sources import sky, survey

SF = "/root/testdata/sf0.001"


def apart(a, b):
    h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * math.degrees(math.asin(math.sqrt(min(1, h)))) * 3600


def points():
    rng = random.Random(5)
    out = [(rng.uniform(-10, 370), math.degrees(math.asin(rng.uniform(-1, 1)))) for _ in range(1500)]
    edges = [0.0, 360.0, 180.0, 90.0, 359.9999999, 1e-9]
    return out + [(ra, dec) for ra in edges for dec in (-90.0, 90.0, 0.0, 89.99999, -89.99999, 30.0)] + [(rng.uniform(0, 360), s * (90 - rng.uniform(0, 0.01))) for s in (1, -1) for _ in range(100)]


def test_covers_hold_their_cones(spark):
    rows = sky.with_cells(spark.createDataFrame([(i, *p) for i, p in enumerate(points())], "i int, ra double, dec double")).collect()
    assert all(r["sky_cell"] == r["sky_fine"] >> 2 * (sky.FINE_LEVEL - sky.CELL_LEVEL) and 0 <= r["sky_fine"] < 2 << 2 * sky.FINE_LEVEL for r in rows)
    rng = random.Random(7)
    centres = rng.sample(points(), 60) + points()[1500:1536]
    for ra, dec in centres:
        for radius in (0.0, 2.0, 3600.0, 90000.0, 400000.0):
            ranges = sky.cover(ra, dec, radius)
            assert len(ranges) <= sky.MOST_RANGES * 4 and ranges == sorted(ranges)
            for r in rows:
                if apart((ra, dec), (r["ra"], r["dec"])) <= radius:
                    assert any(a <= r["sky_fine"] <= b for a, b in ranges), (ra, dec, radius, r)


def test_small_cones_are_covered_by_little():
    share = sum(b - a + 1 for a, b in sky.cover(120.0, 40.0, 60.0)) / (2 << 2 * sky.FINE_LEVEL)
    assert share < 1e-6
    assert sum(b - a + 1 for a, b in sky.cover(10.0, 0.0, 180 * 3600.0)) == 2 << 2 * sky.FINE_LEVEL


@pytest.mark.parametrize("where", [(10.0, -59.5, 36000.0), (0.2, 3.0, 30000.0), (80.0, 88.0, 150000.0), (137.5, 1.8, 0.0)])
def test_cone_of_a_laid_table(spark, tmp_path, where):
    sources = views.sky_sources(spark, SF)
    odd = spark.createDataFrame([("n", None, 1.0, 99), ("m", 3.0, None, 99), ("x", float("nan"), 2.0, 99)], sources.schema)
    both = sources.unionByName(odd)
    sky.write(both, str(tmp_path))
    laid = sky.read(spark, str(tmp_path))
    assert laid.count() == both.count()
    ids = lambda df: sorted(r["source_id"] for r in survey.in_cone(df, *where).collect())
    assert ids(laid) == ids(both)
    plan = survey.in_cone(laid, *where)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sky_cell" in plan or "PartitionFilters: [sky_cell" in plan
    assert "sky_fine" in plan.split("PushedFilters")[1].split("ReadSchema")[0]


def test_a_cone_reads_few_files(spark, tmp_path):
    sky.write(views.sky_sources(spark, SF), str(tmp_path))
    laid = sky.read(spark, str(tmp_path))
    cone = survey.in_cone(laid, 137.50776405, 1.8, 600.0)
    assert cone.count() == 1
    scan = [n for n in cone._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in n]
    assert scan
    cells = {c for a, b in sky.cover(137.50776405, 1.8, 600.0) for c in range(a >> 18, (b >> 18) + 1)}
    assert len(cells) <= 2 < laid.select("sky_cell").distinct().count()


def test_region_warns_at_the_limit_and_counts_once(spark):
    sources = views.sky_sources(spark, SF)
    ids, cut = survey.near_ids(sources, 100.0, 10.0, 90000.0, limit=3)
    assert cut and ids.count() == 3
    ids, cut = survey.near_ids(sources, 100.0, 10.0, 90000.0)
    assert not cut and ids.count() == sources.where(survey.separation_arcsec(F.col("ra"), F.col("dec"), F.lit(100.0), F.lit(10.0)) <= 90000).where("nobs >= 50").count()
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        survey.by_region(views.survey_documents(spark, SF), 30.0, 12.0, 36000.0)


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    own, cat = views.sky_sources(spark, SF), views.sky_catalog(spark, SF).select("gid", "ra", "dec")
    name = f"t_{uuid.uuid4().hex}"
    left = survey.stored_for_join(own, f"{name}_a", f"{tmp_path}/a", 2.0, 4)
    right = survey.stored_for_join(cat, f"{name}_b", f"{tmp_path}/b", 2.0, 4, around=True)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = survey.paired(left, right, 2.0).select("source_id", "gid")
        assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
        assert sorted(pairs.collect()) == sorted(survey.within_radius(own, cat, 2.0).select("source_id", "gid").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"drop table {name}_a")
        spark.sql(f"drop table {name}_b")
