"""The data source of observations: pushed filters, slices of ids, and rows equal to those of the table."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, StringContains

from lyraflux.plans import views
from lyraflux.sources import connector

FETCHER, PATH = "lyraflux.sources.connector:TableFetcher", "/root/testdata/sf0.001/events.parquet"


@pytest.fixture
def obs(spark):
    return connector.observations(spark, FETCHER, path=PATH, slice="4")


def rows(df):
    return sorted(map(repr, df.select(*[F.round(c, 9).alias(c) if c in ("t", "mag", "mag_err") else c for c in df.columns]).collect()))


@pytest.mark.parametrize("where", [
    "true", "source_id in ('3', '5', '5', '999', 'x', '03')", "source_id = '7' and t > 2460320.5", "t >= 2460315 and t < 2460316.25 and t > 2460314", "band = 'g'", "band in ('r', 'g') and source_id like '1%'",
    "source_id in ('1', '2') and source_id = '2' and mag > 15", "source_id is null", "source_id = '1' or source_id = '2'",
])
def test_rows_are_those_of_the_table(spark, obs, where):
    assert rows(obs.where(where)) == rows(views.lc_events(spark, "/root/testdata/sf0.001").where(where))


def test_filters_reach_the_fetcher():
    reader = connector.ObservationReader({"fetcher": FETCHER, "path": PATH, "slice": "2"})
    left = list(reader.pushFilters([In(("source_id",), ("5", "1", "1", None, "9")), StringContains(("source_id",), "1"), GreaterThan(("t",), 3.0), GreaterThanOrEqual(("t",), 3.0), LessThan(("t",), 9.0), EqualTo(("band",), "r"), EqualTo(("mag",), 1.0)]))
    assert [type(f).__name__ for f in left] == ["StringContains", "EqualTo"]
    w = reader.wanted
    assert (w.ids, w.bands, w.after, w.before) == (["1", "5", "9"], ["r"], (3.0, False), (9.0, False))
    assert [p.ids for p in reader.partitions()] == [["1", "5"], ["9"]]
    assert list(reader.pushFilters([EqualTo(("source_id",), "2")])) == [] and reader.partitions() == []


def test_one_task_a_slice(spark, obs):
    wanted = obs.where(F.col("source_id").isin([str(i) for i in range(10)]))
    assert wanted.rdd.getNumPartitions() == 3
