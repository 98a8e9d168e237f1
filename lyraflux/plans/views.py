"""Light curves, survey documents and sky positions derived from the test tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def days(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 86400e6 + 2440587.5


def lc_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations (source_id, band, t, mag, mag_err, ord): one band, a source a user."""
    return lc_of_events(table(spark, sf_dir, "events"))


def lc_of_events(events: DataFrame, *more: Column) -> DataFrame:
    return events.select(
        F.col("user_id").cast("string").alias("source_id"), F.lit("r").alias("band"), days(F.col("ts")).alias("t"), (15 + F.col("value") / 100).alias("mag"),
        (0.02 + (F.col("event_id") % 7) * 0.01).alias("mag_err"), F.col("event_id").alias("ord"), *more,
    )


def lc_awkward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lc_events`` with zero, null, NaN and infinite values in single epochs of most sources; those of ids that end in 0, 1 or 2 stay whole."""
    kind, hit = F.pmod(F.col("user_id"), F.lit(10)), F.col("event_id") % 13 == 0
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    mag = F.when(hit & (kind == 4), nan).when(hit & (kind == 5), F.lit(None)).when(hit & (kind == 6), inf)
    err = F.when(hit & (kind == 3), F.lit(0.0)).when(hit & (kind == 7), F.lit(None)).when(hit & (kind == 8), nan).when(hit & (kind == 9), -inf)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("source_id"), F.lit("r").alias("band"), days(F.col("ts")).alias("t"),
        F.when(hit & kind.isin(4, 5, 6), mag).otherwise(15 + F.col("value") / 100).alias("mag"),
        F.when(hit & kind.isin(3, 7, 8, 9), err).otherwise(0.02 + (F.col("event_id") % 7) * 0.01).alias("mag_err"), F.col("event_id").alias("ord"),
    )


def lc_lean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of each user and event type; the error of an epoch of small value is 0, so that it can't be used."""
    return table(spark, sf_dir, "events").select(
        F.concat_ws("-", "user_id", "event_type").alias("source_id"), F.lit("r").alias("band"), days(F.col("ts")).alias("t"), (15 + F.col("value") / 100).alias("mag"),
        F.when(F.col("value") < 60, 0.0).otherwise(0.05).alias("mag_err"), F.col("event_id").alias("ord"),
    )


def lc_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of a source a supplier, in three bands; days repeat."""
    order = Window.partitionBy("l_suppkey", "l_returnflag").orderBy("l_shipdate", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    band = F.when(F.col("l_returnflag") == "A", "g").when(F.col("l_returnflag") == "R", "r").otherwise("i")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("source_id"), band.alias("band"), days(F.col("l_shipdate")).alias("t"), (15 + F.col("l_extendedprice") / 20011).alias("mag"),
        (0.02 + F.col("l_discount") * 0.5).alias("mag_err"), F.row_number().over(order).cast("long").alias("ord"),
    )


def survey_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested survey documents: one a user and event type, epochs in ``data``."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    code = F.when(kind == "click", 1).when(kind == "view", 2).when(kind == "purchase", 3).when(kind == "signup", 4).otherwise(99)
    epoch = F.struct(
        days(F.col("ts")).alias("hjd"), (15 + F.col("value") / 100).alias("mag"), (0.02 + (F.col("event_id") % 7) * 0.01).alias("magerr"),
        F.when(k % 10 == 0, F.lit(None).cast("int")).when(k % 10 == 1, 4).otherwise(0).alias("catflags"),
        F.when(k % 5 == 0, F.lit(None).cast("int")).when(k % 5 == 4, 7).otherwise(k % 5).alias("programid"), F.col("event_id").alias("ord"),
    )
    rows = table(spark, sf_dir, "events").select((F.col("user_id") * 5 + F.pmod(code, F.lit(5))).alias("_id"), code.alias("filter"), epoch.alias("epoch"))
    docs = rows.groupBy("_id", "filter").agg(F.sort_array(F.collect_list("epoch")).alias("data"))
    return docs.select("_id", "filter", ((F.col("_id") * 0.37) % 360).alias("ra"), F.when(F.col("_id") % 11 != 0, (F.col("_id") * 0.11) % 90).alias("dec"), "data")


def sky_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.cast("string").alias("source_id"), ((k * 137.50776405) % 360).alias("ra"), ((k * 61.803398875) % 120 - 60).alias("dec"), (k % 120).cast("int").alias("nobs")
    )


def sky_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows (gid, ra, dec, parallax, parallax_error, g, bp, rp, noise) near a third of the sources."""
    k, base = F.col("c_custkey"), table(spark, sf_dir, "customer").where("c_custkey % 3 = 0")
    ra, dec = (k * 137.50776405) % 360, (k * 61.803398875) % 120 - 60
    one = base.select(
        (k * 2).alias("gid"), ra.alias("ra"), (dec + ((k % 7) - 3) * 0.0002).alias("dec"), (F.col("c_acctbal") / 1000).alias("parallax"), F.lit(0.1).alias("parallax_error"),
        (16 + (k % 30) / 10).alias("g"), F.when(k % 5 != 0, 17 + (k % 100) / 100).alias("bp"), (16.5 + (k % 50) / 100).alias("rp"), F.lit(0.5).alias("noise"),
    )
    two = base.where("c_custkey % 6 = 0").select(
        (k * 2 + 1).alias("gid"), ra.alias("ra"), (dec + 0.0003).alias("dec"), (F.col("c_acctbal") / 2000).alias("parallax"), F.lit(0.2).alias("parallax_error"),
        F.lit(17.0).alias("g"), F.lit(18.0).alias("bp"), F.lit(17.0).alias("rp"), F.lit(0.7).alias("noise"),
    )
    return one.unionByName(two)


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked periods of four methods for every customer: (source_id, algo, ai, rank, period, significance)."""
    k = F.col("c_custkey")
    names = F.array(*map(F.lit, ("CE", "AOV", "LS", "MHF")))
    rows = table(spark, sf_dir, "customer").select(k, F.posexplode(names).alias("ai", "algo")).select(k, "ai", "algo", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("rank"))
    period = 0.05 + ((k * (F.col("ai") + 2) + F.col("rank") * F.col("rank") * 3) % 41) * 0.05
    return rows.select(
        k.cast("string").alias("source_id"), "algo", "ai", "rank", F.when((k + F.col("ai") + F.col("rank")) % 9 != 0, period).otherwise(F.lit(float("nan"))).alias("period"),
        (10.0 - F.col("rank") * 2 + (k % 7) * 0.1 + F.col("ai") * 0.01).alias("significance"), ((k * 3 + F.col("ai") * 5) % 10 / 10).alias("f1_power"),
    )


#: The same views for DuckDB, as the first parts of WITH lists.
LC_EVENTS = "lc as (select cast(user_id as varchar) as source_id, 'r' as band, epoch_us(ts) / 86400e6 + 2440587.5 as t, 15 + value / 100 as mag, 0.02::double + (event_id % 7) * 0.01::double as mag_err, event_id as ord from events)"
LC_AWKWARD = """ev as (select *, user_id % 10 as kind, event_id % 13 = 0 as hit from events),
raw as (select cast(user_id as varchar) as source_id, 'r' as band, epoch_us(ts) / 86400e6 + 2440587.5 as t, event_id as ord,
  case when hit and kind = 4 then 'nan'::double when hit and kind = 5 then null when hit and kind = 6 then 'inf'::double else 15 + value / 100 end as mag,
  case when hit and kind = 3 then 0.0::double when hit and kind = 7 then null when hit and kind = 8 then 'nan'::double when hit and kind = 9 then '-inf'::double else 0.02::double + (event_id % 7) * 0.01::double end as mag_err from ev),
flags as (select source_id, band, bool_and(coalesce(isfinite(mag), false)) as m_ok, bool_and(coalesce(isfinite(mag_err) and mag_err > 0, false)) as e_ok from raw group by all),
lc as (select source_id, band, t, ord, case when isfinite(mag) then mag else 0 end as mag, case when isfinite(mag_err) and mag_err > 0 then mag_err else 1 end as mag_err from raw)"""
LC_LINEITEM = """lc as (select cast(l_suppkey as varchar) as source_id, case l_returnflag when 'A' then 'g' when 'R' then 'r' else 'i' end as band,
  epoch_us(l_shipdate) / 86400e6 + 2440587.5 as t, 15 + l_extendedprice / 20011 as mag, 0.02::double + l_discount * 0.5::double as mag_err,
  row_number() over (partition by l_suppkey, l_returnflag order by l_shipdate, l_orderkey, l_partkey, l_linenumber, l_extendedprice) as ord from lineitem)"""
EPOCHS = """raw as (select *, cast(json_extract_string(props, '$.k') as int) as k,
  case event_type when 'click' then 1 when 'view' then 2 when 'purchase' then 3 when 'signup' then 4 else 99 end as filter from events),
epochs as (select user_id * 5 + filter % 5 as _id, filter, epoch_us(ts) / 86400e6 + 2440587.5 as hjd, 15 + value / 100 as mag, 0.02::double + (event_id % 7) * 0.01::double as magerr, event_id as ord,
  case when k % 10 = 0 then null when k % 10 = 1 then 4 else 0 end as catflags, case when k % 5 = 0 then null when k % 5 = 4 then 7 else k % 5 end as programid from raw)"""
SKY = """src as (select cast(c_custkey as varchar) as source_id, (c_custkey * 137.50776405::double) % 360 as ra, (c_custkey * 61.803398875::double) % 120 - 60 as dec, cast(c_custkey % 120 as int) as nobs from customer),
cat as (select c_custkey * 2 as gid, (c_custkey * 137.50776405::double) % 360 as ra, (c_custkey * 61.803398875::double) % 120 - 60 + ((c_custkey % 7) - 3) * 0.0002::double as dec, c_acctbal / 1000 as parallax,
    0.1::double as parallax_error, 16 + (c_custkey % 30) / 10 as g, case when c_custkey % 5 <> 0 then 17 + (c_custkey % 100) / 100 end as bp, 16.5::double + (c_custkey % 50) / 100 as rp, 0.5::double as noise
  from customer where c_custkey % 3 = 0
  union all
  select c_custkey * 2 + 1, (c_custkey * 137.50776405::double) % 360, (c_custkey * 61.803398875::double) % 120 - 60 + 0.0003::double, c_acctbal / 2000, 0.2::double, 17.0::double, 18.0::double, 17.0::double, 0.7::double
  from customer where c_custkey % 6 = 0)"""
PEAKS = """pk as (select cast(c_custkey as varchar) as source_id, ['CE', 'AOV', 'LS', 'MHF'][ai + 1] as algo, ai, rank,
  case when (c_custkey + ai + rank) % 9 <> 0 then 0.05::double + ((c_custkey * (ai + 2) + rank * rank * 3) % 41) * 0.05::double else 'nan'::double end as period,
  10.0::double - rank * 2 + (c_custkey % 7) * 0.1::double + ai * 0.01::double as significance, (c_custkey * 3 + ai * 5) % 10 / 10 as f1_power
  from customer, (select unnest(range(4)) as ai), (select unnest(range(3)) as rank))"""
