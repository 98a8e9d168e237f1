"""Feature tables as Parquet: flat columns for ranked lists, schema drift, resumable runs."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession) -> str:
    """A new folder under the cluster's shared one; in local mode, where none is named, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='lyraflux-')}/{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> bool:
    """Deletes a folder; whether it was there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: what several plans use is computed once, and outlives executors."""
    df.write.parquet(folder := scratch(df.sparkSession))
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """``materialised`` rows, and the ``metrics`` (aggregates) of them, taken while they are written: no scan of its own."""
    watch = Observation()
    made = materialised(df.observe(watch, *[value.alias(name) for name, value in metrics.items()]))
    return made, watch.get


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def cached(spark: SparkSession, build: Callable[[], DataFrame], folder: str, settings: dict) -> DataFrame:
    """What ``build`` made under equal ``settings`` before, from ``folder``; else it is made and kept there."""
    path = f"{folder}/{hashlib.sha1(json.dumps(settings, sort_keys=True).encode()).hexdigest()}"
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def flattened(features: DataFrame, maps: tuple[str, ...], algorithms: tuple[str, ...], ranks: int) -> DataFrame:
    """``features`` with each map of ranked lists as columns such as period_0_LS, and a 2-D ``dmdt`` (rows of an array) as dmdt_flat and its shape."""
    columns = [F.get(F.try_element_at(F.col(m), F.lit(a)), F.lit(r)).alias(f"{m.removesuffix('_top')}_{r}_{a}") for m in maps for a in algorithms for r in range(ranks)]
    out = features
    if "dmdt" in features.columns and features.schema["dmdt"].dataType.simpleString().startswith("array<array<"):
        rows = F.when(F.col("dmdt").isNotNull(), F.size("dmdt"))
        cols = F.when(F.col("dmdt").isNotNull(), F.size(F.get("dmdt", F.lit(0))))
        out = out.withColumns({"dmdt_flat": F.flatten("dmdt"), "dmdt_rows": rows, "dmdt_cols": cols}).drop("dmdt")
    return out.select(*[c for c in out.columns if c not in maps], *columns)


def unflattened(flat: DataFrame, maps: tuple[str, ...], algorithms: tuple[str, ...], ranks: int) -> DataFrame:
    """The maps again, and ``dmdt`` as rows; what is null or NaN in a list is left out, so that later ranks move up."""
    out, gone = flat, []
    for m in maps:
        lists = []
        for a in algorithms:
            names = [n for r in range(ranks) if (n := f"{m.removesuffix('_top')}_{r}_{a}") in flat.columns]
            gone += names
            lists += [F.lit(a), F.filter(F.array(*map(F.col, names)), lambda x: x.isNotNull() & ~F.isnan(x))] if names else []
        out = out.withColumn(m, F.map_filter(F.create_map(*lists), lambda k, v: F.size(v) > 0)) if lists else out
    if {"dmdt_flat", "dmdt_rows", "dmdt_cols"} <= set(flat.columns):
        row = lambda i: F.slice("dmdt_flat", i * F.col("dmdt_cols") + 1, F.col("dmdt_cols"))
        whole = F.col("dmdt_flat").isNotNull() & (F.col("dmdt_rows") > 0) & (F.col("dmdt_cols") > 0)
        out = out.withColumn("dmdt", F.when(whole, F.transform(F.sequence(F.lit(0), F.col("dmdt_rows") - 1), row)))
        gone += ["dmdt_flat", "dmdt_rows", "dmdt_cols"]
    return out.drop(*gone)


def read_features(spark: SparkSession, folder: str, schema: T.StructType, in_file_order: bool = False) -> DataFrame:
    """The declared columns of all files of ``folder``: unknown ones are left out, missing ones are null.

    ``in_file_order`` sorts rows by file name and place in the file, as one reader after another would see them.
    """
    found = spark.read.option("mergeSchema", "true").parquet(folder)
    found = found.orderBy("_metadata.file_path", "_metadata.row_index") if in_file_order else found
    return found.select(*[(F.col(f.name) if f.name in found.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def run_in_chunks(rows: DataFrame, key: list[str], build: Callable[[DataFrame], DataFrame], folder: str, chunks: int, into: str | None = None) -> DataFrame:
    """``build`` of ``rows`` by chunks of keys, each written to ``folder`` before the next; finished chunks are not made again.

    A manifest of the number of chunks and the key tells whether what is there belongs to this
    run; if not, all is made anew. A chunk counts as finished by its _SUCCESS file. ``rows`` are
    read once: they are dealt to chunks as a partitioned table. With ``into`` the whole result
    is written there at the end, and ``folder`` goes.
    """
    spark = rows.sparkSession
    mark = f"{chunks}|{','.join(key)}|{','.join(rows.columns)}"
    manifest, dealt = f"{folder}/manifest", f"{folder}/input"
    if not (exists(spark, f"{manifest}/_SUCCESS") and spark.read.text(manifest).first()["value"] == mark):
        for old in (dealt, *(f"{folder}/chunk={k}" for k in range(chunks))):
            removed(spark, old)
        spark.createDataFrame([(mark,)], "value string").coalesce(1).write.mode("overwrite").text(manifest)
    left = [k for k in range(chunks) if not exists(spark, f"{folder}/chunk={k}/_SUCCESS")]
    if left and not exists(spark, f"{dealt}/_SUCCESS"):
        rows.withColumn("dealt_chunk", F.pmod(F.xxhash64(*key), F.lit(chunks))).write.mode("overwrite").partitionBy("dealt_chunk").parquet(dealt)
    for k in left:
        place = f"{dealt}/dealt_chunk={k}"
        own = spark.read.schema(rows.schema).parquet(place) if exists(spark, place) else rows.limit(0)
        build(own).write.mode("overwrite").parquet(f"{folder}/chunk={k}")
    found = spark.read.option("mergeSchema", "true").parquet(*[f"{folder}/chunk={k}" for k in range(chunks)])
    if into is None:
        return found
    found.write.mode("overwrite").parquet(into)
    removed(spark, folder)
    return spark.read.parquet(into)
