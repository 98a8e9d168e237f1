"""Shared helpers of the text operators: table access, folds, lineage cuts, Arrow maps."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handled at once inside a task; bounds the memory of a Python worker.
SLICE_ROWS = 512
#: Rows of an Arrow batch; an upper bound for the session's own setting.
ARROW_ROWS = 1_024


def bounded_batches(spark: SparkSession) -> None:
    """At most ARROW_ROWS rows go to a Python worker at once; texts are long, and two workers share an executor's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of the documents table; other columns are not read."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the decimal id, mod 4, is 2. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only in local mode, and only where the session names none, a temporary one is made, once;
    a cluster without a shared folder is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named is None and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    folder = named or tempfile.mkdtemp(prefix="lyraflux-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def removed(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def arrow_map(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` for columns of any name: Spark would read one with a dot as a path."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, schema)


#: How a Python worker forgets what an operator keeps from task to task, and whose task it ran last.
_KEPT: dict[str, Callable[[], None]] = {}
_SERVED = [""]


def keeps(owner: str, forget: Callable[[], None]) -> None:
    _KEPT[owner] = forget


def begins(owner: str) -> None:
    """Where a task of ``owner`` begins: Spark hands workers from one operator to the next, so what others kept is forgotten."""
    if _SERVED[0] == owner:
        return
    _SERVED[0] = owner
    for other, forget in _KEPT.items():
        if other != owner:
            forget()
    gc.collect()
    pa.default_memory_pool().release_unused()


#: Checkpoints and tables that cut_lineage and written left since they were last dropped.
_WRITTEN: list[str] = []


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    file = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        _WRITTEN.append(file.get())
    return out


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts lineage and is smaller than a checkpoint."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_checkpoints(spark: SparkSession) -> None:
    """Deletes what cut_lineage and written left so far; only for callers that have written their result elsewhere."""
    while _WRITTEN:
        removed(spark, _WRITTEN.pop())
