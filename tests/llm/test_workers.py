"""A task of a text operator holds one Python worker: two Arrow maps in a row would hold two, each with what it keeps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lyraflux.llm import bpe, catalog, neardup

from .conftest import edge_rows


def maps(df):
    return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")


def test_encode_and_decode_share_one_worker(spark, folders):
    docs = spark.read.parquet(f"{folders['edge']}/documents.parquet")
    made = corpus_pipeline.encode(spark, docs, folders["edge"])
    assert maps(made) == 1 and maps(catalog.op5_bpe_codec(spark, folders["edge"])) == 1
    apart = bpe.decode(bpe.encode(docs)).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")
    assert sorted(map(str, made.collect())) == sorted(map(str, apart.collect())) and made.schema == apart.schema
    clash = bpe.codec(docs.withColumn("ids", F.lit("x")).withColumn("a.b", F.lit(1)), ids="decoded", decoded="ids")
    assert clash.columns == [*docs.columns, "a.b", "decoded", "ids"]
    assert {r["ids"] for r in clash.collect()} == {r["decoded"] for r in made.collect()}


@pytest.mark.parametrize("outside", [True, False])
def test_sets_and_their_first_shingles_share_one_worker(spark, outside):
    rows = [(i, t) for i, t, *_ in edge_rows() if i is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("comp"), F.lit(outside).alias("outside")).distinct()
    made = neardup.first_shingles(ids, lambda ids, *then: neardup.full_sets(ids, docs, 4, "doc_id", "text", *then), 80)
    assert maps(made) == 1
    sets = [(i, neardup.shingle_set(t, 4)) for i, t in rows]
    counts = np.zeros(1 << neardup.SKETCH_BITS, np.int64)
    for _, x in sets:
        np.add.at(counts, neardup._cells(x), 1)
    wanted = []
    for i, x in sets if outside else []:  # without a set outside none can be joined
        at = sorted(range(len(x)), key=lambda k: (counts[neardup._cells(x[k : k + 1])[0]], x[k]))[: len(x) - -(-80 * len(x) // 100) + 1]
        wanted += [(i, i, len(x), k, int(x[j].view(np.int64))) for k, j in enumerate(at) if counts[neardup._cells(x[j : j + 1])[0]] > 1]
    assert sorted(map(tuple, made.collect())) == sorted(wanted) and bool(wanted) is outside
