"""A corpus from raw documents to token ids: five stages, each written as Parquet and read again.

Every stage works on all rows that the one before it kept. All but the last return the
columns of documents, whatever further columns the table has.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lyraflux.llm import bpe, catalog, langid, mixing, neardup, pii
from lyraflux.llm.common import drop_checkpoints, held_out, removed, shared_folder


def _packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all columns as ``row``: whatever names and types a table has, none meets one of an operator's own."""
    return docs.select(*names, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def _unpacked(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of ``row`` again, some of them new."""
    return rows.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in columns])


def _orderable(kind: T.DataType) -> bool:
    """Whether values of a type can be compared: maps and variants can't."""
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind)
    return _orderable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, T.MapType | T.VariantType)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; their lang is the predicted one.

    A null, empty or letterless text has no language and goes, as does one whose likeliest language
    hardly stands out. Null ids, nulls elsewhere and repeated rows pass like others, row by row; two
    equally likely languages are decided for the first in alphabetical order. Where no row has both
    a text and a language nothing can be learned, and no document is kept.
    """
    model = langid.fit(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    found = langid.predict(_packed(docs, "text"), model)
    kept = found.where(~langid.rejected(F.col("lang_pred"), F.col("score")))
    return _unpacked(kept, docs.columns, lang=F.col("lang_pred"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: of its smallest id, and of rows that share it the least by their columns in order.

    Rows that share an id are one document with several texts, so they are one group. A text that is
    null or without words is like no other, and stays, one row an id. Rows without an id can't be linked;
    they stay, one of each different text (of null texts one).
    """
    kept = neardup.near_duplicates(docs.select("doc_id", "text")).where("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    rows = _packed(docs, "doc_id", "text")
    # what can't be compared is compared as text
    order = F.struct(*[F.col("row").getField(f.name) if _orderable(f.dataType) else F.to_json(F.struct(F.col("row").getField(f.name).alias("x"))) for f in docs.schema])
    least = lambda df, *keys: df.groupBy(*keys).agg(F.min_by("row", order).alias("row")).select("row")
    ids = lambda which: kept.where(which).select("doc_id")
    alone = rows.join(ids("rows = 1"), "doc_id", "left_semi").select("row")
    shared = least(rows.join(ids("rows > 1"), "doc_id", "left_semi"), "doc_id")
    nameless = least(rows.where("doc_id is null"), F.sha2("text", 256))
    return _unpacked(alone.unionByName(shared).unionByName(nameless), docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind in brackets, n_chars by the new length; no row goes.

    Null and empty texts stay as they are (n_chars null and 0); overlapping spans become one; repeated rows and
    rows with nulls elsewhere are treated alike.
    """
    clean = pii.find_spans(_packed(docs, "text"), pii.fit(docs.select("text")), redact=True)
    return _unpacked(clean, docs.columns, text=F.col("text"), n_chars=F.length("text").cast("long"))


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their domains ask for: at a rate below 1 some go, above 1 some repeat.

    A null or empty text has no tokens and keeps about the rate of its likeliest domain. Rows that share an id (null
    ids too) share the least number of copies that any of them got. Without labels all belong to one domain and stay.
    """
    rates = mixing.document_rates(docs.select("doc_id", "text"), catalog.labelled_domains(spark, sf_dir), catalog.mixing_targets)
    return mixing.resampled(docs, rates)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, and for every row the token ids of its text, their number, and what they decode to.

    A null or empty text has no ids and decodes to the empty one; repeated rows give repeated rows.
    """
    coded = bpe.codec(docs.select("doc_id", "lang", "source", "text"), without=("text",))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("target_mix", target_mix),
    ("encode", encode),
]

#: Trained models, hash forests and merges have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written beside the checkpoints and read again.

    What a stage leaves behind goes once the next one's rows are written; the last stage reads
    the one before it, which stays with the result.
    """
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(path := f"{folder}/{k}_{name}")
            docs = spark.read.parquet(path)
            drop_checkpoints(spark)
            if before is not None:
                removed(spark, before)
            before = path
    return docs
