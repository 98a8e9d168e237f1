"""Responses of a survey service as raw JSON text, read through VARIANT: no schema ends a job, unknown fields stay, what can't be read is reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What ``survey.light_curves`` reads of a document; numbers sent as text count as numbers.
EPOCHS = "array<struct<hjd double, mag double, magerr double, catflags int, programid int>>"
FIELDS = {"_id": "bigint", "filter": "int", "ra": "double", "dec": "double", "data": EPOCHS}


def _get(v: str | Column, path: str, kind: str) -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, kind)


def _field(name: str, kind: str) -> Column:
    """A known field of ``doc``; a whole number is taken from its text, as a cast would cut a fraction off."""
    return _get("doc", f"$.{name}", "string").try_cast(kind) if kind in ("int", "bigint") else _get("doc", f"$.{name}", kind)


def documents(raw: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Documents of the responses in ``body``, and the problems.

    Documents have _id, filter, ra, dec, data, and ``rest``, a map of the fields that aren't known (empty where there are none).
    A known field that can't be read as its type is null, as is one that is absent; an epoch that is none is null and left out.
    Problems have kind, message and text: ``unparsable`` responses (null included), ``failed`` ones (any status but success), and
    ``malformed`` documents (no object, no whole number as _id, or epochs that are no array).
    """
    return _split(raw, body, lambda v: _get(v, "$.data", "array<variant>"))


def cone_documents(raw: DataFrame, body: str = "body", target: str = "center") -> tuple[DataFrame, DataFrame]:
    """``documents`` of cone responses, whose data map a collection's name to a map from target to documents."""
    around = lambda v: F.map_values(_get(v, "$.data", "map<string, map<string, variant>>"))
    found = lambda m: F.coalesce(_get(F.try_element_at(m, F.lit(target)), "$", "array<variant>"), F.array().cast("array<variant>"))
    return _split(raw, body, lambda v: F.flatten(F.transform(around(v), found)))


def _split(raw: DataFrame, body: str, documents_of) -> tuple[DataFrame, DataFrame]:
    read = raw.select(F.col(body).cast("string").alias("text"), F.try_parse_json(F.col(body).cast("string")).alias("v"))
    read = read.withColumn("status", _get("v", "$.status", "string"))
    good = F.coalesce(F.col("status") == "success", F.lit(False))
    docs = read.where(good).select(F.explode(documents_of("v")).alias("doc"))
    fields = docs.select("doc", _get("doc", "$", "map<string, variant>").alias("all"), *[_field(name, kind).alias(name) for name, kind in FIELDS.items()])
    sound = F.col("_id").isNotNull() & F.col("data").isNotNull()
    rest = F.map_filter("all", lambda k, v: ~k.isin(*FIELDS))
    kept = fields.where(sound).select(*[c for c in FIELDS if c != "data"], F.filter("data", lambda p: p.isNotNull()).alias("data"), rest.alias("rest"))
    kind = F.when(F.col("v").isNull(), "unparsable").otherwise("failed")
    bad = read.where(F.col("v").isNull() | ~good).select(kind.alias("kind"), _get("v", "$.message", "string").alias("message"), "text")
    torn = fields.where(~sound).select(F.lit("malformed").alias("kind"), F.lit(None).cast("string").alias("message"), F.to_json("doc").alias("text"))
    return kept, bad.unionByName(torn)


def new_fields(docs: DataFrame) -> DataFrame:
    """How many documents carry each field that isn't known: field, n."""
    return docs.select(F.explode(F.map_keys("rest")).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))
