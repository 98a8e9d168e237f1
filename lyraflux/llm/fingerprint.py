"""Document fingerprints by a threshold-scaled sketch of word shingles.

A sketch holds every hash of a document's distinct shingles that lies in the lowest 1/SCALE of
the hash range; where none does, it holds the least of all. The same rule makes the sketch of
one shingle and of a million, so equal sets have equal sketches and likeness 1, and only texts
without words have an empty one. Sketches of very unequal documents stay comparable, merge by
union, and estimate likeness (Jaccard) and containment; the standard error falls with the
square root of the hashes held. Everything is built from Spark SQL functions.

Following documents are found without a global window: ids are cut at approximate quantiles
into many small ordered buckets, an id (or null) that fills several of them is cut further by
a hash of the text, each bucket also gets the first row of the one after it, and a window
inside the buckets does the rest. A text is shuffled once.

Defined results: a null text is the empty one, whose sketch and fingerprint are empty; two
texts without words have likeness and containment 1, one of them and another 0; whether a text
with no hash in the range is inside one that has some can't be told and is null; a text of fewer
words than a shingle is one shingle; rows that share an id are ordered by a hash of the text,
then by the text; null ids come last; the only row follows itself; repeated rows give repeated
rows; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
#: One in so many hashes of the range is retained.
SCALE = 2
#: Ordered buckets for each shuffle partition, and of all at most.
BUCKETS_A_PARTITION, MAX_BUCKETS = 4, 16_384
#: White space between words, as a pattern.
SPACES = r"[\x20\t-\r]+"


def highest_kept(scale: int = SCALE) -> int:
    """The signed 64-bit hash below which hashes are retained."""
    return -(1 << 63) + (1 << 64) // scale


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer if ``df`` has such a column already."""
    while name in df.columns:
        name += "_"
    return name


def retained(hashes: Column, scale: int = SCALE) -> Column:
    """Of an array of hashes those in the range, or the least one where none is: sorted and distinct."""
    low = F.sort_array(F.array_distinct(F.filter(hashes, lambda h: h < F.lit(highest_kept(scale)))))
    return F.when(F.size(low) > 0, low).when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(F.array().cast("array<bigint>"))


def with_sketch(df: DataFrame, text: Column, out: str, words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """``df`` with the sketch of ``text``: a sorted array of distinct hashes."""
    own, all_ = free_name(df, f"{out}__words"), free_name(df, f"{out}__hashes")
    split = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACES), "")
    firsts = F.slice(own, F.lit(1), F.greatest(F.size(own) - (words - 1), F.lit(1)))
    # places beyond the end are null, and null words don't enter a hash: a short text is one shingle
    hashes = F.transform(firsts, lambda w, i: F.xxhash64(w, *[F.get(F.col(own), i + k) for k in range(1, words)]))
    # the words and hashes stand in columns of their own, so that no later expression makes them anew
    df = df.withColumn(own, split).withColumn(all_, hashes)
    return df.withColumn(out, retained(F.col(all_), scale)).drop(own, all_)


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two documents taken as one, apart from shingles across their seam."""
    return retained(F.array_union(a, b), scale)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches; 1 for equal ones."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    either = F.size(a) + F.size(b) - common
    return F.when(either > 0, common / either).otherwise(1.0)


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has; null where only ``b`` has hashes in the range, as those can't tell."""
    in_range = lambda x: F.coalesce(F.array_min(x) < highest_kept(scale), F.lit(False))
    share = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))
    return F.when(F.size(a) == 0, (F.size(b) == 0).cast("double")).when(in_range(a) | ~in_range(b), share)


def as_text(sketch: Column) -> Column:
    """A fingerprint to store or compare: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def edited(text: Column, following: Column) -> Column:
    """``text`` whose last third (rounded down) gives way to as many characters of ``following``, or all it has."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - third), F.substr(following, F.lit(1), third))


def _upto(id_: Column, splits: list[int], strict: bool) -> Column:
    """How many of the sorted ``splits`` are at most ``id_``, or below it, by binary search."""
    table = F.split(F.lit(",".join(map(str, splits))), ",").cast("array<bigint>")  # folded into one literal
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(splits).bit_length()))])
    below = (lambda x: x < id_) if strict else (lambda x: x <= id_)
    fits = lambda at, step: (at + step <= len(splits)) & below(F.get(table, at + step - 1))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(fits(at, step), at + step).otherwise(at))


def _bucket(id_: Column, tie: Column, splits: list[int], null_parts: int) -> Column:
    """The place of a row among ordered buckets. An id that stands k times among the ``splits`` has k buckets, by its ``tie``; null ids have those below 0."""
    part = lambda n: F.least(F.floor((tie / 2.0**64 + 0.5) * n).cast("int"), n - 1)
    null = -1 - part(F.lit(null_parts))
    if not splits:
        return F.when(id_.isNull(), null).otherwise(F.lit(0))
    last = _upto(id_, splits, False)
    if len(set(splits)) == len(splits):
        return F.when(id_.isNull(), null).otherwise(last)
    equal = last - _upto(id_, splits, True)
    return F.when(id_.isNull(), null).when(equal > 1, last - part(equal)).otherwise(last)


def with_following(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, object]:
    """Rows (doc_id, text, tie, bucket, extra) and the window in which each row's follower is the next one.

    Rows with ``extra`` 1 are only there to be followers, and have to be left out at the end.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, min(MAX_BUCKETS, parts * BUCKETS_A_PARTITION))
    cuts = [k / buckets for k in range(1, buckets)]
    # only the cut points come to the driver: MAX_BUCKETS numbers at most
    cut = F.percentile_approx("doc_id", cuts, 10 * buckets) if cuts else F.lit(None).cast("array<bigint>")
    found = rows.agg(cut.alias("cuts"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.count(F.lit(1)).alias("n")).first()
    null_parts = max(1, -(-buckets * found["nulls"] // max(found["n"], 1)))
    rows = rows.withColumn("tie", F.xxhash64("text", F.lit(3)))
    placed = rows.withColumn("bucket", _bucket(F.col("doc_id"), F.col("tie"), sorted(found["cuts"] or ()), null_parts))
    first = F.max(F.struct("doc_id", F.bitwise_not("tie").alias("tie")))  # the greatest id, then the least tie
    heads = placed.groupBy("bucket").agg(first.alias("head"))  # a row a bucket
    falling = Window.orderBy(F.desc("bucket"))
    whole = falling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select("bucket", F.struct(F.lead("bucket").over(falling).alias("bucket"), F.lead("head").over(falling).alias("head")).alias("next"), F.first(F.struct("bucket", "head")).over(whole).alias("top"))
    after = after.select(F.col("bucket").alias("to"), F.when(F.col("next.bucket").isNotNull(), F.col("next")).otherwise(F.col("top")).alias("from"))
    after = after.select("to", F.col("from.bucket").alias("bucket"), F.col("from.head.doc_id").alias("head"), F.bitwise_not("from.head.tie").alias("head_tie"))
    one = Window.partitionBy("to").orderBy("text")
    # a bucket is asked for at most twice, so ``after`` has MAX_BUCKETS + 1 rows at most
    same = (placed["bucket"] == after["bucket"]) & placed["doc_id"].eqNullSafe(after["head"]) & (placed["tie"] == after["head_tie"])
    lead = placed.join(F.broadcast(after), same)
    lead = lead.select(placed["doc_id"], placed["text"], placed["tie"], "to").withColumn("n", F.row_number().over(one)).where("n = 1")
    lead = lead.select("doc_id", "text", "tie", F.col("to").alias("bucket"), F.lit(1).alias("extra"))
    both = placed.select("doc_id", "text", "tie", "bucket", F.lit(0).alias("extra")).unionByName(lead)
    return both, Window.partitionBy("bucket").orderBy("extra", F.desc_nulls_last("doc_id"), "tie", "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """Each document's sketch, its edited text's sketch, and the sketch of the document that follows by falling id.

    Columns: doc_id, text, edited; sketch, edited_sketch, next_sketch.
    """
    rows, window = with_following(docs, id_col, text)
    rows = rows.withColumn("following", F.lead("text").over(window))
    rows = with_sketch(rows, F.col("text"), "sketch", words, scale)
    rows = rows.withColumn("next_sketch", F.lead("sketch").over(window)).where("extra = 0")
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("following")))
    rows = with_sketch(rows, F.col("edited"), "edited_sketch", words, scale)
    return rows.select("doc_id", "text", "edited", "sketch", "edited_sketch", "next_sketch")
