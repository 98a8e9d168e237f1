"""Queries that apply each text operator to its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lyraflux.llm import alignment, backtrack, bpe, chat, fingerprint, langid, mixing, neardup, negatives, pii, tiff, toxicity
from lyraflux.llm.common import documents, held_out, table


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate component: four-word shingles, similarity 0.8."""
    return neardup.near_duplicates(documents(spark, sf_dir), words=4, percent=80)


OP1_SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents
), shingles as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s
  from words
), sizes as (
  select doc_id, count(*) as n from shingles group by doc_id
), common as (
  select x.doc_id as a, y.doc_id as b, count(*) as n from shingles x join shingles y on x.s = y.s and x.doc_id < y.doc_id group by all
), links as (
  select a, b from common c join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * c.n >= 80 * (p.n + q.n - c.n)
), edges as (
  select a, b from links union select b, a from links
), reach as (
  select doc_id as node, doc_id as to_id from documents
  union
  select r.node, e.b from reach r join edges e on e.a = r.to_id
), component as (
  select node, min(to_id) as component_id from reach group by node
)
select d.doc_id, coalesce(s.n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d left join sizes s using (doc_id) join component c on c.node = d.doc_id
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text; over_limit: more than 512."""
    counted = bpe.token_counts(documents(spark, sf_dir), tokenizer="byte_bpe_50k.json")
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op3_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's fingerprint, its edited text's, and how alike they and the next document's are."""
    made = fingerprint.fingerprints(documents(spark, sf_dir))
    own, edited, following = map(F.col, ("sketch", "edited_sketch", "next_sketch"))
    both = fingerprint.merged(own, following)
    return made.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint.as_text(own).alias("fingerprint"), fingerprint.as_text(edited).alias("edited_fingerprint"),
        fingerprint.likeness(own, edited).alias("near_edited"), fingerprint.likeness(own, following).alias("near_next"), fingerprint.containment(own, following).alias("inside_next"),
        F.size(both).cast("long").alias("merged_hashes"), F.sha2(fingerprint.as_text(both), 256).alias("merged_sha256"),
    )


def op4_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a TIFF file and read back, with digests and features of what was read."""
    docs = documents(spark, sf_dir).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), tiff.payload(F.col("text")).alias("payload"))
    stored = tiff.store_payloads(docs)
    stored = stored.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    read = tiff.tiff_pages(stored)
    return read.select(
        "doc_id", "n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -64)")).alias("tail_crc32"), "media_bytes", "media_sha256", "feature", "compression", "predictor", "tiled", "error",
    )


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded, then decoded from its ids."""
    back = bpe.codec(documents(spark, sf_dir), tokenizer="word_bpe_49k.json", without=("text",))
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled table: the domain of each labelled document, its language and quality."""
    lang = table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return labels.join(lang, "doc_id").select("doc_id", F.concat("lang", F.lit("/"), F.col("quality").cast("string")).alias("domain"))


def mixing_targets(names: list[str], totals: list[float]) -> list[float]:
    """Languages by their share to the power 0.7; of low quality, a quarter of that."""
    return mixing.tempered_targets(names, totals, power=0.7, favour=lambda name: 0.25 if name.endswith("/0") else 1.0)


def op6_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's rate in a mix of languages and qualities by weight."""
    return mixing.document_rates(documents(spark, sf_dir), labelled_domains(spark, sf_dir), mixing_targets)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's chance of being marked toxic; labels of held-out documents are not learned from."""
    docs = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


PROBE = "\\### Assistant: </turn> ok"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back, and the one numbered -7."""
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    made = chat.format_conversations(turns.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    back = made.withColumns({"read": chat.read_turns(F.col("formatted")), "loss": chat.read_loss_text(F.col("formatted"), F.col("loss_spans"))})
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def chat_typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with an image behind each text, a recording before each assistant's and a file behind every third turn, and what its visitor records."""
    turn, odd = F.coalesce("turn", F.lit(0)).cast("int"), F.col("role") == "assistant"

    def part(kind: str, name: str, **more: Column) -> Column:
        types = {"width": "int", "height": "int", "seconds": "double", "pages": "int"}
        ref = F.concat(F.lit(f"{name}/"), turn.cast("string"))
        return F.struct(F.lit(kind).alias("type"), F.lit(None).cast("string").alias("text"), ref.alias("ref"), *[(more[k] if k in more else F.lit(None)).cast(t).alias(k) for k, t in types.items()])

    none = F.array().cast(f"array<{chat.PART_TYPE}>")
    parts = F.concat(
        F.when(odd, F.array(part("audio", "a", seconds=turn + 0.5))).otherwise(none), chat.text_part(F.col("text")), F.array(part("image", "i", width=57 + turn, height=28 * (turn + 1))),
        F.when(turn % 3 == 2, F.array(part("document", "d", pages=turn + 1))).otherwise(none),
    )
    made = chat.format_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", parts.alias("parts")))
    made = made.withColumn("read", chat.read_parts(F.col("formatted"), F.col("attachments")))
    refs = F.array_join(F.flatten(F.transform("read", lambda t: F.filter(F.transform(t["parts"], lambda p: p["ref"]), lambda r: r.isNotNull()))), ",")
    return made.select(
        "conv_id", "n_turns", F.size("attachments").cast("long").alias("n_attachments"), "expanded_tokens", F.sha2(refs, 256).alias("refs_sha256"),
        F.size(F.filter("attachments", lambda a: a["type"] == "image")).cast("long").alias("n_images"),
    )


CHAT_PARTS_SQL = """
with t as (
  select conv_id, coalesce(turn, 0) as k, role, coalesce(role = 'assistant', false) as a, turn, coalesce(role, '') as r, coalesce(text, '') as text from conversations
)
select conv_id, count(*) as n_turns, cast(sum(1 + a::int + (k % 3 = 2)::int) as bigint) as n_attachments,
  cast(sum(ceil((57 + k) / 28) * (k + 1) + case when a then ceil((k + 0.5) * 12.5) else 0 end + case when k % 3 = 2 then (k + 1) * 1024 else 0 end) as bigint) as expanded_tokens,
  sha256(string_agg(case when a then 'a/' || k || ',' else '' end || 'i/' || k || case when k % 3 = 2 then ',d/' || k else '' end, ',' order by turn, r, text)) as refs_sha256,
  count(*) as n_images
from t group by conv_id
"""


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in the array's order."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, text), ",")


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: exact base spans and what the weakly supervised classifier adds."""
    docs = documents(spark, sf_dir)
    found = pii.find_spans(docs, pii.fit(docs)).drop("text")
    base = F.filter("pii_spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("pii_spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("pii_spans")).alias("spans"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's language; held-out documents are not learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    scored = langid.predict(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each anchor and positive the highest rows of other labels at half to 95 per cent of the positive's score."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), anchors=lambda i: i % 50 == 0, label=label)


OP11_SQL = """
with r as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.id as anchor_id, a.label = b.label as same, b.id, cast(list_inner_product(a.v, b.v) as bigint) as score
  from r a join r b on a.id <> b.id where a.id % 50 = 0
), positive as (
  select anchor_id, id, score from scored where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select p.anchor_id, p.id as positive_id, cast(row_number() over w as integer) as rank, n.id as negative_id, p.score as positive_score, n.score as negative_score
from positive p join scored n on n.anchor_id = p.anchor_id and not n.same and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score
window w as (partition by p.anchor_id, p.id order by n.score desc, n.id)
qualify row_number() over w <= 3
"""


def op12_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by ranks, then decoded from its ids."""
    coded = backtrack.encode(documents(spark, sf_dir), ranks="byte_bpe_multi_50k.tiktoken").drop("text")
    back = backtrack.decode(coded, ranks="byte_bpe_multi_50k.tiktoken")
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two tokenizers cut every text, and how their ids end together in the corpus."""
    made = alignment.align(documents(spark, sf_dir), a="byte_bpe_50k.json", b="piece_bpe_32k.model")
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    scored = alignment.link_statistics(made.withColumn("groups_sha256", digest).drop("groups"))
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


OP8_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -7, r.i, r.role, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) r(i, role)
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
  cast(sum(length('<turn role="">') + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '"', '&quot;'))
    + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + length('</turn>') + 1) as bigint) as formatted_chars
from turns group by conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_duplicates": op1_near_duplicates,
        "op2_token_counts": op2_token_counts,
        "op3_scaled_sketch": op3_scaled_sketch,
        "op4_tiff_media": op4_tiff_media,
        "op5_bpe_codec": op5_bpe_codec,
        "op6_soft_mixing": op6_soft_mixing,
        "op7_toxicity": op7_toxicity,
        "op8_chat_format": op8_chat_format,
        "op9_pii_spans": op9_pii_spans,
        "op10_language_id": op10_language_id,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_backtracking_bpe": op12_backtracking_bpe,
        "op13_tokenizer_alignment": op13_tokenizer_alignment,
        "chat_typed_parts": chat_typed_parts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_near_duplicates": OP1_SQL, "op11_hard_negatives": OP11_SQL, "op8_chat_format": OP8_SQL, "chat_typed_parts": CHAT_PARTS_SQL}
