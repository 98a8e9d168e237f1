"""Chat formatting with typed content parts.

A turn holds an array of parts: text, image, audio or document. The visitor flattens them
in order: text is escaped, every other part becomes a numbered placeholder whose
attachment reference and expanded token count are recorded. ``<`` opens control strings
only: inside texts ``&`` and ``<`` are written ``&amp;`` and ``&lt;`` (in roles ``"`` as
well, in types of parts ``>``), which is undone by replacing in the opposite order. Reading
gives texts back with ``read_turns``, and every part with ``read_parts``: neighbouring texts
come back as one, empty ones not at all.

Defined results: a null role is the empty role; a null part array is no parts; a null text
part is the empty text; a part of unknown type becomes a placeholder of 0 tokens; turns
with the same number are ordered by role, then content; rows with a null conversation id
form one conversation; repeated rows are repeated turns; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, OPENED, CLOSE = '<turn role="', '">', "</turn>\n"
TRAINED_ROLE = "assistant"

PART_TYPE = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;")) if role else out


def part_mark(kind: Column) -> Column:
    """A part's type inside its placeholder; null is ``unknown``."""
    return F.replace(escape(F.coalesce(kind, F.lit("unknown"))), F.lit(">"), F.lit("&gt;"))


def unescape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("&quot;"), F.lit('"')) if role else text
    return F.replace(F.replace(out, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def text_part(text: Column) -> Column:
    """A part array that holds one text."""
    null = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("type"), text.alias("text"), null.cast("string").alias("ref"), null.cast("int").alias("width"),
            null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages"),
        )
    )


def part_tokens(part: Column, patch: int, audio_rate: float, page_tokens: int) -> Column:
    """Tokens that a model puts in place of a part's placeholder."""
    tiles = F.ceil(part["width"] / patch) * F.ceil(part["height"] / patch)
    counted = (
        F.when(part["type"] == "image", tiles)
        .when(part["type"] == "audio", F.ceil(part["seconds"] * audio_rate))
        .when(part["type"] == "document", part["pages"].cast("long") * page_tokens)
    )
    return F.coalesce(counted.cast("long"), F.lit(0).cast("long"))


def flatten_parts(turns: DataFrame, parts: str = "parts", patch: int = 28, audio_rate: float = 12.5, page_tokens: int = 1024) -> DataFrame:
    """``turns`` with ``content`` (flat text with placeholders) and ``attachments`` of each row."""
    own = F.coalesce(F.col(parts), F.array().cast(f"array<{PART_TYPE}>"))

    def flat(part: Column, i: Column) -> Column:
        mark = F.concat(F.lit("<"), part_mark(part["type"]), F.lit(":"), i.cast("string"), F.lit("/>"))
        return F.when(part["type"] == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(mark)

    def attachment(part: Column, i: Column) -> Column:
        return F.struct(
            i.alias("part"), part["type"].alias("type"), part["ref"].alias("ref"),
            part_tokens(part, patch, audio_rate, page_tokens).alias("tokens"),
        )

    listed = F.filter(F.transform(own, attachment), lambda a: ~a["type"].eqNullSafe(F.lit("text")))
    return turns.withColumns({"content": F.array_join(F.transform(own, flat), ""), "attachments": listed})


def format_conversations(turns: DataFrame, trained_role: str = TRAINED_ROLE, **visitor) -> DataFrame:
    """One row for each conversation of ``turns`` (conv_id, turn, role, parts).

    formatted: the whole template text; loss_spans: code-point spans [start, end) of what is
    trained on; attachments: with the turn's place; expanded_tokens: their tokens in all.
    A conversation is one row of the result, so it has to fit in memory as one string.
    """
    # rows of one turn and role go by what they say, not by its escaped form
    said = F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("said")
    rows = flatten_parts(turns.select("conv_id", "turn", "role", "parts", said), **visitor).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), "said", "content", "attachments"
    )
    head = F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit(OPENED))
    rows = rows.withColumns({"head": head, "piece": F.concat(head, "content", F.lit(CLOSE))})
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "said", "content")
    placed = rows.withColumns(
        {
            "n": F.row_number().over(order),
            "ends": F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    start = F.col("ends") - F.length("piece") + F.length("head")
    span = F.when(F.col("role") == trained_role, F.struct(start.alias("start"), (start + F.length("content")).alias("end")))
    turn = F.struct("n", "piece", span.alias("span"), F.transform("attachments", lambda a: F.struct((F.col("n") - 1).alias("turn"), a["part"], a["type"], a["ref"], a["tokens"])).alias("attachments"))
    grouped = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.select(
        "conv_id",
        "n_turns",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of struct<role, text>, unescaped, placeholders left out."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, OPENED)
        role = F.substr(piece, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1)
        text = F.regexp_replace(F.substr(piece, cut + len(OPENED)), "<[^>]*/>", "")
        return F.struct(unescape(role, role=True).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def read_parts(formatted: Column, attachments: Column) -> Column:
    """The turns of a formatted text with their parts in order: array of struct<role, parts: array<struct<type, text, ref>>>."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    null = F.lit(None).cast("string")

    def part(token: Column, turn: Column) -> Column:
        inside = F.substring_index(F.substr(token, F.lit(2), F.length(token) - 3), ":", -1)
        kind = F.substr(token, F.lit(2), F.length(token) - 4 - F.length(inside))
        own = F.get(F.filter(attachments, lambda a: (a["turn"] == turn) & (a["part"] == inside.cast("int"))), F.lit(0))
        other = F.struct(unescape(F.replace(kind, F.lit("&gt;"), F.lit(">"))).alias("type"), null.alias("text"), own["ref"].alias("ref"))
        return F.when(F.startswith(token, F.lit("<")), other).otherwise(F.struct(F.lit("text").alias("type"), unescape(token).alias("text"), null.alias("ref")))

    def turn(piece: Column, i: Column) -> Column:
        cut = F.instr(piece, OPENED)
        role = F.substr(piece, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1)
        tokens = F.regexp_extract_all(F.substr(piece, cut + len(OPENED)), F.lit("(<[^>]*/>|[^<]+)"), F.lit(1))
        return F.struct(unescape(role, role=True).alias("role"), F.transform(tokens, lambda t: part(t, i)).alias("parts"))

    return F.transform(pieces, turn)


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """What stands under the loss mask, unescaped, with nothing between."""
    cut = lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return F.array_join(F.transform(spans, cut), "")
