"""Alignment of two tokenizers over a corpus: groups of tokens that cover the same bytes, and how often two ids end together.

Each text is cut where tokens of both sides end. An id pair's count is the number of such ends
that it holds in all texts. Postings carry the multiplicity of a pair in each document: packed
lists by pair and block of documents go to the B id they belong to, where they meet the pair's
count and the id's highest one in a merge of two sorted streams, which spill. What a posting
adds goes back to its block and is summed by document.

Hot ids are dealt in several parts by block, as many as their postings ask for; counts are
summed before and after their shuffle. What is sent to every task is bounded by the B vocabulary.

Defined results: a null or empty text, and one whose tokens don't give back its bytes, has no
tokens: zeros, empty groups. Repeated rows are documents of their own and count each; null and
shared ids are kept. Other columns pass through; those named like a result are replaced.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lyraflux.llm.backtrack import Backtracker
from lyraflux.llm.bpe import BYTE_OF, tokenizer_path
from lyraflux.llm.common import SLICE_ROWS, arrow_map, begins, keeps, written

#: Posting lists of an id before it is dealt in another part.
SPLIT_LISTS = 20_000
#: Row numbers of a block of documents.
BLOCK_ROWS = 4_096
#: Characters of white space in a run that the library's pattern engine can't take.
LONG_RUN = 100_000

RESULTS = ("n_a", "n_b", "groups", "link_b", "link_a", "link_n")


def json_ranks(path: str) -> dict[bytes, int]:
    """The byte strings of a byte-level vocabulary and their ids, which have to ascend with the merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, specials = spec["model"]["vocab"], {t["content"] for t in spec["added_tokens"]}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    order = [vocab[a + b] for a, b in pairs]
    if any(x >= y for x, y in zip(order, order[1:])):
        raise ValueError("ids don't ascend with the merges")
    return {bytes(BYTE_OF[c] for c in entry): i for entry, i in vocab.items() if entry not in specials}


class ByteSide:
    """Tokens of the byte-level vocabulary (A) for a space and the text."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        self.ranks = json_ranks(path)
        self.entries = {i: entry for entry, i in self.ranks.items()}
        self.engine = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.own: Backtracker | None = None
        self.long_run = regex.compile(rf"\s{{{LONG_RUN}}}")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._long(t) if len(t) > LONG_RUN and self.long_run.search(t) else self.engine.encode_ordinary(t) for t in (" " + t for t in texts)]

    def _long(self, text: str) -> list[int]:
        if self.own is None:
            self.own = Backtracker(self.ranks)
        return self.own.of(text)


class PieceSide:
    """Tokens of the piece vocabulary (B), which puts the space in front itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.engine = sentencepiece.SentencePieceProcessor(model_file=path)
        named = self.engine.id_to_piece(list(range(self.engine.get_piece_size())))
        self.entries = {i: bytes([int(p[3:5], 16)]) if self.engine.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(named)}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.engine.encode(texts, num_threads=1)


class Sides:
    """Both vocabularies: bytes, lengths and decimal forms by id."""

    def __init__(self, a: str, b: str) -> None:
        self.a, self.b = ByteSide(a), PieceSide(b)
        self.bytes, self.lengths, self.forms = [], [], []
        for side, closes in ((self.a, "|"), (self.b, ";")):
            size = max(side.entries) + 1
            entries = [side.entries.get(i, b"") for i in range(size)]
            self.bytes.append(entries)
            self.lengths.append(np.array([len(x) for x in entries], np.int64))
            self.forms.append((np.array([f"{i}," for i in range(size)], object), np.array([f"{i}{closes}" for i in range(size)], object)))

    def aligned(self, raw: bytes, a: list[int], b: list[int]) -> tuple | None:
        """Groups as text and the ids of linked tokens; None if either side doesn't give the bytes."""
        if any(b"".join(map(entries.__getitem__, ids)) != raw for entries, ids in zip(self.bytes, (a, b))):
            return None
        ids = np.array(a, np.int64), np.array(b, np.int64)
        ends = [np.cumsum(length[i]) for length, i in zip(self.lengths, ids)]
        common = np.intersect1d(*ends, assume_unique=True)
        last = [np.searchsorted(e, common) for e in ends]
        group = [np.searchsorted(common, e) for e in ends]
        text = np.empty(len(a) + len(b), object)
        closes = [common[g] == e for g, e in zip(group, ends)]
        before_a = np.concatenate(([0], last[1] + 1))[group[0]]
        shown = [np.where(c, form[1][i], form[0][i]) for c, form, i in zip(closes, self.forms, ids)]
        text[np.arange(len(a)) + before_a] = shown[0]
        text[np.arange(len(b)) + last[0][group[1]] + 1] = shown[1]
        return "".join(text.tolist())[:-1], ids[0][last[0]], ids[1][last[1]]


@lru_cache(maxsize=1)
def sides(a: str, b: str) -> Sides:
    return Sides(a, b)


keeps("alignment", sides.cache_clear)


def align(df: DataFrame, text: str = "text", a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    """``df`` without its text: tokens of both sides (n_a, n_b), groups ``a1,a2|b1;a3|b2,b3``, and each linked id pair (link_b, link_a) with its multiplicity (link_n)."""
    kept = [c for c in df.columns if c not in (text, *RESULTS)]
    places, at = [df.columns.index(c) for c in kept], df.columns.index(text)
    ints = T.ArrayType(T.IntegerType())
    kinds = (T.LongType(), T.LongType(), T.StringType(), ints, ints, ints)
    schema = T.StructType([*(df.schema[i] for i in places), *(T.StructField(n, k) for n, k in zip(RESULTS, kinds))])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        begins("alignment")
        arrow = to_arrow_schema(schema)
        own = sides(tokenizer_path(a), tokenizer_path(b))
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), *_made(own, part.column(at).to_pylist())], schema=arrow)

    return arrow_map(df, run, schema)


def _made(own: Sides, texts: list[str | None]) -> list[pa.Array]:
    given = [i for i, t in enumerate(texts) if t]
    coded = dict(zip(given, zip(own.a.encode([texts[i] for i in given]), own.b.encode([texts[i] for i in given]))))
    counts, groups, ends, lists = [[], []], [], [0], [[], [], []]
    for i, t in enumerate(texts):
        found = own.aligned(b" " + t.encode(), *coded[i]) if i in coded else None
        for count, ids in zip(counts, coded[i] if found else ((), ())):
            count.append(len(ids))
        groups.append(found[0] if found else "")
        if found:
            key, n = np.unique(found[2] << 32 | found[1], return_counts=True)
            for out, values in zip(lists, (key >> 32, key & 0xFFFFFFFF, n)):
                out.append(values.astype(np.int32))
        ends.append(ends[-1] + (len(key) if found else 0))
    flat = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int32)) for x in lists]
    return [*(pa.array(c, pa.int64()) for c in counts), pa.array(groups, pa.string()), *(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in flat)]


POSTINGS = "b int, a int, block long, docs array<int>, times array<int>"


def postings(rows: DataFrame) -> DataFrame:
    """Lists of postings by pair from rows (row, link_b, link_a, link_n): a list for each pair and block of neighbouring documents, whose row is block + docs[i]."""

    def run(batches):
        begins("alignment")
        for batch in batches:
            row = batch.column(0).to_numpy()
            if not len(row):
                continue
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            b, a, n = (batch.column(k).flatten().to_numpy() for k in (1, 2, 3))
            # row numbers of one task are neighbours; a batch that spans more makes several blocks
            block = row - row % BLOCK_ROWS
            for one in np.unique(block):
                inside = np.repeat(block == one, lengths)
                doc = np.repeat(row - one, lengths)[inside].astype(np.int32)
                key = b[inside].astype(np.int64) << 32 | a[inside]
                order = np.argsort(key, kind="stable")
                key, doc, times = key[order], doc[order], n[inside][order]
                starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
                ends = pa.array(np.append(starts, len(key)).astype(np.int32))
                first = key[starts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((first >> 32).astype(np.int32)), pa.array((first & 0xFFFFFFFF).astype(np.int32)), pa.array(np.full(len(starts), one)), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (doc, times))],
                    names=["b", "a", "block", "docs", "times"],
                )

    return rows.select("row", "link_b", "link_a", "link_n").mapInArrow(run, POSTINGS)


def pair_counts(lists: DataFrame, split: int = SPLIT_LISTS) -> DataFrame:
    """Of each pair (b, a): its count in all documents, the highest count of its b, and in how many parts b is dealt."""
    held = F.aggregate("times", F.lit(0).cast("long"), lambda x, y: x + y)
    totals = lists.groupBy("b", "a").agg(F.sum(held).alias("count"), F.count(F.lit(1)).alias("lists"))
    of_b = Window.partitionBy("b")  # at most as many rows as A has ids
    return totals.select("b", "a", "count", F.max("count").over(of_b).alias("best"), (F.sum("lists").over(of_b) / F.lit(split) + 1).cast("int").alias("parts"))


def link_statistics(aligned: DataFrame, split: int = SPLIT_LISTS) -> DataFrame:
    """``aligned`` (from ``align``) with n_groups, n_links, n_best (links whose count is the highest of their B id) and count_sum (of the counts of all links)."""
    kept = [c for c in aligned.columns if c not in ("n_groups", "n_links", "n_best", "count_sum", "row")]
    rows = written(aligned.select(*(aligned[f"`{c}`"] for c in kept), F.monotonically_increasing_id().alias("row")))
    lists = written(postings(rows))
    counts = written(pair_counts(lists, split))
    hot = F.broadcast(counts.where("parts > 1").select("b", F.col("parts").alias("dealt")).distinct())  # at most as many rows as B has ids
    part = F.coalesce(F.pmod(F.xxhash64("block"), "dealt"), F.lit(0)).cast("int")
    dealt = lists.join(hot, "b", "left").withColumn("part", part).drop("dealt")
    known = counts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    met = dealt.join(known.hint("merge"), ["b", "part", "a"])
    # lists travel packed; once dealt by block, the sums of its documents need no other shuffle
    back = met.select("block", "docs", "times", "count", (F.col("count") == F.col("best")).alias("top")).repartition("block")
    each = back.select("block", F.explode(F.arrays_zip("docs", "times")).alias("p"), "count", "top")
    sums = each.groupBy("block", F.col("p.docs").alias("doc")).agg(
        F.sum(F.when(F.col("top"), F.col("p.times")).otherwise(0)).alias("n_best"), F.sum(F.col("p.times") * F.col("count")).alias("count_sum")
    ).withColumn("row", F.col("block") + F.col("doc"))
    links = F.aggregate("link_n", F.lit(0).cast("long"), lambda x, y: x + y)
    out = rows.withColumns({"n_groups": links, "n_links": links}).join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(*(rows[f"`{c}`"] for c in kept), zero("n_groups"), zero("n_links"), zero("n_best"), zero("count_sum"))
