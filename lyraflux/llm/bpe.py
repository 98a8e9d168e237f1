"""Byte-pair tokenizers read from public vocabulary files: token counts, encoding, decoding.

Both operators merge with a priority queue of merge ranks over a doubly linked list of
symbols. A queue entry whose pair no longer stands at its place is stale and skipped, so a
piece of n symbols costs O(n log n), also when one "word" is the whole of a long text.

Defined results: a null text counts as the empty one (0 tokens, empty id list); null ids
decode to the empty string; repeated rows give repeated rows; other columns of the input
pass through, and a column named like a result is replaced by it.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lyraflux.llm.common import SLICE_ROWS, arrow_map, begins, keeps

#: Words whose result a worker remembers; then it starts anew. Bounds memory, not results.
CACHE_WORDS = 250_000

#: White space as the tokenizers' patterns understand it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The split pattern of the byte-level tokenizer.
BYTE_LEVEL = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+"
    r"|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + r"]+"
)
#: The split pattern of the lower-casing word tokenizer.
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + SPACE + r"\p{L}\p{N}]+"


#: Letters and digits that Unicode 16.0 added. The tokenizers' patterns know them, and none of later versions.
ADDED_16 = (
    "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b 1138e 11390-113b5 113b7 113d1 113d3 11bc0-11be0 "
    "13460-143fa 16100-1611d 16d40-16d6c 18cff 1e5d0-1e5ed 1e5f0 10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"
)
#: Capital letters later than Unicode 15.1 (first, last) and what to add for the small one.
ADDED_CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1),
    (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)
ADDED_LOWER = {c: c + step for a, b, step in ADDED_CAPITALS for c in range(a, b + 1)}


@lru_cache(maxsize=1)
def newer_characters() -> tuple[regex.Pattern, dict[int, str]]:
    """Characters later than Unicode 15.1 that the pattern module counts as letters or digits, or that have small forms; and what stands for them.

    Those later than 16.0 are neither to the tokenizers: an exclamation mark takes their place while a text is split.
    """
    added = [[int(x, 16) for x in run.split("-")] for run in ADDED_16.split()]
    known = {c for run in added for c in range(run[0], run[-1] + 1)}
    found = []
    for start in range(0, 0x110000, 0x1000):  # surrogates are neither letters nor digits
        block = "".join(map(chr, range(start, start + 0x1000)))
        found += [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", block) if unicodedata.category(c) == "Cn"]
    runs: list[list[int]] = []
    for c in sorted({*found, *ADDED_LOWER}):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    inside = "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in runs)
    return regex.compile(f"[{inside}]"), dict.fromkeys((c for c in found if c not in known), "!")


def tokenizer_path(name: str) -> str:
    """A file's place: as given where it has a folder, else beside the public vocabularies."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in table)
    table.update({b: chr(256 + i) for i, b in enumerate(hidden)})
    return [table[b] for b in range(256)]


BYTE_SYMBOLS = _byte_symbols()
BYTE_OF = {c: b for b, c in enumerate(BYTE_SYMBOLS)}


class Merges:
    """Vocabulary, merge ranks and text rules of one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.specials.items()}
        self.lowers = spec.get("normalizer") is not None
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.pattern = regex.compile(WORD_LEVEL if self.lowers else BYTE_LEVEL)
        marks = "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))
        self.marks = regex.compile(f"({marks})") if marks else None

    def segments(self, text: str) -> list[str]:
        """Ordinary text at even places, special strings at odd ones."""
        if self.marks is None or "<|" not in text:
            return [text]
        return self.marks.split(text)

    def pieces(self, text: str) -> list[str]:
        if self.lowers:
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
            # str.lower() turns a final capital sigma into another letter; character by character it doesn't
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        if not text.isascii():
            newer, stand_in = newer_characters()
            if newer.search(text) is not None:
                text = text.translate(ADDED_LOWER) if self.lowers else text
                return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(stand_in))]
        return self.pattern.findall(text)

    def symbols(self, piece: str) -> list[str]:
        out = [BYTE_SYMBOLS[b] for b in piece.encode("utf-8")]
        out[-1] += self.suffix
        return out

    def text_of(self, ids: list[int]) -> str:
        """The vocabulary strings of the ids in order; ids outside the vocabulary are skipped."""
        found = [s for i in ids if (s := self.strings.get(i)) is not None]
        if not self.byte_decoder:
            return " ".join(found)
        raw = b"".join(
            s.encode("utf-8") if s in self.specials else bytes(BYTE_OF[c] for c in s) for s in found
        )
        return raw.decode("utf-8", errors="replace")

    def merge(self, sym: list[str | None]) -> int:
        """Merge ``sym`` in place (merged-away places become None); returns the number of merges."""
        ranks, n, done = self.ranks, len(sym), 0
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i) for i in range(n - 1) if (r := ranks.get((sym[i], sym[i + 1]))) is not None]
        heapify(queue)
        while queue:
            rank, i = heappop(queue)
            left, j = sym[i], after[i]
            if left is None or j >= n or ranks.get((left, sym[j])) != rank:
                continue  # stale: one of the two has been merged since
            sym[i], sym[j] = joined, _ = left + sym[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((joined, sym[k]))) is not None:
                    heappush(queue, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((sym[h], joined))) is not None:
                heappush(queue, (r, h))
            done += 1
        return done


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


class PieceCounts(dict):
    """Tokens of a piece: its initial symbols less the merges. No id is looked up."""

    def __init__(self, tokenizer: Merges) -> None:
        self.tokenizer = tokenizer

    def __missing__(self, piece: str) -> int:
        sym = self.tokenizer.symbols(piece)
        count = len(sym) - self.tokenizer.merge(sym)
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(piece) <= 64:
            self[piece] = count
        return count

    def of(self, text: str) -> int:
        total = 0
        for k, segment in enumerate(self.tokenizer.segments(text)):
            total += 1 if k % 2 else sum(map(self.__getitem__, self.tokenizer.pieces(segment)))
        return total


class PieceIds(dict):
    """Ids of a piece."""

    def __init__(self, tokenizer: Merges) -> None:
        self.tokenizer = tokenizer

    def __missing__(self, piece: str) -> tuple[int, ...]:
        sym = self.tokenizer.symbols(piece)
        self.tokenizer.merge(sym)
        ids = tuple(self.tokenizer.vocab[s] for s in sym if s is not None)
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def of(self, text: str) -> list[int]:
        out: list[int] = []
        for k, segment in enumerate(self.tokenizer.segments(text)):
            if k % 2:
                out.append(self.tokenizer.specials[segment])
            else:
                out.extend(chain.from_iterable(map(self.__getitem__, self.tokenizer.pieces(segment))))
        return out


@lru_cache(maxsize=4)
def piece_counts(path: str) -> PieceCounts:
    return PieceCounts(merges(path))


@lru_cache(maxsize=4)
def piece_ids(path: str) -> PieceIds:
    return PieceIds(merges(path))


def forget() -> None:
    for kept in (piece_counts, piece_ids, merges):
        kept.cache_clear()


keeps("bpe", forget)


def _slices(column: pa.Array):
    for start in range(0, len(column), SLICE_ROWS):
        yield column.slice(start, SLICE_ROWS).to_pylist()


def with_column(df: DataFrame, name: str, kind: T.DataType, source: str, fn, owner: str = "bpe") -> DataFrame:
    """``df`` with ``name`` made by ``fn`` from Arrow arrays of ``source``; rows stay where they are."""
    return with_columns(df, {name: kind}, source, lambda part: [fn(part)], owner)


def with_columns(df: DataFrame, kinds: dict[str, T.DataType], source: str, fn, owner: str = "bpe", without: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the columns of ``kinds`` made together by ``fn`` from Arrow arrays of ``source``, and without those named; rows stay where they are."""
    kept = [c for c in df.columns if c not in kinds and c not in without]
    at = df.columns.index(source)
    places = [df.columns.index(c) for c in kept]
    schema = T.StructType([*(df.schema[i] for i in places), *(T.StructField(name, kind, True) for name, kind in kinds.items())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        begins(owner)
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), *fn(part.column(at))], schema=arrow)

    return arrow_map(df, run, schema)


def token_counts(df: DataFrame, text: str = "text", tokenizer: str = "byte_bpe_50k.json", out: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of each whole text."""

    def count(texts: pa.Array) -> pa.Array:
        counts = piece_counts(tokenizer_path(tokenizer))
        return pa.array([counts.of(t) if t else 0 for t in texts.to_pylist()], pa.int64())

    return with_column(df, out, T.LongType(), text, count)


def _ids_of(texts: pa.Array, tokenizer: str) -> pa.ListArray:
    table = piece_ids(tokenizer_path(tokenizer))
    rows = [table.of(t) if t else [] for t in texts.to_pylist()]
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    flat = np.fromiter(chain.from_iterable(rows), np.int32, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _texts_of(lists: pa.ListArray, tokenizer: str) -> pa.Array:
    own = merges(tokenizer_path(tokenizer))
    ends = lists.offsets.to_numpy().tolist()
    flat = lists.values.to_numpy(zero_copy_only=False)
    made = [own.text_of(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return pa.array(made, pa.string())


def encode(df: DataFrame, text: str = "text", tokenizer: str = "word_bpe_49k.json", out: str = "ids") -> DataFrame:
    """``df`` with the token ids of each whole text, without added special tokens."""
    return with_column(df, out, T.ArrayType(T.IntegerType(), True), text, lambda texts: _ids_of(texts, tokenizer))


def decode(df: DataFrame, ids: str = "ids", tokenizer: str = "word_bpe_49k.json", out: str = "decoded") -> DataFrame:
    """``df`` with the vocabulary strings of the ids, joined as the file's decoder joins them."""
    return with_column(df, out, T.StringType(), ids, lambda lists: _texts_of(lists, tokenizer))


def codec(df: DataFrame, text: str = "text", tokenizer: str = "word_bpe_49k.json", ids: str = "ids", decoded: str = "decoded", without: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the token ids of each whole text and what they decode to, as ``encode`` and ``decode`` give them.

    Both are made in one Arrow map: two in a row hold two Python workers a core, each with a vocabulary of its own.
    """

    def both(texts: pa.Array) -> list[pa.Array]:
        lists = _ids_of(texts, tokenizer)
        return [lists, _texts_of(lists, tokenizer)]

    return with_columns(df, {ids: T.ArrayType(T.IntegerType(), True), decoded: T.StringType()}, text, both, without=without)
