"""Byte-level byte-pair encoding in linear time from a file of ranks, and decoding.

A piece's bytes are read as Latin-1 characters, so that one character is one byte and an
Aho-Corasick automaton over strings finds all vocabulary entries in it. The encoder walks
from the front, takes the longest entry at each place, and steps back to shorter ones where
two neighbours can't stand beside each other in a result of the merges. Whether they can
depends on the two entries alone and is remembered. No place is given up twice, so a piece
costs time in proportion to its length, also when it is the whole of a long text.

This gives the result of merging by rank if each longer entry comes from exactly one merge
of two earlier ones; the file is checked for that when it is read, and another one is an error.

Defined results: a null text counts as the empty one (no ids); null id lists decode to empty
bytes; ids outside the vocabulary and null ids inside a list are skipped; repeated rows give
repeated rows; other columns pass through, and one named like a result is replaced by it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lyraflux.llm.bpe import BYTE_LEVEL, newer_characters, tokenizer_path, with_column
from lyraflux.llm.common import keeps

#: Words, and as many pieces, whose ids a worker remembers. Bounds memory, not results.
CACHE_WORDS = 400_000
#: Pairs of neighbours whose verdict a worker remembers; then it starts anew. Bounds memory, not results.
CACHE_PAIRS = 500_000
#: Characters of the longest word or piece whose ids are remembered.
CACHE_LENGTH = 64

PIECES = regex.compile(BYTE_LEVEL)
#: A space before white space or the end, and one before anything else. The latter always begins a match of the split
#: pattern, and what stands before it splits in the same way whatever follows, so a text can be cut there.
ODD_SPACE, WORD_SPACE = re.compile(r" (?!\S)"), re.compile(r" (?=\S)")


def pieces(text: str) -> list[str]:
    """The matches of the split pattern, which cover the text."""
    if not text.isascii():
        newer, stand_in = newer_characters()
        if newer.search(text) is not None:
            return [text[m.start() : m.end()] for m in PIECES.finditer(text.translate(stand_in))]
    return PIECES.findall(text)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(entry): int(rank) for entry, rank in (line.split() for line in f if line.strip())}


class Kept(dict):
    """A function's results for short strings: the newest of them, and those before, which return when they are used again."""

    def __init__(self, made: Callable[[str], tuple[int, ...]]) -> None:
        self.made, self.older = made, {}

    def __missing__(self, text: str) -> tuple[int, ...]:
        found = self.older.get(text)
        if found is None:
            found = self.made(text)
            if len(text) > CACHE_LENGTH:
                return found
        if len(self) >= CACHE_WORDS // 2:
            self.older = self.copy()
            self.clear()
        self[text] = found
        return found


class Backtracker:
    """Ids of a piece, and of whole texts."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ids = {entry.decode("latin-1"): i for entry, i in ranks.items()}
        self.bytes_of = {i: entry for entry, i in ranks.items()}
        if missing := [b for b in range(256) if chr(b) not in self.ids]:
            raise ValueError(f"the ranks lack {len(missing)} single bytes")
        self.length = {i: len(entry) for i, entry in self.bytes_of.items()}
        #: by id, and an empty one at the end
        self.strings = np.array([self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 2)], object)
        self.pieces = Kept(lambda piece: self.encode_bytes(piece.encode("utf-8")))
        self.words = Kept(lambda word: tuple(chain.from_iterable(map(self.pieces.__getitem__, pieces(" " + word)))))
        self.verdicts: dict[tuple[int, int], bool] = {}
        #: the longest shorter entry that an entry begins with, the two that its merge puts together, and what a merge of two gives
        self.shorter: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for entry, i in sorted(self.ids.items(), key=lambda x: x[1]):
            self.shorter[i] = next((self.ids[entry[:k]] for k in range(len(entry) - 1, 0, -1) if entry[:k] in self.ids), -1)
        for entry, i in sorted(self.ids.items(), key=lambda x: x[1]):
            self._place(entry, i)
        self.automaton = ahocorasick.Automaton()
        for entry, i in self.ids.items():
            self.automaton.add_word(entry, (len(entry) - 1, i))
        self.automaton.make_automaton()

    def _place(self, entry: str, i: int) -> None:
        """Find the merge of two earlier entries that makes this one."""
        if len(entry) == 1:
            self.halves[i] = (i, i)
            return
        left = self.shorter[i]
        while left >= 0:
            right = self.ids.get(entry[self.length[left] :], i)
            if left < i and right < i and self._can_meet(left, right):
                self.halves[i] = (left, right)
                self.merged[left, right] = i
                return
            left = self.shorter[left]
        raise ValueError(f"no merge of earlier entries makes the one of rank {i}")

    def _can_meet(self, left: int, right: int) -> bool:
        """Whether the merges of the joined bytes leave a border here.

        Both sides are taken apart in the reverse order of their merges; a merge across the
        border that comes before the one just undone would have been made first.
        """
        limit = len(self.strings)
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            if left > right:
                limit, left = left, self.halves[left][1]
                if left == limit:
                    limit, right = right + 1, self.halves[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, self.halves[right][0]
                if right + 1 == limit:
                    limit, left = left, self.halves[left][1]
                    if left == limit:
                        return True

    def encode_bytes(self, raw: bytes) -> tuple[int, ...]:
        """Ids of one piece."""
        piece = raw.decode("latin-1")
        whole = self.ids.get(piece)
        if whole is not None:
            return (whole,)
        n, length, shorter = len(piece), self.length, self.shorter
        longest = [-1] * n
        for end, (back, i) in self.automaton.iter(piece):
            longest[end - back] = i  # a later end is a longer entry
        open_ends = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        verdicts, at, last, i = self.verdicts, 0, -1, longest[0] if n else -1
        while at < n:
            while i >= 0:
                if open_ends[end := at + length[i]]:
                    if last < 0:
                        break
                    meets = verdicts.get((last, i))
                    if meets is None:
                        if len(verdicts) >= CACHE_PAIRS:
                            verdicts.clear()
                        meets = verdicts[last, i] = self._can_meet(last, i)
                    if meets:
                        break
                i = shorter[i]
            if i >= 0:
                out.append(i)
                at, last = end, i
                i = longest[at] if at < n else -1
            else:  # nothing fits here: never come back, and shorten what stands before
                open_ends[at] = 0
                i = out.pop()
                at -= length[i]
                last = out[-1] if out else -1
        return tuple(out)

    def of(self, text: str) -> list[int]:
        first, *words = text.split(" ") if ODD_SPACE.search(text) is None else WORD_SPACE.split(text)
        out = list(chain.from_iterable(map(self.pieces.__getitem__, pieces(first))))
        out.extend(chain.from_iterable(map(self.words.__getitem__, words)))
        return out

    def decoded(self, lists: pa.Array) -> list[bytes]:
        """Bytes of each list; what isn't an id of the vocabulary has none."""
        ends = lists.offsets.to_numpy()
        flat = lists.values.fill_null(-1).to_numpy(zero_copy_only=False)
        strings = self.strings[np.where((flat < 0) | (flat >= len(self.strings)), len(self.strings) - 1, flat)].tolist()
        return [b"".join(strings[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


@lru_cache(maxsize=2)
def backtracker(path: str) -> Backtracker:
    return Backtracker(read_ranks(path))


keeps("backtrack", backtracker.cache_clear)


def id_lists(rows: list[list[int]]) -> pa.Array:
    """An Arrow array of lists of 32-bit ids."""
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(rows), np.int32, int(ends[-1]))))


def encode(df: DataFrame, text: str = "text", ranks: str = "byte_bpe_multi_50k.tiktoken", out: str = "ids") -> DataFrame:
    """``df`` with the token ids of each whole text; strings of special tokens are ordinary text."""

    def ids(texts: pa.Array) -> pa.Array:
        own = backtracker(tokenizer_path(ranks))
        return id_lists([own.of(t) if t else [] for t in texts.to_pylist()])

    return with_column(df, out, T.ArrayType(T.IntegerType(), True), text, ids, owner="backtrack")


def decode(df: DataFrame, ids: str = "ids", ranks: str = "byte_bpe_multi_50k.tiktoken", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids stand for."""

    def joined(lists: pa.Array) -> pa.Array:
        own = backtracker(tokenizer_path(ranks))
        return pa.array(own.decoded(lists), pa.binary())

    return with_column(df, out, T.BinaryType(), ids, joined, owner="backtrack")
