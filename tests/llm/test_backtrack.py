"""Linear-time byte-pair encoding against the library."""

import random
import time

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from lyraflux.llm import backtrack


@pytest.fixture(scope="module")
def both():
    ranks = backtrack.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return backtrack.Backtracker(ranks), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_pieces(both):
    own, library = both
    rng, entries = random.Random(5), list(own.bytes_of.values())
    for k in range(6000):
        raw = b"".join(rng.choice(entries) for _ in range(rng.randint(1, 6))) if k % 2 else bytes(rng.choice(b"aabn \xc3\xa9\xe4\xb8") for _ in range(rng.randint(1, 60)))
        assert list(own.encode_bytes(raw)) == library._core_bpe.encode_single_piece(raw)
        assert own.decoded(pa.array([own.encode_bytes(raw)], pa.list_(pa.int32()))) == [raw]


def test_white_space_anywhere(both):
    own, library = both
    rng = random.Random(8)
    for _ in range(4000):
        text = "".join(rng.choice([" ", " ", "  ", "\n", "\t", "\xa0", "\u3000", "\x1c", "\x85", "a", "Bé", "'s", "12", "½", "!", "東"]) for _ in range(rng.randint(1, 25)))
        assert own.of(text) == library.encode_ordinary(text)


def test_every_code_point(both):
    own, library = both
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 8192):
        text = "\n".join(f"a{c}1 {c}!" for c in points[k : k + 8192])
        assert own.of(text) == library.encode_ordinary(text)


def test_time_follows_length(both):
    own, seconds = both[0], []
    for n in (50_000, 400_000):
        began = time.perf_counter()
        own.encode_bytes(b"ab" * n)
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 24 * seconds[0]


def test_texts_null_ids_and_clashing_columns(spark, both):
    texts = [None, "", "one two", "one two", "<|endoftext|> ok", "é東京 😀" * 500, "x" * 30_000]
    df = spark.createDataFrame([(i, t, f"k{i}", i) for i, t in enumerate(texts)], "doc_id long, text string, `a.b` string, ids int").repartition(2)
    coded = backtrack.encode(df)
    rows = backtrack.decode(coded).orderBy("doc_id").collect()
    assert [list(r["ids"]) for r in rows] == [both[1].encode_ordinary(t or "") for t in texts]
    assert [bytes(r["decoded"]) for r in rows] == [(t or "").encode() for t in texts] and rows[3]["a.b"] == "k3"
    odd = spark.createDataFrame([([64, None, 10**6],), (None,)], "ids array<int>")
    assert sorted(bytes(r["decoded"]) for r in backtrack.decode(odd).collect()) == [b"", both[0].bytes_of[64]]


def test_other_rank_files_are_refused():
    singles = {bytes([b]): b for b in range(256)}
    with pytest.raises(ValueError, match="no merge"):
        backtrack.Backtracker({**singles, b"abc": 256})
    with pytest.raises(ValueError, match="single bytes"):
        backtrack.Backtracker({b"a": 0})
    assert backtrack.Backtracker({**singles, b"ab": 256, b"abc": 257}).encode_bytes(b"abcab") == (257, 256)
