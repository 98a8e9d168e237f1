"""Cross-tokenizer alignment against plain loops over the libraries' own tokens."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lyraflux.llm import alignment, catalog
from lyraflux.llm.bpe import BYTE_OF

from .conftest import edge_rows


def plain(texts):
    """For each text: tokens by both libraries, groups, links, then counts over all texts."""
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    done = []
    for t in texts:
        ids_a = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        raw_a = [bytes(BYTE_OF[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not t or b"".join(raw_a) != b"".join(raw_b) or b"".join(raw_a) != (" " + t).encode():
            done.append((0, 0, "", []))
            continue
        ends = []
        for raw in (raw_a, raw_b):
            at, places = 0, {}
            for k, x in enumerate(raw):
                at += len(x)
                places[at] = k
            ends.append(places)
        groups, links, i, j = [], [], 0, 0
        for end in sorted(ends[0].keys() & ends[1].keys()):
            x, y = ends[0][end], ends[1][end]
            groups.append(",".join(map(str, ids_a[i : x + 1])) + "|" + ",".join(map(str, ids_b[j : y + 1])))
            links.append((ids_b[y], ids_a[x]))
            i, j = x + 1, y + 1
        done.append((len(ids_a), len(ids_b), ";".join(groups), links))
    counts = Counter(p for d in done for p in d[3])
    best = defaultdict(int)
    for (y, _), n in counts.items():
        best[y] = max(best[y], n)
    return [
        (na, nb, len(links), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for na, nb, g, links in done
    ]


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_awkward_rows(spark, folders):
    rows = edge_rows()
    wanted = plain([r[1] for r in rows])
    found = catalog.op13_tokenizer_alignment(spark, folders["edge"]).collect()
    shown = lambda x: sorted(x, key=repr)
    assert shown((r["doc_id"], *(r[f] for f in FIELDS)) for r in found) == shown((r[0], *w) for r, w in zip(rows, wanted))


@pytest.mark.parametrize("split", [1, 3, 20_000])
def test_whole_table_in_any_number_of_parts(spark, split):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(3)
    rows = docs.collect()
    made = alignment.align(docs)
    made = made.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")
    found = {r["doc_id"]: tuple(r[f] for f in FIELDS) for r in alignment.link_statistics(made, split).collect()}
    assert found == {r["doc_id"]: w for r, w in zip(rows, plain([r["text"] for r in rows]))}


def test_clashing_columns_pass(spark):
    df = spark.createDataFrame([("hello world", 1, "x", 2.0), (None, 2, "y", None)], "text string, row long, `a.b` string, n_best double")
    out = alignment.link_statistics(alignment.align(df)).orderBy("n_a").collect()
    assert [r["a.b"] for r in out] == ["y", "x"] and [r["n_links"] for r in out] == [0, 2] and [r["n_best"] for r in out] == [0, 2]


def test_strange_texts():
    own = alignment.sides(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    texts = ["a\0b", "<s> x </s> <unk> <0x41>", "▁ a", "tab\tnew\nline", "<|endoftext|>", " lead", "ﬁ ① é 😀", "trail  "]
    made = alignment._made(own, texts)
    assert [(a.as_py(), b.as_py()) for a, b in zip(made[0], made[1])] == [w[:2] for w in plain(texts)]
    # a run of white space that the library's engine can't take
    text = "x" + " " * 1_200_000 + "y"
    assert b"".join(own.a.entries[i] for i in own.a.encode([text])[0]) == (" " + text).encode()
    short = "x" + " " * 100_001 + "y z"
    assert own.a.encode([short])[0] == own.a.engine.encode_ordinary(" " + short)


def test_tokens_of_every_code_point():
    side = alignment.ByteSide(P.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["\n".join(f"a{c}1{c} {c}" for c in points[k : k + 8192]) for k in range(0, len(points), 8192)]
    assert side.encode(texts) == [library.encode(" " + t, add_special_tokens=False).ids for t in texts]
