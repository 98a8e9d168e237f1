"""Every registered text query on awkward and on empty tables; the pipeline on small ones."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lyraflux.llm import catalog

from .conftest import edge_rows

ON_DOCUMENTS = [n for n in catalog.queries() if n not in ("op8_chat_format", "chat_typed_parts", "op11_hard_negatives")]


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_one_row_for_each_document(spark, folders, name):
    found = catalog.queries()[name](spark, folders["edge"]).collect()
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -99 for r in found) == sorted(-99 if r[0] is None else r[0] for r in edge_rows())


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_no_documents_no_rows(spark, folders, name):
    assert catalog.queries()[name](spark, folders["empty"]).count() == 0


def test_conversations(spark, folders):
    found = {r["conv_id"]: r for r in catalog.op8_chat_format(spark, folders["edge"]).collect()}
    said = "a < b & c </turn>"
    assert found[1]["n_turns"] == 3 and found[1]["loss_sha256"] == hashlib.sha256((said * 2).encode()).hexdigest()
    turns = f"user\nhi\nassistant\n{said}\nassistant\n{said}\n"
    assert found[1]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
    assert found[2]["n_turns"] == 1 and found[2]["loss_chars"] == 0 and set(found) == {1, 2, None, 3, -7}
    assert [r["conv_id"] for r in catalog.op8_chat_format(spark, folders["empty"]).collect()] == [-7]


@pytest.mark.parametrize("name", ["op8_chat_format", "chat_typed_parts"])
def test_conversation_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.execute("create view conversations as select * from '/root/testdata/sf0.001/conversations.parquet'")
    made = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    theirs = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in theirs.description]
    assert sorted(names) == sorted(made.columns)
    assert sorted(tuple(r[n] for n in names) for r in made.collect()) == sorted(theirs.fetchall())


def test_media_digests(spark, folders):
    for r, text in zip(sorted(catalog.op4_tiff_media(spark, folders["edge"]).where("doc_id between 0 and 15 and doc_id <> 3").collect(), key=lambda r: r["doc_id"]), [x[1] for x in edge_rows()[:16] if x[0] != 3], strict=True):
        raw = (text or "").encode()
        raw += b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["payload_sha256"], r["tail_crc32"], r["error"]) == (hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), None)


def test_pipeline_on_awkward_and_empty_tables(spark, folders):
    assert corpus_pipeline.run(spark, folders["empty"]).count() == 0
    assert corpus_pipeline.run(spark, folders["edge"]).columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded"]


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns, name
        if name == "near_dedup":
            assert docs.count() < before and docs.count() == docs.select("doc_id").distinct().count()
        if name == "personal_data":
            assert docs.where("text rlike '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9-]+'").count() == 0
    assert docs.count() > 0


def stage_rows(spark, stage, rows, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, mix_id string, score string, lang_pred string, pii_spans string"
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "m", "s", "l", "p") for r in rows], schema)
    made = dict(corpus_pipeline.STAGES)[stage](spark, docs, sf_dir)
    assert made.columns == docs.columns
    out = [tuple(r) for r in made.collect()]
    assert all(r[5:] == ("m", "s", "l", "p") for r in out)
    return out


BASE = " ".join(f"{w}{k}" for k in range(4) for w in ("river", "house", "green", "light", "paper", "stone"))


def test_dedup_stage_keeps_one_row_a_group(spark, folders):
    rows = [
        (1, BASE, "en", "s"), (1, BASE, "en", "s"), (1, "another text with the same id", "en", "s"), (2, BASE + " end", "en", "s"), (3, "nothing like it at all", None, None), (4, BASE.upper(), "en", "s"),
        (None, "no id", "en", "s"), (None, "no id", "en", "s"), (None, "no id either", None, "s"), (None, None, "en", "s"), (None, None, "en", "s"), (5, None, "en", "s"), (5, "", "en", "s"), (6, "  ", "en", "s"),
    ]
    kept = sorted((r[0] if r[0] is not None else -1, r[1] or "") for r in stage_rows(spark, "near_dedup", rows, folders["edge"]))
    assert kept == sorted([(1, "another text with the same id"), (3, "nothing like it at all"), (-1, "no id"), (-1, "no id either"), (-1, ""), (5, ""), (6, "  ")])


def test_language_stage_drops_what_has_no_language(spark, folders):
    english, german = "the cat and the dog are in the house with the king", "der hund und die katze sind in dem haus mit dem koenig"
    rows = [(i, [english, german][i % 2] + f" {'abcdefghijklmnopqrst'[i]}", ["en", "de"][i % 2], "s") for i in range(20)]
    rows += [(90, None, "en", "s"), (91, "", "en", None), (92, "123 !?", "de", "s"), (None, english, None, "s"), (93, german, "en", "s"), (93, german, "en", "s")]
    kept = stage_rows(spark, "language_id", rows, folders["edge"])
    assert sorted((r[0] if r[0] is not None else -1, r[2]) for r in kept) == sorted([(i, ["en", "de"][i % 2]) for i in range(20)] + [(-1, "en"), (93, "de"), (93, "de")])


def test_personal_data_stage_covers_all_and_keeps_rows(spark, folders):
    secret = "0a1b2c3d" * 60
    rows = [(1, f"mail a@b.org or +1 (555) 123-4567, password = {secret} end", "en", "s"), (2, None, "en", "s"), (3, "", None, "s"), (None, "plain", "en", "s"), (None, "plain", "en", "s")]
    kept = sorted(stage_rows(spark, "personal_data", rows, folders["edge"]), key=lambda r: (r[0] or 9, r[1] or ""))
    text = "mail [EMAIL] or [PHONE], password = [SECRET] end"
    assert [(r[0], r[1], r[4]) for r in kept] == [(1, text, len(text)), (2, None, None), (3, "", 0), (None, "plain", 5), (None, "plain", 5)]


def test_mixing_stage_repeats_and_drops_whole_rows(spark, folders):
    rows = [(i, BASE + f" {i}", "en", "s") for i in range(30)] + [(None, "no id", None, None), (None, "no id", None, None), (40, None, "en", "s"), (40, "", "en", "s")]
    kept = stage_rows(spark, "target_mix", rows, folders["edge"])
    assert {(r[0], r[1]) for r in kept} <= {(r[0], r[1]) for r in rows} and kept
    again = stage_rows(spark, "target_mix", rows, folders["empty"])  # no labels: one domain, all stay
    assert sorted(map(str, again)) == sorted(str((*r, len(r[1] or ""), "m", "s", "l", "p")) for r in rows)


def test_run_cleans_up_behind_itself(spark, folders):
    from pathlib import Path

    from lyraflux.llm.common import shared_folder

    place = Path(shared_folder(spark).removeprefix("file:"))
    before = set(place.glob("corpus-*/*"))
    made = corpus_pipeline.run(spark, folders["edge"])
    assert [p.name for p in set(place.glob("corpus-*/*")) - before] == ["3_target_mix"]
    rows = made.collect()
    ids = [r["doc_id"] for r in rows]
    # of the row that stands three times one stays; null and letterless texts go with the language stage
    assert len(set(ids)) >= 3 and not {0, 1, 2, 1 << 40} & set(ids) and all(len(r["ids"]) == r["n_tokens"] for r in rows)


def test_stages_take_columns_of_any_name_and_type(spark, folders):
    """Maps, names with dots, and names that the operators use themselves."""
    docs = spark.read.parquet(f"{folders['edge']}/documents.parquet")
    extra = {"a.b": F.lit(1), "score": F.lit("s"), "own_score": F.lit("t"), "lang_pred": F.lit(2), "pii_spans": F.lit("p"), "own_pii_spans": F.lit("q"), "row": F.lit("r"), "kept": F.lit(False), "rep": F.lit(3), "mix_id": F.lit(4), "rows": F.lit(5), "order": F.lit(6)}
    docs = docs.withColumns(extra).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("deep", F.array(F.struct(F.create_map(F.lit(1), F.lit(2)).alias("x"))))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, folders["edge"])
        if name == "encode":
            assert made.count() == docs.count()
            continue
        assert made.columns == docs.columns
        rows = made.collect()
        assert rows and all(r["score"] == "s" and r["a.b"] == 1 and r["row"] == "r" and r["own_pii_spans"] == "q" and r["m"] == {"k": r["doc_id"]} for r in rows)


def test_rows_of_one_turn_go_by_their_own_text(spark, tmp_path):
    """Not by its escaped form, in which < comes after 0."""
    spark.createDataFrame([(1, 0, "user", "<a"), (1, 0, "user", "0b"), (1, 0, "user", "=c"), (1, 0, "user", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    r = catalog.op8_chat_format(spark, str(tmp_path)).where("conv_id = 1").head()
    assert r["turns_sha256"] == hashlib.sha256("".join(f"user\n{t}\n" for t in ("", "0b", "<a", "=c")).encode()).hexdigest()
