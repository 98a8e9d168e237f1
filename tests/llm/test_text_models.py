"""Tokenizers against their library, near duplicates and fingerprints against brute force, models on held-out rows."""

import hashlib
import math
import random
import warnings

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lyraflux.llm import bpe, catalog, chat, common, fingerprint, langid, mixing, neardup, pii, toxicity

from .conftest import WORDS, edge_rows

ODD = [
    "don't  stop\n\n  now   x y", "ÀÉÎ õ ß ﬁ", "१२३ 4567 ½", "a" * 3000, "!!!??? --- ...", "\r\n\t ", "é café", "<|endoftext|>", "x<|endoftext|>y <|startoftext|>",
    "ΣΑΣ İI ı", "👩‍👩‍👧 🇩🇪", "​﻿", "'s 'LL I'Ve", "\x00\x01 \x1c \x85",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokenizers_agree_with_the_library(spark, name):
    rng = random.Random(3)
    texts = ODD + [r[1] or "" for r in edge_rows()] + ["".join(rng.choice("abc ABC'.,\n\té😀1") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    library = Tokenizer.from_file(bpe.tokenizer_path(name))
    library.no_truncation(), library.no_padding()
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit("clash"))
    rows = sorted(bpe.decode(bpe.token_counts(bpe.encode(df, tokenizer=name), tokenizer=name), tokenizer=name).collect(), key=lambda r: r["i"])
    for r, t, ids in zip(rows, texts, expected, strict=True):
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == library.decode(ids, skip_special_tokens=False), repr(t)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_code_point_between_letters_and_digits(name):
    library, own = Tokenizer.from_file(bpe.tokenizer_path(name)), bpe.piece_ids(bpe.tokenizer_path(name))
    library.no_truncation(), library.no_padding()
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}b1{chr(c)}1" for c in points[k : k + 500]) for k in range(0, len(points), 500)]
    for k, (text, found) in enumerate(zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True)):
        if own.of(text) != found.ids:
            wrong = [hex(c) for c in points[500 * k : 500 * k + 500] if own.of(f"a{chr(c)}b1{chr(c)}1") != library.encode(f"a{chr(c)}b1{chr(c)}1", add_special_tokens=False).ids]
            raise AssertionError(wrong or "only together")


def words_of(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def brute_components(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets.setdefault(i, []).append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and any(100 * len(a & b) >= percent * len(a | b) > 0 and a & b for a in sets[x] for b in sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("region_rows, window", [(1024, 16), (6, 1), (6, 3)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, region_rows, window):
    monkeypatch.setattr(neardup, "REGION_ROWS", region_rows)
    rng, rows = random.Random(11), []
    for group in range(6):
        base = [rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(rng.choice([30, 60, 120]))]
        for _ in range(14):
            own = list(base)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = f"new{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows), rows[0][1].upper()), (len(rows) + 1, None), (len(rows) + 2, " "), (len(rows) + 3, "one"), (len(rows) + 4, "ONE"), (3, rows[3][1])]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=5, percent=80, window=window).collect()
    expected = brute_components(rows, 5, 80)
    assert {r["doc_id"]: r["component_id"] for r in found} == expected
    assert len(found) == len(rows) and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def crowded(pairs):
    """Two texts a pair around one passage, 0.765 alike; each has one partner of exactly 0.8."""
    passage, rows = [f"p{k}" for k in range(82)], []
    for pair in range(pairs):
        both = [f"b{pair}_{k}" for k in range(2)]
        rows += [(2 * pair + own, " ".join([f"o{pair}_{own}_{k}" for k in range(10)] + both + passage)) for own in (0, 1)]
    return rows


@pytest.mark.parametrize("window", [1, 16])
def test_crowded_regions_lose_no_link(spark, monkeypatch, window):
    monkeypatch.setattr(neardup, "REGION_ROWS", 16)
    rows = crowded(150)
    expected = brute_components(rows, 5, 80)
    assert expected == {i: i - i % 2 for i in range(300)}
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=5, percent=80, window=window).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == expected


def test_neighbours_of_a_sorted_order_and_its_borders(spark):
    rows = crowded(40) + [(1000 + i, " ".join(f"{i}x{k}" for k in range(30))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = neardup.features(docs, 5).selectExpr("doc_id as rep", "n_shingles as n", "doc_id as comp", "signature").cache()
    labels = {r["rep"]: [bytes(r["signature"][32 * t : 32 * t + 32]) for t in range(neardup.TREES)] for r in signed.collect()}
    prefix = lambda x, y: next((d for d in range(8) if x[4 * d : 4 * d + 4] != y[4 * d : 4 * d + 4]), 8)
    for window in (1, 3):
        expected, again = set(), set()
        for t in range(neardup.TREES):
            order = sorted(labels, key=lambda r: (labels[r][t], r))
            for at, r in enumerate(order):
                near = [q for q in order[max(0, at - window) : at] if prefix(labels[q][t], labels[r][t]) >= 2]
                expected |= {(min(q, r), max(q, r)) for q in near}
            again |= {r for at, r in enumerate(order) for lo in range(max(0, at - window - 1), at + 1) if lo + window + 1 < len(order) and prefix(labels[order[lo]][t], labels[order[lo + window + 1]][t]) >= 2}
        pairs, left = neardup.nearest_pairs(signed, 80, window)
        found, left = {tuple(r) for r in pairs.collect()}, {r["id"] for r in left.collect()}
        # a candidate a row and tree; whoever has more, or lies in a run longer than the window, is looked at again
        assert found <= expected and (found == expected or window > 1) and again <= left
        assert all(a in left and b in left for a, b in expected - found)
        assert {b for _, b in expected} | {a for a, _ in expected} == {x for p in found for x in p} | (left & {x for p in expected for x in p})


@pytest.mark.parametrize("border_rows", [16, 60, None])
def test_windows_across_many_borders_are_all_seen(spark, border_rows):
    label, sketch, window, n = b"\0" * 4 * neardup.DEPTH, b"\0" * (neardup.VALUES // 2), 3, 900
    rows = spark.createDataFrame([(0, label, i, 1, i, sketch) for i in range(n)], neardup.ORDERED)

    def look(part, first):
        at = [(i - back, i) for back in range(1, window + 1) for i in range(max(first, back), part.rows)]
        i, j = np.array(at, int).reshape(-1, 2).T
        return [(neardup.PAIR, part.rep[i], part.rep[j])]

    ordered = rows.repartitionByRange(70, *neardup.ORDER).sortWithinPartitions(*neardup.ORDER)
    found = [tuple(r) for r in neardup.scanned(ordered, look, window, border_rows).select("a", "b").collect()]
    assert {(i, j) for j in range(n) for i in range(max(0, j - window), j)} <= set(found)
    # a border costs at most its own rows once more a level
    assert len(found) <= 3 * window * n


def test_joining_looks_at_all_pairs():
    rng = np.random.default_rng(5)
    for _ in range(30):
        base = rng.integers(0, 1 << 60, 60)
        sets = []
        for _ in range(12):
            own = base.copy()
            own[rng.permutation(60)[: rng.integers(0, 14)]] = rng.integers(0, 1 << 60, 1)
            sets.append(np.unique(own).astype(np.uint64))
        links = neardup._joining(sets, np.arange(12), 80)
        root = np.arange(12)
        for i in range(12):
            for j in range(12):
                if neardup._similar(sets[i], sets[j], 80):
                    root[root == root[j]] = root[i]
        mine = np.arange(12)
        for i, j in links:
            mine[mine == mine[j]] = mine[i]
        assert len(links) < 12 and (len(set(mine)) == len(set(root)))


def brute_hashes(text):
    words, hashes = [w for w in words_of(text)], set()
    for k in range(max(1, len(words) - 4) if words else 0):
        h = 42
        for w in words[k : k + 5]:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        hashes.add(h - (1 << 64) if h >= 1 << 63 else h)
    return hashes, max(1, len(words) - 4) if words else 0


def brute_kept(hashes):
    return sorted(h for h in hashes if h < fingerprint.highest_kept()) or sorted(hashes)[:1]


def brute_sketch(text):
    return brute_kept(brute_hashes(text)[0])


def fold(rows):
    """Documents in falling order of their ids, each with the next one."""
    signed = lambda t: (h := xxhash.xxh64_intdigest((3).to_bytes(4, "little"), seed=xxhash.xxh64_intdigest(t.encode(), seed=42))) - (1 << 64 if h >= 1 << 63 else 0)
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1] or ""), r[1] or ""))
    return [(*r, rows[(k + 1) % len(rows)][1] or "") for k, r in enumerate(rows)]


@pytest.mark.parametrize("parts", ["4", "1", "60"])
@pytest.mark.parametrize("hot", [False, True])
def test_fingerprints_equal_brute_force(spark, tmp_path, parts, hot):
    rng = random.Random(2)
    make = lambda: " ".join(rng.choice(WORDS) + str(rng.randint(0, 2)) for _ in range(rng.choice([0, 3, 10, 40, 200])))
    rows = [(i * 7 % 101 * (1 << rng.randint(0, 40)), make()) for i in range(60)]
    rows = list(dict(rows).items()) + [(None, "no id at all")]
    if hot:  # an id and null that hold a third of all rows each, and an empty text
        rows += [(7, make() + f" {i}") for i in range(60)] + [(None, make() + f" {i}") for i in range(60)] + [(8, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = catalog.op3_scaled_sketch(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    hexed = lambda hs: "".join(f"{h % (1 << 64):016x}" for h in hs)
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    expected = []
    for i, text, following in fold(rows):
        text = text or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        low = {t: set(brute_sketch(t)) for t in (text, edited, following)}
        like = lambda a, b: jaccard(low[a], low[b])  # noqa: B023, E731
        a, b = low[text], low[following]
        ranged = [any(h < fingerprint.highest_kept() for h in x) for x in (a, b)]
        inside = float(not b) if not a else len(a & b) / len(a) if ranged[0] or not ranged[1] else None
        union = brute_kept(a | b)
        expected.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed(brute_sketch(text)), hexed(brute_sketch(edited)), like(text, edited), like(text, following), inside, len(union), hashlib.sha256(hexed(union).encode()).hexdigest()))
    names = "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next inside_next merged_hashes merged_sha256".split()
    text_of = lambda rows: sorted(tuple(f"{v:.9f}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert text_of([r[n] for n in names] for r in found) == text_of(expected)


def test_buckets_of_a_hot_id_are_many(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 5).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    placed, _ = fingerprint.with_following(rows.unionByName(rows.select(F.lit(None).cast("long").alias("doc_id"), "text")))
    sizes = placed.where("extra = 0").groupBy("bucket").count()
    assert sizes.agg(F.max("count")).first()[0] < 700


def test_likeness_containment_and_merging(spark):
    long, part = [f"w{k}" for k in range(4000)], [f"w{k}" for k in range(1000)]
    df = spark.createDataFrame([(" ".join(long), " ".join(part), " ".join(long[3000:]))], "a string, b string, c string").withColumns({"sa__words": F.lit("clash"), "sa__hashes": F.lit("clash")})
    for c in "abc":
        df = fingerprint.with_sketch(df, F.col(c), f"s{c}")
    assert df.first()["sa__words"] == df.first()["sa__hashes"] == "clash"
    none = F.array().cast("array<bigint>")
    r = df.select(
        fingerprint.likeness(F.col("sa"), F.col("sb")).alias("like"), fingerprint.containment(F.col("sb"), F.col("sa")).alias("inside"),
        fingerprint.containment(fingerprint.merged(F.col("sb"), F.col("sc")), F.col("sa")).alias("both"), fingerprint.likeness(none, none).alias("none"),
    ).first()
    assert abs(r["like"] - 0.25) < 0.06 and r["inside"] == 1.0 and r["both"] > 0.99 and r["none"] == 1.0


def test_equal_texts_are_alike_whatever_they_repeat(spark):
    """Each text twice in a row: likeness 1, one fingerprint; different texts with words don't share one."""
    texts = [" ".join([f"w{k}"] * 500) for k in range(8)] + ["\n".join([" ".join(f"l{k}x{j}" for j in range(12))] * 40) for k in range(100)] + ["one", "two words", "", None]
    docs = spark.createDataFrame([(2 * i + j, t) for i, t in enumerate(texts) for j in (0, 1)], "doc_id long, text string")
    made = fingerprint.fingerprints(docs)
    found = {r["doc_id"]: r for r in made.select("doc_id", fingerprint.as_text(F.col("sketch")).alias("print"), fingerprint.likeness(F.col("sketch"), F.col("next_sketch")).alias("next")).collect()}
    # the one of the greater id is followed by its copy
    assert all(found[2 * i + 1]["next"] == 1.0 and found[2 * i + 1]["print"] == found[2 * i]["print"] for i in range(len(texts)))
    assert len({found[2 * i]["print"] for i in range(len(texts) - 2)}) == len(texts) - 2 and "" not in {found[2 * i]["print"] for i in range(len(texts) - 2)}


def test_a_passage_is_never_said_to_be_outside_its_text(spark):
    long = [f"w{k}" for k in range(3000)]
    rows = [(" ".join(long[at : at + n]),) for n in (5, 6, 8, 10, 40, 80) for at in range(0, 2900, 29)]
    df = spark.createDataFrame(rows, "part string").withColumn("whole", F.lit(" ".join(long)))
    df = fingerprint.with_sketch(fingerprint.with_sketch(df, F.col("part"), "p"), F.col("whole"), "w")
    inside = fingerprint.containment(F.col("p"), F.col("w"))
    said = [r[0] for r in df.select(inside).collect()]
    assert set(said) == {1.0, None} and said.count(1.0) > 250


def test_rates_meet_the_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["zzz", "kaz"] if i % 5 == 0 else ["tea", "hot"]) for _ in range(rng.randint(5, 60))), "z" if i % 5 == 0 else "t") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    wanted = lambda names, totals: [0.5 * sum(totals)] * 2
    rates = mixing.document_rates(docs.select("doc_id", "text"), docs.where("doc_id % 3 = 0").select("doc_id", "domain"), wanted).cache()
    assert rates.where("rate < 0").count() == 0 and rates.count() == 400
    total = sum(len(t.split()) for _, t, _ in rows)
    for r in rates.groupBy("domain").agg(F.sum(F.col("rate") * F.col("n_tokens")).alias("got")).collect():
        assert abs(r["got"] / (total / 2) - 1) < 0.05
    copies = mixing.resampled(docs, rates)
    assert copies.columns == docs.columns and copies.count() == rates.agg(F.sum("copies")).first()[0]
    alone = mixing.document_rates(docs, docs.limit(0).select("doc_id", "domain"))
    assert alone.select("domain").distinct().collect()[0][0] == "all"


def test_resampling_takes_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a", 7, 8), (2, "b", 9, 9), (None, "c", 1, 1)], "doc_id long, text string, mix_id long, `row.x` long")
    rates = spark.createDataFrame([(1, 2), (2, 0), (None, 1)], "doc_id long, copies int")
    made = mixing.resampled(docs, rates)
    assert made.columns == docs.columns and sorted(r["text"] for r in made.collect()) == ["a", "a", "c"]


def domain_docs(spark, domains, n=300):
    rng = random.Random(9)
    letters = "e a o n s t h w k z u q y".split()
    words = {d: [letters[(d + j) % 13] * rng.randint(1, 3) + rng.choice("abc") for j in range(4)] for d in range(domains)}
    rows = [(i, " ".join(rng.choice(words[i % domains] + ["tea"]) for _ in range(rng.randint(3, 40))), f"d{i % domains:02}") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, domain string")


def test_rates_equal_a_plain_projected_gradient(spark):
    docs = domain_docs(spark, 3)
    wanted = lambda names, totals: [0.4 * totals[0], 1.3 * totals[1], totals[2]]
    found = mixing.document_rates(docs, docs.where("doc_id % 2 = 0"), wanted).orderBy("doc_id").collect()
    p, tokens = np.array([r["posteriors"] for r in found]), np.array([r["n_tokens"] for r in found], float)
    assert np.allclose(p.sum(axis=1), 1) and (tokens == [len(r["text"].split()) for r in docs.orderBy("doc_id").collect()]).all()
    before = tokens @ p
    target = np.array([0.4, 1.3, 1.0]) * before
    rate = ahead = np.ones(len(found))
    momentum = 1.0
    weigh = np.linalg.inv((p * tokens[:, None]).T @ p + mixing.RIDGE * np.diag(before))
    while np.abs(((ahead * tokens) @ p - target) / target).max() > 1e-3:
        step = np.maximum(0, ahead - p @ (weigh @ ((ahead * tokens) @ p - target)))
        faster = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        ahead, rate, momentum = np.maximum(0, step + (momentum - 1) / faster * (step - rate)), step, faster
    rates = np.array([r["rate"] for r in found])
    assert np.allclose(rates, ahead, atol=1e-6) and all(r["converged"] for r in found)
    total = (rates * tokens) @ p
    assert np.abs(total / target - 1).max() <= 1.001e-3
    assert all(abs(r["domain_total"] - total[int(r["domain"][1:])]) < 1e-6 * total.max() and abs(r["domain_target"] - target[int(r["domain"][1:])]) < 1e-6 * total.max() for r in found)


def test_targets_out_of_reach_are_flagged(spark):
    docs = spark.createDataFrame([(i, "same words here", f"d{i % 2}") for i in range(30)], "doc_id long, text string, domain string")
    with pytest.warns(UserWarning, match="from their targets"):
        found = mixing.document_rates(docs, docs, lambda names, totals: [0.0, 2 * totals[1]]).collect()
    assert len(found) == 30 and not any(r["converged"] for r in found)


def worst(found, name=lambda r: r["domain"]):
    """Greatest relative miss of the totals over domains, as fitted and at rate 1 everywhere."""
    p, tokens = np.array([r["posteriors"] for r in found]), np.array([r["n_tokens"] for r in found], float)
    target = {name(r): r["domain_target"] for r in found}
    names = sorted(target)
    at = [i for i, n in enumerate(names)]
    ends = [np.abs((rate * tokens) @ p / np.array([target[n] for n in names]) - 1)[at].max() for rate in (np.array([r["rate"] for r in found]), np.ones(len(found)))]
    return ends, np.array([r["rate"] for r in found]), (np.array([r["rate"] for r in found]) * tokens).sum() / tokens.sum()


def test_inseparable_domains_end_no_worse_than_they_start(spark):
    """Domains that say nothing about a text, and two languages whose qualities can't be told apart."""
    rng = random.Random(11)
    words = "tea hot zen koala quiz under white even".split()
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(5, 60)))
    docs = spark.createDataFrame([(i, text(), f"d{rng.randrange(6)}") for i in range(400)], "doc_id long, text string, domain string")
    tilted = lambda names, totals: [(0.8, 1.3)[i % 2] * t for i, t in enumerate(totals)]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        found = mixing.document_rates(docs.drop("domain"), docs.drop("text"), tilted).collect()
        domains = {r["domain"] for r in found}
        if len(domains) == 6:
            (end, start), rates, _ = worst(found)
            assert end <= start + 1e-9
        rates = np.array([r["rate"] for r in found])
        assert rates.max() < 10 and rates.min() >= 0 and not any(r["converged"] for r in found)
        # every posterior sum reached is reported as it is
        p, tokens = np.array([r["posteriors"] for r in found]), np.array([r["n_tokens"] for r in found], float)
        totals = (rates * tokens) @ p
        assert all(np.abs(totals - r["domain_total"]).min() < 1e-6 * tokens.sum() for r in found)
        pair = [(i, " ".join(rng.choice(["zzz", "kaz"] if i % 2 else ["tea", "hot"]) for _ in range(rng.randint(5, 40))), f"{'zt'[i % 2]}/{rng.randrange(2)}") for i in range(400)]
        docs = spark.createDataFrame(pair, "doc_id long, text string, domain string")
        wanted = lambda names, totals: [(0.5 if n.endswith("/0") else 1.5) * t for n, t in zip(names, totals, strict=True)]
        found = mixing.document_rates(docs.drop("domain"), docs.drop("text"), wanted).collect()
        rates = np.array([r["rate"] for r in found])
        tokens = np.array([r["n_tokens"] for r in found], float)
        assert rates.max() < 10 and 0.5 < (rates * tokens).sum() / tokens.sum() < 1.6


def test_the_fit_is_the_same_for_any_number_of_sums(spark, monkeypatch):
    docs = domain_docs(spark, 3)
    wanted = lambda names, totals: [0.4 * totals[0], 1.3 * totals[1], totals[2]]
    rates = []
    for sums in (1, 400):
        monkeypatch.setattr(mixing, "SUMS", sums)
        rates.append([r["rate"] for r in mixing.document_rates(docs, docs, wanted).orderBy("doc_id").collect()])
    assert np.allclose(*rates)


def test_many_domains(spark):
    docs = domain_docs(spark, 70, 420)
    found = mixing.document_rates(docs, docs, lambda names, totals: totals).collect()
    assert len(found) == 420 and all(r["converged"] for r in found) and all(len(r["posteriors"]) == 70 for r in found)


def test_a_domain_without_a_target_goes(spark):
    docs = spark.createDataFrame([(i, "zzz kaz zzz" if i % 2 else "tea hot tea", "z" if i % 2 else "t") for i in range(40)], "doc_id long, text string, domain string")
    rates = mixing.document_rates(docs, docs, lambda names, totals: [0.0 if n == "z" else t for n, t in zip(names, totals, strict=True)])
    assert rates.where("domain = 'z'").agg(F.max("rate")).first()[0] < 0.05


def test_language_of_held_out_texts(spark):
    rng = random.Random(1)
    sound = {"aa": "the and ing tion", "bb": "der und ich sch", "cc": "le que eau oux"}
    make = lambda lang: " ".join("".join(rng.choice(sound[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(20))
    rows = [(i, make(lang), lang) for i in range(240) for lang in [list(sound)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id < 160"))
    assert (model.weights == 0).mean() > 0.5  # sparse
    found = langid.predict(docs.where("doc_id >= 160").withColumn("score", F.lit("clash")), model)
    assert found.where("lang_pred = lang").count() == 80
    none = langid.predict(spark.createDataFrame([(None,), ("",), ("123 !?",)], "text string"), model).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}


def plain_ftrl(rows, langs, idf):
    """FTRL-proximal with elastic net over dictionaries, one weight at a time."""
    c = langid.FtrlSettings()
    z, n = {}, {}

    def weight(key):
        zk = z.get(key, 0.0)
        return 0.0 if abs(zk) <= c.l1 else -(zk - math.copysign(c.l1, zk)) / ((c.beta + math.sqrt(n.get(key, 0.0))) / c.alpha + c.l2)

    for _ in range(c.epochs):
        for grams, lang in rows:
            x = {g: math.log1p(k) * idf[g] for g, k in grams.items()}
            size = math.sqrt(sum(v * v for v in x.values()))
            x = {g: v / size for g, v in x.items()}
            w = {(g, y): weight((g, y)) for g in x for y in range(len(langs))}
            scores = [sum(v * w[g, y] for g, v in x.items()) for y in range(len(langs))]
            e = [math.exp(v - max(scores)) for v in scores]
            for y in range(len(langs)):
                p = e[y] / sum(e) - (langs[y] == lang)
                for g, v in x.items():
                    grad = v * p
                    old = n.get((g, y), 0.0)
                    n[g, y] = old + grad * grad
                    z[g, y] = z.get((g, y), 0.0) + grad - (math.sqrt(n[g, y]) - math.sqrt(old)) / c.alpha * w[g, y]
    return {key: weight(key) for key in z}


def plain_grams(text):
    clean = "".join(ch if ch.isalpha() else " " for ch in f" {text.lower()} ")
    codes = [ord(ch) for k, ch in enumerate(clean) if ch != " " or k == 0 or clean[k - 1] != " "]
    out = {}
    for order in (1, 2, 3):
        for k in range(len(codes) - order + 1):
            key = codes[k]
            for ch in codes[k + 1 : k + order]:
                key = (key * 0x01000193 + ch) % (1 << 32)
            at = ((key ^ order * 0x9E37) * 0x9E3779B1 % (1 << 32)) >> (32 - langid.BUCKETS_LOG2)
            out[at] = out.get(at, 0) + 1
    return out


def test_language_weights_equal_plain_loops(spark):
    rng = random.Random(5)
    texts = [(" ".join(rng.choice(["the", "and", "tea"] if i % 2 else ["der", "und", "Täg!"]) for _ in range(8)), ["de", "en"][i % 2]) for i in range(40)]
    texts = list(dict.fromkeys(texts))
    model = langid.fit(spark.createDataFrame(texts + texts[:5] * 30, "text string, lang string"))
    every = texts + texts[:5] * 30
    df = {}
    for t, _ in every:
        for g in plain_grams(t):
            df[g] = df.get(g, 0) + 1
    idf = {g: math.log((1 + len(every)) / (1 + k)) + 1 for g, k in df.items()}
    assert all(abs(model.idf[g] - v) < 1e-12 for g, v in idf.items())
    def key(t):
        h = xxhash.xxh64_intdigest((11).to_bytes(4, "little"), seed=xxhash.xxh64_intdigest(t.encode(), seed=42))
        return h - (1 << 64) if h >= 1 << 63 else h

    order = sorted(texts, key=lambda x: key(x[0]))
    fitted = [(plain_grams(t), y) for t, y in order if key(t) // 1_000_000 % langid.CALIBRATION_SHARE]
    for (g, y), w in plain_ftrl(fitted, ["de", "en"], idf).items():
        assert abs(model.weights[g, y] - w) < 1e-6


def test_copies_of_a_text_count_once_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_PER_LANG", 20)
    sizes = []
    fit = langid.fit_ftrl
    monkeypatch.setattr(langid, "fit_ftrl", lambda rows, *more: sizes.append(len(rows)) or fit(rows, *more))
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, "copy of one text").otherwise(F.concat(F.lit("text number "), F.col("id").cast("string"), F.lit(" "), F.chr(97 + F.col("id") % 26))).alias("text"), F.lit("en").alias("lang"))
    langid.fit(rows)
    assert 10 <= sizes[0] <= 20


def test_every_language_is_learned(spark):
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i * 7 % 26)}q{chr(97 + i * 11 % 26)}" for i in range(230)]
    rows = [(f"{w} {w}{w} {w} {n}", f"l{i:03}") for i, w in enumerate(words) for n in "abcd"]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.langs) == 230 and np.all(np.abs(model.weights).sum(axis=0) > 0)


def test_temperature_softens_overconfident_scores():
    y = np.array([0, 1] * 50)
    logits = np.where(np.eye(2)[y] > 0, 20.0, -20.0)
    logits[:20] = -logits[:20]
    assert langid.fit_temperature(logits, y) > 5


def plain_logit(model, words):
    """The highest window's logit, number by number."""
    p, hidden = model.params, toxicity.HIDDEN
    dot = lambda x, w, k: sum(float(a) * float(row[k]) for a, row in zip(x, w))
    sigmoid = lambda v: 1 / (1 + math.exp(-v))

    def vector(word):
        grams = toxicity.trigrams(word)
        chars = [sum(float(p["char"][g][k]) for g in grams) / len(grams) for k in range(toxicity.CHAR_DIM)]
        return [*map(float, p["word"][model.vocabulary.get(word, 0)]), *chars]

    def walked(vectors, side):
        w, u, c = p["w" + side], p["u" + side], p["c" + side]
        h, out = [0.0] * hidden, []
        for x in vectors:
            new = []
            for k in range(hidden):
                z = sigmoid(dot(x, w, k) + float(c[k]) + dot(h, u, k))
                s = sigmoid(dot(x, w, hidden + k) + float(c[hidden + k]) + dot(h, u, hidden + k))
                n = math.tanh(dot(x, w, 2 * hidden + k) + float(c[2 * hidden + k]) + s * dot(h, u, 2 * hidden + k))
                new.append(z * h[k] + (1 - z) * n)
            h = new
            out.append(h)
        return out

    best = -math.inf
    start = 0
    while True:
        vectors = [vector(w) for w in words[start : start + toxicity.WINDOW]]
        states = [f + b for f, b in zip(walked(vectors, "f"), walked(vectors[::-1], "b")[::-1])]
        shares = [math.exp(sum(float(a) * b for a, b in zip(p["att"], s))) for s in states]
        pooled = [sum(a * s[k] for a, s in zip(shares, states)) / sum(shares) for k in range(2 * hidden)] if states else []
        best = max(best, sum(a * float(b) for a, b in zip(pooled, p["out"])) + float(p["bias"][0]))
        if start + toxicity.WINDOW >= len(words):
            return best
        start += toxicity.STRIDE


def test_scores_of_windows_by_plain_loops():
    rng = np.random.default_rng(8)
    model = toxicity.ToxicityModel({w: i + 1 for i, w in enumerate(WORDS[:6])}, {k: v + rng.normal(0, 0.3, v.shape).astype(np.float32) for k, v in toxicity.new_params(6, rng).items()})
    sizes = (0, 1, 5, toxicity.WINDOW, toxicity.WINDOW + 1, 2 * toxicity.WINDOW, 101)
    texts = [[WORDS[i] for i in rng.integers(0, len(WORDS), n)] for n in sizes]
    together = toxicity.text_logits(model, toxicity.Lexicon(model), texts)
    assert together == pytest.approx([plain_logit(model, ws) for ws in texts], abs=1e-4)


def test_toxicity_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    model = toxicity.ToxicityModel({"good": 1, "bad": 2}, {k: v.astype(np.float64) for k, v in toxicity.new_params(2, rng).items()})
    batch, y, weight = [["good", "bad", "new"], ["bad"], []], np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])

    def loss():
        z = np.array([toxicity.text_logits(model, toxicity.Lexicon(model), [ws])[0] for ws in batch], float)
        return float((weight * (np.log1p(np.exp(z)) - y * z)).sum() / weight.sum())

    grads = toxicity._gradients(model, batch, y, weight)
    for name in ("out", "att", "wf", "ub", "cf"):
        flat = model.params[name].reshape(-1)
        for at in (0, len(flat) // 2, len(flat) - 1):
            flat[at] += 1e-2
            up = loss()
            flat[at] -= 2e-2
            down = loss()
            flat[at] += 1e-2
            assert abs((up - down) / 2e-2 - grads[name].reshape(-1)[at]) < 3e-3, name


def test_toxicity_of_held_out_texts(spark):
    rng = random.Random(8)

    def make(toxic):
        words = [rng.choice(WORDS) + rng.choice("abc") for _ in range(rng.randint(10, 80))]
        if toxic:
            at = rng.randrange(len(words))
            words[at : at + 2] = ["vile", rng.choice(["idiots", "idiot", "idiotic"])]
        return " ".join(words)

    rows = [(i, make(i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df.where("doc_id < 280").select("doc_id", "toxic"))
    found = toxicity.score(df.where("doc_id >= 280"), model).collect()
    assert np.mean([(r["score"] >= 0.3) == (r["toxic"] == 1) for r in found]) > 0.9
    one = toxicity.fit(df, df.where("toxic = 0").select("doc_id", "toxic"))
    assert all(r["score"] < 0.01 for r in toxicity.score(df.limit(5), one).collect())
    assert toxicity.score(spark.createDataFrame([(None,), ("",)], "text string"), model).where("score between 0 and 1").count() == 2


def brute_base(text):
    import re

    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_equal_plain_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("a@.1234567890-+ ()bZ_%\n") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute_base(text), repr(text)


def test_weak_supervision_adds_spans_and_redacts(spark):
    rng = random.Random(3)
    secret = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(f'log token = "{secret()}" and mail x{i}@example.org from 10.0.0.{i}',) for i in range(60)] + [("plain words only",)] * 20 + [(None,)]
    df = spark.createDataFrame(rows, "text string").withColumn("pii_spans", F.lit("clash"))
    model = pii.fit(df)
    found = pii.find_spans(df, model, redact=True).collect()
    assert sum(any(s["kind"] == "secret" and not s["base"] for s in r["pii_spans"]) for r in found) == 60
    assert sum("[SECRET]" in (r["text"] or "") and "[EMAIL]" in r["text"] and "[IP]" in r["text"] for r in found) == 60
    assert all(not r["pii_spans"] for r in found if r["text"] in (None, "plain words only"))


@pytest.mark.parametrize("size", [200, 201, 300, 5000])
@pytest.mark.parametrize("dots", [False, True])
def test_long_secrets_are_covered_whole(size, dots):
    rng = random.Random(size)
    secret = "".join("." if dots and k % 90 == 89 else rng.choice("0123456789abcdef") for k in range(size - 1)) + "f"
    for text in (f"token = {secret} and more", f'log "password": "{secret}"', f"token: {secret}"):
        at = text.index(secret)
        spans = [{"kind": k, "start": a, "end": b} for k, a, b in pii.extra_spans(text) if k == "secret"]
        assert [(s["start"], s["end"]) for s in spans] == [(at, at + size)]
        assert pii.redacted(text, spans) == text.replace(secret, "[SECRET]")


def test_typed_parts_become_placeholders(spark):
    schema = f"conv_id long, turn long, role string, parts array<{chat.PART_TYPE}>"
    parts = [("text", "see <b> & ", None, None, None, None, None), ("image", None, "i.png", 57, 28, None, None), ("audio", None, "a.wav", None, None, 2.0, None), ("document", None, "d.pdf", None, None, None, 3), ("odd", None, "o", None, None, None, None)]
    r = chat.format_conversations(spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "yes </turn>", *[None] * 5)]), (2, 0, None, None)], schema)).where("conv_id = 1")
    r = r.withColumns({"read": chat.read_turns(F.col("formatted")), "loss": chat.read_loss_text(F.col("formatted"), F.col("loss_spans"))}).first()
    assert [(a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", "i.png", 3), ("audio", "a.wav", 25), ("document", "d.pdf", 3072), ("odd", "o", 0)]
    assert r["expanded_tokens"] == 3100 and r["loss"] == "yes </turn>"
    assert [tuple(t) for t in r["read"]] == [("user", "see <b> & "), ("assistant", "yes </turn>")]
    assert hashlib.sha256(r["formatted"].encode()).digest()


def test_parts_come_back_whatever_their_types_are_called(spark):
    schema = f"conv_id long, turn long, role string, parts array<{chat.PART_TYPE}>"
    none = [None] * 4
    parts = [("text", "a /> b", None, *none), ("a/>b", None, "one", *none), ("<x:1/>", None, "two", *none), ("text", "&gt; c", None, *none), ("text", "", None, *none), (None, None, None, *none)]
    made = chat.format_conversations(spark.createDataFrame([(1, 0, 'q"<>', parts), (1, 1, "assistant", [("image", None, "i", *none)])], schema))
    r = made.withColumns({"read": chat.read_turns(F.col("formatted")), "parts": chat.read_parts(F.col("formatted"), F.col("attachments"))}).first()
    assert [tuple(t) for t in r["read"]] == [('q"<>', "a /> b&gt; c"), ("assistant", "")]
    assert [tuple(p) for p in r["parts"][0]["parts"]] == [("text", "a /> b", None), ("a/>b", None, "one"), ("<x:1/>", None, "two"), ("text", "&gt; c", None), ("unknown", None, None)]
    assert [tuple(p) for p in r["parts"][1]["parts"]] == [("image", None, "i")]


def plain_em(patterns, before, votes, rounds=50):
    """Two classes, labelers that are right a share of the times when they vote; everything spelled out."""
    post = {k: 1 / (1 + math.exp(-2 * (k.count("+") - 1.5 * k.count("-") - 0.5))) for k in patterns}
    for _ in range(rounds):
        prior = min(0.95, max(0.05, sum(n * post[k] for k, n in patterns.items()) / sum(patterns.values())))
        right = []
        for j in range(len(pii.LABELERS)):
            good = sum(n * (post[k] if k[j] == "+" else 1 - post[k]) for k, n in patterns.items() if k[j] != "0")
            cast = sum(n for k, n in patterns.items() if k[j] != "0")
            right.append(min(0.99, max(0.5, (good + votes * before[j]) / (cast + votes))))
        for k in patterns:
            yes, no = prior, 1 - prior
            for j, v in enumerate(k):
                if v != "0":
                    yes, no = yes * (right[j] if v == "+" else 1 - right[j]), no * (1 - right[j] if v == "+" else right[j])
            post[k] = yes / (yes + no)
    return post, right


def test_reliabilities_equal_plain_expectation_maximisation():
    rng = random.Random(4)
    counts = {}
    for _ in range(600):
        kind, good = rng.choice(["card", "secret", "name"]), rng.random() < 0.5
        vote = "".join(rng.choice("++0" if good else "-00") if rng.random() < (0.9 if kind == "card" else 0.6) else rng.choice("+0-") for _ in pii.LABELERS)
        key = f"{kind}|{vote}|{rng.randint(0, 5)}{rng.randint(0, 3)}{rng.randint(0, 3)}{rng.randint(0, 1)}"
        counts[key] = counts.get(key, 0) + rng.randint(1, 5)
    model = pii.fit_counts(counts)
    by = lambda kind: {v: sum(n for k, n in counts.items() if k.split("|")[1] == v and (kind is None or k.startswith(kind))) for v in {k.split("|")[1] for k in counts if kind is None or k.startswith(kind)}}
    _, pooled = plain_em(by(None), [pii.FIRST_SHARE] * 5, pii.FIRST_VOTES)
    posts = {}
    for kind in ("card", "secret", "name"):
        posts[kind], right = plain_em(by(kind), pooled, pii.POOLED_VOTES)
        assert np.allclose(model.reliability[kind], right, atol=1e-6)
    # the classifier: adagrad on the logistic loss, one key and feature at a time
    keys, w, squares = sorted(counts), {}, {}
    for _ in range(300):
        grad, whole = {}, sum(math.log1p(counts[k]) for k in keys)
        for k in keys:
            own = pii.span_features(k)
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(w.get(f, 0.0) for f in own)))))
            for f in own:
                grad[f] = grad.get(f, 0.0) + math.log1p(counts[k]) * (p - posts[k.split("|")[0]][k.split("|")[1]]) / whole
        for f in grad:
            g = grad[f] + 1e-3 * w.get(f, 0.0)
            squares[f] = squares.get(f, 1e-8) + g * g
            w[f] = w.get(f, 0.0) - 0.5 * g / math.sqrt(squares[f])
    assert all(abs(model.weights[f] - v) < 1e-6 for f, v in w.items())


def test_recall_of_planted_spans(spark):
    rng = random.Random(12)
    secret = lambda: "".join(rng.choice("0123456789abcdefXYZ") for _ in range(rng.randint(24, 300)))
    planted, rows = [], []
    for i in range(400):
        kind = ["secret", "name", "national_id", None][i % 4]
        value = {"secret": secret(), "name": rng.choice(["Anna Keller", "Jean Dupont", "Xaver Quandt"]), "national_id": f"{rng.randint(100, 600)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", None: ""}[kind]
        lead = {"secret": rng.choice(["api_key = ", "password: ", "token is "]), "name": rng.choice(["by Dr ", "dear Mrs. ", "Herr "]), "national_id": "social security number ", None: ""}[kind]
        text = " ".join(rng.choice(WORDS) for _ in range(20)) + f" {lead}{value} " + " ".join(rng.choice(WORDS) for _ in range(20))
        rows.append((i, text))
        planted.append((i, kind, text.index(value) if value else 0, value))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: {(s["kind"], s["start"], s["end"]) for s in r["pii_spans"]} for r in pii.find_spans(docs, pii.fit(docs)).collect()}
    hits = {k: [(k, at, at + len(v)) in found[i] for i, kind, at, v in planted if kind == k] for k in ("secret", "name", "national_id")}
    print({k: sum(v) / len(v) for k, v in hits.items()})
    assert all(sum(v) / len(v) >= 0.95 for v in hits.values())
    assert not any(found[i] for i, kind, _, _ in planted if kind is None)


def test_a_worker_forgets_what_other_operators_kept():
    path = bpe.tokenizer_path("word_bpe_49k.json")
    common.begins("bpe")
    ids = bpe.piece_ids(path).of("some words to keep")
    neardup.shingle_set("some words to keep", 5)
    common.begins("bpe")
    assert bpe.piece_ids(path) and len(neardup._WORDS)
    common.begins("neardup")
    assert not bpe.piece_ids.cache_info().currsize and not bpe.merges.cache_info().currsize and len(neardup._WORDS)
    common.begins("bpe")
    assert not len(neardup._WORDS) and bpe.piece_ids(path).of("some words to keep") == ids
