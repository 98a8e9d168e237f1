"""Hard negatives against all pairs, on random, copied, ragged, huge and absent vectors."""

import math

import duckdb
import numpy as np
import pytest

from lyraflux.llm import catalog, negatives

SCHEMA = "vec_id long, embedding array<double>, label long, `a.b` string, key string"


def plain(rows, anchors=lambda i: i % 50 == 0, k=5, m=3):
    usable = {
        (i, tuple(max(min(math.floor(256 * x), 2**63 - 1), -(2**63)) for x in v), y)
        for i, v, y in rows if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    out = []
    for a in usable:
        if not anchors(a[0]):
            continue
        scored = [(-sum(x * y for x, y in zip(a[1], b[1])), b[0], b) for b in usable if b != a]
        for s, i, _ in sorted(x[:2] + (x[2][2],) for x in scored if x[2][2] == a[2])[:k]:
            hard = sorted(x[:2] for x in scored if x[2][2] != a[2] and 50 * -s <= 100 * -x[0] <= 95 * -s)[:m]
            out += [(a[0], i, rank, j, -s, -t) for rank, (t, j) in enumerate(hard, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(i, v, y, "x", "k") for i, v, y in rows], SCHEMA)
    return sorted(map(tuple, negatives.mine(df, anchors=lambda i: i % 50 == 0, **more).collect()))


def vectors(n, width, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, width))
    return (centre[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, width))) / 8


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_clusters(spark, spread):
    x = vectors(900, 12, 3, spread)
    rows = [(i, list(map(float, v)), i % 4) for i, v in enumerate(x)]
    found = mined(spark, rows)
    assert found == plain(rows) and found


def test_many_blocks_and_small_leaves(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_POINTS", 7)
    rows = [(i, list(map(float, v)), i % 3) for i, v in enumerate(vectors(500, 6, 9))]
    assert mined(spark, rows) == plain(rows)


def test_copies_ties_and_rows_without_part(spark):
    x = [list(map(float, v)) for v in vectors(40, 4, 1)]
    rows = [(i, x[0] if i % 3 == 0 else x[i % 40], i % 2) for i in range(400)]
    rows += rows[:120] + [(50, x[7], 1), (50, x[8], 0), (100, x[9], None), (None, x[3], 1), (150, None, 1), (200, [1.0, None, 0.0, 0.0], 0), (250, [float("nan")] * 4, 1), (300, [float("inf")] * 4, 0)]
    found = mined(spark, rows)
    assert found == plain(rows) and len(found) > 50


def test_other_shapes(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0, 0.0], 1)]) == []
    assert mined(spark, [(0, [], 1), (1, [], 1), (2, [], 2)]) == plain([(0, [], 1), (1, [], 1), (2, [], 2)])
    ragged = [(i, [float(i % 5)] * (1 + i % 3), i % 2) for i in range(120)]
    assert mined(spark, ragged) == plain(ragged)
    below = [(i, [-1.0 - i % 7, 1.0], i % 2) for i in range(0, 100)]
    assert mined(spark, below) == plain(below)


def test_scores_beyond_double_precision(spark):
    rows = [(i, [float(2**20 + i), float(2**19 + 3 * i % 11)], i % 2) for i in range(60)]
    rows += [(100 + i, [float(2**20 + i) * 0.7, float(2**19)], i % 2) for i in range(60)]
    assert mined(spark, rows) == plain(rows)


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    theirs = con.execute(catalog.OP11_SQL)
    made = catalog.op11_hard_negatives(spark, "/root/testdata/sf0.01")
    names = [d[0] for d in theirs.description]
    assert sorted(names) == sorted(made.columns)
    assert sorted(tuple(r[n] for n in names) for r in made.collect()) == sorted(theirs.fetchall())
