import numpy as np
import pytest

import __spark_entry__
from lyraflux.functions import kernels
from lyraflux.sources import survey
from tests.test_round3 import against_sql


def curve(n, seed=4, levels=None):
    rng = np.random.default_rng(seed)
    t, m, e = np.sort(rng.random(n)) * 30, rng.random(n), 0.02 + rng.random(n)
    return t - t[0], kernels.unit_scaled(m if levels is None else np.floor(m * levels)), e


def plain(name, t, m, e, f):
    """The formulas of the folded methods by loops over frequencies, bins and levels."""
    out = []
    for x in f:
        place = np.floor(kernels.FOLD_BINS * (x * t - np.floor(x * t))).astype(int)
        level, w = np.minimum((m * kernels.LEVELS).astype(int), kernels.LEVELS - 1), 1 / e**2
        bins = [np.flatnonzero(place == b) for b in np.unique(place)]
        if name == "AOV":
            y = m - m.mean()
            between = sum(y[b].sum() ** 2 / len(b) for b in bins)
            free = len(t) - len(bins)
            out.append(between * free / ((y @ y - between) * (len(bins) - 1)) if free else 0.0)
        elif name == "FPW":
            y = m - w @ m / w.sum()
            out.append(sum((w[b] @ y[b]) ** 2 / w[b].sum() for b in bins) / (w @ (y * y)))
        else:
            cells = [c for b in bins for c in np.bincount(level[b]) if c]
            out.append((sum(len(b) * np.log(len(b)) for b in bins) - sum(c * np.log(c) for c in cells)) / len(t))
    return np.array(out)


# few epochs of a level; three levels of many epochs, whose cells are counted otherwise
@pytest.mark.parametrize("t,m,e", [curve(66), curve(7), curve(900, levels=3), curve(130, levels=2)])
@pytest.mark.parametrize("name", ["CE", "AOV", "FPW"])
def test_folded_methods_in_parts_equal_plain_loops(monkeypatch, name, t, m, e):
    f = np.linspace(0.1, 288, 45)
    wanted = plain(name, t, m, e, f)
    assert kernels.periodogram(name, t, m, e, f) == pytest.approx(wanted, rel=1e-9, abs=1e-12)
    monkeypatch.setattr(kernels, "PART_CELLS", 11 * len(t))
    monkeypatch.setattr(kernels, "BLOCK_CELLS", 30 * len(t))
    assert kernels.periodogram(name, t, m, e, f) == pytest.approx(wanted, rel=1e-9, abs=1e-12)


def test_a_fold_keeps_a_byte_an_epoch_and_its_sums_no_longer_than_a_part(monkeypatch):
    t, m, e = curve(66)
    monkeypatch.setattr(kernels, "PART_CELLS", 66 * 16)
    room, seen = kernels.Room(t, 400), []
    empty = kernels.Fold(t, np.zeros(0), 20, room)
    for method in (kernels.analysis_of_variance, kernels.conditional_entropy, kernels.folded_power):
        assert method(t, m, e, empty).shape == (0,)
    kept = dict(room.learned)
    room.learned = {name: lambda part, make=make: seen.append(part.rows) or make(part) for name, make in kept.items()}
    fold = kernels.Fold(t, np.linspace(1, 9, 400), 20, room)
    # a fold of no frequency is enough for later ones to make all while a part is at hand
    assert len(seen) == 25 * len(kept) and max(seen) == 16
    kernels.analysis_of_variance(t, m, e, fold)
    assert len(seen) == 25 * len(kept)
    assert fold.place.dtype == np.uint8 and fold.place.shape == (66, 400)
    assert room.cells.size == 66 * 16


@pytest.mark.parametrize("n,levels", [(66, None), (120, 2), (700, 2)])
def test_entropies_of_equal_shares_are_equal(n, levels):
    t, m, e = curve(n, levels=levels)
    f, order = np.linspace(0.1, 288, 300), np.random.default_rng(6).permutation(n)
    found = kernels.periodogram("CE", t, m, e, f)
    # the order of epochs, of bins and of levels is no matter, so peaks of one entropy keep the order of the grid
    assert found.tolist() == kernels.periodogram("CE", t[order], m[order], e[order], f).tolist()
    assert found == pytest.approx(plain("CE", t, m, e, f), rel=1e-11)


def test_every_pair_of_rows_on_the_edges_of_the_sky_is_returned(spark, tmp_path):
    rows = [{"c_custkey": k} for k in range(1500)] + [{"c_custkey": None}]
    made, wanted = against_sql(spark, tmp_path, "sky_edges", customer=rows)
    assert len(made) == len(wanted) == 28047 and {r[:2] for r in made} == {r[:2] for r in wanted}
    assert [r[2] for r in made] == pytest.approx([r[2] for r in wanted], abs=2e-4)
    assert __spark_entry__.queries()["sky_edges"](spark, str(tmp_path)).columns == ["source_id", "gid", "sep"]
    one = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 2.0), ("c", 50.0, 2.0), ("d", None, 2.0), ("e", float("nan"), 2.0)], "source_id string, ra double, dec double")
    other = spark.createDataFrame([(5, 1.0, 2.0), (5, 1.0, 2.0), (9, 1.0, 2.0001), (7, None, 2.0)], "gid long, ra double, dec double")
    found = sorted(map(tuple, survey.within_radius_by_place(one, other, 2.0, 4).collect()))
    assert found == [(s, g, d) for s in "ab" for g, d in ((5, 0.0), (5, 0.0), (9, 0.36))]
