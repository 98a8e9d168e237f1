"""Near-duplicate documents by a MinHash LSH forest, confirmed on full shingle sets.

1. Each text becomes its set of hashed word shingles; equal sets form a class, represented
   by its smallest id, so copies never meet as pairs.
2. Each representative has TREES labels of DEPTH MinHash values. Every tree is one sorted
   order of its labels, made by a range-partitioned sort: rows next to each other have the
   longest common prefixes, and a large run of equal prefixes is cut between tasks like any
   other stretch. The rows at the borders of partitions meet in one more small task.
3. Each row looks back at the WINDOW rows before it. Those that share at least FIRST_DEPTH
   values, and whose small sketches and sizes allow the similarity, are its neighbours; the
   one of the longest common prefix (then of the likeliest sketch) is its candidate. So the
   depth adapts to the region: where labels are crowded, only deep prefixes stand side by
   side. Candidates are confirmed on full sets; confirmed links give components.
4. Rows with further neighbours, and those of runs too long for the window, are sorted once
   more, with their components. What has a neighbour in another component, or lies in a long
   run of several components, is open.
5. Open rows get an exact way: a prefix filter, which misses no pair: of two similar sets the
   first common shingle in a fixed order, rare ones first, is near the beginning of both.
   Rows with such a shingle in common, whose sizes, places and signatures allow the
   similarity, meet with their full sets, and an inverted index in the task gives all their
   similarities. Only links that join two components leave it. Of a crowded shingle only the
   rows outside its largest component go to every block of the others.

A pair of similarity 0.8 shares FIRST_DEPTH values in no tree with a chance of 8e-8, and fails
the sketch with one below 1e-7; every other pair is compared, or in one component already, or
open. No rows of one region, shingle or component have to fit into one task.

Defined results: a null text, or one without words, has an empty set and is linked with
nothing; a text of fewer words than a shingle is one shingle; a null id gets a null
component and isn't kept; rows that share an id are one node, with the sets of all of them;
repeated rows give repeated rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyraflux.llm.common import SLICE_ROWS, begins, cut_lineage, keeps

TREES, DEPTH, FIRST_DEPTH = 16, 8, 2
VALUES = TREES * DEPTH
#: Rows of a tree's order that each row looks back at.
WINDOW = 16
#: Rows of a crowded shingle that meet at once; more are dealt to blocks.
REGION_ROWS = 1_024
#: Signature agreement below which a pair isn't looked at: 5.8 deviations under 0.8.
LEAST_AGREEMENT = 76
#: The same for sketches of four bits a value, of which a sixteenth agrees by chance.
LEAST_ALIKE = 78
#: Parts of a crowded key in a join that only tells which keys count.
SALTS = 8
#: Ids that are broadcast at most; beyond it the join shuffles.
BROADCAST_IDS = 2_000_000
EDGES_A_TASK = 100_000
CACHE_WORDS = 100_000
#: ``full_sets`` of the documents at hand: ids, and what goes on with the sets in the same Arrow map.
Sets = Callable[..., DataFrame]
#: Cells of the sketch that orders shingles by how often they occur: its size doesn't depend on the corpus.
SKETCH_BITS = 18


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _WordHashes()
keeps("neardup", _WORDS.clear)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z count as a-z."""
    # bytes.lower() and bytes.split() know ASCII letters and the six ASCII white-space bytes only
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
    return np.unique(out)


@lru_cache(maxsize=1)
def _lanes() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    odd = rng.integers(0, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1)
    return odd[:, None], rng.integers(0, 1 << 32, VALUES, dtype=np.uint32)[:, None]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of VALUES permutations of 32-bit hashes."""
    odd, add = _lanes()
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 512):
        y = x[None, k : k + 512] * odd + add
        y ^= y >> np.uint32(15)
        out = np.minimum(out, (y * np.uint32(0x2C1B3C6D)).min(axis=1))
    return out


def features(docs: DataFrame, words: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_key and signature of each row."""

    def run(batches):
        begins("neardup")
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                sizes, keys, signs = [], [], []
                for t in part.column(1).to_pylist():
                    s = shingle_set(t, words)
                    sizes.append(len(s))
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    signs.append(signature(s).astype(">u4").tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())],
                    names=["doc_id", "n_shingles", "set_key", "signature"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, signature binary")


ORDER = ["tree", "label", "rep"]
ORDERED = "tree int, label binary, rep long, n long, comp long, sketch binary"


def tree_orders(signed: DataFrame) -> DataFrame:
    """A row for each tree of each of ``signed`` (rep, n, comp, signature), sorted by tree and label across all partitions."""

    def run(batches):
        begins("neardup")
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                if not part.num_rows:
                    continue
                signs = part.column(3).to_pylist()
                low = np.frombuffer(b"".join(signs), np.uint8).reshape(len(signs), VALUES, 4)[:, :, 3] & 15
                sketches = (low[:, ::2] << 4 | low[:, 1::2]).astype(np.uint8)
                labels = [s[4 * DEPTH * t : 4 * DEPTH * (t + 1)] for s in signs for t in range(TREES)]
                owner = pa.array(np.repeat(np.arange(len(signs)), TREES))
                columns = [pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(signs))), pa.array(labels, pa.binary()), *(part.column(k).take(owner) for k in range(3))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes() for x in sketches], pa.binary()).take(owner)], names=["tree", "label", "rep", "n", "comp", "sketch"])

    rows = signed.select("rep", "n", "comp", "signature").mapInArrow(run, ORDERED)
    return rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)


class _Stretch:
    """Some consecutive rows of a tree's order as arrays."""

    def __init__(self, table: pa.Table) -> None:
        self.table, self.rows = table, table.num_rows
        label = np.frombuffer(b"".join(table.column("label").to_pylist()), ">u4").reshape(self.rows, DEPTH)
        self.label = label.astype(np.uint32)
        self.sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(self.rows, VALUES // 2)
        self.tree, self.rep, self.n, self.comp = (table.column(c).to_numpy() for c in ("tree", "rep", "n", "comp"))

    def together(self, back: int, first: int) -> np.ndarray:
        """Rows from ``first`` on that share FIRST_DEPTH values with the row ``back`` before."""
        at = np.arange(max(first, back), self.rows)
        ok = self.tree[at] == self.tree[at - back]
        for d in range(FIRST_DEPTH):
            ok &= self.label[at, d] == self.label[at - back, d]
        return at[ok]

    def neighbours(self, back: int, first: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows from ``first`` on whose row ``back`` before may be similar, that row, their common prefix and alikeness; and all that share the first depth."""
        met = self.together(back, first)
        i, j = met - back, met
        different = x = self.sketch[i] ^ self.sketch[j]
        alike = ((x & 0xF0) == 0).sum(axis=1) + ((different & 0x0F) == 0).sum(axis=1)
        ok = (alike >= LEAST_ALIKE) & (100 * np.minimum(self.n[i], self.n[j]) >= percent * np.maximum(self.n[i], self.n[j])) & (self.rep[i] != self.rep[j])
        i, j, alike = i[ok], j[ok], alike[ok]
        return j, i, np.cumprod(self.label[i] == self.label[j], axis=1).sum(axis=1), alike


def _tried(rows: _Stretch, first: int, percent: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row from ``first`` on its candidate before it; and rows that have other neighbours too or lie in a long run."""
    best, link, more = np.full(rows.rows, -1), np.zeros(rows.rows, int), np.zeros(rows.rows, bool)
    for back in range(1, window + 1):
        j, i, prefix, alike = rows.neighbours(back, first, percent)
        if not j.size and not rows.together(back, first).size:
            break
        value = prefix * (VALUES + 1) + alike
        # where a row has two neighbours, one of them stays open with it
        again, wins = best[j] >= 0, value > best[j]
        more[j[again]] = True
        more[np.where(wins, link[j], i)[again]] = True
        best[j[wins]], link[j[wins]] = value[wins], i[wins]
    more |= _long(rows, first, window)
    at = np.flatnonzero(best >= 0)
    return link[at], at, more


def _long(rows: _Stretch, first: int, window: int) -> np.ndarray:
    """Rows of runs that reach further than the window."""
    ends, depth = rows.together(window + 1, first), np.zeros(rows.rows + 1, int)
    np.add.at(depth, ends - window - 1, 1)
    np.add.at(depth, ends + 1, -1)
    return np.cumsum(depth)[:-1] > 0


def _apart(rows: _Stretch, first: int, percent: int, window: int) -> np.ndarray:
    """Rows that have a neighbour of another component."""
    out = np.zeros(rows.rows, bool)
    for back in range(1, window + 1):
        if not rows.together(back, first).size:
            break
        j, i, _, _ = rows.neighbours(back, first, percent)
        differ = rows.comp[i] != rows.comp[j]
        out[i[differ]] = out[j[differ]] = True
    return out


PAIR, MEMBER, RUN, BORDER = range(4)
FOUND = f"kind int, a long, b long, {ORDERED}"
#: Rows at the borders of partitions that one task goes through.
BORDER_ROWS = 100_000


def scanned(ordered: DataFrame, look: Callable[[_Stretch, int], list[tuple[int, np.ndarray, np.ndarray]]], window: int, border_rows: int | None = None) -> DataFrame:
    """What ``look`` finds (kind, a, b) in each stretch of an order, with ``window`` + 1 rows before it, and all that spans partitions.

    The first and last rows of every partition are gone through once more, in their order: by one task up to
    ``border_rows`` of them, else in partitions of so many, whose own borders are gone through in turn. Every window that spans
    a border lies in these rows without a gap, so each level keeps all that the one before it would find.
    """

    def found(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch | None:
        kind = np.concatenate([np.full(len(a), k, np.int32) for k, a, _ in parts])
        if not kind.size:
            return None
        a, b = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (1, 2))
        none = [pa.nulls(len(kind), t) for t in (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(b), *none], names=names)

    def border(table: pa.Table) -> list[pa.RecordBatch]:
        table = table.combine_chunks()
        lead = [pa.array(np.full(table.num_rows, BORDER, np.int32)), pa.nulls(table.num_rows, pa.int64()), pa.nulls(table.num_rows, pa.int64())]
        return pa.Table.from_arrays([*lead, *table.columns], names=names).to_batches()

    names = [x.split()[0] for x in FOUND.split(", ")]
    edge = window + 1

    def run(batches, whole: bool):
        held, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = pa.Table.from_batches([batch])
            table = fresh if held is None else pa.concat_tables([held, fresh])
            first = table.num_rows - fresh.num_rows
            if (out := found(look(_Stretch(table.combine_chunks()), first))) is not None:
                yield out
            if whole and seen < edge:
                yield from border(fresh.slice(0, edge - seen))
            seen += fresh.num_rows
            held = table.slice(max(0, table.num_rows - edge))
        if whole and held is not None and seen > edge:
            # rows that were given as first ones aren't given again
            yield from border(held.slice(max(0, held.num_rows - (seen - edge))))

    inside = cut_lineage(ordered.mapInArrow(lambda batches: run(batches, True), FOUND))
    edges = inside.where(F.col("kind") == BORDER).select("tree", "label", "rep", "n", "comp", "sketch")
    # each level has to have fewer partitions than the one before
    most = max(border_rows or BORDER_ROWS, 4 * edge)
    tasks = -(-2 * edge * inside.rdd.getNumPartitions() // most)
    if tasks > 1:
        across = scanned(edges.repartitionByRange(tasks, *ORDER).sortWithinPartitions(*ORDER), look, window, border_rows)
    else:
        across = edges.repartition(1).sortWithinPartitions(*ORDER).mapInArrow(lambda batches: run(batches, False), FOUND)
    return inside.where(F.col("kind") != BORDER).select("kind", "a", "b").unionByName(across.select("kind", "a", "b"))


def nearest_pairs(signed: DataFrame, percent: int, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b) of ``signed`` (rep, n, comp, signature), and the ids (id) of what has to be looked at again."""

    def look(rows: _Stretch, first: int):
        i, j, more = _tried(rows, first, percent, window)
        a, b = rows.rep[i], rows.rep[j]
        return [(PAIR, np.minimum(a, b), np.maximum(a, b)), (MEMBER, rows.rep[more], rows.rep[more])]

    found = scanned(tree_orders(signed), look, window)
    return found.where(F.col("kind") == PAIR).select("a", "b").distinct(), found.where(F.col("kind") == MEMBER).select(F.col("a").alias("id")).distinct()


def open_members(signed: DataFrame, percent: int, window: int = WINDOW) -> DataFrame:
    """Those of ``signed`` (id, outside, comp) with a neighbour of another component, or in a long run of several components.

    ``outside`` are all but those that lie in the largest component of each of their runs: of two
    that may be joined one is outside.
    """

    def look(rows: _Stretch, first: int):
        apart, long = _apart(rows, first, percent, window), np.flatnonzero(_long(rows, first, window))
        region = rows.tree[long].astype(np.uint64)
        for d in range(FIRST_DEPTH):
            region = _mixed(region * np.uint64(0x9E3779B97F4A7C15) + rows.label[long, d])
        return [(MEMBER, rows.rep[apart], rows.rep[apart]), (RUN, rows.rep[long], region.view(np.int64))]

    found = scanned(tree_orders(signed), look, window)
    runs = found.where(F.col("kind") == RUN).select(F.col("a").alias("rep"), F.col("b").alias("region")).distinct()
    runs = runs.join(signed.select("rep", "comp"), "rep")
    members = _known(runs, sized(runs), "region").select(F.col("rep").alias("id"), (F.col("comp") != F.col("top")).alias("outside"))
    apart = found.where(F.col("kind") == MEMBER).select(F.col("a").alias("id"), F.lit(True).alias("outside"))
    either = apart.unionByName(members).groupBy("id").agg(F.bool_or("outside").alias("outside"))
    return cut_lineage(either.join(signed.select(F.col("rep").alias("id"), "comp"), "id"))


def _known(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` (with rep) joined with one row for each ``key`` of ``keys``; the rows of a crowded key are dealt to several tasks."""
    every = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(every, [key, "salt"]).drop("salt")


def _roots(comp: np.ndarray) -> np.ndarray:
    """For each member the first member of its component."""
    _, first, place = np.unique(comp, return_index=True, return_inverse=True)
    return first[place]


def _chained(s: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the members that have candidates in other components; where there are two sides, on the other one."""
    out, root = [], np.arange(len(s))
    across = len(np.unique(side)) > 1
    for i in range(len(s) - 1):
        j = np.arange(i + 1, len(s))
        j = j[(root[j] != root[i]) & (comp[j] != comp[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]
        if across:
            j = j[side[j] != side[i]]
        if j.size:
            j = j[(s[j] == s[i]).sum(axis=1) >= LEAST_AGREEMENT]
        for k in j.tolist():
            if root[k] != root[i]:
                out.append((i, k))
                root[root == root[k]] = root[i]
    return out


def _joining(sets: list[np.ndarray], comp: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between members of different components that make them one, by an inverted index of their sets."""
    sizes = np.array([len(x) for x in sets])
    root = _roots(comp)
    if len(sets) == 2:
        return [(0, 1)] if root[0] != root[1] and _similar(sets[0], sets[1], percent) else []
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, local, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    posted = owner[np.argsort(local, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(df)])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for i in range(len(sets)):
        if (root == root[i]).all():
            break
        own = local[ends[i] : ends[i + 1]]
        own = own[df[own] > 1]
        total = int(df[own].sum())
        if not total:
            continue
        before = np.cumsum(df[own]) - df[own]
        at = np.repeat(starts[own] - before, df[own]) + np.arange(total)
        common = np.bincount(posted[at], minlength=len(sets))
        close = (100 * common >= percent * (sizes + sizes[i] - common)) & (common > 0)
        for j in np.flatnonzero(close & (root != root[i])).tolist():
            if root[j] != root[i]:
                out.append((i, j))
                root[root == root[j]] = root[i]
    return out


def _in_groups(rows: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """``fn`` of tables that hold whole groups of ``keys``, in order; a group has 2 x REGION_ROWS members at most.

    ``fn`` takes a table and the places where its groups begin and end.
    """
    width = len(keys)

    def made(table: pa.Table):
        cuts = np.zeros(table.num_rows - 1, bool)
        for k in range(width):
            v = table.column(k).to_numpy()
            cuts |= v[1:] != v[:-1]
        return fn(table, np.concatenate([[0], np.flatnonzero(cuts) + 1, [table.num_rows]]))

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            same = np.ones(held.num_rows, bool)
            for k in range(width):
                same &= held.column(k).to_numpy() == held.column(k)[held.num_rows - 1].as_py()
            cut = int(same.argmax())
            if cut:
                yield made(held.slice(0, cut).combine_chunks())
                held = held.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield made(held)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "rep").mapInArrow(run, schema)


def _signatures(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("signature").to_pylist()), ">u4").reshape(-1, VALUES).astype(np.uint32)


GROUP = ["region", "low", "high"]


def candidate_chains(rows: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that hold together, in each group, the members with candidates in other components by their signatures: fewer than members."""

    def chosen(table: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
        n, comp, side, rep = (table.column(c).to_numpy() for c in ("n", "comp", "side", "rep"))
        s, first, second = _signatures(table), [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = slice(a, b)
            if b - a > 1 and (comp[own] != comp[a]).any():
                found = _chained(s[own], n[own], comp[own], side[own], percent)
                first += [int(rep[a + i]) for i, _ in found]
                second += [int(rep[a + j]) for _, j in found]
        return pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())], names=["a", "b"])

    wanted = rows.select(*GROUP, "rep", "comp", "n", "side", "signature")
    return _in_groups(wanted, GROUP, chosen, "a long, b long").distinct()


def joining_links(waiting: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that a confirmed pair joins, from the members of each group and their full sets (rep, shingles)."""

    def linked(table: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
        comp, own = table.column("comp").to_numpy(), table.column("shingles").combine_chunks()
        first, second = [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            found = _joining([np.frombuffer(own[i].as_buffer(), np.uint64) for i in range(a, b)], comp[a:b], percent)
            first += [int(comp[a + i]) for i, _ in found]
            second += [int(comp[a + j]) for _, j in found]
        return pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())], names=["x", "y"])

    made = _in_groups(waiting.join(sets, "rep").select(*GROUP, "rep", "comp", "shingles"), GROUP, linked, "x long, y long").where("x <> y")
    return made.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def shingle_counts(ids: DataFrame, sets: Sets) -> np.ndarray:
    """How many shingles of all sets of ``ids`` fall into each cell of the sketch."""

    def run(batches):
        found = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for v in batch.column("shingles"):
                found += np.bincount(_cells(np.frombuffer(v.as_buffer(), np.uint64)), minlength=len(found))
        cells = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(found[cells], pa.int64())], names=["cell", "n"])

    table = sets(ids.select("id"), run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    out[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    return out


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


#: Cells of the map of those shingles that sets outside have first: its size doesn't depend on the corpus.
MAP_BITS = 20


def _firsts(x: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The places and shingles of a set that a similar one can have first in common with it."""
    c = counts[_cells(x)]
    at = np.lexsort((x, c))[: len(x) + (-percent * len(x)) // 100 + 1]
    # alone in its cell, a shingle is in no other set
    places = np.flatnonzero(c[at] > 1)
    return places, x[at[places]]


def outside_map(ids: DataFrame, sets: Sets, counts, percent: int) -> np.ndarray:
    """For each of 2^MAP_BITS cells whether a first shingle of a set of ``ids`` falls into it."""

    def run(batches):
        found = np.zeros(1 << MAP_BITS, bool)
        for batch in batches:
            for v in batch.column("shingles"):
                found[_firsts(np.frombuffer(v.as_buffer(), np.uint64), counts.value, percent)[1] & np.uint64((1 << MAP_BITS) - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(found), pa.int64())], names=["cell"])

    out = np.zeros(1 << MAP_BITS, bool)
    out[sets(ids.select("id"), run, "cell long").distinct().toArrow().column("cell").to_numpy()] = True
    return out


def first_shingles(ids: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """(rep, comp, size, place, region): the shingles of each set of ``ids`` (id, comp, outside) that a similar one can have first in common with it.

    ``place`` counts from 0 in the order of the sketch and then of the hash; ``region`` is the
    shingle. Sets that aren't ``outside`` only give those that a set outside may give too.
    """
    context = ids.sparkSession.sparkContext
    shared = context.broadcast(shingle_counts(ids, sets))
    wanted = context.broadcast(outside_map(ids.where("outside"), sets, shared, percent))

    def run(batches):
        counts, known = shared.value, wanted.value
        for batch in batches:
            batch = batch.filter(pc.greater(pc.binary_length(batch.column("shingles")), 0))
            reps, comps, outside = (batch.column(c).to_pylist() for c in ("id", "comp", "outside"))
            for start in range(0, batch.num_rows, SLICE_ROWS):
                own = []
                for i in range(start, min(start + SLICE_ROWS, batch.num_rows)):
                    x = np.frombuffer(batch.column("shingles")[i].as_buffer(), np.uint64)
                    places, firsts = _firsts(x, counts, percent)
                    if not outside[i]:
                        met = known[firsts & np.uint64((1 << MAP_BITS) - 1)]
                        places, firsts = places[met], firsts[met]
                    k = len(firsts)
                    own.append((np.full(k, reps[i]), np.full(k, comps[i]), np.full(k, len(x)), places, firsts.view(np.int64)))
                columns = [pa.array(np.concatenate([o[c] for o in own]).astype(np.int64), pa.int64()) for c in range(5)]
                yield pa.RecordBatch.from_arrays(columns, names=["rep", "comp", "size", "place", "region"])

    return sets(ids, run, "rep long, comp long, size long, place long, region long")


def _leading(size, percent: int):
    """How many first shingles of a set hold the first common one with any similar set that isn't smaller."""
    return size - -(-2 * percent * size // (100 + percent)) + 1


def _hopeful(size: np.ndarray, place: np.ndarray, comp: np.ndarray, side: np.ndarray, percent: int) -> np.ndarray:
    """Which members may be similar to one of another component if the group's shingle is their first common one; of two blocks, across them."""
    out = np.zeros(len(size), bool)
    across = len(np.unique(side)) > 1
    for i in np.flatnonzero(place < _leading(size, percent)):
        fits = (comp != comp[i]) & (size >= size[i]) & (100 * size[i] >= percent * size)
        fits &= np.minimum(size[i] - place[i], size - place) * (100 + percent) >= percent * (size[i] + size)
        if across:
            fits &= side != side[i]
        if fits.any():
            out[i] = True
            out |= fits
    return out


def hopeful_members(rows: DataFrame, percent: int) -> DataFrame:
    """The rows (GROUP, rep, comp, side) of groups of a common first shingle whose sizes and places allow the similarity across components."""

    def chosen(table: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
        size, place, comp, side = (table.column(c).to_numpy() for c in ("size", "place", "comp", "side"))
        keep = np.zeros(len(size), bool)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a > 1:
                keep[a:b] = _hopeful(size[a:b], place[a:b], comp[a:b], side[a:b], percent)
        out = table.select([*GROUP, "rep", "comp", "side"]).filter(pa.array(keep)).combine_chunks()
        return out.to_batches()[0] if out.num_rows else pa.RecordBatch.from_pylist([], schema=out.schema)

    wanted = rows.select(*GROUP, "rep", "comp", "side", "size", "place")
    return _in_groups(wanted, GROUP, chosen, "region long, low int, high int, rep long, comp long, side int")


def dealt(met: DataFrame) -> DataFrame:
    """GROUP and side of each member of a shingle's group (region, rep, comp, members, top, outside), groups of REGION_ROWS or so.

    Links are sought between components only, so one end is always outside the largest one
    (``top``). Of a larger group every member is at home in a block, and those ``outside`` visit
    every block, at most REGION_ROWS or so at a time.
    """
    blocks, turns = (F.ceil(F.col(c) / REGION_ROWS).cast("int") for c in ("members", "outside"))
    home, turn = (F.pmod(F.xxhash64("rep", "region", F.lit(k)), n).cast("int") for k, n in ((0, blocks), (1, F.greatest(turns, F.lit(1)))))
    place = lambda low, high, side: F.struct(low.alias("low"), high.alias("high"), F.lit(side).alias("side"))
    at_home = F.transform(F.sequence(F.lit(0), turns - 1), lambda i: place(home, i, 0))
    visits = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: place(j, turn, 1))
    many = F.when(F.col("comp") == F.col("top"), at_home).otherwise(F.concat(at_home, visits))
    spread = met.withColumn("at", F.explode(F.when(blocks > 1, many).otherwise(F.array(place(F.lit(0), F.lit(0), 0)))))
    return spread.select(*met.columns, "at.low", "at.high", "at.side")


def sized(rows: DataFrame, *led: str) -> DataFrame:
    """Of each region of ``rows`` (region, rep, comp) with several components: members, top (the largest component) and how many are outside it."""
    each = rows.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("n"), *[F.bool_or(c).alias(c) for c in led])
    groups = each.groupBy("region").agg(F.sum("n").alias("members"), F.max(F.struct("n", "comp")).alias("most"), F.count(F.lit(1)).alias("comps"), *[F.bool_or(c).alias(c) for c in led])
    groups = groups.where(" and ".join(["comps > 1", *led]))
    return groups.select("region", "members", F.col("most.comp").alias("top"), (F.col("members") - F.col("most.n")).alias("outside"))


def parted_members(ids: DataFrame, sets: Sets, comps: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Members (GROUP, rep, comp) of ``ids`` (id, comp, outside) that may have a link to another component, with all those that it may lead to.

    Two that may be similar have many first shingles in common. What the groups of shingles say
    is put together first, so that a full set travels once and not once a shingle.
    """
    named = comps.withColumnRenamed("node", "rep")
    leads = F.col("place") < F.col("size") - F.ceil(2 * percent * F.col("size") / (100 + percent)) + 1
    firsts = cut_lineage(first_shingles(ids, sets, percent).withColumn("led", leads))
    hopeful = hopeful_members(dealt(_known(firsts, sized(firsts, "led"), "region")), percent)
    chains = candidate_chains(hopeful.join(signed, "rep"), percent)
    clusters = cut_lineage(connected_components(chains)).select(F.col("node").alias("rep"), F.col("comp").alias("region"))
    members = clusters.join(named, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    return dealt(_known(members, sized(members), "region")).select(*GROUP, "rep", "comp")


def _few(ids: DataFrame) -> DataFrame:
    """``ids`` marked for broadcast if they are few; else as they are, for a shuffle join."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def full_sets(ids: DataFrame, docs: DataFrame, words: int, id_col: str, text: str, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, schema: str | None = None) -> DataFrame:
    """(id, shingles) of the rows of ``docs`` whose id is in ``ids``, with the other columns of ``ids``: the sets as bytes, made anew from the texts.

    ``then`` makes rows of ``schema`` from batches of these in the same Arrow map: a second map after it would hold a second
    Python worker a core, and workers of the pool stay and serve later stages too.
    """
    more = [c for c in ids.columns if c != "id"]

    def sets(batches):
        begins("neardup")
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                made = [shingle_set(t, words).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(made, pa.binary()), *(part.column(c) for c in more)], names=["id", "shingles", *more])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).join(_few(ids), "id")
    if then is not None:
        return own.select("id", "text", *more).mapInArrow(lambda batches: then(sets(batches)), schema)
    schema = ", ".join(["id long", "shingles binary", *(f"{c} {ids.schema[c].dataType.simpleString()}" for c in more)])
    return own.select("id", "text", *more).mapInArrow(sets, schema)


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int, id_col: str, text: str) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity. ``pairs`` is checkpointed."""
    ids = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    own = full_sets(ids, docs, words, id_col, text).groupBy("id").agg(F.collect_set("shingles").alias("sets"))

    def joined(batches):
        for batch in batches:
            a, b, keep = batch.column("a"), batch.column("b"), []
            for i in range(batch.num_rows):
                xs, ys = ([np.frombuffer(v, np.uint64) for v in batch.column(c)[i].as_py()] for c in ("left", "right"))
                keep.append(any(_similar(x, y, percent) for x in xs for y in ys))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    left = pairs.join(own.select(F.col("id").alias("a"), F.col("sets").alias("left")), "a")
    both = left.join(own.select(F.col("id").alias("b"), F.col("sets").alias("right")), "b")
    return cut_lineage(both.select("a", "b", "left", "right").mapInArrow(joined, "a long, b long"))


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that can be reached, for every node of the links (a, b).

    Alternating large and small stars; each turn is checkpointed and the last one changes nothing.
    A turn runs in as many tasks as its edges need, so that small graphs don't leave many small files.
    """
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before, now = None, edges.agg(state).first()[0]
    while now != before:
        tasks = 1 + 2 * now[0] // EDGES_A_TASK
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.where("u <> v").coalesce(tasks).distinct().coalesce(tasks))
        before, now = now, edges.agg(state).first()[0]
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)


def _joined(comps: DataFrame, waiting: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """``comps`` (node, comp) after the links that ``waiting`` members have. Both are checkpointed."""
    if waiting.isEmpty():
        return comps
    ids = cut_lineage(waiting.select(F.col("rep").alias("id")).distinct())
    more = cut_lineage(joining_links(waiting, sets(ids).withColumnRenamed("id", "rep"), percent))
    # components become the nodes of a smaller graph
    joined = connected_components(more).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    moved = comps.join(joined, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return cut_lineage(moved.unionByName(joined.select(F.col("comp").alias("node"), F.col("to").alias("comp"))).groupBy("node").agg(F.min("comp").alias("comp")))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs``.

    Documents are linked whose sets of ``words``-word shingles have a Jaccard similarity of
    ``percent`` hundredths or more; component_id is the smallest id that links reach.
    """
    rows = cut_lineage(features(docs, words, id_col, text))
    some = rows.where("n_shingles > 0 and doc_id is not null")
    classes = cut_lineage(some.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")))
    signed = classes.select("rep", "n", "signature")

    pairs, again = nearest_pairs(signed.withColumn("comp", F.col("rep")), percent, window)
    links = confirmed(cut_lineage(pairs), docs, words, percent, id_col, text)
    comps = cut_lineage(connected_components(links))

    known = comps.withColumnRenamed("node", "rep")
    left = signed.join(again.withColumnRenamed("id", "rep"), "rep", "left_semi").join(known, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    open_ = open_members(cut_lineage(left), percent, window)
    if not open_.isEmpty():
        sets = lambda ids, *then: full_sets(ids, docs, words, id_col, text, *then)
        parted = cut_lineage(parted_members(open_, sets, comps, signed, percent))
        comps = _joined(comps, parted, sets, percent)

    named = classes.select("set_key", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("set_key", F.coalesce("comp", "rep").alias("component_id"))
    out = rows.drop("signature").join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
