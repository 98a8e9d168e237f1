"""Hard negatives by inner product from a forest of vantage-point trees.

Vectors get one more component that brings all of them to the greatest norm, and a query gets
0 there; then a higher inner product is a shorter distance, a window of scores is an annulus
around the query, and trees over distances serve. Rows are dealt into shells of equal shares
around one vantage point, and within a shell into blocks of bounded size; each block is one tree
in one task. A query goes to the shells that its annulus meets and takes a tree's nodes nearest
first, beginning at the inner edge, until it has its k rows or leaves the annulus.

Rows of one vector and label are one point with its first ids, as many as any answer can use,
so copies are searched, and searched for, once. Points are cut to those ids before they travel.

Defined results: rows with a null id, label or vector or any component null or not finite take no
part; rows that repeat id, label and vector are one; rows that only share an id are rows of their
own; shorter vectors count as filled up with zeros. Scores are exact; beyond 64 bits they stay
at the bound. No rows give no rows. Further columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyraflux.llm.common import begins, cut_lineage

#: Shells around the first vantage point.
SHELLS = 64
#: Points of a block at most, on average; bounds a task's memory. Fewer rows make smaller blocks, not fewer.
BLOCK_POINTS = 131_072
#: Points below which a tree isn't split further.
LEAF = 96
#: Queries that go through a tree together; bounds a task's memory.
ASKING = 1024

LONG = 2**63 - 1


def matrix(lists: pa.Array, width: int = 0) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    wide = max(width, int(sizes.max(initial=0)))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == wide).all():
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide))
    out[np.arange(wide) < sizes[:, None]] = flat
    return out


def exact(values: np.ndarray, kind: type) -> np.ndarray:
    """Whole numbers in a type in which sums of their products are exact."""
    return np.vectorize(int, otypes=[object])(values) if kind is object and values.size else values.astype(kind)


class Tree:
    """A vantage-point tree over the points of one block."""

    def __init__(self, points: np.ndarray, norms: np.ndarray, labels: np.ndarray, ids: list[list[int]], keys: np.ndarray, top: float) -> None:
        # sums below these bounds are exact in the type chosen
        self.kind = np.float32 if top < 2**23 else np.float64 if top < 2**52 else object
        self.top, self.slack = top, 1e-6 * top**0.5 + 1e-9
        self.width = points.shape[1]
        filled = np.sqrt(np.maximum(top - norms, 0.0))
        self.whole = np.column_stack([points, filled])
        self.nodes: list[tuple] = []  # (vantage, inner, its least and greatest distance, outer, likewise) or (-1, from, to)
        self.vantages: list[int] = []
        order: list[np.ndarray] = []
        self._grow(np.arange(len(points)), order)
        at = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.points, self.labels, self.keys = exact(points[at], self.kind), labels[at], keys[at]
        self.ids = [ids[i] for i in at]
        self.heads = exact(points[self.vantages], self.kind)
        self.head_fill = filled[self.vantages]
        del self.whole

    def _distances(self, at: np.ndarray, to: int) -> np.ndarray:
        return np.sqrt(np.maximum(2 * self.top - 2 * (self.whole[at] @ self.whole[to]), 0.0))

    def _grow(self, at: np.ndarray, order: list[np.ndarray]) -> int:
        number = len(self.nodes)
        self.nodes.append(())
        if len(at) > LEAF:
            vantage = at[int(np.argmax(self._distances(at, at[0])))]
            far = self._distances(at, vantage)
            inside = far <= np.median(far)
            if not inside.all():
                place = len(self.vantages)
                self.vantages.append(int(vantage))
                edges = [(float(far[m].min()), float(far[m].max())) for m in (inside, ~inside)]
                children = [self._grow(at[m], order) for m in (inside, ~inside)]
                self.nodes[number] = (place, *zip(children, edges))
                return number
        start = sum(map(len, order))
        order.append(at)
        self.nodes[number] = (-1, start, start + len(at))
        return number

    def query(self, q: np.ndarray, norm: float) -> Query:
        return Query(self, q, norm)


class Query:
    """One query in one tree; scores of a leaf are computed once for all its windows."""

    def __init__(self, tree: Tree, q: np.ndarray, norm: float) -> None:
        short = np.zeros(tree.width)
        short[: min(len(q), tree.width)] = q[: tree.width]
        self.tree, self.q, self.norm = tree, exact(short, tree.kind), norm
        self.seen: dict[int, np.ndarray] = {}
        scores = (tree.heads @ self.q).astype(np.float64) if len(tree.heads) else np.zeros(0)
        self.to_heads = np.sqrt(np.maximum(norm + tree.top - 2 * scores, 0.0))

    def distance(self, score: float) -> float:
        return max(self.norm + self.tree.top - 2.0 * score, 0.0) ** 0.5

    def nearest(self, k: int, label: int, same: bool, low: int | None = None, high: int | None = None) -> list[tuple[int, int, int]]:
        """The first k rows (-score, id, point) of the label, or of others, with low <= score <= high."""
        tree, slack = self.tree, self.tree.slack
        near = 0.0 if high is None else self.distance(high)
        far = float("inf") if low is None else self.distance(low)
        least = -LONG - 1 if low is None else low
        found: list[tuple[int, int, int]] = []
        heap = [(near, 0)]
        while heap:
            bound, number = heappop(heap)
            if bound > far + slack:
                break
            node = tree.nodes[number]
            if node[0] < 0:
                scores = self._scores(number, node[1], node[2])
                wanted = (tree.labels[node[1] : node[2]] == label) == same
                wanted &= scores >= least
                if high is not None:
                    wanted &= scores <= high
                at = np.flatnonzero(wanted)
                if len(at) > k:  # points that can't be among the first k rows: each has a row at least
                    rough = scores[at].astype(np.float64)
                    at = at[rough >= np.partition(rough, len(at) - k)[len(at) - k]]
                if len(at):
                    found += [(-int(scores[i]), one, int(tree.keys[node[1] + i])) for i in at for one in tree.ids[node[1] + i]]
                    found = sorted(found)[:k]
                    if len(found) == k:
                        least = max(least, -found[-1][0])
                        far = min(far, self.distance(-found[-1][0]))
                continue
            to_head = float(self.to_heads[node[0]])
            for child, (first, last) in node[1:]:
                closest = max(bound, to_head - last, first - to_head)
                if closest <= far + slack and to_head + last >= near - slack:
                    heappush(heap, (closest, child))
        return found

    def _scores(self, number: int, start: int, end: int) -> np.ndarray:
        found = self.seen.get(number)
        if found is None:
            made = self.tree.points[start:end] @ self.q
            if self.tree.kind is object:
                made = np.array([min(max(int(x), -LONG - 1), LONG) for x in made], object)
            found = self.seen[number] = made
        return found


class Batch:
    """Windows of many queries that go through one tree together; for numbers that floats hold exactly.

    Each window keeps its own bounds and meets the nodes that they reach, as in ``Query.nearest``; a leaf is one product of matrices for
    all queries that come to it.
    """

    def __init__(self, tree: Tree, vectors: np.ndarray, norms: np.ndarray, labels: np.ndarray, owner: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> None:
        short = np.zeros((len(vectors), tree.width))
        wide = min(vectors.shape[1], tree.width)
        short[:, :wide] = vectors[:, :wide]
        self.tree, self.q, self.owner, self.label = tree, exact(short, tree.kind), owner, labels[owner]
        self.norm, self.least, self.high = norms[owner], lows.copy(), highs
        scores = (self.q @ tree.heads.T).astype(np.float64)
        self.to_heads = np.sqrt(np.maximum(norms[:, None] + tree.top - 2 * scores, 0.0))
        everything = np.arange(len(owner))
        self.far, self.near = self.distance(everything, lows), self.distance(everything, highs)
        self.found: list[list[tuple[int, int, int]]] = [[] for _ in owner]

    def distance(self, at: np.ndarray, score: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.norm[at] + self.tree.top - 2.0 * score, 0.0))

    def nearest(self, k: int, same: bool) -> list[list[tuple[int, int, int]]]:
        """``Query.nearest`` of every window."""
        self._visit(0, np.arange(len(self.owner)), self.near, k, same)
        return self.found

    def _visit(self, number: int, at: np.ndarray, bound: np.ndarray, k: int, same: bool) -> None:
        slack, node = self.tree.slack, self.tree.nodes[number]
        reached = bound <= self.far[at] + slack
        at, bound = at[reached], bound[reached]
        if not len(at):
            return
        if node[0] < 0:
            return self._leaf(at, node[1], node[2], k, same)
        to_head, ways = self.to_heads[self.owner[at], node[0]], []
        for child, (first, last) in node[1:]:
            closest = np.maximum(bound, np.maximum(to_head - last, first - to_head))
            reached = to_head + last >= self.near[at] - slack
            ways.append((float(closest.mean()), child, at[reached], closest[reached]))
        for _, child, there, closest in sorted(ways, key=lambda way: way[0]):
            self._visit(child, there, closest, k, same)

    def _leaf(self, at: np.ndarray, start: int, end: int, k: int, same: bool) -> None:
        tree = self.tree
        asking, back = np.unique(self.owner[at], return_inverse=True)
        scores = (self.q[asking] @ tree.points[start:end].T).astype(np.float64)[back]
        wanted = (tree.labels[start:end] == self.label[at][:, None]) == same
        wanted &= scores >= self.least[at][:, None]
        wanted &= scores <= self.high[at][:, None]
        many = np.flatnonzero(wanted.sum(axis=1) > k)
        if len(many):  # points that can't be among the first k rows: each has a row at least
            rough = np.where(wanted[many], scores[many], -np.inf)
            wanted[many] &= rough >= np.partition(rough, -k, axis=1)[:, -k, None]
        rows, columns = np.nonzero(wanted)
        cuts = np.flatnonzero(np.diff(rows, prepend=-1)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(rows)]):
            window, new = int(at[rows[a]]), columns[a:b].tolist()
            own = self.found[window] + [(-int(scores[rows[a], i]), one, int(tree.keys[start + i])) for i in new for one in tree.ids[start + i]]
            self.found[window] = own = sorted(own)[:k]
            if len(own) == k:
                self.least[window] = max(self.least[window], -own[-1][0])
                self.far[window] = min(self.far[window], float(self.distance(window, -own[-1][0])))


TRAVELLING = "shell int, salt int, asks boolean, key long, label long, v array<double>, norm double, ids array<long>, lows array<long>, highs array<long>, caps array<long>"
NAMES = [x.split()[0] for x in TRAVELLING.split(", ")]


def searched(points: DataFrame, queries: DataFrame, top: float, k: int, same: bool) -> DataFrame:
    """The first k rows of each block for each window of each query: (key, cap, score, id, point)."""

    def run(batches):
        begins("negatives")
        block, gathered, tree = None, [], None
        for batch in batches:
            shells, salts, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((shells[1:] != shells[:-1]) | (salts[1:] != salts[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if (here := (shells[a], salts[a])) != block:
                    block, gathered, tree = here, [], None
                if not asks[a]:
                    gathered.append(part)
                    continue
                if tree is None and gathered:
                    tree, gathered = grown(pa.Table.from_batches(gathered).combine_chunks(), top), []
                if tree is not None:
                    yield answers(tree, part, k, same)

    kind = "key long, cap long, score long, id long, point long"
    both = points.select(*NAMES).unionByName(queries.select(*NAMES))
    return both.repartition("shell", "salt").sortWithinPartitions("shell", "salt", "asks").mapInArrow(run, kind)


def grown(rows: pa.Table, top: float) -> Tree:
    one = lambda name: rows.column(name).combine_chunks()
    whole = one("v")
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    return Tree(matrix(whole), one("norm").to_numpy(), one("label").to_numpy(), one("ids").to_pylist(), one("key").to_numpy(), top)


def answers(tree: Tree, part: pa.RecordBatch, k: int, same: bool) -> pa.RecordBatch:
    out: list[tuple] = []
    for start in range(0, part.num_rows, ASKING):
        out += answered(tree, part.slice(start, ASKING), k, same)
    columns = list(zip(*out)) if out else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "cap", "score", "id", "point"])


def answered(tree: Tree, part: pa.RecordBatch, k: int, same: bool) -> list[tuple]:
    """(key, cap, score, id, point) of the first k rows of each window of each query."""
    vectors = matrix(part.column("v"))
    keys, labels, norms, lows, highs, caps = (part.column(c).to_pylist() for c in ("key", "label", "norm", "lows", "highs", "caps"))
    windows = [(i, *w) for i in range(part.num_rows) for w in (zip(caps[i], lows[i], highs[i]) if caps[i] else [(None, None, None)])]
    if tree.kind is object:
        asked = [tree.query(q, norm) for q, norm in zip(vectors, norms)]
        found = [asked[i].nearest(k, labels[i], same, low, high) for i, _, low, high in windows]
    else:
        bounds = [np.array([otherwise if w[at] is None else w[at] for w in windows], float) for at, otherwise in ((2, -np.inf), (3, np.inf))]
        batch = Batch(tree, vectors, np.array(norms, float), np.array(labels, np.int64), np.array([w[0] for w in windows]), *bounds)
        found = batch.nearest(k, same)
    return [(keys[i], cap, -s, one, point) for (i, cap, _, _), rows in zip(windows, found, strict=True) for s, one, point in rows]


def first_rows(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The best k of all blocks, in order, as an array. Each task passes on k rows of a key at most."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "point")
    best = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k)
    return best.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("at", "score", "id", "point"))).alias("rows"))


def usable(df: DataFrame, vec_id: str, vector: str, label: Column, scale: int) -> DataFrame:
    """Distinct (id, label, v) of the rows that take part, each component floor(scale * x)."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(F.col(vec_id).isNotNull() & label.isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return rows.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(v, lambda x: F.floor(x * scale).cast("double")).alias("v")).distinct()


def dot(a: Column, b: Column) -> Column:
    """Inner product; where one is shorter the rest counts as zeros."""
    both = F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0)))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def mine(
    df: DataFrame, anchors: Callable[[Column], Column], vec_id: str = "vec_id", vector: str = "embedding", label: Column | None = None,
    scale: int = 256, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95),
) -> DataFrame:
    """For each row whose id satisfies ``anchors`` and each of its first ``positives`` other rows of the same label by
    score, the first ``negatives`` rows of other labels whose score lies within ``window`` per cent of the positive's."""
    rows = usable(df, vec_id, vector, F.col("label") if label is None else label, scale)
    held = positives + 1
    of_point = Window.partitionBy("label", "v")
    first = rows.withColumn("at", F.row_number().over(of_point.orderBy("id"))).where(F.col("at") <= held)
    grouped = first.groupBy("label", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    points = cut_lineage(grouped.select(F.monotonically_increasing_id().alias("key"), "label", "v", "ids", dot(F.col("v"), F.col("v")).alias("norm")))
    asking = cut_lineage(rows.where(anchors(F.col("id"))).select(F.col("id").alias("anchor_id"), "label", "v"))

    top, n, vantage, vantage_norm = points.agg(F.max("norm"), F.count(F.lit(1)), F.min_by("v", "key"), F.min_by("norm", "key")).head()
    if not n:
        top, vantage, vantage_norm = 0.0, [], 0.0
    # distances from the first vantage point, and shells with equal shares of the points
    head = F.array(*map(F.lit, vantage)) if vantage else F.array().cast("array<double>")
    fill = F.sqrt(F.greatest(F.lit(top) - F.col("norm"), F.lit(0.0))) * max(top - vantage_norm, 0.0) ** 0.5
    apart = F.sqrt(F.greatest(2 * F.lit(top) - 2 * (dot(F.col("v"), head) + fill), F.lit(0.0)))
    measured = points.withColumn("apart", apart)
    cuts = measured.agg(F.percentile_approx("apart", [i / SHELLS for i in range(1, SHELLS)], 10_000)).head()[0] or []
    cut_list = F.array(*map(F.lit, sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    measured = measured.withColumn("shell", F.size(F.filter(cut_list, lambda c: c < F.col("apart"))))
    table = measured.groupBy("shell").agg(F.min("apart"), F.max("apart"), F.count(F.lit(1))).collect()  # SHELLS rows at most
    parts = {s: 1 + n_s // BLOCK_POINTS for s, _, _, n_s in table}
    dealt = F.coalesce(*[F.when(F.col("shell") == s, F.lit(p)) for s, p in parts.items()], F.lit(1))
    none = F.array().cast("array<long>")
    placed = measured.withColumns({"salt": F.pmod(F.xxhash64("key"), dealt).cast("int"), "asks": F.lit(False), "lows": none, "highs": none, "caps": none})

    shell_type = "array<struct<shell:int,first:double,last:double,parts:int>>"
    shells = F.array(*[F.struct(F.lit(s).alias("shell"), F.lit(a).alias("first"), F.lit(b).alias("last"), F.lit(parts[s]).alias("parts")) for s, a, b, _ in table]).cast(shell_type)

    def sent(queries: DataFrame, shells: Column) -> DataFrame:
        each = queries.withColumn("s", F.explode(shells)).withColumns({"shell": F.col("s.shell"), "asks": F.lit(True), "ids": none})
        return each.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("s.parts") - 1)))

    # points of which any row is an anchor; an anchor need not be among a point's first ids
    queries = cut_lineage(points.join(asking.select("label", "v").distinct(), ["label", "v"], "left_semi").select("key", "label", "v", "norm"))
    found = searched(placed, sent(queries.withColumns({"lows": none, "highs": none, "caps": none}), shells), top, held, True)
    best = cut_lineage(first_rows(found, ["key"], held))

    low, high = window
    windowed = queries.join(best, "key").withColumn("caps", F.array_distinct(F.transform("rows", lambda r: r["score"])))
    windowed = windowed.withColumn("caps", F.filter("caps", lambda c: low * c <= high * c)).where(F.size("caps") > 0)
    # whole numbers: score >= low/100 of the cap and score <= high/100 of it
    wide = lambda c: c.cast("decimal(38,0)")
    windowed = windowed.withColumns({
        "lows": F.transform("caps", lambda c: F.ceil(wide(c) * low / 100).cast("long")), "highs": F.transform("caps", lambda c: F.floor(wide(c) * high / 100).cast("long")),
    })
    to_score = lambda s: F.sqrt(F.greatest(F.col("norm") + top - 2 * s.cast("double"), F.lit(0.0)))
    slack = 1e-6 * top**0.5 + 1e-9
    windowed = windowed.withColumns({"near": to_score(F.array_max("highs")) - slack, "far": to_score(F.array_min("lows")) + slack, "head": to_score(dot(F.col("v"), head))})
    met = F.filter(shells, lambda s: (F.col("head") - F.col("far") <= s["last"]) & (F.col("head") + F.col("far") >= s["first"]) & (F.col("head") + s["last"] >= F.col("near")))
    harder = first_rows(searched(placed, sent(windowed, met), top, negatives, False), ["key", "cap"], negatives)

    # one row a point: its positives with their negatives; then its anchors, which may be many
    of_cap = harder.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("cap", "rows"))).alias("hard"))
    known = queries.select("key", "label", "v").join(best, "key").join(of_cap, "key").drop("norm")
    each = asking.join(known, ["label", "v"])
    others = F.slice(F.filter("rows", lambda r: ~((r["point"] == F.col("key")) & (r["id"] == F.col("anchor_id")))), 1, positives)
    each = each.select("anchor_id", "hard", F.explode(others).alias("p")).select("anchor_id", "p", F.explode(F.col("hard")[F.col("p.score")]).alias("n"))
    return each.select(
        "anchor_id", F.col("p.id").alias("positive_id"), F.col("n.at").alias("rank"), F.col("n.id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"),
    )
