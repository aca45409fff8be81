"""Exact top-k by inner product: dual-tree search over cover trees.

Queries and data are both indexed.  The tops of the two trees are the same few
pivots, by which rows are dealt out; below, each group of queries and each shard
of data has a cover tree of its own.  A pair of nodes is dropped when no inner
product between them can reach the worst kth score of the node's queries.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sampled, spread
from .vectors import askers, first_copies, matrix, padded, ranked, valid

#: Rows of a shard and queries of a group, about, at most.
SHARD_ROWS, GROUP_QUERIES = 8192, 1024
#: Rows among which pivots are chosen, about, at most, and pivots.
PIVOT_ROWS, PIVOTS = 4096, 16
#: Rows below which a node of a data tree and of a query tree is split on only where its rows lie in separate heaps.
LEAF, QUERY_LEAF = 256, 64
#: Rows that a heap should have, on the average.
HEAP = 4
#: Children of a node at most, and the share of a node's radius that its children should have.
CHILDREN, SHRINK = 16, 0.5


def _net(points: np.ndarray, first: int, most: int, radius: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centers from ``first`` on, each the farthest from those before, until all lie within ``radius`` or there are ``most``.

    Returns the centers, and of each point the nearest center and its distance.
    """
    centers = [first]
    away = np.sqrt(((points - points[first]) ** 2).sum(axis=1))
    nearest = np.zeros(len(points), np.int64)
    while len(centers) < most and (far := int(np.argmax(away))) is not None and away[far] > radius:
        d = np.sqrt(((points - points[far]) ** 2).sum(axis=1))
        closer = d < away
        nearest[closer] = len(centers)
        away = np.where(closer, d, away)
        centers.append(far)
    return centers, nearest, away


class CoverTree:
    """Nested balls: a node's center is the center of one of its children, children's centers are farther apart
    than their radii, and every radius covers all rows below.

    Large nodes are always split.  One of ``leaf`` rows or fewer is split as long as a few children reach the share
    of its radius that they should have: then pruning can tell them apart, where elsewhere more nodes only cost time.
    """

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int) -> None:
        order: list[np.ndarray] = []
        self.center: list[np.ndarray] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.span: list[tuple[int, int]] = []
        done = 0
        stack = [(np.arange(len(points)), 0, -1)]
        while stack:  # depth first, so that every node's rows lie together
            rows, first, parent = stack.pop()
            own, node = points[rows], len(self.center)
            away = np.sqrt(((own - own[first]) ** 2).sum(axis=1))
            radius = float(away.max())
            self.center.append(own[first])
            self.radius.append(radius)
            self.children.append([])
            self.span.append((done, done + len(rows)))
            if parent >= 0:
                self.children[parent].append(node)
            small = len(rows) <= leaf
            most = max(1, min(CHILDREN, len(rows) // HEAP)) if small else CHILDREN
            centers, nearest, away = _net(own, first, most, radius * SHRINK)
            if radius == 0 or (small and away.max() > radius * SHRINK):
                order.append(rows)
                done += len(rows)
                continue
            for i, c in enumerate(centers):
                mine = np.flatnonzero(nearest == i)
                stack.append((rows[mine], int(np.flatnonzero(mine == c)[0]), node))
        at = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.points, self.ids = points[at], ids[at]
        self.centers, self.radii = np.array(self.center), np.array(self.radius)
        self.norms = np.sqrt((self.centers**2).sum(axis=1)) if len(self.center) else np.zeros(0)
        del self.center, self.radius


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer-valued matrices."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2**53:
        return a @ b.T
    exact = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return exact(a) @ exact(b).T


class Best:
    """Each query's best rows so far, by score and then by id; ``floor`` is a score that its kth is known to reach."""

    def __init__(self, n: int, k: int, floor: np.ndarray) -> None:
        self.k, self.rows, self.floor = k, [[] for _ in range(n)], floor.copy()

    def add(self, queries: range, scores: np.ndarray, ids: np.ndarray) -> None:
        reach = scores >= self.floor[queries.start : queries.stop][:, None]
        for i in np.flatnonzero(reach.any(axis=1)).tolist():
            q, cols = queries.start + i, np.flatnonzero(reach[i])
            new = [(-int(s), int(j)) for s, j in zip(scores[i, cols].tolist(), ids[cols].tolist(), strict=True)]
            if len(new) > 4 * self.k:
                cut = np.partition(-scores[i, cols].astype(float), self.k - 1)[self.k - 1]
                new = [r for r in new if r[0] <= cut]
            kept = sorted(self.rows[q] + new)[: self.k]
            self.rows[q] = kept
            if len(kept) == self.k:
                self.floor[q] = max(self.floor[q], -kept[-1][0])


def dual_search(queries: CoverTree, data: CoverTree, best: Best) -> int:
    """Search a query tree and a data tree together; returns the number of leaf pairs that were scored.

    For centers q, r with radii s, t no product between the two balls exceeds
    <q, r> + s|r| + t|q| + st.
    """
    scored = 0
    if not len(queries.ids) or not len(data.ids):
        return 0
    stack = [(0, 0)]
    while stack:
        q, r = stack.pop()
        span = queries.span[q]
        floor = best.floor[span[0] : span[1]].min()
        qs, rs = queries.children[q] or [q], data.children[r] or [r]
        cq, cr = queries.centers[qs], data.centers[rs]
        bound = cq @ cr.T + np.outer(queries.radii[qs], data.norms[rs]) + np.outer(queries.norms[qs], data.radii[rs])
        bound += np.outer(queries.radii[qs], data.radii[rs])
        bound += 1e-9 * (1 + np.outer(queries.norms[qs] + queries.radii[qs], data.norms[rs] + data.radii[rs]))
        if qs == [q] and rs == [r]:
            if bound[0, 0] >= floor:
                (a, b), (c, d) = span, data.span[r]
                best.add(range(a, b), products(queries.points[a:b], data.points[c:d]), data.ids[c:d])
                scored += 1
            continue
        floors = np.array([best.floor[slice(*queries.span[x])].min() for x in qs])
        i, j = np.nonzero(bound >= floors[:, None])
        for k in np.argsort(bound[i, j], kind="stable").tolist():  # the most promising pair last, so it comes first
            stack.append((qs[i[k]], rs[j[k]]))
    return scored


_FOUND = "rep long, vec_id long, score long"
_RESULT = "query_id long, rank int, vec_id long, score long"


def _assigned(rows: DataFrame, pivots: np.ndarray, scale: float) -> DataFrame:
    """``id, v, pivot, away`` with ``v`` in integers, dealt to the nearest pivot."""
    dim = pivots.shape[1]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.floor(scale * matrix(b.column("v"), dim))
            d = np.sqrt(np.maximum(0, ((v**2).sum(axis=1)[:, None] - 2 * v @ pivots.T + (pivots**2).sum(axis=1))))
            pivot = d.argmin(axis=1)
            away = np.sqrt(((v - pivots[pivot]) ** 2).sum(axis=1))
            lists = pa.ListArray.from_arrays(np.arange(0, (len(v) + 1) * dim, dim, dtype=np.int32), v.ravel())
            arrays = [b.column("id"), lists, pa.array(pivot.astype(np.int32)), pa.array(away)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "v", "pivot", "away"])

    return materialize(rows.mapInArrow(over, "id long, v array<double>, pivot int, away double"), "assigned")


class _Dealt:
    """Rows dealt to parts of about ``most`` rows, each of one pivot, with a tree for each part."""

    def __init__(self, rows: DataFrame, pivots: np.ndarray, scale: float, most: int, leaf: int) -> None:
        assigned, dim = _assigned(rows, pivots, scale), pivots.shape[1]
        sizes = assigned.groupBy("pivot").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect()  # <= PIVOTS
        self.radius = {r.pivot: r.away for r in sizes}
        self.parts, self.total = {}, 0
        for r in sorted(sizes, key=lambda r: r.pivot):
            n = -(-r.n // most)
            self.parts[r.pivot] = (self.total, n)
            self.total += n
        base = F.lit([self.parts.get(p, (0, 1))[0] for p in range(len(pivots))])
        many = F.lit([self.parts.get(p, (0, 1))[1] for p in range(len(pivots))])
        nth = F.pmod(F.xxhash64("id"), F.get(many, F.col("pivot")))
        dealt = assigned.withColumn("part", (F.get(base, F.col("pivot")) + nth).cast("long"))

        def build(table: pa.Table) -> pa.Table:
            points = matrix(table.column("v").combine_chunks(), dim)
            ids = table.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")  # the same tree whatever order rows come in
            tree = CoverTree(points[order], ids[order], leaf)
            part, pivot = table.column("part")[0].as_py(), table.column("pivot")[0].as_py()
            return pa.table(
                {
                    "part": pa.array([part], pa.int64()),
                    "pivot": pa.array([pivot], pa.int32()),
                    "tree": pa.array([pickle.dumps(tree, 5)], pa.binary()),
                    "ids": pa.array([tree.ids.tolist()], pa.list_(pa.int64())),
                }
            )

        built = spread(dealt, "part", self.total).groupBy("part").applyInArrow(build, "part long, pivot int, tree binary, ids array<long>")
        self.trees = materialize(built, "trees")


def _searched(shards: DataFrame, n_shards: int, tasks: DataFrame, k: int) -> DataFrame:
    """``rep, vec_id, score`` of ``tasks`` (``shard, tree, floor``): each group of queries in the shard it names.

    Each shard's tree comes first in its task, and then one group after the
    other; no more than one tree of each is held.
    """
    none = F.lit(None)
    trees = shards.select(F.col("part").alias("shard"), F.lit(0).alias("kind"), "tree", none.cast("array<long>").alias("floor"))
    both = trees.unionByName(tasks.select("shard", F.lit(1).alias("kind"), "tree", "floor"))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, data = None, None
        for b in batches:
            for i in range(b.num_rows):
                tree = pickle.loads(b.column("tree")[i].as_py())
                if b.column("kind")[i].as_py() == 0:
                    shard, data = b.column("shard")[i].as_py(), tree
                    continue
                if shard != b.column("shard")[i].as_py():
                    continue  # a shard without rows
                floor = b.column("floor")[i].as_py() or [None] * len(tree.ids)
                floor = np.array([-np.inf if f is None else f for f in floor])
                best = Best(len(tree.ids), k + 1, floor)
                dual_search(tree, data, best)
                reps = [int(q) for q, rows in zip(tree.ids, best.rows, strict=True) for _ in rows]
                flat = [r for rows in best.rows for r in rows]
                columns = [reps, [j for _, j in flat], [-s for s, _ in flat]]
                arrays = [pa.array(c, pa.int64()) for c in columns]
                yield pa.RecordBatch.from_arrays(arrays, names=["rep", "vec_id", "score"])

    return spread(both, "shard", n_shards).sortWithinPartitions("shard", "kind").mapInArrow(over, _FOUND)


def top_k(
    table: DataFrame,
    queries: DataFrame,
    k: int = 20,
    scale: float = 64.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest integer inner products over all other rows.

    Components become floor(scale * x).  Vectors that are null or hold null or
    non-finite components, and rows without id, take no part; shorter vectors are
    taken with zeros behind; a query with fewer candidates gets all; equal scores
    go to the smaller id; rows that are equal
    in id and vector count once; no row of a query's own id is its result.  Scores must
    fit in a long.  An empty table gives an empty table.
    """
    data, n, dim = padded(valid(table, id_col, vector_col))
    asks, n_asks, own_dim = padded(valid(queries, id_col, vector_col))
    if not n or not n_asks or not dim:
        return table.sparkSession.createDataFrame([], _RESULT)
    if own_dim < dim:
        asks = asks.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), dim - own_dim)))
    data = materialize(first_copies(data, k + 1), "rows")
    reps, asked = askers(asks.withColumn("v", F.slice("v", 1, dim)))  # components beyond meet zeros only
    asked = materialize(asked, "asked")

    # The top of both trees: pivots among a bounded sample, each the farthest from those before.
    picked = sampled(data, "id", PIVOT_ROWS, seed=2).orderBy("id").toArrow().column("v").combine_chunks()
    sample = np.floor(scale * matrix(picked, dim))
    pivots = sample[_net(sample, 0, PIVOTS, 0.0)[0]] if len(sample) else np.zeros((1, dim))
    shards = _Dealt(data, pivots, scale, SHARD_ROWS, LEAF)
    groups = _Dealt(reps.select(F.col("rep").alias("id"), "v"), pivots, scale, GROUP_QUERIES, QUERY_LEAF)

    # First each group of queries in the shards of its own pivot, for a floor under each kth score.
    mine = F.lit([list(range(b, b + c)) for b, c in (shards.parts.get(p, (0, 0)) for p in range(len(pivots)))])
    no_floor = F.lit(None).cast("array<long>").alias("floor")
    near = groups.trees.select(F.explode(F.get(mine.cast("array<array<long>>"), F.col("pivot"))).alias("shard"), "tree", no_floor)
    first = materialize(_searched(shards.trees, shards.total, near, k), "found")
    by_score = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    # Spark trims each task's rows to k + 1 for each query before the shuffle
    kth = first.withColumn("_nth", F.row_number().over(by_score)).where(F.col("_nth") <= k + 1).where(F.col("_nth") == k + 1)
    kth = kth.select("rep", F.col("score").alias("kth"))
    places = groups.trees.select("part", F.posexplode("ids").alias("place", "rep")).join(kth, "rep", "left")
    floors = places.groupBy("part").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "kth"))), lambda m: m["kth"]).alias("floor")
    )

    # Then in the shards of all other pivots whose ball can hold a better row.
    radius = np.array([shards.radius.get(p, 0.0) for p in range(len(pivots))])
    there = np.array([p in shards.parts for p in range(len(pivots))])
    norms = np.sqrt((pivots**2).sum(axis=1))

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = []
            for i in range(b.num_rows):
                tree, own = pickle.loads(b.column("tree")[i].as_py()), b.column("pivot")[i].as_py()
                floor = min(-np.inf if f is None else f for f in b.column("floor")[i].as_py())
                c, r, norm = tree.centers[0], tree.radii[0], tree.norms[0]
                bound = pivots @ c + r * norms + radius * norm + r * radius
                bound += 1e-9 * (1 + (norm + r) * (norms + radius))
                wanted.append([p for p in np.flatnonzero(there & (bound >= floor)).tolist() if p != own])
            arrays = [b.column("tree"), b.column("floor"), pa.array(wanted, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["tree", "floor", "wanted"])

    ready = groups.trees.join(floors, "part").select("pivot", "tree", "floor")
    far = ready.mapInArrow(reaching, "tree binary, floor array<long>, wanted array<int>")
    far = far.select("tree", "floor", F.explode("wanted").alias("pivot"))
    far = far.select(F.explode(F.get(mine.cast("array<array<long>>"), F.col("pivot"))).alias("shard"), "tree", "floor")
    found = first.unionByName(_searched(shards.trees, shards.total, far, k))
    return ranked(found, asked, k, "score", best_first=True)
