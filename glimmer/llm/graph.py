"""Approximate nearest neighbours by a robust-pruned directed graph in each shard."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread
from .vectors import askers, first_copies, matrix, padded, ranked, valid

#: Distinct vectors of a shard, about, and queries that are searched together.
SHARD_ROWS, QUERY_BLOCK = 8192, 256
#: Out-edges of a node, at most; nodes that a search keeps while the graph is built, and when it is asked.
DEGREE, BUILD_BEAM, SEARCH_BEAM = 32, 64, 160
#: An edge is dropped if one that is kept leads this much nearer to its end.
RELAX = 1.2
#: Nodes that are inserted side by side, at most, and nodes of a beam that are expanded side by side.
BATCH, EXPAND = 512, 4
_RESULT = "query_id long, rank int, vec_id long, score double"


class Graph:
    """Points with out-edges, -1 after the last; searches start at the point nearest to the mean."""

    def __init__(self, points: np.ndarray, seed: int = 0) -> None:
        self.unit = float(np.abs(points).max(initial=0)) or 1.0  # keeps squares within single precision
        self.points = np.ascontiguousarray(points / self.unit, np.float32)
        n = len(points)
        self.squares = (self.points**2).sum(axis=1)
        self.edges = np.full((n, DEGREE), -1, np.int32)
        self.start = int(np.argmin(((self.points - self.points.mean(axis=0)) ** 2).sum(axis=1))) if n else -1
        order = np.random.default_rng(seed).permutation(n)
        order = np.concatenate([[self.start], order[order != self.start]]) if n else order
        done = 1
        while done < n:  # batches grow with the graph, so that each finds most of its neighbours there
            nodes = order[done : done + min(BATCH, done)]
            self._insert(nodes)
            done += len(nodes)

    def beam(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Greedy search for all queries (in the graph's unit) in step: the ``width`` nearest points met, nearest first
        (-1: none), and their squared distances."""
        n = len(queries)
        squares = (queries**2).sum(axis=1)
        met = np.zeros((n, len(self.points)), bool)
        ids = np.full((n, width), -1, np.int32)
        away = np.full((n, width), np.inf, np.float32)
        ids[:, 0] = self.start
        away[:, 0] = squares + self.squares[self.start] - 2 * queries @ self.points[self.start]
        met[:, self.start] = True
        fresh = ids >= 0
        while True:
            going = np.flatnonzero(fresh.any(axis=1))
            if not len(going):
                return ids, away
            # the nearest nodes of each beam that haven't been expanded
            nth = np.cumsum(fresh[going], axis=1)
            chosen = fresh[going] & (nth <= EXPAND)
            at = np.argsort(~chosen, axis=1, kind="stable")[:, :EXPAND]
            real = np.take_along_axis(chosen, at, axis=1)
            fresh[going] &= ~chosen
            ends = self.edges[np.take_along_axis(ids[going], at, axis=1)]
            ends = np.where(real[:, :, None], ends, -1).reshape(len(going), -1)
            new = (ends >= 0) & ~met[going[:, None], np.maximum(ends, 0)]
            # one node may stand in several lists: it counts where it stands first
            order = np.argsort(np.where(new, ends, np.iinfo(np.int32).max), axis=1, kind="stable")
            ends, new = np.take_along_axis(ends, order, axis=1), np.take_along_axis(new, order, axis=1)
            new[:, 1:] &= ends[:, 1:] != ends[:, :-1]
            i, j = np.nonzero(new)
            if not len(i):
                continue
            node, asker = ends[i, j], going[i]
            met[asker, node] = True
            dots = np.einsum("ij,ij->i", queries[asker], self.points[node])
            d = np.full(ends.shape, np.inf, np.float32)
            d[i, j] = squares[asker] + self.squares[node] - 2 * dots
            all_ids = np.concatenate([ids[going], np.where(new, ends, -1)], axis=1)
            all_away = np.concatenate([away[going], d], axis=1)
            all_fresh = np.concatenate([fresh[going], new], axis=1)
            best = np.argsort(all_away, axis=1, kind="stable")[:, :width]
            ids[going] = np.take_along_axis(all_ids, best, axis=1)
            away[going] = np.take_along_axis(all_away, best, axis=1)
            fresh[going] = np.take_along_axis(all_fresh, best, axis=1)

    def _prune(self, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Of each node's candidates (-1: none) the out-edges: nearest first, without those that a kept one is nearer to."""
        candidates = np.where(candidates == nodes[:, None], -1, candidates)
        order = np.argsort(candidates, axis=1, kind="stable")
        candidates = np.take_along_axis(candidates, order, axis=1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
        ends = self.points[np.maximum(candidates, 0)]
        away = ((ends - self.points[nodes][:, None]) ** 2).sum(axis=2)
        away[candidates < 0] = np.inf
        out = np.full((len(nodes), DEGREE), -1, np.int32)
        rows = np.arange(len(nodes))
        left, factor = away.copy(), RELAX**2
        for k in range(DEGREE):
            best = left.argmin(axis=1)
            there = np.isfinite(left[rows, best])
            if not there.any():
                break
            out[there, k] = candidates[there, best[there]]
            live = np.flatnonzero(there)
            between = ((ends[live] - ends[live, best[live]][:, None]) ** 2).sum(axis=2)
            sub = left[live]
            sub[factor * between <= away[live]] = np.inf
            sub[np.arange(len(live)), best[live]] = np.inf
            left[live] = sub
        return out

    def _insert(self, nodes: np.ndarray) -> None:
        found, _ = self.beam(self.points[nodes], BUILD_BEAM)
        self.edges[nodes] = self._prune(nodes, found)
        # and back: every end gets the edge too, and is pruned if it has too many
        ends, starts = self.edges[nodes].ravel(), np.repeat(nodes, DEGREE)
        real = ends >= 0
        ends, starts = ends[real], starts[real]
        order = np.argsort(ends, kind="stable")
        ends, starts = ends[order], starts[order]
        targets, first, many = np.unique(ends, return_index=True, return_counts=True)
        more = np.full((len(targets), int(many.max(initial=0))), -1, np.int32)
        nth = np.arange(len(ends)) - np.repeat(first, many)
        more[np.repeat(np.arange(len(targets)), many), nth] = starts
        both = np.concatenate([self.edges[targets], more], axis=1)
        count = (both >= 0).sum(axis=1)
        few = count <= DEGREE
        order = np.argsort(both[few] < 0, axis=1, kind="stable")[:, :DEGREE]
        self.edges[targets[few]] = np.take_along_axis(both[few], order, axis=1)
        for at in np.array_split(np.flatnonzero(~few), -(-int((~few).sum()) // BATCH) or 1):
            if len(at):
                widest = int(count[at].max())
                order = np.argsort(both[at] < 0, axis=1, kind="stable")[:, :widest]
                self.edges[targets[at]] = self._prune(targets[at], np.take_along_axis(both[at], order, axis=1))


def nearest(
    table: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    beam: int = SEARCH_BEAM,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest other rows found, by Euclidean distance.

    Every distinct vector is a node of its shard's graph, and every query is
    searched in every shard; distances are those of the original vectors in
    double precision.  Vectors that are null, zero or hold null or non-finite
    components, and rows without id, take no part; shorter vectors are taken with
    zeros behind; equal distances go to the smaller id; rows that are equal in id
    and vector count once; no row of a query's own id is its result.  An empty table gives an empty table.
    """
    data, n, dim = padded(valid(table, id_col, vector_col, zero=False))
    asks, n_asks, own_dim = padded(valid(queries, id_col, vector_col, zero=False))
    if not n or not n_asks:
        return table.sparkSession.createDataFrame([], _RESULT)
    width = max(dim, own_dim)
    data, asks = (d.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), width - F.size("v")))) for d in (data, asks))
    copies = first_copies(data, k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    nodes = materialize(copies, "nodes")
    reps, asked = askers(asks)
    asked = materialize(asked, "asked")
    n_shards = max(1, -(-nodes.count() // shard_rows))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(n_shards)))

    def build(rows: pa.Table) -> pa.Table:
        ids = rows.column("ids").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: ids[i][0])  # the same graph whatever order rows come in
        points = matrix(rows.column("v").combine_chunks(), width)[order]
        made = (Graph(points), points, [ids[i] for i in order])
        return pa.table(
            {"shard": pa.array([rows.column("shard")[0].as_py()], pa.int64()), "data": pa.array([pickle.dumps(made, 5)])}
        )

    shards = materialize(spread(dealt, "shard", n_shards).groupBy("shard").applyInArrow(build, "shard long, data binary"), "graphs")
    shards = shards.withColumn("kind", F.lit(0))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, QUERY_BLOCK):
                part = b.slice(at, QUERY_BLOCK)
                block = (part.column("rep").to_numpy(), matrix(part.column("v"), width))
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block, 5)])], names=["data"])

    asking = materialize(reps.mapInArrow(blocks, "data binary"), "asking")
    asking = asking.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))).alias("shard"), "data")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, made = None, None
        for b in batches:
            for i in range(b.num_rows):
                if b.column("kind")[i].as_py() == 0:
                    shard, made = b.column("shard")[i].as_py(), pickle.loads(b.column("data")[i].as_py())
                elif shard == b.column("shard")[i].as_py():  # else a shard without rows
                    yield _ask(*made, *pickle.loads(b.column("data")[i].as_py()), k, beam)

    # each shard's graph comes first in its task, then one block of queries after the other
    both = shards.select("shard", "kind", "data").unionByName(asking.select("shard", F.lit(1).alias("kind"), "data"))
    both = spread(both, "shard", n_shards).sortWithinPartitions("shard", "kind")
    found = both.mapInArrow(search, "rep long, vec_id long, score double")
    return ranked(found, asked, k, "score", best_first=False)


def _ask(
    graph: Graph, points: np.ndarray, ids: list[list[int]], reps: np.ndarray, queries: np.ndarray, k: int, beam: int
) -> pa.RecordBatch:
    """The k + 1 nearest rows of a shard that a beam search finds for each query, by exact distance."""
    found, _ = graph.beam((queries / graph.unit).astype(np.float32), min(max(beam, k + 1), max(1, len(points))))
    out: tuple[list[int], list[int], list[float]] = ([], [], [])
    for rep, query, nodes in zip(reps.tolist(), queries, found, strict=True):
        nodes = nodes[nodes >= 0]
        exact = np.sqrt(((points[nodes] - query) ** 2).sum(axis=1)).tolist()
        rows = sorted((d, i) for d, node in zip(exact, nodes.tolist(), strict=True) for i in ids[node])[: k + 1]
        out[0].extend([rep] * len(rows))
        out[1].extend(i for _, i in rows)
        out[2].extend(d for d, _ in rows)
    arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())]
    return pa.RecordBatch.from_arrays(arrays, names=["rep", "vec_id", "score"])
