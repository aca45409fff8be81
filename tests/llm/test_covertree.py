import numpy as np
import pytest

from glimmer.llm import covertree
from glimmer.llm.covertree import Best, CoverTree, dual_search, products, top_k

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, k, step):
    rows = list({str(r): r for r in rows}.values())
    ok = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(object)) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max((len(v) for _, v in ok), default=0)
    ok = [(i, [int(x) for x in v] + [0] * (dim - len(v))) for i, v in ok]
    out = []
    for q, a in ok:
        if q % step == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), j) for j, b in ok if j != q)[:k]
            out += [(q, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


def run(spark, rows, k=5, step=4):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, top_k(df, df.where(f"vec_id % {step} = 0"), k).collect()))


@pytest.fixture
def small(monkeypatch):
    for name, value in {"SHARD_ROWS": 40, "GROUP_QUERIES": 10, "PIVOTS": 4, "LEAF": 8, "QUERY_LEAF": 3, "CHILDREN": 4}.items():
        monkeypatch.setattr(covertree, name, value)


def test_matches_brute_force(spark, small):
    rnd = np.random.default_rng(1)
    centers = rnd.normal(size=(6, 7)) * 3
    rows = [(i, [float(x) for x in centers[i % 6] + 0.2 * rnd.normal(size=7)]) for i in range(150)]
    rows += [(200 + i, [0.5] * 7) for i in range(60)]  # one vector many times: ties
    rows += [(300, None), (304, [1.0, None] + [0.0] * 5), (308, [float("nan")] * 7), (312, [float("inf")] + [0.0] * 6)]
    rows += rows[:9] + [(200, [0.5] * 7)] * 30  # rows that stand twice or more count once
    rows += [(316, [0.0] * 7), (320, [1.0, 2.0]), (None, [1.0] * 7), (324, [])]
    assert run(spark, rows) == brute(rows, 5, 4)


def test_few_and_none(spark):
    rows = [(4, [1.0, 2.0]), (8, [1.0, 2.0]), (3, [0.0, -1.0])]
    assert run(spark, rows) == brute(rows, 5, 4)
    assert run(spark, [(4, [1.0])]) == []
    assert run(spark, []) == []
    assert run(spark, [(4, None)]) == []


def test_large_components(spark):
    rows = [(i, [float(np.float32(3e5 * (i + 1))), 1.0, -2.5]) for i in range(12)]
    assert run(spark, rows) == brute(rows, 5, 4)
    big = np.array([[2.0**40, 1.0]])
    assert products(big, big)[0, 0] == 2**80 + 1


def test_tree_invariants_and_pruning():
    rnd = np.random.default_rng(0)
    points = np.concatenate([rnd.normal(size=(200, 3)) + c for c in ((0, 0, 0), (50, 0, 0), (0, 90, 0), (0, 0, 200))])
    points = np.round(points)
    tree = CoverTree(points, np.arange(len(points)), 16)
    for n, (a, b) in enumerate(tree.span):
        away = np.linalg.norm(tree.points[a:b] - tree.centers[n], axis=1)
        assert away.max() <= tree.radii[n] + 1e-9
        kids = tree.children[n]
        if kids:
            assert sum(tree.span[c][1] - tree.span[c][0] for c in kids) == b - a
            assert any((tree.centers[c] == tree.centers[n]).all() for c in kids)
    assert sorted(tree.ids.tolist()) == list(range(len(points)))
    queries = CoverTree(points[:40], np.arange(40), 8)
    best = Best(40, 3, np.full(40, -np.inf))
    leaves = [len([c for c in t.children if not c]) for t in (queries, tree)]
    assert dual_search(queries, tree, best) < 0.5 * leaves[0] * leaves[1]
    for q, rows in zip(queries.points, best.rows, strict=True):
        scores = tree.points @ q
        order = np.lexsort((tree.ids, -scores))[:3]
        assert rows == [(-int(scores[i]), int(tree.ids[i])) for i in order]


def test_small_nodes_are_split_where_rows_lie_in_heaps():
    rnd = np.random.default_rng(4)
    centers = rnd.normal(size=(64, 64))
    heaps = centers[rnd.integers(0, 64, 4096)] + 0.15 * rnd.normal(size=(4096, 64))
    points = np.floor(64 * heaps / np.linalg.norm(heaps, axis=1)[:, None])
    data, asks = CoverTree(points, np.arange(4096), 256), CoverTree(points[:1000], np.arange(1000), 64)
    best = Best(1000, 5, np.full(1000, -np.inf))
    dual_search(asks, data, best)
    again = Best(1000, 5, best.floor)
    leaves = [len([c for c in t.children if not c]) for t in (asks, data)]
    assert dual_search(asks, data, again) < 0.2 * leaves[0] * leaves[1]
    even = rnd.normal(size=(2048, 64))
    even = np.floor(64 * even / np.linalg.norm(even, axis=1)[:, None])
    assert len([c for c in CoverTree(even, np.arange(2048), 256).children if not c]) < 200  # nothing to tell apart there
    for q, first, second in zip(asks.points, best.rows, again.rows, strict=True):
        scores = data.points @ q
        order = np.lexsort((data.ids, -scores))[:5]
        assert first == second == [(-int(scores[i]), int(data.ids[i])) for i in order]
