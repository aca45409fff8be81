import numpy as np

from glimmer.llm import queries
from glimmer.llm.graph import DEGREE, Graph, nearest

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, k, step):
    rows = list({str(r): r for r in rows}.values())
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    dim = max((len(v) for _, v in ok), default=0)
    ok = [(i, np.pad(v, (0, dim - len(v)))) for i, v in ok]
    out = []
    for q, a in ok:
        if q % step == 0:
            found = sorted((float(np.sqrt(((a - b) ** 2).sum())), j) for j, b in ok if j != q)[:k]
            out += [(q, n + 1, j, d) for n, (d, j) in enumerate(found)]
    return sorted(out)


def run(spark, rows, step, **more):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, nearest(df, df.where(f"vec_id % {step} = 0"), 5, **more).collect()))


def test_matches_brute_force_on_few_rows(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, rnd.normal(size=6).tolist()) for i in range(120)]
    rows += [(200 + i, [0.5] * 6) for i in range(40)]  # one vector many times: ties
    rows += [(300, None), (304, [1.0, None] + [0.0] * 4), (308, [float("nan")] * 6), (312, [float("inf")] + [0.0] * 5)]
    rows += rows[:9] + [(200, [0.5] * 6)] * 30  # rows that stand twice or more count once
    rows += [(316, [0.0] * 6), (320, [1.0, 2.0]), (None, [1.0] * 6), (324, [])]
    got, want = run(spark, rows, 4, shard_rows=50), brute(rows, 5, 4)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-14, atol=0)


def test_few_and_none(spark):
    rows = [(4, [1.0, 2.0]), (8, [1.0, 2.0]), (3, [0.0, -1.0]), (12, [1e30, 1e30])]
    assert [r[:3] for r in run(spark, rows, 4)] == [r[:3] for r in brute(rows, 5, 4)]
    assert run(spark, [(4, [1.0])], 4) == [] and run(spark, [], 4) == [] and run(spark, [(4, [0.0])], 4) == []


def test_graph_is_pruned_and_reached():
    points = np.random.default_rng(3).normal(size=(3000, 16))
    graph = Graph(points)
    assert graph.edges.shape == (3000, DEGREE) and (graph.edges != np.arange(3000)[:, None]).all()
    for row in graph.edges[:200]:
        real = row[row >= 0]
        assert len(set(real.tolist())) == len(real)
    found, away = graph.beam(graph.points[:300], 64)
    true = ((graph.points[:300, None] - graph.points[None]) ** 2).sum(axis=2).argsort(axis=1)[:, :10]
    assert np.mean([len(set(f[:10].tolist()) & set(t.tolist())) / 10 for f, t in zip(found, true, strict=True)]) > 0.95
    assert (np.diff(away, axis=1) >= 0).all()


def test_recall_over_the_table(spark):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = brute([(r.vec_id, r.embedding) for r in table], 10, 100)
    got = {(r.query_id, r.vec_id) for r in queries.op9_graph_search(spark, sf).collect()}
    assert len(got) == len(want)
    assert np.mean([(q, j) in got for q, _, j, _ in want]) >= 0.9
