"""Many regions over few sets of pixels: work goes by the sets, rows by the regions."""

import numpy as np
import pytest

from glimmer.operators import compare, matching, rois
from glimmer.plans import registry

#: 3 x 3 squares: every region stands at one of 12 corners; two of one corner have the same pixels.
CORNERS = [(y, x) for y in range(0, 6, 2) for x in range(0, 6, 2)] + [(1, 1), (3, 2), (5, 5)]


def squares(spark, n):
    rows = [(r, y + i // 3, x + i % 3) for r in range(n) for y, x in [CORNERS[r * r % 12]] for i in range(9)]
    return spark.createDataFrame(rows, "roi long, y long, x long")


@pytest.fixture(scope="module")
def film(spark):
    a = np.random.default_rng(4).integers(0, 2000, (4, 8, 8))
    rows = [(f, y, x, int(a[f, y, x])) for f in range(4) for y in range(8) for x in range(8)]
    return a, spark.createDataFrame(rows, "frame long, y long, x long, adu long")


def columns(n):
    """Pixels by regions, 1 where a region has a pixel."""
    out = np.zeros((64, n))
    for r in range(n):
        y, x = CORNERS[r * r % 12]
        out[[(y + i // 3) * 8 + x + i % 3 for i in range(9)], r] = 1
    return out


def cells(df, n):
    out = np.full((4, n), np.nan)
    for r in df.collect():
        assert np.isnan(out[r.frame, r.roi])
        out[r.frame, r.roi] = np.nan if r.v is None else r.v
    return out


def test_least_squares_of_many_regions(spark, film, monkeypatch):
    solved, pinv = [], np.linalg.pinv
    monkeypatch.setattr(np.linalg, "pinv", lambda g, *a, **k: solved.append(g.shape) or pinv(g, *a, **k))
    got = cells(compare.least_squares_traces(film[1], squares(spark, 150)), 150)
    monkeypatch.undo()
    assert np.allclose(got, np.linalg.lstsq(columns(150), film[0].reshape(4, 64).T, rcond=1e-9)[0].T)  # of least norm
    assert solved and max(solved) <= (12, 12)  # what the driver holds doesn't grow with the regions


def test_least_squares_without_regions(spark, film):
    assert compare.least_squares_traces(film[1], squares(spark, 1).limit(0)).count() == 0


def test_peak_to_peak_query_of_many_regions(spark, tmp_path, monkeypatch):
    source = "/root/testdata/sf0.001"
    spark.read.parquet(f"{source}/embeddings.parquet").where("vec_id < 4").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(150).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()}
    frames = np.floor((np.stack([vectors[f] for f in range(4)]) + 1) * 1000)
    mask = np.zeros((64, 150))
    for r in range(150):
        mask[[((r * 7 + 1) % 6 + i // 3) * 8 + r // 4 % 6 + i % 3 for i in range(9)], r] = 1
    v = np.linalg.lstsq(mask, frames.T, rcond=1e-9)[0].T
    want = v / (v.max(axis=0) - v.min(axis=0))
    solved, pinv = [], np.linalg.pinv
    monkeypatch.setattr(np.linalg, "pinv", lambda g, *a, **k: solved.append(g.shape) or pinv(g, *a, **k))
    got = cells(registry.queries()["peak_to_peak"](spark, str(tmp_path)), 150)
    monkeypatch.undo()
    assert np.allclose(got, want, atol=6e-5)
    assert solved and max(solved) <= (24, 24)  # suppliers stand at 24 corners
    lstsq = cells(registry.queries()["lstsq_traces"](spark, str(tmp_path)), 150)
    assert np.allclose(lstsq, v, atol=6e-5)


def join_rows(df):
    """What ``df.collect()`` gives, and the rows that each join of its plan made."""
    found, rows = df.collect(), []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if "Join" in name:
            rows.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found, rows


def test_traces_of_many_regions(spark, film):
    twice = spark.createDataFrame([(150, 0, 0), (150, 0, 0), (150, 0, 1), (151, None, 3)], "roi long, y long, x long")
    found, made = join_rows(rois.extract_traces(film[1], squares(spark, 150).unionByName(twice)))
    got = {(r.frame, r.roi): r.v for r in found}
    a, mask = film[0].reshape(4, 64), columns(150)
    want = {(f, r): a[f][mask[:, r] > 0].mean() for f in range(4) for r in range(150)}
    want |= {(f, 150): (2 * a[f, 0] + a[f, 1]) / 3 for f in range(4)}  # a pixel that stands twice counts twice
    assert len(found) == len(got) and got == pytest.approx(want)
    assert sum(made) <= 2 * len(found)  # not nine rows for each


def three_annotators(spark):
    """120 regions of one annotator over 12 corners, in descending order of number; seven of the next; two of the last."""
    rows = [(0, 500 - r, y, x) for r, y, x in squares(spark, 120).collect()]
    rows += [(1, r, y + r // 4, x) for r, y, x in squares(spark, 7).collect()]
    rows += [(2, 7 * r, y, x) for r, y, x in squares(spark, 2).collect()]
    rows += [(2, 30, 0, 0), (2, 30, 0, 0), (2, 30, 4, 4)]  # a pixel that stands twice
    return spark.createDataFrame(rows, "annotator int, roi long, y long, x long"), rows


def slow_best(rows):
    sets = {}
    for a, r, y, x in rows:
        sets.setdefault((a, r), []).append((y, x))
    best = {}
    for (a, r), p in sets.items():
        for (b, s), q in sets.items():
            both = sum(p.count(c) * q.count(c) for c in set(p))
            if a != b and both:
                best[a, r, b] = max(best.get((a, r, b), (-1, 0)), (both / (len(p) + len(q) - both), -s))
    return {(a, r, b, -s, iou) for (a, r, b), (iou, s) in best.items() if -best[b, -s, a][1] == r}, sets


def test_mutual_best_of_many_regions(spark):
    sets, rows = three_annotators(spark)
    found, made = join_rows(matching.mutual_best(sets))
    assert {tuple(r) for r in found} == slow_best(rows)[0] and len(found) == len(set(found)) > 4
    assert max(made) <= 600


def test_majority_of_many_regions(spark):
    df, rows = three_annotators(spark)
    best, sets = slow_best(rows)
    want = set()
    for key in sets:
        members = sorted([key, *((b, s) for a, r, b, s, _ in best if (a, r) == key)])
        if len(members) * 2 > 3:
            pixels = [c for m in members for c in sets[m]]
            want |= {(",".join(f"{a}:{r}" for a, r in members), *c) for c in pixels if pixels.count(c) * 2 > len(members)}
    found, made = join_rows(matching.majority_vote(df))
    assert {tuple(r) for r in found} == want and len(found) == len(want) > 9
    assert max(made) <= 600


def test_majority_reads_pixels_once(spark):
    df = matching.majority_vote(three_annotators(spark)[0])
    df.collect()
    leaves, sent = [], []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "BroadcastExchangeExec":
            sent.append(node.metrics().apply("numOutputRows").value())
        if node.children().size() == 0 and name != "ReusedExchangeExec":
            leaves.append(name)
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    assert len(leaves) <= 2  # pixels once, annotators once
    assert sent and max(sent) == 1  # the number of annotators; pixels grow with their tables


def test_majority_of_several_annotators(spark):
    rnd = np.random.default_rng(6)
    for annotators in (1, 2, 4):
        rows = []
        for a in range(annotators):
            for r in range(12):
                y, x = (int(v) for v in rnd.integers(0, 9, 2))
                rows += [(a, r, y + i // 3, x + i % 3) for i in range(int(rnd.integers(4, 10)))]
        rows += [(0, None, 0, 0), (0, 20, None, 0)]  # a region without number, a pixel without place
        best, sets = slow_best([r for r in rows if None not in r[1:]] + [(0, 20, -1, -1)])
        want = set()
        for key in sets:
            members = sorted([key, *((b, s) for a, r, b, s, _ in best if (a, r) == key)])
            if len(members) * 2 > annotators:
                pixels = [c for m in members for c in sets[m]]
                want |= {(",".join(f"{a}:{r}" for a, r in members), *c) for c in pixels if pixels.count(c) * 2 > len(members)}
        want = {(c, None, 0) if y == -1 else (c, y, x) for c, y, x in want}
        df = spark.createDataFrame(rows, "annotator int, roi long, y long, x long")
        found = [tuple(r) for r in matching.majority_vote(df).collect()]
        assert set(found) == want and len(found) == len(want) > 9


def test_majority_votes_by_distinct_sets(spark):
    sets, rows = three_annotators(spark)
    df = matching.majority_vote(sets)
    found = df.collect()
    uses = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name == "ShuffleQueryStageExec":
            dealt = node.plan().child() if node.plan().getClass().getSimpleName() == "ReusedExchangeExec" else node.plan()
            uses.append(dealt.metrics().apply("shuffleRecordsWritten").value())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    assert sum(n >= len(rows) for n in uses) == 1  # all pixels are read for their distinct sets, not again for the votes
    named = {",".join(f"{m.annotator}:{m.roi}" for m in r.members) for r in matching.majority_sets(sets).collect()}
    assert {r.consensus for r in found} <= named
