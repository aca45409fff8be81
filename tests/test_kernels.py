"""Kernels against numpy, small arrays worked by hand, and edge cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.functions.columns import iir_coefficients, let, upper_median
from glimmer.operators import compare, frames, generators, matching, morphology, motion, rois, sampling, signals, spikes, tiles


def video(spark, a, name="adu"):
    a = np.asarray(a)
    kind = "long" if a.dtype.kind in "iu" else "double"
    rows = [(f, y, x, a[f, y, x].item()) for f in range(a.shape[0]) for y in range(a.shape[1]) for x in range(a.shape[2])]
    return spark.createDataFrame(rows, f"frame long, y long, x long, {name} {kind}")


def cube(df, shape, value="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["frame"], r["y"], r["x"]] = np.nan if r[value] is None else r[value]
    return out


def trace(spark, *values):
    rows = [(k, t, float(v)) for k, vs in enumerate(values) for t, v in enumerate(vs)]
    return spark.createDataFrame(rows, "roi long, t long, v double")


def pixels(spark, text, roi=0):
    rows = [(roi, y, x) for y, line in enumerate(text.split()) for x, c in enumerate(line) if c == "#"]
    return spark.createDataFrame(rows, "roi long, y long, x long")


RND = np.random.default_rng(0)


def test_upper_median_and_let(spark):
    df = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (0, 4), (1, 7)], "k int, v int")
    assert {r.k: r.m for r in df.groupBy("k").agg(upper_median("v").alias("m")).collect()} == {0: 3, 1: 7}
    assert spark.range(1).select(let(F.lit(3), lambda v: v * v).alias("v")).first().v == 9


def test_segments_leave_out_a_partial_one(spark):
    v = video(spark, RND.integers(0, 100, (7, 2, 2)))
    assert {r.seg for r in signals.segment_signals(v, 3).collect()} == {0, 1}
    assert {r.frame for r in signals.decimate(v, 3, "mean").collect()} == {0, 1, 2}
    assert {r.frame for r in signals.decimate(v, 0, "mean").collect()} == {0}
    with pytest.raises(ValueError):
        signals.segment_signals(v, 3, "other")


def test_negative_maximum_is_clamped(spark):
    v = video(spark, -np.arange(1, 9).reshape(4, 1, 2))
    got = {(r.x): r.temporal for r in signals.segment_signals(v, 4).collect()}
    assert got == {0: 0 - (-3), 1: 0 - (-4)}


def test_smoothing_matches_numpy(spark):
    a = RND.normal(size=(3, 6, 9))
    rows = [(i, 6, 9, a[i].ravel().tolist()) for i in range(3)]
    df = spark.createDataFrame(rows, "frame long, h int, w int, px array<double>")
    gain, b1, b2, b3 = iir_coefficients(1.5)

    def one(v):
        out = [v[0]] * 3
        for x in v:
            out.append(gain * x + b1 * out[-1] + b2 * out[-2] + b3 * out[-3])
        return out[3:]

    def both(v):
        forth = one([*v, *[v[-1]] * 3])
        return one(forth[::-1])[::-1][: len(v)]

    want = np.apply_along_axis(both, 1, np.apply_along_axis(both, 2, a))
    got = np.array([r.px for r in signals.smooth_frames(df, 1.5).orderBy("frame").collect()]).reshape(3, 6, 9)
    assert np.allclose(got, want)
    assert signals.smooth_frames(df, 0.3) is df
    flat = signals.smooth_frames(spark.createDataFrame([(0, 2, 5, [4.0] * 10)], df.schema), 2.0).first().px
    assert np.allclose(flat, 4.0)
    with pytest.raises(ValueError):
        iir_coefficients(0.4)


def test_trace_smoothing_is_a_fold(spark):
    gain, b1, b2, b3 = iir_coefficients(1.0)
    v = RND.normal(size=30).tolist()

    def one(a):
        a = list(a)
        for i in range(3, len(a)):
            a[i] = gain * a[i] + b1 * a[i - 1] + b2 * a[i - 2] + b3 * a[i - 3]
        return a

    got = {r.roi: r.px for r in signals.smooth_trace(trace(spark, v, [1.0, 2.0]), 1.0).collect()}
    assert np.allclose(got[0], one(one(v)[::-1])[::-1]) and got[1] == [1.0, 2.0]


def test_patch_components_match_svd(spark):
    a = RND.normal(size=(20, 4, 4)) + 3 * RND.normal(size=(20, 1, 1)) * np.arange(16).reshape(4, 4) / 8
    got = {(r.y, r.x): r.v for r in signals.patch_components(video(spark, a), 20, 4, 4, 4, 4).collect()}
    m = a.reshape(20, 16) - a.reshape(20, 16).mean(axis=0)
    values, vectors = np.linalg.eigh(m.T @ m / 20)
    want = values[-1] * np.abs(vectors[:, -1])
    assert np.allclose([got[i // 4, i % 4] for i in range(16)], want, rtol=1e-3)


def test_flat_and_single_frames(spark):
    v = video(spark, np.full((1, 2, 2), 5))
    assert np.isnan(cube(frames.rescale(v), (1, 2, 2))).all() and np.isnan(cube(frames.standardize(v), (1, 2, 2))).all()
    assert (cube(frames.equalize_frames(v), (1, 2, 2)) == 1).all()
    assert np.isnan(cube(frames.equalize_frames(video(spark, np.zeros((1, 2, 2), int))), (1, 2, 2))).all()
    odd = video(spark, RND.integers(0, 9, (1, 5, 3)))
    assert frames.pyramid_down(odd, 5, 3).count() == 2


def test_area_downsample_keeps_the_mean(spark):
    a = RND.integers(0, 100, (2, 7, 9))
    for factor in (1.0, 1.5, 2.0, 2.7):
        h, w = int(7 / factor + 0.5), int(9 / factor + 0.5)
        got = cube(frames.area_downsample(video(spark, a), 7, 9, factor), (2, h, w))
        assert np.allclose(got.mean(axis=(1, 2)), a.mean(axis=(1, 2)))
    assert np.allclose(cube(frames.area_downsample(video(spark, a), 7, 9, 1.0), (2, 7, 9)), a)


def test_bilinear_shift(spark):
    a = RND.normal(size=(2, 5, 6))
    motion_rows = spark.createDataFrame([(0, 1.0, -2.0), (1, 0.25, 0.5)], "frame long, mx double, my double")
    got = cube(frames.shift_bilinear(video(spark, a), motion_rows, 5, 6), (2, 5, 6))
    assert np.allclose(got[0, 2:, :5], a[0, :3, 1:])
    inner = 0.5 * (0.75 * a[1, 1, 2] + 0.25 * a[1, 1, 3]) + 0.5 * (0.75 * a[1, 2, 2] + 0.25 * a[1, 2, 3])
    assert np.isclose(got[1, 1, 2], inner)


def test_peaks_of_plateaus_and_ends(spark):
    t = trace(spark, [5, 1, 3, 3, 3, 1, 2, 2], [1, 2, 2, 1], [4, 4, 4], [0, 9, 0, 3, 0], [1.0])
    assert sorted((r.roi, r.t, r.v) for r in spikes.find_peaks(t).collect()) == [(0, 3, 3.0), (1, 1, 2.0), (3, 1, 9.0), (3, 3, 3.0)]
    assert [(r.roi, r.t) for r in spikes.find_peaks(t, 9).collect()] == [(3, 1)]


def test_scale_guards_zero(spark):
    got = {(r.roi, r.t): r.v for r in spikes.center_and_scale(trace(spark, [2.0] * 5, [0.0, 1.0, 2.0])).collect()}
    assert got[0, 0] is None and got[1, 2] > 0


def test_baseline_matches_numpy(spark):
    v = RND.normal(size=25)
    k = np.exp(-0.5 * (np.arange(-12, 13) / 3) ** 2)
    k /= k.sum()
    padded = np.pad(v, 12, mode="symmetric")
    want = v - np.array([padded[i : i + 25] @ k for i in range(25)])
    got = [r.v for r in spikes.remove_baseline(trace(spark, v.tolist()), 3.0).orderBy("t").collect()]
    assert np.allclose(got, want)


def test_photobleach_quadratic_first_segment(spark):
    x = np.arange(10)
    t = trace(spark, (3 + 2 * x - 0.5 * x**2).tolist() + (1 + 4 * x).tolist())
    got = spikes.photobleach_trend(t, 10, F.col("t") % 3 != 0).orderBy("t").collect()
    assert np.allclose([r.trend for r in got], [r.v for r in t.orderBy("t").collect()])


def test_morphology_round_trip(spark):
    p = pixels(spark, "....... .#####. .#####. .#####. .......")
    grown = morphology.dilate(p, 1, 5, 7)
    assert grown.count() == 15 + 2 * 5 + 2 * 3
    back = morphology.erode(grown, 1, 5, 7)
    assert {(r.y, r.x) for r in p.collect()} <= {(r.y, r.x) for r in back.collect()}
    assert morphology.erode(p, 1, 5, 7).count() == 3
    assert morphology.dilate(p.limit(0), 1, 5, 7).count() == 0


def test_labels_and_holes(spark):
    p = pixels(spark, "##..# .#..# ..#.. ##### #...# #.#.# ##### .....")
    labels = {(r.y, r.x): r.label for r in morphology.label_components(p, ["roi"]).collect()}
    assert labels[0, 0] == labels[1, 1] == labels[2, 2] == labels[4, 0] and labels[0, 4] != labels[0, 0]
    assert len(set(labels.values())) == 2
    four = {r.label for r in morphology.label_components(p, ["roi"], 4).collect()}
    assert len(four) == 3
    filled = {(r.y, r.x) for r in morphology.fill_holes(p, ["roi"], 8, 5).collect()}
    assert {(4, 1), (4, 2), (4, 3), (5, 1), (5, 3)} <= filled and (7, 0) not in filled


def test_shapes(spark):
    line = pixels(spark, "#####")
    disk = pixels(spark, ".##. #### #### .##.")
    assert rois.region_properties(line).first().eccentricity > 0.95
    assert rois.region_properties(disk).first().eccentricity < 1e-6
    ell = pixels(spark, "#.. #.. ###")
    got = morphology.convex_area(ell, ["roi"]).first()
    assert (got.area, got.convex_area) == (5, 6)
    assert morphology.convex_area(line, ["roi"]).first().convex_area == 5


def test_demix_parts_overlapping_masks(spark):
    rows = [(0, s, y, x) for s in range(6) for y in range(3) for x in range(3)]
    rows += [(0, s, y, x) for s in range(4, 12) for y in range(2, 5) for x in range(5, 8)]
    got = morphology.demix(spark.createDataFrame(rows, "grp long, seg long, y long, x long"), 3)
    parts = {}
    for r in got.collect():
        parts.setdefault(r.component, set()).add((r.y, r.x))
    assert sorted(map(len, parts.values())) == [9, 9]


def test_iou_edge_cases(spark):
    a, b = pixels(spark, "##..", 0), pixels(spark, ".##.", 7)
    assert [(r.eval_id, r.gt_id, round(r.iou, 9)) for r in matching.iou_matrix(a, b).collect()] == [(0, 7, round(1 / 3, 9))]
    none = a.limit(0)
    assert matching.iou_matrix(none, b).count() == 0 and matching.threshold_counts(matching.iou_matrix(a, none)).count() == 0
    scored = matching.scores(spark.createDataFrame([(0.5, 0, 0, 3), (0.6, 2, 0, 0)], "threshold double, tp long, fp long, fn long"))
    assert [(r.precision, r.recall, r.f1) for r in scored.orderBy("threshold").collect()] == [(0, 0, 0), (1, 1, 1)]


def test_matching_is_largest():
    rnd = random.Random(1)
    for _ in range(200):
        pairs = sorted({(rnd.randint(0, 4), rnd.randint(0, 4)) for _ in range(rnd.randint(0, 9))})
        best = max((n for n in range(len(pairs) + 1) for c in itertools.combinations(pairs, n)
                    if len({p[0] for p in c}) == n and len({p[1] for p in c}) == n), default=0)
        assert matching._largest_matching(pairs) == best


def test_one_to_one_counts(spark):
    iou = spark.createDataFrame([(0, 0, 0.6), (1, 0, 0.7), (1, 1, 0.3), (2, 1, 0.0)], "eval_id long, gt_id long, iou double")
    got = {round(r.threshold, 2): (r.tp, r.fp, r.fn) for r in matching.matched_counts(iou, 10).collect()}
    assert got[0.1] == (2, 1, 0) and got[0.5] == (1, 2, 1) and got[0.8] == (0, 3, 2)


def test_tiles_merge_back(spark):
    a = RND.normal(size=(2, 8, 8))
    images = video(spark, a, "v").withColumnRenamed("frame", "seg")
    grid = tiles.tile_grid(spark, 8, 8, (4, 4), (2, 2))
    cut = tiles.extract_tiles(images, grid, (4, 4))
    merged = tiles.merge_weighted(cut, (4, 4), rois.pixel_grid(spark, 8, 8)).withColumnRenamed("seg", "frame")
    assert np.allclose(cube(merged, (2, 8, 8)), a)
    sparse = tiles.extract_tiles(images, tiles.tile_grid(spark, 8, 8, (4, 4), (3, 3)), (4, 4))
    holes = cube(tiles.merge_weighted(sparse, (4, 4), rois.pixel_grid(spark, 8, 8)).withColumnRenamed("seg", "frame"), (2, 8, 8))
    assert (holes[:, 7] == 0).all() and np.allclose(holes[:, :7, :7], a[:, :7, :7])
    assert tiles.center_patch(9, 8, (4, 4)) == (2, 2) and tiles.batch_numbers(10, 4, True) == 3 and tiles.batch_numbers(10, 4, False) == 2
    margin = tiles.tile_grid(spark, 20, 20, (4, 4), (4, 4), (0.3, 0.0)).collect()
    assert {r.ty for r in margin} == {4, 8, 12} and {r.tx for r in margin} == {0, 4, 8, 12, 16}


def test_motion_finds_a_shift(spark):
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=(40, 40))
    base = sum(np.roll(np.roll(base, i, 0), j, 1) for i in range(3) for j in range(3)) + 20
    a = np.stack([base[4:36, 4:36], base[5:37, 2:34], base[4:36, 4:36]])
    got = {r.frame: (r.mx, r.my) for r in motion.estimate_motion(video(spark, a, "v"), 32, 32, motion.Search(3, 4, 4), 1).collect()}
    assert abs(got[1][0] - 2) < 0.3 and abs(got[1][1] + 1) < 0.3
    assert abs(got[2][0]) < 0.05 and abs(got[2][1]) < 0.05


def test_no_positive_correlation_is_the_corner(spark):
    rows = [(1, 0, 0, dx, dy, -1.0) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    corr = spark.createDataFrame(rows, "frame long, bx long, by long, dx long, dy long, corr double")
    got = motion.best_offset(corr, 1).first()
    assert (got.i, got.j, got.corr) == (0, 0, 0.0)


def test_shading_is_taken_off(spark):
    n = 24
    mx, my = np.sin(np.arange(n)) * 2, np.cos(np.arange(n) * 1.7) * 2
    a = np.zeros((n, 2, 2)) + 10
    cx, cy = mx - mx.mean(), my - my.mean()
    a += (0.5 * cx - 0.2 * cy + 0.1 * cx * cy)[:, None, None]
    rows = [(i, float(mx[i]), float(my[i]), True) for i in range(n)]
    m = spark.createDataFrame(rows, "frame long, mx double, my double, valid boolean")
    assert np.allclose(cube(motion.shading_correction(video(spark, a, "v"), m, n), a.shape), 10, atol=1e-8)
    still = m.withColumn("mx", F.lit(0.0))
    assert np.allclose(cube(motion.shading_correction(video(spark, a, "v"), still, n), a.shape), a)


def test_splits(spark):
    items = spark.range(23).select(F.col("id").alias("k"))
    folds = [r.fold for r in sampling.fold_of(items, "k", 5).orderBy("k").collect()]
    assert folds == [i for i, part in enumerate(np.array_split(range(23), 5)) for _ in part]
    assert sum(r.valid for r in sampling.shuffled_split(items, "k", 1, 5).collect()) == 4
    few = sampling.fold_of(items.limit(2), "k", 5)
    assert sorted(r.fold for r in few.collect()) == [0, 1]
    assert sampling.fold_of(items.limit(0), "k", 5).count() == 0


def test_places_over_many_ranges(spark):
    items = spark.range(500).select((F.col("id") % 90).alias("a"), (-F.col("id")).alias("b")).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        nth = sampling.numbered(items, ["a", "b"], "place", "n").collect()
        cut = sampling.batches(items, ["a", "b"], 64).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted((i % 90, -i) for i in range(500))
    assert [(r.a, r.b) for r in sorted(nth, key=lambda r: r.place)] == want
    assert sorted(r.place for r in nth) == list(range(500)) and {r.n for r in nth} == {500}
    assert sorted((r.a, r.b, r.batch) for r in cut) == [(a, b, i // 64) for i, (a, b) in enumerate(want)]


def test_generators_repeat(spark):
    one = generators.synthetic_video(spark, 5, 16, 16, 4, 9)[0]
    two = generators.synthetic_video(spark, 5, 16, 16, 4, 9)[0].repartition(3)
    assert sorted(one.collect()) == sorted(two.collect())
    masks = generators.neuron_masks(spark, 30, 32, 32, 2)
    assert masks.groupBy("y", "x").count().agg(F.max("count")).first()[0] <= 2
    assert {r.roi for r in generators.spike_pattern(spark, 20, 500, 1).collect()} >= {0}
    walk = generators.random_walk(spark, 50, 3).orderBy("frame").collect()
    assert len(walk) == 50 and walk[0].mx != walk[0].my


def test_least_squares_traces(spark):
    a = np.zeros((3, 2, 4))
    a[:, :, :2] += np.array([1, 2, 3])[:, None, None]
    a[:, :, 1:3] += np.array([5, 4, 7])[:, None, None]
    masks = pixels(spark, "##.. ##..", 0).unionByName(pixels(spark, ".##. .##.", 1))
    got = {(r.roi, r.frame): r.v for r in compare.least_squares_traces(video(spark, a), masks).collect()}
    assert np.allclose([got[0, f] for f in range(3)], [1, 2, 3]) and np.allclose([got[1, f] for f in range(3)], [5, 4, 7])


def test_background_components_match_svd(spark):
    a = RND.normal(size=(12, 3, 3)) + 5
    got = compare.background_components(video(spark, a), 2).collect()
    _, _, vt = np.linalg.svd(a.reshape(12, 9), full_matrices=False)
    for k in range(2):
        mine = np.array([r.v for r in sorted((r for r in got if r.component == k), key=lambda r: (r.y, r.x))])
        assert np.allclose(np.abs(mine @ vt[k]), 1)


def test_demix_filters(spark):
    def left(points, **limits):
        rows = [(0, s, y, x, 0.5, 0.4) for s in range(4) for y, x in points]
        got = morphology.demix(spark.createDataFrame(rows, "grp long, seg long, y long, x long, img double, prb double"), 3, **limits)
        return sorted((r.y, r.x) for r in got.collect())

    square = sorted((y, x) for y in range(5, 9) for x in range(3, 7))
    ring = sorted((y, x) for y in range(9) for x in range(9) if max(abs(y - 4), abs(x - 4)) == 4)
    line = [(3, x) for x in range(12)]
    assert left(square) == square
    assert left(ring, concavity=10.0) == ring and left(ring, concavity=81 / 32 - 0.01) == [] and left(ring, concavity=81 / 32) == ring
    assert left(line) == [] and left(line, eccentricity=1.0) == line
    assert left(square, intensity=0.5) == square and left(square, intensity=0.51) == []
    assert left(square, activity=0.2) == square and left(square, activity=0.21) == []


def test_compute_masks_of_two_datasets_by_hand(spark):
    from glimmer.plans.masks import compute_masks

    h, w = 30, 40
    cells = {"a": [(5, 5), (5, 9), (20, 30)], "b": [(12, 12)]}  # corners of squares of 6; the first two overlap
    active = {("a", 0): [0], ("a", 1): [0], ("a", 2): [0], ("a", 3): [0], ("a", 4): [1], ("a", 5): [2], ("b", 0): [0], ("b", 1): []}
    square = lambda c: {(y, x) for y in range(c[0], c[0] + 6) for x in range(c[1], c[1] + 6)}
    prob, image = [], []
    for d, corners in cells.items():
        lit = set().union(*map(square, corners))
        image += [(d, y, x, 1.0 if (y, x) in lit else 0.0) for y in range(h) for x in range(w)]
    for (d, seg), who in active.items():
        on = set().union(*(square(cells[d][i]) for i in who))
        on |= {(28, 2), (28, 3), (28, 4)} if d == "a" else set()  # no cell there: the image is dark
        prob += [(d, seg, y, x, 0.9 if (y, x) in on else 0.1) for y in range(h) for x in range(w)]
    prob = spark.createDataFrame(prob, "dataset string, seg long, y long, x long, p double")
    image = spark.createDataFrame(image, "dataset string, y long, x long, v double")
    run = lambda **more: compute_masks(prob, image, h, w, area_min=3, keys=["dataset"], background_sigma=5.0, **more)

    def regions(df):
        out = {}
        for r in df.collect():
            out.setdefault((r.dataset, r.roi), set()).add((r.y, r.x))
        return out

    got = regions(run())
    want = [square((5, 5)), square((5, 9)) - square((5, 5)), square((20, 30)), square((12, 12))]  # what is shared goes to the one that is active more
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    assert sorted(k[1] for k in got if k[0] == "a") == [0, 1, 2]
    assert run(area_max=30).count() == 0 and run(intensity=2.0).count() == 0
    grown = regions(run(dilation=1))
    assert sorted(map(len, grown.values())) == [6 * 4 + 20, 60, 60, 60]
    large = regions(run(out_shape=(2 * h, 2 * w)))
    assert sorted(map(len, large.values())) == [96, 144, 144, 144]


def test_foreground_and_vignette(spark):
    assert morphology._vignette(5, 0) == [1.0] * 5
    row = morphology._vignette(40, 2.0)
    assert len(row) == 40 and abs(row[20] - 1) < 1e-9 and 0.5 < row[0] < 0.7 and np.allclose(row, row[::-1])
    flat = spark.createDataFrame([(0, y, x, 3.0) for y in range(12) for x in range(12)], "k int, y long, x long, v double")
    pixels_, above = morphology.foreground(flat, ["k"], 12, 12, 2.0, 1.0, 0.003)
    assert pixels_.count() == 0 and above.agg({"v": "max"}).first()[0] < 1e-9


def test_majority_of_one_annotator(spark):
    sets = spark.createDataFrame([(0, 5, 1, 1), (0, 5, 1, 2), (0, 6, 4, 4)], "annotator int, roi int, y int, x int")
    assert sorted((r.y, r.x) for r in matching.majority_vote(sets).collect()) == [(1, 1), (1, 2), (4, 4)]
    two = sets.unionByName(spark.createDataFrame([(1, 9, 1, 1)], sets.schema))  # alone of two: no majority
    assert {(r.y, r.x) for r in matching.majority_vote(two).collect()} <= {(1, 1), (1, 2)}


def test_block_matching_against_plain_loops(spark):
    rnd = np.random.default_rng(3)
    h, w, search = 20, 24, motion.Search(radius=2, patch=3, spacing=4)
    frames_ = rnd.random((3, h, w))
    rows = [(f, y, x, float(frames_[f, y, x])) for f in range(3) for y in range(h) for x in range(w)]
    video = spark.createDataFrame(rows, "frame long, y long, x long, v double")
    base = spark.createDataFrame([(1, 1, -1), (2, 0, 2)], "frame long, bx long, by long")
    got = {(r.frame, r.dx, r.dy): r.corr for r in motion.correlations(video.where("frame > 0"), video.where("frame = 0"), search, h, w, base).collect()}
    assert len(got) == 50
    for f, bx, by in ((1, 1, -1), (2, 0, 2)):
        for dx in range(bx - 2, bx + 3):
            for dy in range(by - 2, by + 3):
                total = 0.0
                for cy in search.centers(h, 1.0, by):
                    for cx in search.centers(w, 1.0, bx):
                        ys = [y for y in range(cy - 3, cy + 4) if 0 <= y < h]
                        xs = [x for x in range(cx - 3, cx + 4) if 0 <= x < w]
                        r = np.array([frames_[0, y, x] for y in ys for x in xs])
                        t = np.array([frames_[f, min(h - 1, max(0, y + dy)), min(w - 1, max(0, x + dx))] for y in ys for x in xs])
                        cov = (r * t).mean() - r.mean() * t.mean()
                        total += (r * r).mean() * cov / np.sqrt(r.var() * t.var() + 1e-6)
                assert abs(got[f, dx, dy] - total) < 1e-9


def test_surface_fit_is_least_squares():
    x, y = np.array(motion._GRID, float).T
    v = np.random.default_rng(1).random(9)
    want = np.linalg.lstsq(np.stack([x**0, x, y, x * x, x * y, y * y], axis=1), v, rcond=None)[0]
    assert np.allclose(motion._surface() @ v, want)
