"""Queries of the generators and of the comparison methods' operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from glimmer.operators import compare, generators, rois
from glimmer.plans.registry import query
from glimmer.sources.views import SIDE, ev, frame_rows, trace, video


def _r(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


_B = ["(1-t)**3", "3*(1-t)**2*t", "3*(1-t)*t*t", "t*t*t"]
_P = [(1.0, 0.5), (2.0, 6.0), (6.0, 1.0), (6.5, 7.0)]
_AT = ["+".join(f"{b}*{p[k]}::DOUBLE" for b, p in zip(_B, _P, strict=True)) for k in (0, 1)]


@query("vessel_path", f"""WITH c AS (SELECT i, {_AT[0]} AS y, {_AT[1]} AS x FROM (SELECT i, i / 1000.0::DOUBLE AS t FROM range(1001) r(i))),
    s AS (SELECT *, coalesce(sqrt((y - lag(y) OVER (ORDER BY i)) ** 2 + (x - lag(x) OVER (ORDER BY i)) ** 2), 0) AS s FROM c)
    SELECT i, round(y, 11) AS y, round(x, 11) AS x, round(sum(s) OVER (ORDER BY i), 9) AS length FROM s""")
def vessel_path(spark, d):
    return _r(_r(generators.bezier_path(spark, _P), "y", "x", digits=11), "length", digits=9)


@query("vessel_flow", f"""WITH c AS (SELECT i, {_AT[0]} AS y, {_AT[1]} AS x FROM (SELECT i, i / 1000.0::DOUBLE AS t FROM range(1001) r(i))),
    s AS (SELECT *, coalesce(sqrt((y - lag(y) OVER (ORDER BY i)) ** 2 + (x - lag(x) OVER (ORDER BY i)) ** 2), 0) AS s FROM c),
    l AS (SELECT i, y, x, sum(s) OVER (ORDER BY i) AS length FROM s),
    v AS (SELECT f.f AS frame, y, x, 0.5 + 0.5 * sin(2 * pi() * (length - f.f * 0.7::DOUBLE) / 3.0::DOUBLE) AS v FROM l, range(20) f(f)),
    k AS (SELECT frame, floor(y) + a.i AS yy, floor(x) + b.i AS xx, v * (CASE WHEN a.i = 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) * (CASE WHEN b.i = 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) AS w
      FROM v, range(2) a(i), range(2) b(i))
    SELECT frame, CAST(yy AS BIGINT) AS y, CAST(xx AS BIGINT) AS x, round(sum(w), 4) AS v FROM k WHERE yy BETWEEN 0 AND 7 AND xx BETWEEN 0 AND 7 GROUP BY ALL""")
def vessel_flow(spark, d):
    return _r(generators.vessel_flow(spark, generators.bezier_path(spark, _P), 20, SIDE, SIDE, 0.7, 3.0), "v", digits=4)


@query("neurons_per_video", "SELECT i AS video, 5 + i % 25 AS neurons FROM range(1000) r(i)")
def neurons_per_video(spark, d):
    return generators.neurons_per_video(spark, 1000, 5, 30)


@query("spike_pattern")
def spike_pattern(spark, d):
    return generators.spike_pattern(spark, 50, 1000, 1)


@query("motion_walk")
def motion_walk(spark, d):
    return _r(generators.random_walk(spark, 200, 5), "mx", "my")


@query("focus_fluctuation")
def focus_fluctuation(spark, d):
    return _r(generators.focus_fluctuation(spark, 1000, 5), "blur")


@query("synthetic_video")
def synthetic_video(spark, d):
    return _r(generators.synthetic_video(spark, 30, 32, 32, 8, 3)[0], "v")


@query("synthetic_labels")
def synthetic_labels(spark, d):
    _, masks, spikes = generators.synthetic_video(spark, 500, 48, 48, 12, 3)
    spatial = generators.spatial_labels(masks, spikes).select(F.lit(-1).cast("long").alias("frame"), "y", "x").distinct()
    return generators.temporal_labels(masks, spikes).unionByName(spatial)


@query("lstsq_traces")
def lstsq_traces(spark, d):
    regions, found = compare.least_squares_of_shapes(video(spark, d), ev(spark, d))
    return rois.of_regions(_r(found, "v", digits=4), regions)


@query("peak_to_peak")
def peak_to_peak(spark, d):
    regions, found = compare.least_squares_of_shapes(video(spark, d), ev(spark, d))
    return rois.of_regions(_r(compare.peak_to_peak(found, "shape"), "v", digits=4), regions)


@query("background_svd")
def background_svd(spark, d):
    return _r(compare.background_components(video(spark, d), 3), "v", digits=4)


@query("blood_mask")
def blood_mask(spark, d):
    return _r(compare.blood_mask(video(spark, d), 20, 100, 0.05), "ratio", digits=4)


@query("tv_denoise")
def tv_denoise(spark, d):
    f = frame_rows(spark, d).select(F.col("frame").alias("seg"), F.posexplode("px").alias("p", "v"))
    image = f.select("seg", F.expr(f"cast(p div {SIDE} as bigint)").alias("y"), F.expr(f"cast(p % {SIDE} as bigint)").alias("x"), "v")
    return _r(compare.denoise(image, SIDE, SIDE, 0.1), "v", digits=3)


@query("detrend")
def detrend(spark, d):
    return _r(compare.detrend(trace(spark, d), 6), "v", digits=4)
