"""Queries of the frame and signal operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from glimmer.operators import frames, signals
from glimmer.plans.registry import query
from glimmer.sources.views import SIDE, frame_rows, sql, trace, video


def _r(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("skip_frames", sql("SELECT frame - 100 AS frame, y, x, adu FROM video WHERE frame >= 100", "video"))
def skip_frames(spark, d):
    return frames.skip_frames(video(spark, d), 100)


@query("thumbnail", sql("SELECT y, x, adu FROM video WHERE frame = 0", "video"))
def thumbnail(spark, d):
    return frames.single_frame(video(spark, d))


@query("frame_equalize", sql("SELECT frame, y, x, round(adu / avg(adu) OVER (PARTITION BY frame), 6) AS v FROM video", "video"))
def frame_equalize(spark, d):
    return _r(frames.equalize_frames(video(spark, d)), "v")


@query("minmax_rescale", sql("SELECT frame, y, x, round((adu - (SELECT min(adu) FROM video)) / CAST((SELECT max(adu) - min(adu) FROM video) AS DOUBLE), 6) AS v FROM video", "video"))
def minmax_rescale(spark, d):
    return _r(frames.rescale(video(spark, d)), "v")


@query("pyramid_down", sql("SELECT frame, y//2 AS y, x//2 AS x, CAST(sum(adu) AS DOUBLE) / 4 AS v FROM video GROUP BY ALL", "video"))
def pyramid_down(spark, d):
    return frames.pyramid_down(video(spark, d), SIDE, SIDE)


_OVERLAP = "least((c.i + 1) * 1.6::DOUBLE, p + 1) - greatest(c.i * 1.6::DOUBLE, p)"


@query("area_downsample", sql(f"""+ o AS (SELECT c.i AS c, p.i AS p, {_OVERLAP.replace(' p + 1', ' p.i + 1').replace(', p)', ', p.i)')} AS w
    FROM range(5) c(i), range(8) p(i)),
    w AS (SELECT * FROM o WHERE w > 1e-12)
    SELECT frame, a.c AS y, b.c AS x, round(sum(adu * a.w * b.w) / sum(a.w * b.w), 6) AS v
    FROM video JOIN w a ON a.p = y JOIN w b ON b.p = x GROUP BY ALL""", "video"))
def area_downsample(spark, d):
    return _r(frames.area_downsample(video(spark, d), SIDE, SIDE, 1.6), "v")


def wobble(v):
    """A made-up motion for each frame."""
    f = F.col("frame")
    return v.select("frame").distinct().select(
        "frame", ((f % 5 - 2) * 0.37).cast("double").alias("mx"), ((f % 3 - 1) * 0.6).cast("double").alias("my")
    )


@query("apply_motion", sql("""+ m AS (SELECT DISTINCT frame, (frame % 5 - 2) * 0.37::DOUBLE AS mx, (frame % 3 - 1) * 0.6::DOUBLE AS my FROM video),
    p AS (SELECT frame, y, x, x + mx AS sx, y + my AS sy FROM video JOIN m USING (frame)),
    q AS (SELECT *, CAST(trunc(sx) AS BIGINT) AS bx, CAST(trunc(sy) AS BIGINT) AS b_y FROM p),
    c AS (SELECT frame, y, x, least(7, greatest(0, b_y + k.i // 2)) AS cy, least(7, greatest(0, bx + k.i % 2)) AS cx,
          (CASE WHEN k.i % 2 = 1 THEN sx - bx ELSE 1 - (sx - bx) END) * (CASE WHEN k.i // 2 = 1 THEN sy - b_y ELSE 1 - (sy - b_y) END) AS w
          FROM q, range(4) k(i))
    SELECT c.frame, c.y, c.x, round(sum(w * adu), 6) AS v FROM c JOIN video v ON v.frame = c.frame AND v.y = cy AND v.x = cx GROUP BY ALL""", "video"))
def apply_motion(spark, d):
    v = video(spark, d)
    return _r(frames.shift_bilinear(v, wobble(v), SIDE, SIDE), "v")


@query("crop_integer", sql("""SELECT frame, y - (1 + CAST(trunc((frame % 3 - 1) * 1.5::DOUBLE) AS BIGINT)) AS y, x - (2 + CAST(trunc((frame % 2) * 1.0::DOUBLE) AS BIGINT)) AS x, adu
    FROM video WHERE y - (1 + trunc((frame % 3 - 1) * 1.5::DOUBLE)) BETWEEN 0 AND 3 AND x - (2 + trunc((frame % 2) * 1.0::DOUBLE)) BETWEEN 0 AND 3""", "video"))
def crop_integer(spark, d):
    v = video(spark, d)
    f = F.col("frame")
    m = v.select("frame").distinct().select("frame", ((f % 2) * 1.0).alias("mx"), ((f % 3 - 1) * 1.5).alias("my"))
    return frames.crop_integer(v, m, 1, 2, 4, 4)


@query("illuminate", sql("SELECT frame, y, x, round(adu * exp(-0.5 * ((y - 3.5) / 4.0::DOUBLE) ** 2) * exp(-0.5 * ((x - 2.5) / 4.0::DOUBLE) ** 2) * 0.9, 6) AS v FROM video", "video"))
def illuminate(spark, d):
    return _r(frames.illuminate(video(spark, d), 3.5, 2.5, 4.0, 0.9), "v")


@query("standardize", sql("SELECT frame, y, x, round((adu - avg(adu) OVER w) / nullif(stddev_pop(adu) OVER w, 0), 6) AS v FROM video WINDOW w AS (PARTITION BY frame)", "video"))
def standardize(spark, d):
    return _r(frames.standardize(video(spark, d)), "v")


@query("composite", sql("""SELECT frame, y, x, round(CASE WHEN g.y1 IS NULL THEN adu ELSE 0.7 * adu + 0.3 * 1500 * (frame % 4) / 4 END, 6) AS v
    FROM video LEFT JOIN (SELECT DISTINCT y AS y1, x AS x1 FROM gt) g ON y = y1 AND x = x1""", "video", "gt"))
def composite(spark, d):
    from glimmer.sources.views import gt

    v = video(spark, d)
    overlay = gt(spark, d).select("y", "x").distinct().withColumn("w", F.lit(1500))
    level = v.select("frame").distinct().select("frame", (F.col("frame") % 4 / 4).alias("level"))
    return _r(frames.composite(v, overlay, level, 0.3), "v")


@query("tv_norm", sql("""SELECT a.frame, CAST(sum(abs(b.adu - a.adu)) AS BIGINT) AS tv FROM video a JOIN video b
    ON a.frame = b.frame AND ((b.y = a.y + 1 AND b.x = a.x) OR (b.y = a.y AND b.x = a.x + 1)) GROUP BY ALL""", "video"))
def tv_norm(spark, d):
    return frames.total_variation(video(spark, d))


_SEG = "SELECT frame // 50 AS seg, y, x, avg(adu) AS spatial, max(adu) AS hi, min(adu) AS lo, list_sort(list(adu))[count(*) // 2 + 1] AS med FROM video GROUP BY ALL"
_MAX_MED = sql(f"SELECT seg, y, x, CAST(greatest(0, hi) - med AS BIGINT) AS temporal, spatial FROM ({_SEG}) WHERE (seg + 1) * 50 <= (SELECT max(frame) + 1 FROM video)", "video")


@query("signal_extract", _MAX_MED)
@query("max_med", _MAX_MED)
def max_med(spark, d):
    return signals.segment_signals(video(spark, d), 50, "max-med")


@query("med_min", sql(f"SELECT seg, y, x, CAST(med - least(900, lo) AS BIGINT) AS temporal, spatial FROM ({_SEG}) WHERE (seg + 1) * 50 <= (SELECT max(frame) + 1 FROM video)", "video"))
def med_min(spark, d):
    return signals.segment_signals(video(spark, d), 50, "med-min", cap=900)


@query("mean_image", sql("SELECT y, x, avg(adu) AS v FROM video GROUP BY ALL", "video"))
def mean_image(spark, d):
    return signals.projection(video(spark, d), "mean")


@query("max_projection", sql("SELECT y, x, max(adu) AS v FROM video GROUP BY ALL", "video"))
def max_projection(spark, d):
    return signals.projection(video(spark, d), "max")


@query("decimate_or", sql("SELECT frame // 7 AS frame, y, x, bool_or(adu > 1150) AS v FROM video GROUP BY ALL", "video"))
def decimate_or(spark, d):
    return signals.decimate(video(spark, d).withColumn("adu", F.col("adu") - 1150), 7, "or")


@query("decimate_mean", sql("SELECT frame // 7 AS frame, y, x, avg(adu) AS v FROM video GROUP BY ALL", "video"))
def decimate_mean(spark, d):
    return signals.decimate(video(spark, d), 7, "mean")


@query("decimate_median", sql("SELECT frame // 7 AS frame, y, x, quantile_cont(CAST(adu AS DOUBLE), 0.5) AS v FROM video GROUP BY ALL", "video"))
def decimate_median(spark, d):
    return signals.decimate(video(spark, d), 7, "median")


@query("iir_gauss")
def iir_gauss(spark, d):
    out = signals.smooth_frames(frame_rows(spark, d), 1.5)
    return out.select("frame", F.posexplode("px").alias("p", "v")).select("frame", "p", F.round("v", 6).alias("v"))


@query("iir_trace")
def iir_trace(spark, d):
    return signals.smooth_trace(trace(spark, d), 2.0).select("roi", F.size("px").alias("n"), F.round(F.aggregate("px", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query("patch_pca")
def patch_pca(spark, d):
    return _r(signals.patch_components(video(spark, d), 50, 4, 2, SIDE, SIDE), "v")


@query("fft_bands")
def fft_bands(spark, d):
    return _r(signals.temporal_band(trace(spark, d), 4, 8), "low_sum", "high_sum", digits=4)
