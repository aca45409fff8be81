"""Queries of the motion operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from glimmer.operators import motion
from glimmer.plans.registry import query
from glimmer.sources.views import SIDE, sql, video

_SEARCH = motion.Search(radius=1, patch=1, spacing=2)
# patches of 3 x 3 around (2, 4, 6) x (2, 4, 6): the space of an 8-pixel axis is 4 - 1 - 1 = 2 on both sides
_NCC = """+ p AS (SELECT 2 + a.i * 2 AS cy, 2 + b.i * 2 AS cx FROM range(3) a(i), range(3) b(i)),
    q AS (SELECT cy, cx, cy + a.i - 1 AS y, cx + b.i - 1 AS x FROM p, range(3) a(i), range(3) b(i)),
    o AS (SELECT a.i - 1 AS dx, b.i - 1 AS dy FROM range(3) a(i), range(3) b(i)),
    r AS (SELECT y, x, CAST(adu AS DOUBLE) AS r FROM video WHERE frame = 0),
    z AS (SELECT o.dx, o.dy, cy, cx, r, least(7, greatest(0, q.y + dy)) AS ty, least(7, greatest(0, q.x + dx)) AS tx FROM q JOIN r ON q.y = r.y AND q.x = r.x, o),
    s AS (SELECT frame, dx, dy, cy, cx, avg(r) AS r, avg(r * r) AS rr, avg(adu) AS t, avg(CAST(adu AS DOUBLE) * adu) AS tt, avg(r * adu) AS rt
      FROM z JOIN video v ON v.y = ty AND v.x = tx WHERE frame > 0 GROUP BY ALL),
    c AS (SELECT frame, dx, dy, sum(rr * (rt - r * t) / sqrt(greatest(0, rr - r * r) * greatest(0, tt - t * t) + 1e-6)) AS corr FROM s GROUP BY ALL)"""
_BEST = f"""{_NCC}, k AS (SELECT *, dx + 1 AS i, dy + 1 AS j, greatest(corr, 0) AS s FROM c),
    b AS (SELECT frame, i, j, s FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY s DESC, i, j) AS n FROM k) WHERE n = 1)"""


def _video(spark, d):
    return video(spark, d).withColumnRenamed("adu", "v")


def _corr(spark, d):
    v = _video(spark, d)
    return motion.correlations(v.where("frame > 0"), v.where("frame = 0"), _SEARCH, SIDE, SIDE)


@query("ncc_search", sql(f"{_NCC} SELECT frame, dx, dy, round(corr, 1) AS corr FROM c", "video"))
def ncc_search(spark, d):
    return _corr(spark, d).select("frame", "dx", "dy", F.round("corr", 1).alias("corr"))


@query("argmax_offset", sql(f"{_BEST} SELECT frame, i, j, round(s, 1) AS corr FROM b", "video"))
def argmax_offset(spark, d):
    return motion.best_offset(_corr(spark, d), 1).select("frame", "i", "j", F.round("corr", 1).alias("corr"))


def _moment(term: str) -> str:
    return f"sum(({term}) * v)"


# sums over the nine points, orthogonalised: 1, x, y, xy, and x^2 and y^2 less their mean of 2/3
@query("subpixel", sql(f"""{_BEST}, g AS (SELECT b.frame, b.i, b.j, x, y, k.corr AS v FROM b, range(-1, 2) p(x), range(-1, 2) q(y)
      JOIN k ON k.frame = b.frame AND k.i = least(2, greatest(0, b.i + x)) AND k.j = least(2, greatest(0, b.j + y))),
    f AS (SELECT frame, i, j, {_moment("x")} / 6 AS gx, {_moment("y")} / 6 AS gy, {_moment("x * y")} / 4 AS hxy,
      {_moment("x * x - 2.0::DOUBLE / 3")} AS hxx, {_moment("y * y - 2.0::DOUBLE / 3")} AS hyy FROM g GROUP BY ALL),
    t AS (SELECT frame, i, j, (hxy * gy - hyy * gx) / nullif(hxx * hyy - hxy * hxy, 0) AS px, (hxy * gx - hxx * gy) / nullif(hxx * hyy - hxy * hxy, 0) AS py FROM f)
    SELECT frame, round(i - 1 + CASE WHEN abs(px) < 1 AND abs(py) < 1 THEN px ELSE 0 END, 5) AS mx,
    round(j - 1 + CASE WHEN abs(px) < 1 AND abs(py) < 1 THEN py ELSE 0 END, 5) AS my FROM t""", "video"))
def subpixel(spark, d):
    out = motion.subpixel(_corr(spark, d), 1)
    return out.select("frame", F.round("mx", 5).alias("mx"), F.round("my", 5).alias("my"))


@query("estimate_motion")
def estimate_motion(spark, d):
    out = motion.estimate_motion(_video(spark, d), SIDE, SIDE, motion.Search(radius=1, patch=2, spacing=2), levels=1)
    return out.select("frame", F.round("mx", 4).alias("mx"), F.round("my", 4).alias("my"))


@query("shading_regress")
def shading_regress(spark, d):
    v = _video(spark, d)
    f = F.col("frame")
    m = v.select("frame").distinct().select(
        "frame", ((f * 7 % 11) * 0.3).cast("double").alias("mx"), ((f * 5 % 13) * 0.25).cast("double").alias("my"), (f % 10 != 3).alias("valid")
    )
    return motion.shading_correction(v.withColumn("v", F.col("v").cast("double")), m, 30).withColumn("v", F.round("v", 4))
