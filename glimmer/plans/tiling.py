"""Queries of the tile operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from glimmer.operators import rois, tiles
from glimmer.plans.registry import query
from glimmer.sources.views import SIDE, sql, video

_GRID = "g AS (SELECT a.i * 2 AS ty, b.i * 3 AS tx FROM range(3) a(i), range(2) b(i))"
_IMAGES = "m AS (SELECT frame // 50 AS seg, y, x, max(adu) AS v FROM video GROUP BY ALL)"
_TILES = f"+ {_GRID}, {_IMAGES}, t AS (SELECT seg, ty, tx, y - ty AS dy, x - tx AS dx, v FROM m JOIN g ON y - ty BETWEEN 0 AND 3 AND x - tx BETWEEN 0 AND 3)"
_WEIGHT = "exp(-0.5 * ((dy - 1.5) ** 2 + (dx - 1.5) ** 2) / ((8 / 6.0::DOUBLE) ** 2))"


def images(spark, d):
    return video(spark, d).groupBy(F.expr("frame div 50").alias("seg"), "y", "x").agg(F.max("adu").alias("v"))


def _tiles(spark, d):
    grid = tiles.tile_grid(spark, SIDE, SIDE, (4, 4), (2, 3))
    return tiles.extract_tiles(images(spark, d), grid, (4, 4))


@query("tile_grid", "SELECT CAST(a.i * 2 AS BIGINT) AS ty, CAST(b.i * 3 AS BIGINT) AS tx FROM range(3) a(i), range(2) b(i)")
def tile_grid(spark, d):
    return tiles.tile_grid(spark, SIDE, SIDE, (4, 4), (2, 3))


@query("tile_extract", sql(f"{_TILES} SELECT * FROM t", "video"))
def tile_extract(spark, d):
    return _tiles(spark, d)


@query("tile_normalize", sql(f"""{_TILES} SELECT seg, ty, tx, dy, dx, round((v - min(v) OVER w) / CAST(nullif(max(v) OVER w - min(v) OVER w, 0) AS DOUBLE), 6) AS v
    FROM t WINDOW w AS (PARTITION BY seg, ty, tx)""", "video"))
def tile_normalize(spark, d):
    return tiles.normalize_tiles(_tiles(spark, d)).withColumn("v", F.round("v", 6))


@query("tile_normalize_channels", sql(f"""{_TILES}, c AS (SELECT *, 0 AS chan FROM t UNION ALL SELECT seg, ty, tx, dy, dx, v * 2 + dy, 1 FROM t),
    n AS (SELECT seg, ty, tx, max(v) - min(v) AS span FROM c WHERE chan = 0 GROUP BY ALL)
    SELECT c.seg, c.ty, c.tx, dy, dx, chan, round((v - CASE WHEN chan = 0 THEN min(v) OVER (PARTITION BY c.seg, c.ty, c.tx, chan) ELSE 0 END) / CAST(span AS DOUBLE), 6) AS v
    FROM c JOIN n ON c.seg = n.seg AND c.ty = n.ty AND c.tx = n.tx""", "video"))
def tile_normalize_channels(spark, d):
    t = _tiles(spark, d)
    two = t.withColumn("chan", F.lit(0)).unionByName(t.withColumn("v", F.col("v") * 2 + F.col("dy")).withColumn("chan", F.lit(1)))
    return tiles.normalize_channels(two, 0, [True, False]).withColumn("v", F.round("v", 6))


@query("merge_weighted", sql(f"""{_TILES}, s AS (SELECT seg, ty + dy AS y, tx + dx AS x, sum({_WEIGHT} * (v + ty)) / sum({_WEIGHT}) AS v FROM t GROUP BY ALL),
    g2 AS (SELECT DISTINCT seg, i // 8 AS y, i % 8 AS x FROM t, range(64) k(i))
    SELECT g2.seg, g2.y, g2.x, round(coalesce(v, 0), 6) AS v FROM g2 LEFT JOIN s ON s.seg = g2.seg AND s.y = g2.y AND s.x = g2.x""", "video"))
def merge_weighted(spark, d):
    t = _tiles(spark, d).withColumn("v", (F.col("v") + F.col("ty")).cast("double"))
    return tiles.merge_weighted(t, (4, 4), rois.pixel_grid(spark, SIDE, SIDE)).withColumn("v", F.round("v", 6))


@query("merge_median", sql(f"{_TILES} SELECT seg, ty + dy AS y, tx + dx AS x, quantile_cont(CAST(v + ty * 10 AS DOUBLE), 0.5) AS v FROM t GROUP BY ALL", "video"))
def merge_median(spark, d):
    return tiles.merge_median(_tiles(spark, d).withColumn("v", F.col("v") + F.col("ty") * 10))


@query("score_tiles")
def score_tiles(spark, d):
    scored = tiles.score_tiles(tiles.normalize_tiles(_tiles(spark, d)), (4, 4))
    return tiles.merge_weighted(scored, (4, 4), rois.pixel_grid(spark, SIDE, SIDE)).withColumn("v", F.round("v", 6))


@query("random_patches")
def random_patches(spark, d):
    return tiles.random_patches(images(spark, d), SIDE, SIDE, (4, 4), 10, 1)


@query("resize_images", sql(f"""+ {_IMAGES} SELECT seg, a.i AS y, b.i AS x, v FROM range(5) a(i), range(5) b(i), m
    WHERE m.y = least(7, CAST(floor((a.i + 0.5) * 8 / 5.0) AS BIGINT)) AND m.x = least(7, CAST(floor((b.i + 0.5) * 8 / 5.0) AS BIGINT))""", "video"))
def resize_images(spark, d):
    return tiles.resize_nearest(images(spark, d), (SIDE, SIDE), (5, 5))


@query("pad_images", sql(f"+ {_IMAGES} SELECT seg, a.i AS y, b.i AS x, v FROM range(10) a(i), range(8) b(i), m WHERE m.y = least(7, a.i) AND m.x = b.i", "video"))
def pad_images(spark, d):
    return tiles.pad_or_magnify(images(spark, d), (SIDE, SIDE), (10, 6), "edge")


@query("mosaic", sql(f"""+ {_IMAGES}, n AS (SELECT seg, y, x, v - 1000 AS v FROM m)
    SELECT seg, y, x, round(v / CAST((SELECT max(v) FROM m) AS DOUBLE), 9) AS v FROM m UNION ALL SELECT seg, y, x + 8, round(v / CAST((SELECT max(v) FROM n) AS DOUBLE), 9) FROM n""", "video"))
def mosaic(spark, d):
    a = images(spark, d)
    return tiles.mosaic(a, a.withColumn("v", F.col("v") - 1000), SIDE).withColumn("v", F.round("v", 9))


@query("fit_and_validate")
def fit_and_validate(spark, d):
    t = tiles.normalize_tiles(_tiles(spark, d))
    labels = images(spark, d).where("v > 1330")
    scored = tiles.score_tiles(t, (4, 4), tiles.fit_scorer(t, labels))
    merged = tiles.merge_weighted(scored, (4, 4), rois.pixel_grid(spark, SIDE, SIDE))
    return tiles.log_loss(merged, labels).withColumn("loss", F.round("loss", 4))
