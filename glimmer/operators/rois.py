"""Regions as sets of pixels: ``roi, y, x``, one row for each member."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_PIXEL = ["y", "x"]

#: Parts that the frames of a shape are dealt to when its regions get its values.
_PARTS = 32


def without_overlap(rois: DataFrame) -> DataFrame:
    """Only the pixels that lie in exactly one region."""
    alone = rois.groupBy(*_PIXEL).agg(F.count("*").alias("_n")).where("_n = 1").select(*_PIXEL)
    return rois.join(alone, _PIXEL, "left_semi").select("roi", "y", "x")


def by_shape(rois: DataFrame, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """``keys, roi, shape`` of every region, and ``keys, shape, first, n, y, x`` of the distinct sets of pixels.

    What depends on a region's pixels alone is the same for all regions over them,
    so it needs computing once for a shape.  ``first`` is the smallest region of
    a shape, ``n`` their number; pixels that stand twice in a region do so in its
    shape.
    """
    k = list(keys)
    each = rois.groupBy(*k, "roi").agg(F.array_sort(F.collect_list(F.struct(*_PIXEL))).alias("p"))
    each = each.withColumn("shape", F.unhex(F.md5(F.col("p").cast("string").cast("binary"))))
    shapes = each.groupBy(*k, "shape").agg(F.min("roi").alias("first"), F.count("*").alias("n"), F.first("p").alias("p"))
    pixels = shapes.select(*k, "shape", "first", "n", F.explode("p").alias("p")).select(*k, "shape", "first", "n", "p.y", "p.x")
    return each.select(*k, "roi", "shape"), pixels


def of_regions(values: DataFrame, regions: DataFrame) -> DataFrame:
    """``roi, frame, v`` of every region, from ``shape, frame, v`` of their shapes.

    A shape's frames are dealt to parts, so that one with many regions doesn't
    lie in one task.  Both sides grow with their tables: neither is broadcast.
    """
    dealt = values.withColumn("part", F.pmod(F.hash("frame"), F.lit(_PARTS)))
    each = regions.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))))
    return dealt.join(each.hint("merge"), ["shape", "part"]).select("roi", "frame", "v")


def extract_traces(video: DataFrame, rois: DataFrame, value: str = "adu") -> DataFrame:
    """``roi, frame, v``: each region's mean in each frame.  A region without pixels has no rows.

    Means are taken once for each shape.  Spark broadcasts the shapes if they are
    small and joins by sort otherwise.
    """
    regions, shapes = by_shape(rois)
    means = video.join(shapes.select("shape", *_PIXEL), _PIXEL).groupBy("shape", "frame").agg(F.avg(value).alias("v"))
    return of_regions(means, regions)


def area_range(rois: DataFrame) -> DataFrame:
    """One row: the least and largest area and their square roots."""
    areas = rois.groupBy("roi").agg(F.count("*").alias("area"))
    ends = areas.agg(F.min("area").alias("min_area"), F.max("area").alias("max_area"))
    return ends.select("*", F.sqrt("min_area").alias("min_side"), F.sqrt("max_area").alias("max_side"))


def equivalent_diameter(rois: DataFrame) -> DataFrame:
    """``roi, diameter`` of the disk of the same area."""
    return rois.groupBy("roi").agg((2 * F.sqrt(F.count("*") / F.lit(math.pi))).alias("diameter"))


def center_of_mass(rois: DataFrame, weight: str | None = None) -> DataFrame:
    """``roi, cy, cx``; null where weights sum to 0."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    total = F.sum(w)
    return rois.groupBy("roi").agg(
        F.try_divide(F.sum(F.col("y") * w), total).alias("cy"), F.try_divide(F.sum(F.col("x") * w), total).alias("cx")
    )


def union_footprint(*sets: DataFrame) -> DataFrame:
    """Pixels of any region of any set."""
    out = sets[0].select(*_PIXEL)
    for s in sets[1:]:
        out = out.unionByName(s.select(*_PIXEL))
    return out.distinct()


def common_footprint(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels that both sets cover."""
    return a.select(*_PIXEL).intersect(b.select(*_PIXEL))


def footprint_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels of ``a`` that ``b`` doesn't cover."""
    return a.select(*_PIXEL).distinct().join(b, _PIXEL, "left_anti")


def pixel_grid(spark, height: int, width: int) -> DataFrame:
    """All pixels of a frame."""
    n = spark.range(height * width)
    return n.select(F.expr(f"id div {width}").alias("y"), (F.col("id") % width).alias("x"))


def complement(rois: DataFrame, height: int, width: int) -> DataFrame:
    """Pixels of the frame that no region covers."""
    return pixel_grid(rois.sparkSession, height, width).join(rois, _PIXEL, "left_anti")


def region_properties(rois: DataFrame) -> DataFrame:
    """``roi, area``, the box (ends exclusive) and the eccentricity of the ellipse with the same second moments.

    A pixel's own extent adds 1/12 to each variance.
    """
    n = F.count("*").cast("double")
    var = lambda a: F.sum(F.col(a) * F.col(a)) / n - F.pow(F.sum(a) / n, F.lit(2.0)) + F.lit(1 / 12)
    cov = F.sum(F.col("y") * F.col("x")) / n - (F.sum("y") / n) * (F.sum("x") / n)
    stats = rois.groupBy("roi").agg(
        F.count("*").alias("area"), F.min("y").alias("y_min"), F.min("x").alias("x_min"),
        (F.max("y") + 1).alias("y_max"), (F.max("x") + 1).alias("x_max"),
        var("y").alias("_a"), var("x").alias("_b"), cov.alias("_c"),
    )
    mid, span = (F.col("_a") + F.col("_b")) / 2, F.sqrt(F.pow((F.col("_a") - F.col("_b")) / 2, F.lit(2.0)) + F.col("_c") * F.col("_c"))
    shape = F.sqrt(F.greatest(F.lit(0.0), 1 - (mid - span) / (mid + span)))
    return stats.withColumn("eccentricity", shape).drop("_a", "_b", "_c")


def filter_regions(
    rois: DataFrame, image: DataFrame, area_min: int, area_max: int, eccentricity: float = 0.98, intensity: float | None = None, value: str = "v"
) -> DataFrame:
    """Members of the regions whose area, shape and mean intensity in ``image`` pass."""
    kept = region_properties(rois).where(F.col("area").between(area_min, area_max) & (F.col("eccentricity") <= eccentricity))
    kept = kept.select("roi")
    if intensity is not None:
        means = rois.join(image, _PIXEL).groupBy("roi").agg(F.avg(value).alias("_mean"))
        kept = kept.join(means.where(F.col("_mean") >= intensity), "roi", "left_semi")
    return rois.join(kept, "roi", "left_semi")


def drop_and_renumber(rois: DataFrame, dropped: DataFrame) -> DataFrame:
    """Regions without the dropped ones, numbered from 0 in their old order.

    Only the list of distinct regions is numbered, in one task; it is as long as
    there are regions, not pixels.
    """
    left = rois.join(dropped, "roi", "left_anti")
    order = left.select("roi").distinct()
    numbered = order.withColumn("new_roi", (F.row_number().over(Window.orderBy("roi")) - 1).cast("long"))
    return left.join(numbered, "roi").select(F.col("new_roi").alias("roi"), "y", "x")


def rasterize(polygons: DataFrame, height: int, width: int) -> DataFrame:
    """Member pixels of polygons ``roi, xs, ys``: those whose center an odd number of edges passes on the left.

    Each edge is dealt to the pixel rows that it crosses, so pixels meet only
    their own row's edges.
    """
    n = F.size("xs")
    edge = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            F.get("xs", i).alias("x0"), F.get("ys", i).alias("y0"),
            F.get("xs", F.pmod(i + 1, n)).alias("x1"), F.get("ys", F.pmod(i + 1, n)).alias("y1"),
        ),
    )
    edges = polygons.where(n > 0).select("roi", F.explode(edge).alias("e")).select("roi", "e.*").where("y0 <> y1")
    low, high = F.ceil(F.least("y0", "y1")), F.ceil(F.greatest("y0", "y1")) - 1
    rows = F.sequence(F.greatest(low, F.lit(0).cast("long")), F.least(high, F.lit(height - 1).cast("long")))
    crossing = edges.where((F.least(high, F.lit(height - 1)) >= F.greatest(low, F.lit(0)))).withColumn("y", F.explode(rows))
    at = F.col("x0") + (F.col("y") - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    # sorted crossings pair up into spans of the row
    spans = crossing.groupBy("roi", "y").agg(F.array_sort(F.collect_list(at)).alias("at"))
    pair = F.explode(F.sequence(F.lit(0), F.expr("size(at) div 2") - 1)).alias("k")
    spans = spans.where(F.size("at") > 1).select("roi", "y", "at", pair)
    first = F.greatest(F.ceil(F.get("at", 2 * F.col("k"))), F.lit(0).cast("long"))
    last = F.least(F.ceil(F.get("at", 2 * F.col("k") + 1)) - 1, F.lit(width - 1).cast("long"))
    spans = spans.select("roi", "y", first.alias("a"), last.alias("b")).where("a <= b")
    return spans.select("roi", "y", F.explode(F.sequence("a", "b")).alias("x")).distinct()
