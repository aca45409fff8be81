"""Queries of region and morphology operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from glimmer.operators import morphology, rois, signals
from glimmer.plans.registry import query
from glimmer.sources.views import SIDE, WIDE, ev, gt, sql, video, wide_ev, wide_gt

_IN = "y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7"
_BRIGHT = "SELECT frame // 50 AS seg, y, x FROM video GROUP BY ALL HAVING max(adu) > 1330"


def bright(spark, d):
    """Pixels of each segment whose maximum is high."""
    high = video(spark, d).groupBy(F.expr("frame div 50").alias("seg"), "y", "x").agg(F.max("adu").alias("m"))
    return high.where("m > 1330").select("seg", "y", "x")


@query("overlap_removed", sql("SELECT roi, y, x FROM (SELECT *, count(*) OVER (PARTITION BY y, x) AS n FROM wide_ev) WHERE n = 1", "wide_ev"))
def overlap_removed(spark, d):
    return rois.without_overlap(wide_ev(spark, d))


@query("trace_extract", sql("SELECT roi, frame, avg(adu) AS v FROM video JOIN ev USING (y, x) GROUP BY ALL", "video", "ev"))
def trace_extract(spark, d):
    return rois.extract_traces(video(spark, d), ev(spark, d))


@query("roi_area_range", sql("SELECT min(n) AS min_area, max(n) AS max_area, sqrt(min(n)) AS min_side, sqrt(max(n)) AS max_side FROM (SELECT roi, count(*) AS n FROM gt GROUP BY roi)", "gt"))
def roi_area_range(spark, d):
    return rois.area_range(gt(spark, d))


@query("equiv_diameter", sql("SELECT roi, round(2 * sqrt(count(*) / pi()), 9) AS diameter FROM ev GROUP BY roi", "ev"))
def equiv_diameter(spark, d):
    return rois.equivalent_diameter(ev(spark, d)).withColumn("diameter", F.round("diameter", 9))


@query("center_of_mass", sql("SELECT roi, CAST(sum(y * adu) AS DOUBLE) / sum(adu) AS cy, CAST(sum(x * adu) AS DOUBLE) / sum(adu) AS cx FROM ev JOIN video USING (y, x) WHERE frame = 0 GROUP BY roi", "ev", "video"))
def center_of_mass(spark, d):
    weighted = ev(spark, d).join(video(spark, d).where("frame = 0"), ["y", "x"])
    return rois.center_of_mass(weighted, "adu")


@query("mask_union", sql("SELECT y, x FROM ev UNION SELECT y, x FROM gt", "ev", "gt"))
def mask_union(spark, d):
    return rois.union_footprint(ev(spark, d), gt(spark, d))


@query("mask_intersect", sql("SELECT y, x FROM wide_ev INTERSECT SELECT y, x FROM wide_gt", "wide_ev", "wide_gt"))
def mask_intersect(spark, d):
    return rois.common_footprint(wide_ev(spark, d), wide_gt(spark, d))


@query("mask_difference", sql("SELECT y, x FROM wide_gt EXCEPT SELECT y, x FROM wide_ev", "wide_ev", "wide_gt"))
def mask_difference(spark, d):
    return rois.footprint_difference(wide_gt(spark, d), wide_ev(spark, d))


@query("mask_complement", sql("SELECT i // 64 AS y, i % 64 AS x FROM range(4096) t(i) EXCEPT SELECT y, x FROM wide_ev", "wide_ev"))
def mask_complement(spark, d):
    return rois.complement(wide_ev(spark, d), WIDE, WIDE)


_PROPS = """SELECT roi, count(*) AS area, min(y) AS y_min, min(x) AS x_min, max(y) + 1 AS y_max, max(x) + 1 AS x_max,
    var_pop(y) + 1/12.0::DOUBLE AS a, var_pop(x) + 1/12.0::DOUBLE AS b, covar_pop(y, x) AS c FROM s GROUP BY roi"""
_ECC = "sqrt(greatest(0, 1 - ((a+b)/2 - sqrt(((a-b)/2)**2 + c*c)) / ((a+b)/2 + sqrt(((a-b)/2)**2 + c*c))))"
_SHAPES = "+ s AS (SELECT frame // 50 AS roi, y, x FROM video GROUP BY ALL HAVING max(adu) > 1330),"


@query("region_props", sql(f"{_SHAPES} p AS ({_PROPS}) SELECT roi, area, y_min, x_min, y_max, x_max, round({_ECC}, 6) AS eccentricity FROM p", "video"))
def region_props(spark, d):
    out = rois.region_properties(bright(spark, d).withColumnRenamed("seg", "roi"))
    return out.withColumn("eccentricity", F.round("eccentricity", 6))


@query("filter_regions", sql(f"""{_SHAPES} p AS ({_PROPS}), m AS (SELECT y, x, avg(adu) AS v FROM video GROUP BY ALL),
    i AS (SELECT roi, avg(v) AS mean FROM s JOIN m USING (y, x) GROUP BY roi)
    SELECT s.roi, y, x FROM s JOIN p USING (roi) JOIN i USING (roi) WHERE area BETWEEN 3 AND 40 AND {_ECC} <= 0.98 AND mean >= 990""", "video"))
def filter_regions(spark, d):
    shapes = bright(spark, d).withColumnRenamed("seg", "roi")
    return rois.filter_regions(shapes, signals.projection(video(spark, d), "mean"), 3, 40, 0.98, 990).select("roi", "y", "x")


@query("renumber_regions", sql("SELECT dense_rank() OVER (ORDER BY roi) - 1 AS roi, y, x FROM gt WHERE roi % 3 <> 0", "gt"))
def renumber_regions(spark, d):
    g = gt(spark, d)
    return rois.drop_and_renumber(g, g.where("roi % 3 = 0").select("roi").distinct())


_POLY = "SELECT n_nationkey AS roi, n_nationkey % 3 + 0.3 AS x0, (n_nationkey // 5) % 3 - 0.4 AS y0 FROM nation"


@query("polygon_raster", sql("""+ n AS (SELECT CAST(n_nationkey AS BIGINT) AS roi, CAST(n_nationkey % 3 + 0.3 AS DOUBLE) AS x0, CAST((n_nationkey // 5) % 3 - 0.4 AS DOUBLE) AS y0 FROM nation),
    e AS (SELECT roi, x0 AS xa, y0 AS ya, x0 + 4.25 AS xb, y0 + 1.5 AS yb FROM n UNION ALL SELECT roi, x0 + 4.25, y0 + 1.5, x0 + 1.5, y0 + 5.25 FROM n
          UNION ALL SELECT roi, x0 + 1.5, y0 + 5.25, x0, y0 FROM n),
    g AS (SELECT i // 8 AS y, i % 8 AS x FROM range(64) t(i))
    SELECT roi, y, x FROM e, g WHERE (ya > y) <> (yb > y) AND x >= xa + (y - ya) * (xb - xa) / (yb - ya)
    GROUP BY roi, y, x HAVING count(*) % 2 = 1""", "gt"))
def polygon_raster(spark, d):
    from glimmer.sources.views import table

    n = table(spark, d, "nation").select(
        F.col("n_nationkey").cast("long").alias("roi"),
        (F.col("n_nationkey") % 3 + 0.3).cast("double").alias("x0"), (F.expr("(n_nationkey div 5) % 3") - 0.4).cast("double").alias("y0"),
    )
    xs, ys = F.expr("array(x0, x0 + 4.25D, x0 + 1.5D)"), F.expr("array(y0, y0 + 1.5D, y0 + 5.25D)")
    return rois.rasterize(n.select("roi", xs.alias("xs"), ys.alias("ys")), SIDE, SIDE)


_MOVES = "(SELECT a.i - 1 AS dy, b.i - 1 AS dx FROM range(3) a(i), range(3) b(i) WHERE (a.i-1)**2 + (b.i-1)**2 <= 1)"


@query("dilate_disk", sql(f"SELECT DISTINCT roi, y + dy AS y, x + dx AS x FROM gt, {_MOVES} WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7", "gt"))
def dilate_disk(spark, d):
    return morphology.dilate(gt(spark, d), 1, SIDE, SIDE)


@query("erode_disk", sql(f"""SELECT g.roi, g.y, g.x FROM gt g WHERE NOT EXISTS (SELECT 1 FROM {_MOVES} m
    WHERE g.y + dy BETWEEN 0 AND 7 AND g.x + dx BETWEEN 0 AND 7 AND NOT EXISTS
    (SELECT 1 FROM gt h WHERE h.roi = g.roi AND h.y = g.y + dy AND h.x = g.x + dx))""", "gt"))
def erode_disk(spark, d):
    return morphology.erode(gt(spark, d), 1, SIDE, SIDE)


@query("outer_boundary", sql(f"SELECT DISTINCT roi, y + dy AS y, x + dx AS x FROM gt, {_MOVES} WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7 EXCEPT SELECT roi, y, x FROM gt", "gt"))
def outer_boundary(spark, d):
    return morphology.outer_boundary(gt(spark, d), SIDE, SIDE)


@query("label_components", f"""WITH RECURSIVE video AS (SELECT vec_id AS frame, (i-1)//8 AS y, (i-1)%8 AS x, CAST(floor((CAST(embedding[i] AS DOUBLE)+1)*1000) AS BIGINT) AS adu
    FROM embeddings, unnest(range(1,65)) AS u(i)), b AS ({_BRIGHT}),
    r AS (SELECT seg, y, x, y * 8 + x AS s FROM b UNION SELECT b.seg, b.y, b.x, r.s FROM r JOIN b ON b.seg = r.seg AND abs(b.y - r.y) <= 1 AND abs(b.x - r.x) <= 1),
    f AS (SELECT seg, y, x, min(s) AS s FROM r GROUP BY ALL)
    SELECT seg, y, x, dense_rank() OVER (PARTITION BY seg ORDER BY s) AS label FROM f""")
def label_components(spark, d):
    return morphology.label_components(bright(spark, d), ["seg"])


@query("fill_holes", f"""WITH RECURSIVE video AS (SELECT vec_id AS frame, (i-1)//8 AS y, (i-1)%8 AS x, CAST(floor((CAST(embedding[i] AS DOUBLE)+1)*1000) AS BIGINT) AS adu
    FROM embeddings, unnest(range(1,65)) AS u(i)), b AS (SELECT frame // 50 AS seg, y, x FROM video GROUP BY ALL HAVING max(adu) > 1270),
    g AS (SELECT seg, i // 8 AS y, i % 8 AS x FROM (SELECT DISTINCT seg FROM b), range(64) t(i) EXCEPT SELECT * FROM b),
    r AS (SELECT * FROM g WHERE y IN (0, 7) OR x IN (0, 7) UNION SELECT g.* FROM r JOIN g ON g.seg = r.seg AND abs(g.y - r.y) + abs(g.x - r.x) = 1)
    SELECT * FROM b UNION SELECT * FROM (SELECT * FROM g EXCEPT SELECT * FROM r)""")
def fill_holes(spark, d):
    high = video(spark, d).groupBy(F.expr("frame div 50").alias("seg"), "y", "x").agg(F.max("adu").alias("m"))
    return morphology.fill_holes(high.where("m > 1270").select("seg", "y", "x"), ["seg"], SIDE, SIDE)


@query("otsu", sql("""+ s AS (SELECT frame // 50 AS seg, adu FROM video), e AS (SELECT seg, min(adu) AS lo, (max(adu) - min(adu)) / 256.0::DOUBLE AS w FROM s GROUP BY seg),
    h AS (SELECT seg, least(255, CAST(floor((adu - lo) / w) AS BIGINT)) AS b, count(*) AS n, any_value(lo) AS lo, any_value(w) AS w FROM s JOIN e USING (seg) GROUP BY seg, b),
    c AS (SELECT *, lo + (b + 0.5) * w AS c FROM h),
    m AS (SELECT *, sum(n) OVER u AS w1, sum(n * c) OVER u AS m1, sum(n) OVER (PARTITION BY seg) AS wa, sum(n * c) OVER (PARTITION BY seg) AS ma FROM c WINDOW u AS (PARTITION BY seg ORDER BY b)),
    v AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY round(w1 * (wa - w1) * (m1 / w1 - (ma - m1) / (wa - w1)) ** 2, 2) DESC, b) AS r FROM m WHERE w1 < wa)
    SELECT seg, round(c, 6) AS threshold FROM v WHERE r = 1""", "video"))
def otsu(spark, d):
    values = video(spark, d).select(F.expr("frame div 50").alias("seg"), "adu")
    return morphology.otsu_threshold(values, ["seg"], "adu").withColumn("threshold", F.round("threshold", 6))


@query("gaussian_blur", sql("""+ k AS (SELECT i - 4 AS k, exp(-0.5 * (i - 4) ** 2) AS g FROM range(9) t(i)), w AS (SELECT k, g / (SELECT sum(g) FROM k) AS g FROM k),
    m AS (SELECT frame // 50 AS seg, y, x, avg(adu) AS v FROM video GROUP BY ALL),
    a AS (SELECT seg, y, t.i AS x, sum(v * g) AS v FROM range(8) t(i), w JOIN m ON m.x = least(7, greatest(0, t.i + k)) GROUP BY ALL)
    SELECT seg, t.i AS y, a.x, round(sum(v * g), 6) AS v FROM range(8) t(i), w JOIN a ON a.y = least(7, greatest(0, t.i + k)) GROUP BY ALL""", "video"))
def gaussian_blur(spark, d):
    means = video(spark, d).groupBy(F.expr("frame div 50").alias("seg"), "y", "x").agg(F.avg("adu").alias("v"))
    return morphology.gaussian_blur(means, ["seg"], 1.0, SIDE, SIDE).select("seg", "y", "x", F.round("v", 6).alias("v"))


@query("convex_area")
def convex_area(spark, d):
    return morphology.convex_area(morphology.label_components(bright(spark, d), ["seg"]), ["seg", "label"])


@query("nmf_demix")
def nmf_demix(spark, d):
    return morphology.demix(bright(spark, d).withColumn("grp", F.lit(0).cast("long")), 3)


@query("compute_masks")
def compute_masks(spark, d):
    from glimmer.plans.masks import compute_masks as run

    prob = signals.segment_signals(video(spark, d), 50)
    peak = prob.groupBy("seg").agg(F.max("temporal").alias("_m"))
    prob = prob.join(peak, "seg").select("seg", "y", "x", (F.col("temporal") / F.col("_m")).alias("p"))
    image = signals.projection(video(spark, d), "mean")
    return run(prob, image, SIDE, SIDE, 0.8, 2, 40, intensity=-50.0, activity=-50.0, background_sigma=2.0, background_threshold=0.0, dilation=1)


_GAUSS2 = "SELECT i - 8 AS k, exp(-0.5 * ((i - 8) / 2.0::DOUBLE) ** 2) AS g FROM range(17) t(i)"
_GAUSS1 = "SELECT i - 4 AS k, exp(-0.5 * (i - 4) ** 2) AS g FROM range(9) t(i)"


@query("foreground", f"""WITH RECURSIVE video AS (SELECT vec_id AS frame, (i-1)//8 AS y, (i-1)%8 AS x, CAST(floor((CAST(embedding[i] AS DOUBLE)+1)*1000) AS BIGINT) AS adu
    FROM embeddings, unnest(range(1,65)) AS u(i)), m AS (SELECT frame // 50 AS seg, y, x, avg(adu) AS v FROM video GROUP BY ALL),
    a AS ({_GAUSS2}), wa AS (SELECT k, g / (SELECT sum(g) FROM a) AS g FROM a), b AS ({_GAUSS1}), wb AS (SELECT k, g / (SELECT sum(g) FROM b) AS g FROM b),
    c AS (SELECT seg, y, t.i AS x, sum(v * g) AS v FROM range(8) t(i), wa JOIN m ON m.x = least(7, greatest(0, t.i + k)) GROUP BY ALL),
    s AS (SELECT seg, t.i AS y, c.x, sum(v * g) AS v FROM range(8) t(i), wa JOIN c ON c.y = least(7, greatest(0, t.i + k)) GROUP BY ALL),
    w AS (SELECT t.i AS p, sum(g) AS g FROM range(8) t(i), wb WHERE t.i + k BETWEEN 0 AND 7 GROUP BY ALL),
    h AS (SELECT m.seg, m.y, m.x FROM m JOIN s ON s.seg = m.seg AND s.y = m.y AND s.x = m.x JOIN w wy ON wy.p = m.y JOIN w wx ON wx.p = m.x WHERE m.v * wy.g * wx.g - s.v > 9),
    e AS (SELECT DISTINCT seg, y + p.i AS y, x + q.i AS x FROM h, range(-1, 2) p(i), range(-1, 2) q(i) WHERE abs(p.i) + abs(q.i) <= 1 AND y + p.i BETWEEN 0 AND 7 AND x + q.i BETWEEN 0 AND 7),
    g AS (SELECT seg, i // 8 AS y, i % 8 AS x FROM (SELECT DISTINCT seg FROM e), range(64) t(i) EXCEPT SELECT * FROM e),
    r AS (SELECT * FROM g WHERE y IN (0, 7) OR x IN (0, 7) UNION SELECT g.* FROM r JOIN g ON g.seg = r.seg AND abs(g.y - r.y) + abs(g.x - r.x) = 1)
    SELECT * FROM e UNION SELECT * FROM (SELECT * FROM g EXCEPT SELECT * FROM r)""")
def foreground(spark, d):
    means = video(spark, d).groupBy(F.expr("frame div 50").alias("seg"), "y", "x").agg(F.avg("adu").alias("v"))
    return morphology.foreground(means, ["seg"], SIDE, SIDE, 2.0, 1.0, 9.0, 1)[0]


@query("contour_edges", sql("""+ s(a, b, c, d, e, f) AS (VALUES (0, 0, 1, 0, 0, -1), (1, 0, 1, 1, 1, 0), (1, 1, 0, 1, 0, 1), (0, 1, 0, 0, -1, 0))
    SELECT roi, y + a AS y0, x + b AS x0, y + c AS y1, x + d AS x1 FROM gt g, s WHERE NOT EXISTS (SELECT 1 FROM gt h WHERE h.roi = g.roi AND h.y = g.y + e AND h.x = g.x + f)""", "gt"))
def contour_edges(spark, d):
    return morphology.contour_edges(gt(spark, d), ["roi"])


@query("background_pixels", sql(f"""+ u AS (SELECT DISTINCT y, x FROM wide_ev),
    g AS (SELECT DISTINCT y + dy AS y, x + dx AS x FROM u, {_MOVES} WHERE y + dy BETWEEN 0 AND 63 AND x + dx BETWEEN 0 AND 63)
    SELECT i // 64 AS y, i % 64 AS x FROM range(4096) t(i) EXCEPT SELECT y, x FROM g""", "wide_ev"))
def background_pixels(spark, d):
    union = rois.union_footprint(wide_ev(spark, d))
    return rois.complement(morphology.dilate(union, 1, WIDE, WIDE), WIDE, WIDE)
