"""Queries of the trace operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from glimmer.operators import spikes
from glimmer.plans.registry import query
from glimmer.sources.views import sql, trace, video


def _r(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("spike_center_scale", sql("""+ f AS (SELECT roi, t, -1.0::DOUBLE * v AS v FROM trace),
    s AS (SELECT roi, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.01) AS q FROM f GROUP BY roi)
    SELECT roi, t, round((v - m) / nullif(m - q, 0), 6) AS v FROM f JOIN s USING (roi)""", "trace"))
def spike_center_scale(spark, d):
    return _r(spikes.center_and_scale(trace(spark, d), polarity=-1), "v")


_PEAKS = """+ c AS (SELECT roi, t, v, CASE WHEN v IS DISTINCT FROM lag(v) OVER w THEN 1 ELSE 0 END AS c FROM trace WINDOW w AS (PARTITION BY roi ORDER BY t)),
    g AS (SELECT roi, t, v, sum(c) OVER (PARTITION BY roi ORDER BY t) AS g FROM c),
    r AS (SELECT roi, g, min(t) AS a, max(t) AS b, any_value(v) AS v FROM g GROUP BY roi, g),
    n AS (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS n FROM r WINDOW w AS (PARTITION BY roi ORDER BY g)),
    p AS (SELECT roi, (a + b) // 2 AS t, v FROM n WHERE l < v AND n < v AND v >= 5000)"""


@query("find_peaks", sql(f"{_PEAKS} SELECT * FROM p", "trace"))
def find_peaks(spark, d):
    return spikes.find_peaks(trace(spark, d), 5000)


@query("running_median_valid", sql("""+ r AS (SELECT roi, t, v, list_sort(list(v) OVER (PARTITION BY roi ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) AS l,
      row_number() OVER (PARTITION BY roi ORDER BY t) AS n FROM trace WHERE t > 0),
    m AS (SELECT roi, t, v, l[len(l) // 2 + 1] AS median, n FROM r)
    SELECT roi, t, v, median, n < 10 OR abs(median - v) < 0.5 * median AS valid FROM m
    UNION ALL SELECT roi, t, v, NULL, true FROM trace WHERE t = 0""", "trace"))
def running_median_valid(spark, d):
    return spikes.running_median_valid(trace(spark, d), 20, 0.5)


@query("baseline_gauss", sql("""+ k AS (SELECT i - 8 AS k, exp(-0.5 * ((i - 8) / 2.0::DOUBLE) ** 2) AS g FROM range(17) t(i)), w AS (SELECT k, g / (SELECT sum(g) FROM k) AS g FROM k),
    n AS (SELECT roi, count(*) AS n FROM trace GROUP BY roi),
    i AS (SELECT roi, t, g, ((t + k) % (2 * n) + 2 * n) % (2 * n) AS f, n FROM trace JOIN n USING (roi), w),
    s AS (SELECT i.roi, i.t, sum(g * b.v) AS s FROM i JOIN trace b ON b.roi = i.roi AND b.t = CASE WHEN f < n THEN f ELSE 2 * n - 1 - f END GROUP BY ALL)
    SELECT roi, t, round(v - s, 5) AS v FROM trace JOIN s USING (roi, t)""", "trace"))
def baseline_gauss(spark, d):
    return _r(spikes.remove_baseline(trace(spark, d), 2.0), "v", digits=5)


@query("remove_inactive", sql(f"{_PEAKS.replace('5000', '9970')} SELECT dense_rank() OVER (ORDER BY roi) - 1 AS roi, t, v FROM trace WHERE roi IN (SELECT roi FROM p)", "trace"))
def remove_inactive(spark, d):
    t = trace(spark, d)
    return spikes.remove_inactive(t, spikes.find_peaks(t, 9970))


@query("nested_spikes", sql(f"""{_PEAKS}, s AS (SELECT roi, count(DISTINCT t) AS n, min(t) AS first FROM p GROUP BY roi)
    SELECT t.roi AS neuron, count(*) AS n_potential, coalesce(any_value(s.n), 0) AS n_spikes, any_value(s.first) AS first_spike, CAST(sum(v * (t.t % 7)) AS BIGINT) AS check_sum
    FROM trace t LEFT JOIN s ON s.roi = t.roi GROUP BY t.roi""", "trace"))
def nested_spikes(spark, d):
    t = trace(spark, d)
    rows = spikes.nested_spikes(t, spikes.find_peaks(t, 5000))
    mixed = F.aggregate(F.transform("potential", lambda v, i: v * (i % 7)), F.lit(0).cast("long"), lambda a, v: a + v)
    return rows.select(
        "neuron", F.size("potential").cast("long").alias("n_potential"), F.size("spikes").cast("long").alias("n_spikes"),
        F.get("spikes", F.lit(0)).alias("first_spike"), mixed.alias("check_sum"),
    )


_KEPT = """+ s AS (SELECT roi, quantile_cont(CAST(v AS DOUBLE), 0.5) AS m, stddev_pop(v) AS s FROM trace GROUP BY roi),
    g AS (SELECT roi, t, v, abs(v - m) < 2.0::DOUBLE * s AS g FROM trace JOIN s USING (roi)),
    k AS (SELECT roi, t, v, bool_and(g) OVER (PARTITION BY roi ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS keep FROM g)"""


@query("outlier_flags", sql(f"{_KEPT} SELECT roi, t, keep, keep AND coalesce(NOT lag(keep) OVER (PARTITION BY roi ORDER BY t), false) AS cut FROM k", "trace"))
def outlier_flags(spark, d):
    return spikes.outlier_flags(trace(spark, d), 2.0, 2)


@query("reindex_kept", sql(f"{_KEPT} SELECT roi, row_number() OVER (PARTITION BY roi ORDER BY t) - 1 AS t, v FROM k WHERE keep", "trace"))
def reindex_kept(spark, d):
    t = trace(spark, d)
    return spikes.reindex(t.join(spikes.outlier_flags(t, 2.0, 2).drop("cut"), ["roi", "t"]))


@query("moving_residual", sql("""SELECT roi, t, round(avg(v) OVER (PARTITION BY roi ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)
    - avg(v) OVER (PARTITION BY roi ORDER BY t ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING), 6) AS v FROM trace""", "trace"))
def moving_residual(spark, d):
    return _r(spikes.moving_residual(trace(spark, d), 21, 5), "v")


@query("photobleach_trend", sql("""+ f AS (SELECT roi, t // 20 AS seg, CAST(t % 20 AS DOUBLE) AS x, v FROM trace WHERE t % 4 <> 0),
    s AS (SELECT roi, seg, CAST(count(*) AS DOUBLE) AS s0, sum(x) AS s1, sum(x * x) AS s2, sum(x * x * x) AS s3, sum(x * x * x * x) AS s4,
      CAST(sum(v) AS DOUBLE) AS p0, sum(x * v) AS p1, sum(x * x * v) AS p2, regr_slope(v, x) AS b, regr_intercept(v, x) AS a FROM f GROUP BY ALL),
    q AS (SELECT *, nullif(s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2), 0) AS det FROM s),
    l AS (SELECT roi, seg, CASE WHEN seg = 0 THEN (p0 * (s2 * s4 - s3 * s3) - s1 * (p1 * s4 - s3 * p2) + s2 * (p1 * s3 - s2 * p2)) / det ELSE a END AS c0,
      CASE WHEN seg = 0 THEN (s0 * (p1 * s4 - s3 * p2) - p0 * (s1 * s4 - s2 * s3) + s2 * (s1 * p2 - p1 * s2)) / det ELSE b END AS c1,
      CASE WHEN seg = 0 THEN (s0 * (s2 * p2 - p1 * s3) - s1 * (s1 * p2 - p1 * s2) + p0 * (s1 * s3 - s2 * s2)) / det ELSE 0 END AS c2 FROM q)
    SELECT trace.roi, t // 20 AS seg, t, round(c0 + c1 * (t % 20) + c2 * (t % 20) ** 2, 4) AS trend FROM trace LEFT JOIN l ON l.roi = trace.roi AND l.seg = t // 20""", "trace"))
def photobleach_trend(spark, d):
    return _r(spikes.photobleach_trend(trace(spark, d), 20, F.col("t") % 4 != 0), "trend", digits=4)


@query("mad_threshold", sql("""+ m AS (SELECT y, x, quantile_cont(CAST(adu AS DOUBLE), 0.5) AS m FROM video GROUP BY ALL),
    d AS (SELECT y, x, quantile_cont(abs(adu - m), 0.5) AS d FROM video JOIN m USING (y, x) GROUP BY ALL)
    SELECT frame, y, x, CASE WHEN adu < m + 1.5::DOUBLE * d THEN 0 ELSE adu END AS v FROM video JOIN m USING (y, x) JOIN d USING (y, x)""", "video"))
def mad_threshold(spark, d):
    return spikes.mad_threshold(video(spark, d), 1.5)


@query("residualize", sql("""+ r AS (SELECT roi, t, t // 25 AS seg, v, (t * 7 % 11) * 1.0::DOUBLE AS mx, (t * 5 % 13) * 1.0::DOUBLE AS my FROM trace),
    s AS (SELECT roi, seg, var_pop(mx) AS xx, var_pop(my) AS yy, covar_pop(mx, my) AS xy, covar_pop(mx, v) AS xv, covar_pop(my, v) AS yv, avg(mx) AS ax, avg(my) AS ay, count(*) AS n FROM r GROUP BY ALL),
    g AS (SELECT *, CASE WHEN xx * yy - xy * xy > 1e-9 * greatest(1e-12, xx * yy) THEN xx * yy - xy * xy END AS det FROM s)
    SELECT r.roi, t, round(CASE WHEN det IS NULL THEN v ELSE v - (xv * yy - yv * xy) / det * (mx - ax) - (yv * xx - xv * xy) / det * (my - ay) END, 4) AS v
    FROM r JOIN g ON r.roi = g.roi AND r.seg = g.seg""", "trace"))
def residualize(spark, d):
    t = trace(spark, d)
    times = t.select("t").distinct().select("t", (F.col("t") * 7 % 11).cast("double").alias("mx"), (F.col("t") * 5 % 13).cast("double").alias("my"))
    return _r(spikes.residualize(t, times, 25), "v", digits=4)
