"""Traces ``roi, t, v``: centring, scaling, peaks, running medians, baselines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimmer.functions.columns import upper_median_of


def center_and_scale(trace: DataFrame, polarity: int = 1, low: float = 0.01) -> DataFrame:
    """``roi, t, v``: flipped for negative polarity, the median taken off, divided by minus the ``low`` percentile.

    Null where that percentile is 0.
    """
    flipped = trace.select("roi", "t", (F.col("v") * (1.0 if polarity >= 0 else -1.0)).alias("v"))
    stats = flipped.groupBy("roi").agg(F.percentile("v", F.lit([0.5, low])).alias("_p"))
    median, scale = F.get("_p", F.lit(0)), F.get("_p", F.lit(0)) - F.get("_p", F.lit(1))
    return flipped.join(stats, "roi").select("roi", "t", F.try_divide(F.col("v") - median, scale).alias("v"))


def find_peaks(trace: DataFrame, height: float | None = None) -> DataFrame:
    """``roi, t, v`` of strict local maxima: higher than the values on both sides; of a plateau its middle.

    Runs of equal values are collapsed, then each run looks at its neighbours;
    the first and last run of a trace are no peaks.
    """
    in_time = Window.partitionBy("roi").orderBy("t")
    change = F.coalesce((F.col("v") != F.lag("v").over(in_time)).cast("int"), F.lit(1))
    numbered = trace.withColumn("_c", change).withColumn("_run", F.sum("_c").over(in_time))
    runs = numbered.groupBy("roi", "_run").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.first("v").alias("v"))
    by_run = Window.partitionBy("roi").orderBy("_run")
    runs = runs.withColumns({"_l": F.lag("v").over(by_run), "_r": F.lead("v").over(by_run)})
    peaks = runs.where((F.col("_l") < F.col("v")) & (F.col("_r") < F.col("v")))
    if height is not None:
        peaks = peaks.where(F.col("v") >= height)
    return peaks.select("roi", F.expr("(a + b) div 2").alias("t"), "v")


def running_median_valid(trace: DataFrame, length: int = 1000, factor: float = 1.0, warm_up: int = 10) -> DataFrame:
    """``roi, t, v, median, valid``: the upper median of the last ``length`` values, and whether a value is near it.

    The first value of a trace is valid and stays out of the medians; the first
    ``warm_up - 1`` after it are valid too.  The window's frame bounds what one
    row gathers.
    """
    in_time = Window.partitionBy("roi").orderBy("t")
    rest = trace.where("t > 0").withColumn("_n", F.row_number().over(in_time))
    values = F.collect_list("v").over(in_time.rowsBetween(-(length - 1), 0))
    median = upper_median_of(values)
    rest = rest.withColumn("median", median)
    near = F.abs(F.col("median") - F.col("v")) < factor * F.col("median")
    rest = rest.select("roi", "t", "v", "median", ((F.col("_n") < warm_up) | near).alias("valid"))
    first = trace.where("t = 0").select("roi", "t", "v", F.lit(None).cast("long").alias("median"), F.lit(True).alias("valid"))
    return first.unionByName(rest)


def _weights(sigma: float) -> list[float]:
    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(raw)
    return [w / total for w in raw]


def remove_baseline(trace: DataFrame, sigma: float) -> DataFrame:
    """``roi, t, v`` minus its Gaussian-weighted neighbourhood (radius 4 sigma), with the ends mirrored half a sample out.

    A trace is gathered into one row and convolved by array functions, so that
    there is no join over neighbouring times.
    """
    weights = _weights(sigma)
    radius = len(weights) // 2
    ordered = trace.groupBy("roi").agg(F.array_sort(F.collect_list(F.struct("t", F.col("v").cast("double").alias("v")))).alias("a"))
    values = ordered.select("roi", F.transform("a", lambda s: s["t"]).alias("ts"), F.transform("a", lambda s: s["v"]).alias("a"))
    n = F.size("a")

    def mirrored(i: Column) -> Column:
        folded = F.pmod(i, 2 * n)
        return F.when(folded < n, folded).otherwise(2 * n - 1 - folded)

    kernel = F.lit([float(w) for w in weights])

    def smooth(v: Column, i: Column) -> Column:
        near = F.transform(F.sequence(i - radius, i + radius), lambda j: F.get("a", mirrored(j)))
        total = F.aggregate(F.zip_with(near, kernel, lambda p, w: p * w), F.lit(0.0), lambda s, x: s + x)
        return v - total

    out = values.select("roi", "ts", F.transform("a", smooth).alias("a"))
    pairs = out.select("roi", F.explode(F.arrays_zip("ts", "a")).alias("p"))
    return pairs.select("roi", F.col("p.ts").alias("t"), F.col("p.a").alias("v"))


def remove_inactive(trace: DataFrame, peaks: DataFrame) -> DataFrame:
    """Traces with at least one peak, numbered from 0 in their old order.  Only the list of traces is numbered in one task."""
    active = peaks.select("roi").distinct()
    numbered = active.withColumn("new_roi", (F.row_number().over(Window.orderBy("roi")) - 1).cast("long"))
    return trace.join(numbered, "roi").select(F.col("new_roi").alias("roi"), "t", "v")


def nested_spikes(trace: DataFrame, peaks: DataFrame) -> DataFrame:
    """``neuron, potential, spikes``: a row for each trace, values and peak times in order."""
    potential = F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda s: s["v"])
    rows = trace.groupBy("roi").agg(potential.alias("potential"))
    times = peaks.groupBy("roi").agg(F.sort_array(F.collect_set("t")).alias("spikes"))
    none = F.lit([]).cast("array<bigint>")
    return rows.join(times, "roi", "left").select(F.col("roi").alias("neuron"), "potential", F.coalesce("spikes", none).alias("spikes"))


def outlier_flags(trace: DataFrame, factor: float = 4.0, buffer: int = 10) -> DataFrame:
    """``roi, t, keep, cut``: values near the median with ``buffer`` good ones around, and kept values right after a gap."""
    stats = trace.groupBy("roi").agg(F.percentile("v", F.lit(0.5)).alias("_m"), F.stddev_pop("v").alias("_s"))
    good = trace.join(stats, "roi").select("roi", "t", (F.abs(F.col("v") - F.col("_m")) < factor * F.col("_s")).alias("good"))
    in_time = Window.partitionBy("roi").orderBy("t")
    kept = good.select("roi", "t", F.min("good").over(in_time.rowsBetween(-buffer, buffer)).alias("keep"))
    before = F.lag("keep").over(in_time)
    return kept.select("roi", "t", "keep", (F.col("keep") & F.coalesce(~before, F.lit(False))).alias("cut"))


def reindex(trace: DataFrame, keep: str = "keep") -> DataFrame:
    """Kept values with their times numbered anew from 0."""
    in_time = Window.partitionBy("roi").orderBy("t")
    return trace.where(F.col(keep)).withColumn("t", (F.row_number().over(in_time) - 1).cast("long")).drop(keep)


def moving_residual(trace: DataFrame, wide: int, narrow: int) -> DataFrame:
    """``roi, t, v``: a moving mean over ``narrow`` values minus one over ``wide``: slow drift and noise taken off."""
    in_time = Window.partitionBy("roi").orderBy("t")
    mean = lambda k: F.avg("v").over(in_time.rowsBetween(-(k // 2), k // 2))
    return trace.select("roi", "t", (mean(narrow) - mean(wide)).alias("v"))


def photobleach_trend(trace: DataFrame, period: int, off: Column) -> DataFrame:
    """``roi, seg, t, trend``: a quadratic over the first ``period`` values, lines over later segments, fitted where ``off``.

    Least squares by grouped sums and closed-form solutions; a segment with too few
    values has null trends.
    """
    rows = trace.withColumn("seg", F.expr(f"t div {period}")).withColumn("_x", (F.col("t") % period).cast("double"))
    fit = rows.where(off)
    powers = [F.sum(F.pow("_x", F.lit(float(k)))).alias(f"s{k}") for k in range(5)]
    products = [F.sum(F.pow("_x", F.lit(float(k))) * F.col("v")).alias(f"p{k}") for k in range(3)]
    s = fit.groupBy("roi", "seg").agg(*powers, *products)
    line_det = F.expr("s0 * s2 - s1 * s1")
    b1 = F.try_divide(F.expr("s0 * p1 - s1 * p0"), line_det)
    b0 = F.try_divide(F.expr("s2 * p0 - s1 * p1"), line_det)
    det = F.expr("s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)")
    q0 = F.try_divide(F.expr("p0 * (s2 * s4 - s3 * s3) - s1 * (p1 * s4 - s3 * p2) + s2 * (p1 * s3 - s2 * p2)"), det)
    q1 = F.try_divide(F.expr("s0 * (p1 * s4 - s3 * p2) - p0 * (s1 * s4 - s2 * s3) + s2 * (s1 * p2 - p1 * s2)"), det)
    q2 = F.try_divide(F.expr("s0 * (s2 * p2 - p1 * s3) - s1 * (s1 * p2 - p1 * s2) + p0 * (s1 * s3 - s2 * s2)"), det)
    first = F.col("seg") == 0
    zero = F.lit(0.0)
    fits = s.select("roi", "seg", F.when(first, q0).otherwise(b0).alias("c0"), F.when(first, q1).otherwise(b1).alias("c1"), F.when(first, q2).otherwise(zero).alias("c2"))
    trend = F.expr("c0 + c1 * _x + c2 * _x * _x")
    return rows.join(fits, ["roi", "seg"], "left").select("roi", "seg", "t", trend.alias("trend"))


def mad_threshold(video: DataFrame, factor: float = 3.0, value: str = "adu") -> DataFrame:
    """``frame, y, x, v``: values under their pixel's median plus ``factor`` median absolute deviations become 0."""
    keys = ["y", "x"]
    med = video.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("_m"))
    with_med = video.join(med, keys)
    mad = with_med.groupBy(*keys).agg(F.percentile(F.abs(F.col(value) - F.col("_m")), F.lit(0.5)).alias("_d"))
    joined = with_med.join(mad, keys)
    low = F.col(value) < F.col("_m") + factor * F.col("_d")
    return joined.select("frame", "y", "x", F.when(low, F.lit(0).cast("long")).otherwise(F.col(value)).alias("v"))


def residualize(trace: DataFrame, motion: DataFrame, epoch: int) -> DataFrame:
    """``roi, t, v``: values less their linear regression on motion ``t, mx, my`` (and a constant kept) in each epoch.

    Two-variable least squares by grouped sums; an epoch whose motion can't be
    told from a constant or a line stays as it is.
    """
    rows = trace.join(motion, "t").withColumn("seg", F.expr(f"t div {epoch}"))
    sums = rows.groupBy("roi", "seg").agg(
        F.var_pop("mx").alias("xx"), F.var_pop("my").alias("yy"), F.covar_pop("mx", "my").alias("xy"),
        F.covar_pop("mx", "v").alias("xv"), F.covar_pop("my", "v").alias("yv"), F.avg("mx").alias("ax"), F.avg("my").alias("ay"),
    )
    det = F.expr("xx * yy - xy * xy")
    good = det > 1e-9 * F.greatest(F.lit(1e-12), F.col("xx") * F.col("yy"))
    bx = F.when(good, F.try_divide(F.expr("xv * yy - yv * xy"), det)).otherwise(0.0)
    by = F.when(good, F.try_divide(F.expr("yv * xx - xv * xy"), det)).otherwise(0.0)
    fits = sums.select("roi", "seg", bx.alias("bx"), by.alias("by"), "ax", "ay")
    return rows.join(fits, ["roi", "seg"]).select("roi", "t", F.expr("v - bx * (mx - ax) - by * (my - ay)").alias("v"))
