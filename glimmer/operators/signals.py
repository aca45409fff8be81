"""Time-segment signals: a segment is a tumbling window of whole frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmer.functions.columns import iir_coefficients, iir_pass, upper_median_of


def with_segment(video: DataFrame, period: int, whole_only: bool = True) -> DataFrame:
    """``video`` with ``seg``; a last, partial segment is left out unless asked for."""
    out = video.withColumn("seg", F.expr(f"frame div {period}"))
    if not whole_only:
        return out
    last = video.agg((F.max("frame") + 1).alias("_n"))  # one row
    return out.crossJoin(F.broadcast(last)).where((F.col("seg") + 1) * period <= F.col("_n")).drop("_n")


def segment_signals(video: DataFrame, period: int, method: str = "max-med", cap: float = 1.0, value: str = "adu") -> DataFrame:
    """``seg, y, x, temporal, spatial``: per pixel and segment the signal and the mean.

    ``max-med`` is the maximum, 0 at least, minus the upper median; ``med-min`` the
    upper median minus the minimum, ``cap`` at most.  A segment's values of one
    pixel are at most ``period``, so gathering them is bounded.
    """
    groups = with_segment(video, period).groupBy("seg", "y", "x")
    median = upper_median_of(F.col("_values"))
    stats = groups.agg(
        F.collect_list(value).alias("_values"), F.max(value).alias("_high"), F.min(value).alias("_low"), F.avg(value).alias("spatial")
    )
    if method == "max-med":
        temporal = F.greatest(F.lit(0), F.col("_high")) - median
    elif method == "med-min":
        temporal = median - F.least(F.lit(cap), F.col("_low"))
    else:
        raise ValueError(f"no such signal method: {method}")
    return stats.select("seg", "y", "x", temporal.alias("temporal"), "spatial")


def decimate(video: DataFrame, size: int, how: str, value: str = "adu") -> DataFrame:
    """Frames gathered by windows of ``size`` (0 or less: one window), a partial last one included: ``or``, ``mean`` or ``median``.

    ``median`` is the true median; a window's values of one pixel are at most ``size``.
    """
    window = F.expr(f"frame div {size}") if size > 0 else F.lit(0).cast("long")
    made = {
        "or": F.max(F.col(value) > 0),
        "mean": F.avg(value),
        "median": F.percentile(value, F.lit(0.5)),
    }[how]
    return video.groupBy(window.alias("frame"), "y", "x").agg(made.alias("v"))


def projection(video: DataFrame, how: str, value: str = "adu") -> DataFrame:
    """The whole video's ``mean`` or ``max`` image."""
    made = {"mean": F.avg, "max": F.max}[how](value)
    return video.groupBy("y", "x").agg(made.alias("v"))


def _iir_edges(a: np.ndarray, sigma: float) -> np.ndarray:
    """The recursive Gaussian along the last axis, forth and back, as if end values went on for ever."""
    gain, b1, b2, b3 = iir_coefficients(sigma)

    def one_way(v: np.ndarray) -> np.ndarray:
        out = np.empty_like(v)
        p1 = p2 = p3 = v[..., 0]
        for i in range(v.shape[-1]):
            out[..., i] = gain * v[..., i] + b1 * p1 + b2 * p2 + b3 * p3
            p1, p2, p3 = out[..., i], p1, p2
        return out

    more = int(sigma * 2)  # the signal goes on beyond its end before the way back
    longer = np.concatenate([a, np.repeat(a[..., -1:], more, axis=-1)], axis=-1)
    back = one_way(one_way(longer)[..., ::-1])[..., ::-1]
    return back[..., : a.shape[-1]]


def smooth_frames(frames: DataFrame, sigma: float, column: str = "px") -> DataFrame:
    """``frame, h, w, px`` through the recursive Gaussian along rows, then along columns.

    A dense kernel: frames of one size are filtered together in numpy, an Arrow
    batch at a time.  A sigma under 0.5 leaves frames as they are.
    """
    if sigma < 0.5:
        return frames

    def over(batches):
        for f in batches:
            out = f.copy()
            for (h, w), part in f.groupby(["h", "w"]):
                a = np.stack(part[column].to_numpy()).reshape(-1, h, w)
                a = _iir_edges(np.swapaxes(_iir_edges(a, sigma), 1, 2), sigma)
                out.loc[part.index, column] = pd.Series(list(np.swapaxes(a, 1, 2).reshape(len(part), -1)), index=part.index)
            yield out

    return frames.mapInPandas(over, frames.schema)


def smooth_trace(trace: DataFrame, sigma: float, key: str = "roi", value: str = "v") -> DataFrame:
    """``key, px``: each trace in time order through the recursive Gaussian; a trace is one row."""
    ordered = trace.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("t", F.col(value).cast("double").alias("v")))).alias("a"))
    values = F.transform("a", lambda s: s["v"])
    return ordered.select(key, values.alias("px")).select(key, iir_pass(F.col("px"), sigma).alias("px"))


def patch_components(video: DataFrame, period: int, patch: int, stride: int, height: int, width: int, value: str = "adu") -> DataFrame:
    """``seg, y, x, v``: overlapping patches' first principal components, added up and divided by their coverage.

    The Gram matrix of a patch's pixels over a segment is a grouped sum; its
    leading eigenvector is found by power iteration in one small group per patch
    (patch ** 4 numbers), scaled by the eigenvalue.
    """
    spark = video.sparkSession
    corners = [(y, x) for y in range(0, height - patch + 1, stride) for x in range(0, width - patch + 1, stride)]
    places = spark.createDataFrame(
        [(ty, tx, y * patch + x, ty + y, tx + x) for ty, tx in corners for y in range(patch) for x in range(patch)],
        "ty long, tx long, p int, y long, x long",
    )
    segments = with_segment(video, period).select("seg", "frame", "y", "x", F.col(value).cast("double").alias("v"))
    tiles = segments.join(F.broadcast(places), ["y", "x"])
    centered = Window.partitionBy("seg", "ty", "tx", "p")
    tiles = tiles.withColumn("v", F.col("v") - F.avg("v").over(centered))
    packed = tiles.groupBy("seg", "ty", "tx", "frame").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda s: s["v"]).alias("row")
    )

    def leading(frame: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(frame["row"].to_numpy())
        gram = m.T @ m / len(m)
        vector = np.zeros(len(gram))
        vector[0] = 1.0
        scale = 0.0
        for _ in range(100):
            new = gram @ vector
            scale = float(np.linalg.norm(new))
            if scale == 0:
                break
            new /= scale
            done = np.abs(new - vector).max() < 1e-6
            vector = new
            if done:
                break
        n = len(vector)
        keys = {k: [frame[k].iloc[0]] * n for k in ("seg", "ty", "tx")}
        return pd.DataFrame(keys | {"p": np.arange(n), "pc": scale * np.abs(vector)})

    found = packed.groupBy("seg", "ty", "tx").applyInPandas(leading, "seg long, ty long, tx long, p int, pc double")
    placed = found.join(F.broadcast(places), ["ty", "tx", "p"])
    return placed.groupBy("seg", "y", "x").agg(F.avg("pc").alias("v"))


def temporal_band(trace: DataFrame, low: int, high: int, key: str = "roi", value: str = "v") -> DataFrame:
    """``key, low_sum, high_sum``: magnitudes of the discrete Fourier transform summed below ``low`` and from ``high`` up.

    One row of a trace at a time, in numpy; the mean is taken off first.
    """
    ordered = trace.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("t", F.col(value).cast("double").alias("v")))).alias("a"))
    arrays = ordered.select(key, F.transform("a", lambda s: s["v"]).alias("a"))

    def bands(frames):
        for f in frames:
            mags = [np.abs(np.fft.rfft(np.asarray(a) - np.mean(a))) for a in f["a"]]
            yield pd.DataFrame({key: f[key], "low_sum": [m[:low].sum() for m in mags], "high_sum": [m[high:].sum() for m in mags]})

    return arrays.mapInPandas(bands, f"{key} long, low_sum double, high_sum double")
