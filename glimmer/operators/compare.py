"""Dense numeric operators of the comparison methods, by normal equations and small grouped kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmer.operators.rois import by_shape, of_regions


def least_squares_of_shapes(video: DataFrame, masks: DataFrame, value: str = "adu") -> tuple[DataFrame, DataFrame]:
    """``roi, shape`` of every mask, and ``shape, frame, v``: the coefficient of each mask of that shape.

    The coefficients are those of least norm: masks over the same pixels share
    equally what their shape explains.  So the Gram matrix is that of the shapes,
    each column weighted by the root of its number of masks; it counts shared
    pixels and is as large as the number of shapes in one image squared, however
    many masks there are.  Frames are solved side by side.
    """
    regions, shapes = by_shape(masks)
    a, b = shapes.select(F.col("shape").alias("i"), F.col("n").alias("m"), "y", "x"), shapes.select(F.col("shape").alias("j"), "y", "x")
    gram = a.join(b, ["y", "x"]).groupBy("i", "m", "j").agg(F.count("*").alias("n")).collect()  # shapes of one image, squared
    weight = {bytes(r.i): r.m**0.5 for r in gram}
    ids = sorted(weight)
    place = {s: n for n, s in enumerate(ids)}
    w = np.array([weight[s] for s in ids])
    g = np.zeros((len(ids), len(ids)))
    for r in gram:
        g[place[bytes(r.i)], place[bytes(r.j)]] = r.n
    inverse = np.linalg.pinv(g * w * w[:, None], rcond=1e-15 * max(10, len(ids)), hermitian=True) * w / w[:, None]
    right = video.join(shapes.select("shape", "y", "x"), ["y", "x"]).groupBy("frame", "shape").agg(F.sum(F.col(value).cast("double")).alias("s"))
    packed = right.groupBy("frame").agg(F.collect_list(F.struct("shape", "s")).alias("r"))  # a row for each shape

    def solve(frames):
        step = max(1, 1_000_000 // max(1, len(ids)))
        for whole in frames:
            for at in range(0, len(whole), step):
                f = whole.iloc[at : at + step]
                s = np.zeros((len(f), len(ids)))
                for n, r in enumerate(f["r"]):
                    for x in r:
                        s[n, place[bytes(x["shape"])]] = x["s"]
                yield pd.DataFrame({"shape": ids * len(f), "frame": np.repeat(f["frame"].to_numpy(), len(ids)), "v": (s @ inverse.T).ravel()})

    return regions, packed.mapInPandas(solve, "shape binary, frame long, v double")


def least_squares_traces(video: DataFrame, masks: DataFrame, value: str = "adu") -> DataFrame:
    """``roi, frame, v``: the coefficients of the masks (0/1 columns) that explain each frame best, those of least norm."""
    regions, found = least_squares_of_shapes(video, masks, value)
    return of_regions(found, regions)


def peak_to_peak(traces: DataFrame, key: str = "roi") -> DataFrame:
    """Each trace over its range; null for a flat one."""
    own = Window.partitionBy(key)
    return traces.select(key, "frame", F.try_divide(F.col("v"), F.max("v").over(own) - F.min("v").over(own)).alias("v"))


def background_components(video: DataFrame, components: int, value: str = "adu") -> DataFrame:
    """``component, y, x, v``: leading right singular vectors of the frames-by-pixels matrix, signed so that the largest
    entry is positive.

    The pixels' Gram matrix is summed where frames lie (pixels squared numbers for
    each task) and only its eigenvectors are computed in one place.
    """
    rows = video.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("y", "x", F.col(value).cast("double").alias("v")))).alias("p"))

    def gram(frames):
        total, pixels = None, None
        for f in frames:
            for p in f["p"]:
                v = np.array([q["v"] for q in p])
                pixels = [(q["y"], q["x"]) for q in p]
                total = np.outer(v, v) if total is None else total + np.outer(v, v)
        if total is not None:
            yield pd.DataFrame({"y": [p[0] for p in pixels], "x": [p[1] for p in pixels], "n": range(len(pixels)), "row": list(total)})

    parts = rows.mapInPandas(gram, "y long, x long, n long, row array<double>")
    entries = parts.select("y", "x", "n", F.posexplode("row").alias("m", "v")).groupBy("y", "x", "n", "m").agg(F.sum("v").alias("v"))
    lines = entries.groupBy("y", "x", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "v"))), lambda s: s["v"]).alias("row"))

    def leading(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("n")
        _, vectors = np.linalg.eigh(np.stack(f["row"].to_numpy()))
        out = []
        for k in range(components):
            v = vectors[:, -1 - k]
            v = v * np.sign(v[np.abs(v).argmax()])
            out.append(pd.DataFrame({"component": k, "y": f["y"], "x": f["x"], "v": v}))
        return pd.concat(out)

    return lines.withColumn("k", F.lit(0)).groupBy("k").applyInPandas(leading, "component long, y long, x long, v double")


def blood_mask(video: DataFrame, low: int, high: int, threshold: float, value: str = "adu") -> DataFrame:
    """``y, x, ratio, blood``: pixels whose low-frequency share of the spectrum exceeds the high-frequency one.

    A pixel's trace is one row; both band sums are normalized by their largest.
    """
    rows = video.groupBy("y", "x").agg(F.array_sort(F.collect_list(F.struct("frame", F.col(value).cast("double").alias("v")))).alias("p"))

    def bands(frames):
        for f in frames:
            mags = [np.abs(np.fft.rfft([q["v"] for q in p])) for p in f["p"]]
            yield pd.DataFrame({"y": f["y"], "x": f["x"], "lo": [m[1 : low + 1].sum() for m in mags], "hi": [m[high:].sum() for m in mags]})

    sums = rows.mapInPandas(bands, "y long, x long, lo double, hi double")
    ends = sums.agg(F.max("lo").alias("ml"), F.max("hi").alias("mh"))
    ratio = F.greatest(F.try_divide("lo", "ml") - F.try_divide("hi", "mh"), F.lit(0.0))
    out = sums.crossJoin(F.broadcast(ends)).withColumn("ratio", ratio)
    return out.select("y", "x", "ratio", (F.col("ratio") >= threshold).alias("blood"))


def denoise(image: DataFrame, height: int, width: int, weight: float, steps: int = 200, rate: float = 0.1, value: str = "v") -> DataFrame:
    """``seg, y, x, v``: gradient descent on squared error plus total variation (smoothed), an image at a time."""

    def over(f: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros((height, width))
        v[f["y"], f["x"]] = f[value]
        scale = v.max() - v.min() or 1.0
        u = start = v / scale
        for _ in range(steps):
            dy, dx = np.diff(u, axis=0, append=u[-1:]), np.diff(u, axis=1, append=u[:, -1:])
            size = np.sqrt(dy**2 + dx**2 + 1e-6)
            py, px = dy / size, dx / size
            div = np.diff(py, axis=0, prepend=0) + np.diff(px, axis=1, prepend=0)
            u = u - rate * ((u - start) - weight * div)
        ys, xs = np.mgrid[0:height, 0:width]
        return pd.DataFrame({"seg": f["seg"].iloc[0], "y": ys.ravel(), "x": xs.ravel(), "v": (u * scale).ravel()})

    return image.groupBy("seg").applyInPandas(over, "seg long, y long, x long, v double")


def detrend(trace: DataFrame, knots: int, trim: float = 0.05) -> DataFrame:
    """``roi, t, v``: values less a piecewise linear spline, fitted again without the largest residuals; a trace at a time."""

    def over(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("t")
        v, t = f["v"].to_numpy(float), np.linspace(0, 1, len(f))
        at = np.linspace(0, 1, min(knots, max(2, len(f))))
        basis = np.maximum(0, 1 - np.abs(t[:, None] - at) * (len(at) - 1))
        fit = basis @ np.linalg.lstsq(basis, v, rcond=None)[0]
        keep = np.abs(v - fit) <= np.quantile(np.abs(v - fit), 1 - trim)
        fit = basis @ np.linalg.lstsq(basis[keep], v[keep], rcond=None)[0]
        return pd.DataFrame({"roi": f["roi"], "t": f["t"], "v": v - fit})

    return trace.groupBy("roi").applyInPandas(over, "roi long, t long, v double")


def block_bounds(height: int, width: int, largest: int) -> tuple[int, int, int, int]:
    """Blocks down and across so that none is larger than ``largest``, and the height and width cut to their multiples."""
    down, across = height // largest + 1, width // largest + 1
    return down, across, height // down * down, width // across * across
