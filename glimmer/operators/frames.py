"""Frame-wise operators: projections, rescaling, downsampling, shifting.

A video is a table ``frame, y, x`` and a value column.  Every operator is a
combinable aggregate or an equi-join on those keys, or an array kernel on one frame at
a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def skip_frames(video: DataFrame, first: int) -> DataFrame:
    """Without the first frames; the next one becomes frame 0.  The filter reaches the scan."""
    return video.where(F.col("frame") >= first).withColumn("frame", F.col("frame") - first)


def single_frame(video: DataFrame, frame: int = 0) -> DataFrame:
    return video.where(F.col("frame") == frame).drop("frame")


def equalize_frames(video: DataFrame, value: str = "adu", out: str = "v") -> DataFrame:
    """Each frame divided by its mean, so that its mean is 1; null for a frame whose mean is 0."""
    means = video.groupBy("frame").agg(F.avg(value).alias("_mean"))
    return video.join(means, "frame").select("frame", "y", "x", F.try_divide(F.col(value).cast("double"), "_mean").alias(out))


def rescale(video: DataFrame, value: str = "adu", out: str = "v") -> DataFrame:
    """All values mapped to 0 to 1; null if they are all the same."""
    ends = video.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))  # one row
    width = (F.col("_high") - F.col("_low")).cast("double")
    scaled = F.try_divide((F.col(value) - F.col("_low")).cast("double"), width)
    return video.crossJoin(F.broadcast(ends)).select("frame", "y", "x", scaled.alias(out))


def pyramid_down(video: DataFrame, height: int, width: int, value: str = "adu", out: str = "v") -> DataFrame:
    """2 x 2 box means; an odd last row or column is left out."""
    inside = video.where((F.col("y") < 2 * (height // 2)) & (F.col("x") < 2 * (width // 2)))
    keys = ["frame", F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x")]
    return inside.groupBy(*keys).agg((F.sum(value) / 4.0).alias(out))


def _cells(n: int, factor: float) -> list[tuple[int, int, float]]:
    """(cell, pixel, covered share of the pixel) of an axis of n pixels cut into floor(n / factor + 0.5) cells."""
    cells = math.floor(n / factor + 0.5)
    size = n / cells
    out = []
    for c in range(cells):
        for p in range(math.floor(c * size), min(n, math.ceil((c + 1) * size))):
            covered = float(min((c + 1) * size, p + 1) - max(c * size, p))
            if covered > 0:
                out.append((c, p, covered))
    return out


def area_downsample(video: DataFrame, height: int, width: int, factor: float, value: str = "adu", out: str = "v") -> DataFrame:
    """Area-weighted means over fractional cells.  The two axes' overlaps are small tables, bound by the frame's sides."""
    spark = video.sparkSession
    rows = spark.createDataFrame(_cells(height, factor), "_cy long, y long, _wy double")
    cols = spark.createDataFrame(_cells(width, factor), "_cx long, x long, _wx double")
    joined = video.join(F.broadcast(rows), "y").join(F.broadcast(cols), "x")
    weight = F.col("_wy") * F.col("_wx")
    cells = joined.groupBy("frame", F.col("_cy").alias("y"), F.col("_cx").alias("x"))
    return cells.agg((F.sum(F.col(value) * weight) / F.sum(weight)).alias(out))


def shift_bilinear(
    video: DataFrame, motion: DataFrame, height: int, width: int, value: str = "adu", out: str = "v"
) -> DataFrame:
    """``out(y, x) = in(y + my, x + mx)`` by bilinear sampling, clamped to the edges.

    ``motion`` is ``frame, mx, my``.  Positions are truncated towards zero, so a
    position before the first pixel is extrapolated.  A frame is one group, bound
    by its size; pixels that it hasn't count as 0 where others are sampled.
    """
    rows = video.select("frame", "y", "x", F.col(value).cast("double").alias("v"))
    rows = rows.join(motion.select("frame", F.col("mx").cast("double").alias("mx"), F.col("my").cast("double").alias("my")), "frame")

    def over(pixels: pa.Table) -> pa.Table:
        y, x, v = (pixels.column(c).to_numpy() for c in ("y", "x", "v"))
        image = np.zeros((height, width))
        image[y, x] = v
        at_y, at_x = y + pixels.column("my")[0].as_py(), x + pixels.column("mx")[0].as_py()
        base_y, base_x = np.trunc(at_y).astype(np.int64), np.trunc(at_x).astype(np.int64)
        fy, fx = at_y - base_y, at_x - base_x
        made = np.zeros(len(v))
        for dy, wy in ((0, 1 - fy), (1, fy)):
            for dx, wx in ((0, 1 - fx), (1, fx)):
                made += wy * wx * image[np.clip(base_y + dy, 0, height - 1), np.clip(base_x + dx, 0, width - 1)]
        return pa.Table.from_arrays([*(pixels.column(c) for c in ("frame", "y", "x")), pa.array(made)], names=["frame", "y", "x", out])

    return rows.groupBy("frame").applyInArrow(over, f"frame long, y long, x long, {out} double")


def crop_integer(video: DataFrame, motion: DataFrame, top: int, left: int, height: int, width: int) -> DataFrame:
    """A window of the frame that follows whole-pixel motion ``frame, mx, my`` (truncated towards zero)."""
    joined = video.join(motion, "frame")
    y0, x0 = (F.lit(top) + F.col("my")).cast("long"), (F.lit(left) + F.col("mx")).cast("long")
    moved = joined.withColumns({"y": F.col("y") - y0, "x": F.col("x") - x0}).drop("mx", "my")
    return moved.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))


def illuminate(video: DataFrame, cy: float, cx: float, sigma: float, scale: float = 1.0, value: str = "adu", out: str = "v") -> DataFrame:
    """Values under a separable Gaussian light."""
    fall = lambda c, at: F.exp(-0.5 * F.pow((F.col(c) - at) / sigma, 2))
    return video.select("frame", "y", "x", (F.col(value) * fall("y", cy) * fall("x", cx) * scale).alias(out))


def standardize(video: DataFrame, value: str = "adu", out: str = "v") -> DataFrame:
    """Zero mean and unit deviation over each frame; null for a flat frame."""
    stats = video.groupBy("frame").agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    score = F.try_divide(F.col(value) - F.col("_mean"), F.col("_sd"))
    return video.join(stats, "frame").select("frame", "y", "x", score.alias(out))


def composite(background: DataFrame, overlay: DataFrame, level: DataFrame, alpha: float, value: str = "adu") -> DataFrame:
    """``(1 - alpha) * background + alpha * overlay * level`` where the overlay ``y, x, w`` lies; ``level`` is ``frame, level``."""
    joined = background.join(level, "frame").join(overlay, ["y", "x"], "left")
    mixed = (1 - alpha) * F.col(value) + alpha * F.col("w") * F.col("level")
    return joined.select("frame", "y", "x", F.coalesce(mixed, F.col(value).cast("double")).alias("v"))


def total_variation(video: DataFrame, value: str = "adu") -> DataFrame:
    """``frame, tv``: the sum of absolute steps to the next pixel down and to the right, by two equi-joins."""
    here = video.select("frame", "y", "x", F.col(value).alias("_v"))
    parts = []
    for key in ("y", "x"):
        next_one = here.withColumn(key, F.col(key) - 1).withColumnRenamed("_v", "_w")
        steps = here.join(next_one, ["frame", "y", "x"])
        parts.append(steps.select("frame", F.abs(F.col("_w") - F.col("_v")).alias("step")))
    return parts[0].unionByName(parts[1]).groupBy("frame").agg(F.sum("step").alias("tv"))
