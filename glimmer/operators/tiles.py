"""Overlapping tiles of images ``seg, y, x, v``: grids, normalization, scoring, merging."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tile_grid(
    spark: SparkSession, height: int, width: int, patch: tuple[int, int], stride: tuple[int, int], margin: tuple[float, float] = (0.0, 0.0)
) -> DataFrame:
    """``ty, tx``: corners of a regular grid; margins are shares of the frame, rounded down to whole patches.

    Where strides don't divide the frame, its right and lower edge stay uncovered.
    """

    def axis(n: int, size: int, step: int, share: float) -> range:
        aside = int(n * share) // size * size
        return range(aside, max(n - size, 0) + 1 - aside, step)

    rows, cols = (axis(*a) for a in zip((height, width), patch, stride, margin, strict=True))
    corners = [(y, x) for y in rows for x in cols]
    return spark.createDataFrame(corners, "ty long, tx long")


def center_patch(height: int, width: int, patch: tuple[int, int]) -> tuple[int, int]:
    """The corner of the patch in the middle."""
    return max(height - patch[0], 0) // 2, max(width - patch[1], 0) // 2


def random_patches(images: DataFrame, height: int, width: int, patch: tuple[int, int], darts: int, seed: int) -> DataFrame:
    """``seg, dart, ty, tx``: patch corners at random for each image, the same ones for the same seed and image."""
    each = images.select("seg").distinct().withColumn("dart", F.explode(F.sequence(F.lit(0), F.lit(darts - 1))))

    def place(salt: int, room: int):
        return F.pmod(F.xxhash64("seg", "dart", F.lit(seed), F.lit(salt)), F.lit(room + 1))

    return each.select(
        "seg", "dart", place(0, max(height - patch[0], 0)).alias("ty"), place(1, max(width - patch[1], 0)).alias("tx")
    )


def extract_tiles(images: DataFrame, grid: DataFrame, patch: tuple[int, int], value: str = "v") -> DataFrame:
    """``seg, ty, tx, dy, dx`` and the value: each pixel in every tile that holds it.

    The grid is unrolled to its pixels, so that tiles meet images by an equi-join.
    """
    dy, dx = (F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))) for n in patch)
    unrolled = grid.withColumn("dy", dy).withColumn("dx", dx)
    unrolled = unrolled.withColumns({"y": F.col("ty") + F.col("dy"), "x": F.col("tx") + F.col("dx")})
    return images.join(unrolled, ["y", "x"]).select("seg", "ty", "tx", "dy", "dx", value)


def normalize_tiles(tiles: DataFrame, value: str = "v") -> DataFrame:
    """Each tile's values from its minimum up, over its range; null in a flat tile."""
    keys = ["seg", "ty", "tx"]
    ends = tiles.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    scaled = F.try_divide((F.col(value) - F.col("_low")).cast("double"), (F.col("_high") - F.col("_low")).cast("double"))
    return tiles.join(ends, keys).select(*keys, "dy", "dx", scaled.alias(value))


def normalize_channels(tiles: DataFrame, norm_channel: int = -1, shift: list[bool] | None = None, value: str = "v") -> DataFrame:
    """Tiles with a column ``chan``: each channel less its minimum (where ``shift`` says so), over the range of one
    channel, or of all (-1)."""
    keys = ["seg", "ty", "tx"]
    own = tiles.groupBy(*keys, "chan").agg(F.min(value).alias("_shift"))
    scope = tiles if norm_channel < 0 else tiles.where(F.col("chan") == norm_channel)
    span = scope.groupBy(*keys).agg((F.max(value) - F.min(value)).alias("_span"))
    shifted = F.lit(True) if shift is None else F.get(F.lit(shift), F.col("chan").cast("int"))
    moved = F.col(value) - F.when(shifted, F.col("_shift")).otherwise(0)
    scaled = F.try_divide(moved.cast("double"), F.col("_span").cast("double")).alias(value)
    return tiles.join(own, [*keys, "chan"]).join(span, keys).select(*keys, "dy", "dx", "chan", scaled)


def merge_weighted(tiles: DataFrame, patch: tuple[int, int], grid: DataFrame, value: str = "v") -> DataFrame:
    """``seg, y, x`` and the mean over tiles, weighted by a Gaussian around each tile's middle; 0 where none lies.

    Weights are computed from the place in the tile; sums are combined before the
    shuffle.  ``grid`` is the frame's pixels ``y, x``.
    """
    sigma = (patch[0] + patch[1]) / 6
    far = F.pow(F.col("dy") - (patch[0] - 1) / 2, F.lit(2.0)) + F.pow(F.col("dx") - (patch[1] - 1) / 2, F.lit(2.0))
    weight = F.exp(-0.5 * far / (sigma * sigma))
    place = [(F.col("ty") + F.col("dy")).alias("y"), (F.col("tx") + F.col("dx")).alias("x")]
    sums = tiles.groupBy("seg", *place).agg((F.sum(weight * F.col(value)) / F.sum(weight)).alias(value))
    every = tiles.select("seg").distinct().crossJoin(F.broadcast(grid))  # one frame's pixels for each image
    return every.join(sums, ["seg", "y", "x"], "left").select("seg", "y", "x", F.coalesce(value, F.lit(0.0)).alias(value))


def merge_median(tiles: DataFrame, value: str = "v") -> DataFrame:
    """``seg, y, x`` and the median over tiles, of covered pixels."""
    place = [(F.col("ty") + F.col("dy")).alias("y"), (F.col("tx") + F.col("dx")).alias("x")]
    return tiles.groupBy("seg", *place).agg(F.percentile(value, F.lit(0.5)).alias(value))


Scorer = Callable[[np.ndarray], np.ndarray]


def contrast_scorer(batch: np.ndarray) -> np.ndarray:
    """A stand-in for a trained network: the logistic of a pixel's contrast to its tile's mean."""
    mean = batch.mean(axis=(1, 2), keepdims=True)
    return 1 / (1 + np.exp(-8 * (batch - mean)))


def score_tiles(tiles: DataFrame, patch: tuple[int, int], scorer: Scorer = contrast_scorer, batch: int = 128, value: str = "v") -> DataFrame:
    """Tiles' values replaced by a model's: ``scorer`` takes and gives (tiles, rows, columns).

    A tile is gathered into an array row, and arrays are scored in batches of
    ``batch``; any model that can be pickled will do.
    """
    h, w = patch
    order = F.array_sort(F.collect_list(F.struct("dy", "dx", F.col(value).cast("double").alias("v"))))
    rows = tiles.groupBy("seg", "ty", "tx").agg(F.transform(order, lambda s: s["v"]).alias("a"))

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                scored = scorer(np.stack(part["a"].to_numpy()).reshape(-1, h, w)).reshape(len(part), -1)
                yield pd.DataFrame({"seg": part["seg"], "ty": part["ty"], "tx": part["tx"], "a": list(scored)})

    scored = rows.mapInPandas(over, "seg long, ty long, tx long, a array<double>")
    out = scored.select("seg", "ty", "tx", F.posexplode("a").alias("p", value))
    return out.select("seg", "ty", "tx", F.expr(f"cast(p div {w} as bigint)").alias("dy"), F.expr(f"cast(p % {w} as bigint)").alias("dx"), value)


def fit_scorer(tiles: DataFrame, labels: DataFrame, most: int = 200_000, seed: int = 0) -> Scorer:
    """A per-pixel logistic model of a pixel's value and its tile's mean, fitted to labels ``seg, y, x`` (members).

    A stand-in for a network behind the same interface.  At most about ``most``
    pixels, chosen by a hash, come to the driver to be fitted.
    """
    place = tiles.withColumns({"y": F.col("ty") + F.col("dy"), "x": F.col("tx") + F.col("dx")})
    means = tiles.groupBy("seg", "ty", "tx").agg(F.avg("v").alias("m"))
    marked = place.join(means, ["seg", "ty", "tx"]).join(labels.select("seg", "y", "x").distinct().withColumn("on", F.lit(1.0)), ["seg", "y", "x"], "left")
    n, span = tiles.count(), 1 << 30
    share = int(min(1.0, most / max(1, n)) * span)
    kept = marked.where(F.pmod(F.xxhash64(F.lit(seed), "seg", "ty", "tx", "dy", "dx"), F.lit(span)) < share)
    rows = kept.select(F.col("v").cast("double"), "m", F.coalesce("on", F.lit(0.0)).alias("on")).toPandas()
    x = np.stack([rows["v"], rows["v"] - rows["m"], np.ones(len(rows))], axis=1)
    y, w = rows["on"].to_numpy(), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(3), x.T @ (p - y) + 1e-3 * w)
    a, b, c = w.tolist()

    def score(batch: np.ndarray) -> np.ndarray:
        mean = batch.mean(axis=(1, 2), keepdims=True)
        return 1 / (1 + np.exp(-np.clip(a * batch + b * (batch - mean) + c, -30, 30)))

    return score


def log_loss(prob: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, ``loss``: the mean cross-entropy of ``seg, y, x, v`` against members ``seg, y, x``."""
    on = labels.select("seg", "y", "x").distinct().withColumn("on", F.lit(True))
    p = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col("v")))
    loss = -F.when(F.col("on"), F.log(p)).otherwise(F.log(1 - p))
    return prob.join(on, ["seg", "y", "x"], "left").agg(F.avg(loss).alias("loss"))


def mosaic(images: DataFrame, other: DataFrame, width: int, value: str = "v") -> DataFrame:
    """Two stacks side by side, each over its own largest value."""

    def scaled(df: DataFrame, shift: int) -> DataFrame:
        top = df.agg(F.max(value).alias("_top"))
        v = F.coalesce(F.try_divide(F.col(value).cast("double"), F.col("_top").cast("double")), F.lit(0.0))
        return df.crossJoin(F.broadcast(top)).select("seg", "y", (F.col("x") + shift).alias("x"), v.alias(value))

    return scaled(images, 0).unionByName(scaled(other, width))


def resize_nearest(images: DataFrame, old: tuple[int, int], new: tuple[int, int], value: str = "v") -> DataFrame:
    """Images at another size by the nearest pixel; the same image where the sizes are equal."""
    spark = images.sparkSession

    def axis(name: str, a: int, b: int) -> DataFrame:
        pairs = [(min(a - 1, math.floor((t + 0.5) * a / b)), t) for t in range(b)]
        return spark.createDataFrame(pairs, f"{name} long, _{name} long")

    joined = images.join(F.broadcast(axis("y", old[0], new[0])), "y").join(F.broadcast(axis("x", old[1], new[1])), "x")
    return joined.select("seg", F.col("_y").alias("y"), F.col("_x").alias("x"), value)


def resize_masks(pixels: DataFrame, keys: list[str], old: tuple[int, int], new: tuple[int, int]) -> DataFrame:
    """Regions ``keys, y, x`` at another frame size: each new pixel is of the region that its nearest old one is of."""
    spark = pixels.sparkSession

    def axis(name: str, a: int, b: int) -> DataFrame:
        pairs = [(min(a - 1, math.floor((t + 0.5) * a / b)), t) for t in range(b)]
        return spark.createDataFrame(pairs, f"{name} long, _{name} long")

    joined = pixels.join(F.broadcast(axis("y", old[0], new[0])), "y").join(F.broadcast(axis("x", old[1], new[1])), "x")
    return joined.select(*keys, F.col("_y").alias("y"), F.col("_x").alias("x"))


def pad_or_magnify(images: DataFrame, shape: tuple[int, int], patch: tuple[int, int], how: str = "magnify", value: str = "v") -> DataFrame:
    """Images smaller than a patch brought to its size, by magnifying or by repeating the last row and column."""
    big = tuple(max(a, b) for a, b in zip(shape, patch, strict=True))
    if big == tuple(shape):
        return images
    if how == "magnify":
        return resize_nearest(images, shape, big, value)
    spark = images.sparkSession
    pads = [spark.createDataFrame([(min(t, n - 1), t) for t in range(m)], f"{a} long, _{a} long") for a, n, m in zip("yx", shape, big, strict=True)]
    joined = images.join(F.broadcast(pads[0]), "y").join(F.broadcast(pads[1]), "x")
    return joined.select("seg", F.col("_y").alias("y"), F.col("_x").alias("x"), value)


def batch_numbers(samples: int, size: int, tiled: bool) -> int:
    """Batches of a sequence: the last, partial one counts where all samples are evaluated."""
    return -(-samples // size) if tiled else samples // size


def splits_for(n_bytes: int, limit: int) -> int:
    """Parts of an output so that none is larger than ``limit`` bytes."""
    return max(1, -(-n_bytes // limit))
