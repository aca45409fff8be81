"""Synthetic videos: neurons, vessels, motion, light and noise, the same for the same seed.

Everything is made by expressions over ``spark.range`` and hashes of keys, so any
partitioning gives the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def uniform(seed: int, *keys: str | Column) -> Column:
    """A number in 0 to 1 for each key."""
    span = 1 << 52
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(span)) / float(span)


def normal(seed: int, *keys: str | Column) -> Column:
    """A standard normal number for each key, from two uniform ones."""
    radius = F.sqrt(-2 * F.log(F.greatest(uniform(seed, *keys), F.lit(1e-300))))
    return radius * F.cos(2 * math.pi * uniform(seed + 1_000_003, *keys))


def neurons_per_video(spark: SparkSession, videos: int, least: int, most: int) -> DataFrame:
    """``video, neurons``: counts that cycle from ``least`` to under ``most``."""
    v = spark.range(videos).withColumnRenamed("id", "video")
    return v.select("video", (F.lit(least) + F.col("video") % (most - least)).alias("neurons"))


def spike_pattern(spark: SparkSession, neurons: int, frames: int, seed: int, silent: float = 0.7) -> DataFrame:
    """``roi, t, boost`` of spiking times: most neurons but the first are silent; others spike in 0.5 to 2 % of frames."""
    n = spark.range(neurons).withColumnRenamed("id", "roi")
    active = n.where((F.col("roi") == 0) | (uniform(seed, "roi") >= silent))
    count = F.floor((0.005 + 0.015 * uniform(seed + 1, "roi")) * frames)
    drawn = active.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(count, F.lit(1).cast("long")))))
    t = F.floor(uniform(seed + 2, "roi", "k") * frames)
    drawn = drawn.select("roi", t.alias("t")).distinct()
    return drawn.select("roi", "t", (1.15 + 0.2 * uniform(seed + 3, "roi", "t")).alias("boost"))


def neuron_masks(spark: SparkSession, neurons: int, height: int, width: int, seed: int, radius: tuple[float, float] = (2.0, 5.0), overlaps: int = 2) -> DataFrame:
    """``roi, y, x`` of ellipses; a neuron is rejected where a pixel would get more than ``overlaps`` layers.

    Earlier neurons stay: a neuron goes if any of its pixels already has that many
    of smaller numbers.
    """
    n = spark.range(neurons).withColumnRenamed("id", "roi")
    a, b = (radius[0] + (radius[1] - radius[0]) * uniform(seed + i, "roi") for i in (1, 2))
    shape = n.select("roi", (uniform(seed + 3, "roi") * height).alias("cy"), (uniform(seed + 4, "roi") * width).alias("cx"), a.alias("a"), b.alias("b"), (uniform(seed + 5, "roi") * math.pi).alias("th"))
    reach = F.ceil(F.greatest("a", "b"))
    span = lambda c, m: F.sequence(F.greatest(F.floor(c) - reach, F.lit(0).cast("long")), F.least(F.floor(c) + reach, F.lit(m - 1).cast("long")))
    boxes = shape.withColumn("y", F.explode(span("cy", height))).withColumn("x", F.explode(span("cx", width)))
    u = (F.col("x") - F.col("cx")) * F.cos("th") + (F.col("y") - F.col("cy")) * F.sin("th")
    v = (F.col("y") - F.col("cy")) * F.cos("th") - (F.col("x") - F.col("cx")) * F.sin("th")
    inside = F.pow(u / F.col("a"), F.lit(2.0)) + F.pow(v / F.col("b"), F.lit(2.0)) <= 1
    pixels = boxes.where(inside).select("roi", "y", "x")
    layer = F.row_number().over(Window.partitionBy("y", "x").orderBy("roi"))
    crowded = pixels.withColumn("n", layer).where(F.col("n") > overlaps).select("roi").distinct()
    return pixels.join(crowded, "roi", "left_anti")


def random_walk(spark: SparkSession, frames: int, seed: int, damping: float = 0.9, power: float = 0.1) -> DataFrame:
    """``frame, mx, my``: positions whose velocity is driven by noise and damped, a fold over one row's array."""

    def axis(salt: int) -> Column:
        push = F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda t: power * normal(seed + salt, t))
        start = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("p"), F.array().cast("array<double>").alias("out"))

        def step(s: Column, a: Column) -> Column:
            v = damping * s["v"] + a
            return F.struct(v.alias("v"), (s["p"] + v).alias("p"), F.concat(s["out"], F.array(s["p"] + v)).alias("out"))

        return F.aggregate(push, start, step, lambda s: s["out"])

    both = spark.range(1).select(F.arrays_zip(axis(0).alias("mx"), axis(17).alias("my")).alias("a"))
    return both.select(F.posexplode("a").alias("frame", "a")).select(F.col("frame").cast("long").alias("frame"), F.col("a.mx").alias("mx"), F.col("a.my").alias("my"))


def bezier_path(spark: SparkSession, points: list[tuple[float, float]], steps: int = 1000) -> DataFrame:
    """``i, y, x, length``: a cubic Bezier curve and its arc length so far.  One curve is one ordered run."""
    t = F.col("id") / float(steps)
    weights = [F.pow(1 - t, F.lit(3.0)), 3 * F.pow(1 - t, F.lit(2.0)) * t, 3 * (1 - t) * t * t, t * t * t]
    at = lambda k: sum((w * p[k] for w, p in zip(weights[1:], points[1:], strict=True)), weights[0] * points[0][k])
    curve = spark.range(steps + 1).select(F.col("id").alias("i"), at(0).alias("y"), at(1).alias("x"))
    order = Window.orderBy("i")
    step = F.hypot(F.col("y") - F.lag("y").over(order), F.col("x") - F.lag("x").over(order))
    curve = curve.withColumn("_s", F.coalesce(step, F.lit(0.0)))
    return curve.select("i", "y", "x", F.sum("_s").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("length"))


def splat(points: DataFrame, height: int, width: int, value: str = "v") -> DataFrame:
    """``frame, y, x, v``: values at fractional positions spread over the four pixels around, those beyond the frame left out."""
    fy, fx = F.col("y") - F.floor("y"), F.col("x") - F.floor("x")
    corners = [
        F.struct((F.floor("y") + dy).alias("y"), (F.floor("x") + dx).alias("x"), ((fy if dy else 1 - fy) * (fx if dx else 1 - fx)).alias("w"))
        for dy in (0, 1)
        for dx in (0, 1)
    ]
    each = points.select("frame", F.col(value).alias("_v"), F.explode(F.array(*corners)).alias("c"))
    each = each.where(F.col("c.y").between(0, height - 1) & F.col("c.x").between(0, width - 1))
    return each.groupBy("frame", F.col("c.y").alias("y"), F.col("c.x").alias("x")).agg(F.sum(F.col("_v") * F.col("c.w")).alias("v"))


def vessel_flow(spark: SparkSession, path: DataFrame, frames: int, height: int, width: int, speed: float, wave: float) -> DataFrame:
    """``frame, y, x, v``: brightness that travels along a curve as a sine of arc length and time."""
    phase = 2 * math.pi * (F.col("length") - F.col("frame") * speed) / wave
    times = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(frames - 1).cast("long")))
    return splat(path.withColumn("frame", times).withColumn("v", 0.5 + 0.5 * F.sin(phase)), height, width)


def smooth_noise(spark: SparkSession, height: int, width: int, seed: int, octaves: int = 4) -> DataFrame:
    """``y, x, v``: sums of ever finer noise, interpolated between lattice points and weighted by one over the octave."""
    grid = spark.range(height * width).select(F.expr(f"id div {width}").alias("y"), (F.col("id") % width).alias("x"))
    total = F.lit(0.0)
    for o in range(1, octaves + 1):
        step = max(1.0, max(height, width) / 2.0**o)
        gy, gx = F.col("y") / step, F.col("x") / step
        y0, x0 = F.floor(gy), F.floor(gx)
        fy, fx = gy - y0, gx - x0
        node = lambda dy, dx, o=o, y0=y0, x0=x0: uniform(seed + o, y0 + dy, x0 + dx)
        upper = node(0, 0) * (1 - fx) + node(0, 1) * fx
        lower = node(1, 0) * (1 - fx) + node(1, 1) * fx
        total = total + (upper * (1 - fy) + lower * fy) / o
    return grid.select("y", "x", total.alias("v"))


def light_fluctuation(spark: SparkSession, frames: int, seed: int, depth: float) -> DataFrame:
    """``frame, level`` around a mean of 1."""
    raw = spark.range(frames).select(F.col("id").alias("frame"), (1 + depth * normal(seed, "id")).alias("level"))
    mean = raw.agg(F.avg("level").alias("_m"))
    return raw.crossJoin(F.broadcast(mean)).select("frame", (F.col("level") / F.col("_m")).alias("level"))


def focus_fluctuation(spark: SparkSession, frames: int, seed: int, share: float = 0.01, depth: float = 10.0, sigma: float = 5.0, sharp: int = 10) -> DataFrame:
    """``frame, blur``: rare frames out of focus, smoothed over time; the first ``sharp`` frames are in focus.

    Each odd frame spreads its blur to its neighbours: rows are as many as odd
    frames times the kernel.
    """
    radius = int(4 * sigma + 0.5)
    norm = sum(math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1))
    n = spark.range(frames).withColumnRenamed("id", "frame")
    odd = n.where((uniform(seed, "frame") < share) & (F.col("frame") >= sharp)).withColumn("d", depth * uniform(seed + 1, "frame"))
    spread = odd.withColumn("k", F.explode(F.sequence(F.lit(-radius), F.lit(radius))))
    blur = spread.groupBy((F.col("frame") + F.col("k")).alias("frame")).agg(F.sum(F.col("d") * F.exp(-0.5 * F.pow(F.col("k") / sigma, F.lit(2.0))) / norm).alias("b"))
    out = n.join(blur, "frame", "left")
    return out.select("frame", F.when(F.col("frame") < sharp, 0.0).otherwise(F.coalesce("b", F.lit(0.0))).alias("blur"))


def add_noise(video: DataFrame, seed: int, photons: float, read: float, value: str = "v") -> DataFrame:
    """Shot noise (a normal of the photon count's deviation) and read noise; no value falls under 0."""
    keys = ("frame", "y", "x")
    shot = F.sqrt(F.greatest(F.col(value), F.lit(0.0)) / photons) * normal(seed, *keys)
    noisy = F.col(value) + shot + read * normal(seed + 7, *keys)
    return video.select(*keys, F.greatest(F.lit(0.0), noisy).alias(value))


def synthetic_video(spark: SparkSession, frames: int, height: int, width: int, neurons: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(video, masks, spikes)``: neurons over a smooth background under changing light, moved and with noise."""
    masks = neuron_masks(spark, neurons, height, width, seed)
    spikes = spike_pattern(spark, neurons, frames, seed + 100)
    background = smooth_noise(spark, height, width, seed + 200)
    light = light_fluctuation(spark, frames, seed + 300, 0.02)
    still = background.crossJoin(F.broadcast(light)).select("frame", "y", "x", (F.col("v") * F.col("level")).alias("v"))  # a video by definition
    bright = masks.join(spikes, "roi").groupBy(F.col("t").alias("frame"), "y", "x").agg(F.sum("boost").alias("b"))
    base = masks.groupBy("y", "x").agg((0.5 * F.count("*")).alias("a"))
    lit = still.join(base, ["y", "x"], "left").join(bright, ["frame", "y", "x"], "left")
    video = lit.select("frame", "y", "x", (F.col("v") + F.coalesce("a", F.lit(0.0)) * F.coalesce("b", F.lit(1.0))).alias("v"))
    return add_noise(video, seed + 400, 100.0, 0.02), masks, spikes


def temporal_labels(masks: DataFrame, spikes: DataFrame) -> DataFrame:
    """``frame, y, x`` that belong to a neuron that spikes then."""
    return masks.join(spikes.select("roi", F.col("t").alias("frame")), "roi").select("frame", "y", "x").distinct()


def spatial_labels(masks: DataFrame, spikes: DataFrame) -> DataFrame:
    """Masks of the neurons that spike at all."""
    return masks.join(spikes.select("roi").distinct(), "roi", "left_semi")
