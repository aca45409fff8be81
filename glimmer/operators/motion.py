"""Block-matching motion estimation against a reference frame, and what follows from motion."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import pyramid_down


@dataclass(frozen=True)
class Search:
    """``radius`` of the offsets, half size and spacing of patches, and the share of the frame that patches cover."""

    radius: int = 3
    patch: int = 10
    spacing: int = 7
    x_range: float = 1.0
    y_range: float = 1.0

    def half(self) -> Search:
        """For a frame of half the size: smaller patches, as many offsets."""
        return Search(self.radius, (self.patch + 1) // 2, (self.spacing + 1) // 2, self.x_range, self.y_range)

    def centers(self, n: int, share: float, base: int) -> list[int]:
        """Patch centers along an axis of ``n`` pixels for a base offset.  Integer quotients go towards zero."""
        space = int(n * share * 0.5) - self.patch - self.radius
        before, after = (max(0, int(s / self.spacing)) for s in (space + base, space - base))
        return [n // 2 + i * self.spacing for i in range(-before, after + 1)]


#: Pixels of the reference frame that are sent to every executor, at most.
REFERENCE_PIXELS = 1 << 24


def _image(frame: DataFrame, height: int, width: int, value: str) -> np.ndarray:
    """One frame as an array on the driver; its size is checked."""
    if height * width > REFERENCE_PIXELS:
        raise ValueError(f"a reference frame of {height} x {width} pixels is too large to send to all executors")
    return _filled(frame.select("y", "x", F.col(value).cast("double").alias("v")).limit(height * width + 1).toArrow(), height, width)


def _filled(pixels: pa.Table, height: int, width: int) -> np.ndarray:
    out = np.zeros((height, width))
    out[pixels.column("y").to_numpy(), pixels.column("x").to_numpy()] = pixels.column("v").to_numpy()
    return out


def _members(search: Search, n: int, share: float, base: int) -> np.ndarray:
    """Which of an axis's pixels each patch has: a row of zeros and ones for each patch."""
    out = []
    for c in search.centers(n, share, base):
        at = np.arange(n)
        out.append((at >= max(0, c - search.patch)) & (at <= min(n - 1, c + search.patch)))
    return np.array(out, float)


def correlations(video: DataFrame, reference: DataFrame, search: Search, height: int, width: int, base: DataFrame | None = None, value: str = "v") -> DataFrame:
    """``frame, bx, by, dx, dy, corr`` for all offsets around each frame's base (0, 0 or ``frame, bx, by``).

    For each patch, normalized correlation times the mean square of the reference
    patch; added up over patches.  A frame is one group, bound by its size; the
    reference frame is broadcast, its size checked.  The sums over all patches at
    an offset are two matrix products.
    """
    spark = video.sparkSession
    shared = spark.sparkContext.broadcast(_image(reference, height, width, value))
    rows = video.select("frame", "y", "x", F.col(value).cast("double").alias("v"))
    zero = F.lit(0).cast("long")
    rows = rows.withColumns({"bx": zero, "by": zero}) if base is None else rows.join(base.select("frame", "bx", "by"), "frame")

    def over(pixels: pa.Table) -> pa.Table:
        target, r = _filled(pixels, height, width), shared.value
        bx, by = pixels.column("bx")[0].as_py(), pixels.column("by")[0].as_py()
        rows, columns = _members(search, height, search.y_range, by), _members(search, width, search.x_range, bx).T
        size = np.outer(rows.sum(axis=1), columns.sum(axis=0))

        def mean(image: np.ndarray) -> np.ndarray:
            return rows @ image @ columns / size

        mr, mrr = mean(r), mean(r * r)
        spread = np.maximum(0, mrr - mr * mr)
        out: tuple[list[int], list[int], list[float]] = ([], [], [])
        for dx in range(bx - search.radius, bx + search.radius + 1):
            at_x = np.clip(np.arange(width) + dx, 0, width - 1)
            for dy in range(by - search.radius, by + search.radius + 1):
                t = target[np.clip(np.arange(height) + dy, 0, height - 1)][:, at_x]
                mt = mean(t)
                own = np.maximum(0, mean(t * t) - mt * mt)
                ncc = mrr * (mean(r * t) - mr * mt) / np.sqrt(spread * own + 1e-6)
                for column, v in zip(out, (dx, dy, float(ncc.sum())), strict=True):
                    column.append(v)
        n = len(out[0])
        same = [pa.array([pixels.column(c)[0].as_py()] * n, pa.int64()) for c in ("frame", "bx", "by")]
        return pa.Table.from_arrays(
            [*same, pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2])], names=["frame", "bx", "by", "dx", "dy", "corr"]
        )

    return rows.groupBy("frame").applyInArrow(over, "frame long, bx long, by long, dx long, dy long, corr double")


def best_offset(corr: DataFrame, radius: int) -> DataFrame:
    """``frame, bx, by, i, j, corr``: the highest correlation, the first in column order of equal ones; 0, 0 if none is over 0."""
    c = corr.withColumns({"i": F.col("dx") - F.col("bx") + radius, "j": F.col("dy") - F.col("by") + radius})
    score = F.greatest(F.col("corr"), F.lit(0.0))
    order = Window.partitionBy("frame").orderBy(F.desc(score), "i", "j")
    top = c.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return top.select("frame", "bx", "by", "i", "j", score.alias("corr"))


def subpixel(corr: DataFrame, radius: int) -> DataFrame:
    """``frame, mx, my, corr``: the top of a quadratic through the nine correlations around the best offset.

    Neighbours beyond the search are taken from its edge; a top a pixel or more
    away leaves the whole-pixel offset.
    """
    best = best_offset(corr, radius)
    c = corr.withColumns({"ci": F.col("dx") - F.col("bx") + radius, "cj": F.col("dy") - F.col("by") + radius})
    near = best.join(c.select("frame", "ci", "cj", F.col("corr").alias("v")), "frame")
    at = [F.greatest(F.lit(0), F.least(F.lit(2 * radius), F.col(own) + step)) for own, step in (("i", F.col("di")), ("j", F.col("dj")))]
    spread = near.withColumn("step", F.explode(F.array(*[F.struct(F.lit(y).alias("dj"), F.lit(x).alias("di"), F.lit(n).alias("nth")) for n, (x, y) in enumerate(_GRID)])))
    spread = spread.select("*", "step.*").where((F.col("ci") == at[0]) & (F.col("cj") == at[1]))
    weight = [F.get(F.lit(row), F.col("nth")) * F.col("v") for row in _surface().tolist()]
    fit = spread.groupBy("frame", "bx", "by", "i", "j", "corr").agg(*[F.sum(w).alias(f"s{k}") for k, w in enumerate(weight)])
    # where the gradient of s0 + s1 x + s2 y + s3 x^2 + s4 xy + s5 y^2 is zero, by Cramer's rule on its Hessian
    hessian = F.expr("2 * s3 * 2 * s5 - s4 * s4")
    fit = fit.withColumns({
        "px": F.try_divide(F.expr("s4 * s2 - 2 * s5 * s1"), hessian),
        "py": F.try_divide(F.expr("s4 * s1 - 2 * s3 * s2"), hessian),
    })
    good = F.coalesce((F.abs("px") < 1) & (F.abs("py") < 1), F.lit(False))
    # at that point the surface is its constant term and half of the gradient's rise
    top = F.expr("s0 + (s1 * px + s2 * py) / 2")
    return fit.select(
        "frame",
        (F.col("bx") + F.col("i") - radius + F.when(good, F.col("px")).otherwise(0.0)).alias("mx"),
        (F.col("by") + F.col("j") - radius + F.when(good, F.col("py")).otherwise(0.0)).alias("my"),
        F.when(good, top).otherwise(F.col("corr")).alias("corr"),
    )


#: The steps to an offset's neighbours and itself.
_GRID = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1)]


def _surface() -> np.ndarray:
    """What turns nine correlations into the least-squares quadratic's terms 1, x, y, x^2, xy, y^2."""
    x, y = np.array(_GRID, float).T
    return np.linalg.pinv(np.stack([x**0, x, y, x * x, x * y, y * y], axis=1))


def estimate_motion(video: DataFrame, height: int, width: int, search: Search, levels: int = 2, value: str = "v") -> DataFrame:
    """``frame, mx, my, corr`` against frame 0: coarse to fine over a pyramid of ``levels`` halvings.

    Each level is a plan of its own around the offsets of the coarser one, doubled
    and cut to whole pixels; only the finest is refined below a pixel.
    """
    base = None
    pyramid = [(video.select("frame", "y", "x", F.col(value).cast("double").alias("v")), height, width, search)]
    for _ in range(levels):
        v, h, w, s = pyramid[-1]
        pyramid.append((pyramid_down(v, h, w, "v", "v"), h // 2, w // 2, s.half()))
    for k, (v, h, w, s) in reversed(list(enumerate(pyramid))):
        reference = v.where("frame = 0")
        corr = correlations(v.where("frame > 0"), reference, s, h, w, base)
        if k:
            best = best_offset(corr, s.radius)
            whole = {a: (2 * (F.col(b) + F.col(i) - s.radius)).cast("long") for a, b, i in (("bx", "bx", "i"), ("by", "by", "j"))}
            base = best.select("frame", *[c.alias(a) for a, c in whole.items()])
        else:
            return subpixel(corr, s.radius)
    raise AssertionError


def shading_correction(video: DataFrame, motion: DataFrame, period: int, value: str = "v") -> DataFrame:
    """Values less what a quadratic of the motion explains, per pixel and period.

    ``motion`` is ``frame, mx, my, valid``.  Periods with fewer than half of their
    frames valid, or with less than a pixel of motion along an axis, and invalid
    frames, stay as they are.  The normal equations are grouped sums; a pixel's
    six-by-six system is solved in numpy.
    """
    moved = motion.withColumn("seg", F.expr(f"frame div {period}")).where("valid")
    stats = moved.groupBy("seg").agg(
        F.count("*").alias("n"), F.avg("mx").alias("ax"), F.avg("my").alias("ay"),
        (F.max("mx") - F.min("mx")).alias("wx"), (F.max("my") - F.min("my")).alias("wy"),
    )
    usable = stats.where(F.expr(f"n >= {period // 2} and wx >= 1 and wy >= 1"))
    centred = moved.join(usable, "seg").select("frame", "seg", (F.col("mx") - F.col("ax")).alias("a"), (F.col("my") - F.col("ay")).alias("b"))
    terms = centred.select("frame", "seg", F.expr("array(1D, a, b, a * a, a * b, b * b)").alias("q"))
    gram = [F.sum(F.get("q", F.lit(i)) * F.get("q", F.lit(j))) for i in range(6) for j in range(6)]
    design = terms.groupBy("seg").agg(F.array(*gram).alias("gram"))
    right = [F.sum(F.get("q", F.lit(i)) * F.col(value)) for i in range(6)]
    asked = video.join(terms, "frame").groupBy("seg", "y", "x").agg(F.array(*right).alias("right")).join(design, "seg")

    def solve(frames):
        for f in frames:
            g = np.stack(f["gram"].to_numpy()).reshape(-1, 6, 6) if len(f) else np.zeros((0, 6, 6))
            r = np.stack(f["right"].to_numpy()) if len(f) else np.zeros((0, 6))
            c = (np.linalg.pinv(g) @ r[:, :, None])[:, :, 0]
            yield pd.DataFrame({"seg": f["seg"], "y": f["y"], "x": f["x"], "coef": list(c)})

    fits = asked.mapInPandas(solve, "seg long, y long, x long, coef array<double>")
    model = F.aggregate(F.zip_with(F.slice("coef", 2, 5), F.slice("q", 2, 5), lambda c, q: c * q), F.lit(0.0), lambda s, v: s + v)
    explained = terms.join(fits, "seg").select("frame", "y", "x", model.alias("_m"))
    joined = video.join(explained, ["frame", "y", "x"], "left")
    return joined.select("frame", "y", "x", (F.col(value) - F.coalesce("_m", F.lit(0.0))).alias("v"))
