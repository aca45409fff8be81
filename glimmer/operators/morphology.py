"""Binary morphology and image geometry over sparse pixels ``roi, y, x``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_PIXEL = ["y", "x"]


def _disk(radius: int) -> list[tuple[int, int]]:
    span = range(-radius, radius + 1)
    return [(dy, dx) for dy in span for dx in span if dy * dy + dx * dx <= radius * radius]


def _offsets(pixels: DataFrame, radius: int) -> DataFrame:
    """Each pixel moved by every offset of the disk."""
    moves = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in _disk(radius)])
    out = pixels.withColumn("_m", F.explode(moves))
    moved = out.withColumns({"y": (F.col("y") + F.col("_m.dy")).cast("long"), "x": (F.col("x") + F.col("_m.dx")).cast("long")})
    return moved.drop("_m")


def dilate(pixels: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """Dilation by a disk, within the frame."""
    inside = F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)
    return _offsets(pixels, radius).where(inside).distinct()


def erode(pixels: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """Erosion by a disk: pixels all of whose disk lies in the region; beyond the frame counts as inside."""
    keys = [c for c in pixels.columns if c not in _PIXEL]
    moves = _disk(radius)
    needed = None
    for dy, dx in moves:
        there = (F.col("y") + dy).between(0, height - 1) & (F.col("x") + dx).between(0, width - 1)
        needed = there.cast("int") if needed is None else needed + there.cast("int")
    hits = _offsets(pixels.distinct(), radius).groupBy(*keys, *_PIXEL).agg(F.count("*").alias("_n"))
    return pixels.distinct().join(hits, [*keys, *_PIXEL]).where(F.col("_n") == needed).drop("_n")


def outer_boundary(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Pixels next to a region but not of it."""
    return dilate(pixels, 1, height, width).join(pixels, pixels.columns, "left_anti")


def _labelled(keys: list[str], connectivity: int):
    """Connected components of one image by union of neighbouring pixels."""

    def over(frame: pd.DataFrame) -> pd.DataFrame:
        at = {p: i for i, p in enumerate(zip(frame["y"].tolist(), frame["x"].tolist(), strict=True))}
        up = list(range(len(at)))

        def top(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
        for (y, x), i in at.items():
            for dy, dx in steps:
                if (j := at.get((y + dy, x + dx))) is not None:
                    a, b = top(i), top(j)
                    if a != b:
                        up[b] = a
        points = list(at)
        least: dict[int, tuple] = {}
        for i, p in enumerate(points):
            r = top(i)
            least[r] = min(least.get(r, p), p)
        ranks = {p: n + 1 for n, p in enumerate(sorted(least.values()))}
        out = pd.DataFrame({"y": [p[0] for p in points], "x": [p[1] for p in points]})
        out["label"] = [ranks[least[top(i)]] for i in range(len(points))]
        for k in keys:
            out[k] = frame[k].iloc[0]
        return out[[*keys, "y", "x", "label"]]

    return over


def label_components(pixels: DataFrame, keys: list[str], connectivity: int = 8) -> DataFrame:
    """``keys, y, x, label``: connected components of each image, numbered from 1 by their first pixel in row order.

    An image's foreground is one group, bound by the frame's size; images are
    labelled side by side.
    """
    schema = ", ".join(f"{k} {dict(pixels.dtypes)[k]}" for k in keys) + ", y long, x long, label long"
    return pixels.select(*keys, *_PIXEL).distinct().groupBy(*keys).applyInPandas(_labelled(keys, connectivity), schema)


def fill_holes(pixels: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """Regions with their holes: background pixels that 4-connected background doesn't join to the border."""
    from .rois import pixel_grid

    frames = pixels.select(*keys).distinct()
    ground = frames.crossJoin(F.broadcast(pixel_grid(pixels.sparkSession, height, width)))  # one frame's grid for each image
    ground = ground.join(pixels, [*keys, *_PIXEL], "left_anti")
    labels = label_components(ground, keys, connectivity=4)
    edge = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == height - 1) | (F.col("x") == width - 1)
    open_ones = labels.where(edge).select(*keys, "label").distinct()
    holes = labels.join(open_ones, [*keys, "label"], "left_anti").select(*keys, *_PIXEL)
    return pixels.select(*keys, *_PIXEL).distinct().unionByName(holes)


def otsu_threshold(values: DataFrame, keys: list[str], value: str, bins: int = 256) -> DataFrame:
    """``keys, threshold``: the bin center that separates values best (largest variance between the two classes).

    A histogram by grouped counts, then running sums over its bins.
    """
    ends = values.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    width = (F.col("_high") - F.col("_low")).cast("double") / bins
    place = F.floor(F.try_divide((F.col(value) - F.col("_low")).cast("double"), width))
    counted = values.join(ends, keys) if keys else values.crossJoin(F.broadcast(ends))
    counted = counted.withColumn("_b", F.least(F.coalesce(place, F.lit(0).cast("long")), F.lit(bins - 1).cast("long")))
    hist = counted.groupBy(*keys, "_b", "_low", "_high").agg(F.count("*").alias("_n"))
    center = F.col("_low") + (F.col("_b") + 0.5) * width
    hist = hist.withColumn("_c", center)
    up = Window.partitionBy(*keys).orderBy("_b")
    all_ = Window.partitionBy(*keys)
    mass, moment = F.sum("_n").over(up), F.sum(F.col("_n") * F.col("_c")).over(up)
    hist = hist.withColumns(
        {"w1": mass, "m1": moment, "w": F.sum("_n").over(all_), "m": F.sum(F.col("_n") * F.col("_c")).over(all_)}
    )
    apart = F.col("m1") / F.col("w1") - (F.col("m") - F.col("m1")) / (F.col("w") - F.col("w1"))
    split = hist.where("w1 < w").withColumn("_s", F.col("w1") * (F.col("w") - F.col("w1")) * apart * apart)
    best = split.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_s"), "_b")))
    return best.where("_r = 1").select(*keys, F.col("_c").alias("threshold"))


def gaussian_blur(image: DataFrame, keys: list[str], sigma: float, height: int, width: int, mode: str = "nearest", value: str = "v") -> DataFrame:
    """Separable Gaussian with a radius of 4 sigma, edges by ``nearest`` pixel or ``constant`` zero.

    Each axis is one join with a table of weights (source, target, weight), in
    which all that falls on an edge pixel is summed.
    """
    spark = image.sparkSession
    radius = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    kernel /= kernel.sum()

    def axis(df: DataFrame, name: str, n: int) -> DataFrame:
        weights: dict[tuple[int, int], float] = {}
        for t in range(n):
            for k, w in zip(range(-radius, radius + 1), kernel.tolist(), strict=True):
                s = t + k
                if mode == "nearest":
                    s = min(max(s, 0), n - 1)
                if 0 <= s < n:
                    weights[s, t] = weights.get((s, t), 0.0) + w
        table = spark.createDataFrame([(s, t, w) for (s, t), w in weights.items()], f"{name} long, _t long, _w double")
        other = [c for c in _PIXEL if c != name]
        joined = df.join(F.broadcast(table), name)  # as long as the axis times the kernel
        return joined.groupBy(*keys, *other, F.col("_t").alias(name)).agg(F.sum(F.col(value) * F.col("_w")).alias(value))

    start = image.select(*keys, *_PIXEL, F.col(value).cast("double").alias(value))
    return axis(axis(start, "x", width), "y", height)


def _hull_area(points: list[tuple[int, int]]) -> int:
    """Pixel centers in the convex hull of pixels (monotone chain)."""
    points = sorted(set(points))

    def half(side: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for p in side:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    hull = half(points) + half(points[::-1]) if len(points) > 1 else points
    ys, xs = np.mgrid[points[0][0] : points[-1][0] + 1, min(p[1] for p in points) : max(p[1] for p in points) + 1]
    inside = np.ones(ys.shape, bool)
    for (ay, ax), (by, bx) in zip(hull, hull[1:] + hull[:1], strict=True):
        inside &= (by - ay) * (xs - ax) - (bx - ax) * (ys - ay) >= 0
    return int(inside.sum())


def convex_area(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, area, convex_area``: pixels of each region, and pixel centers in its convex hull."""

    def over(frame: pd.DataFrame) -> pd.DataFrame:
        points = list(zip(frame["y"].tolist(), frame["x"].tolist(), strict=True))
        row = {k: [frame[k].iloc[0]] for k in keys}
        return pd.DataFrame(row | {"area": [len(set(points))], "convex_area": [_hull_area(points)]})

    schema = ", ".join(f"{k} {dict(pixels.dtypes)[k]}" for k in keys) + ", area long, convex_area long"
    return pixels.groupBy(*keys).applyInPandas(over, schema)


def _eccentricity(y: np.ndarray, x: np.ndarray) -> float:
    """Of the ellipse with a region's second moments; a pixel's own extent adds 1/12 to each variance."""
    a, b, c = y.var() + 1 / 12, x.var() + 1 / 12, ((y - y.mean()) * (x - x.mean())).mean()
    mid, span = (a + b) / 2, np.hypot((a - b) / 2, c)
    return float(np.sqrt(max(0.0, 1 - (mid - span) / (mid + span))))


def _otsu(image: np.ndarray, bins: int = 256) -> float:
    """From where on an image's values are the upper class: the upper end of the last bin of the lower one.

    (Its center would take values of that bin for the upper class.)
    """
    counts, edges = np.histogram(image, bins)
    centers = (edges[:-1] + edges[1:]) / 2
    below, sums = np.cumsum(counts), np.cumsum(counts * centers)
    above = below[-1] - below
    split = (below > 0) & (above > 0)
    gap = sums[split] / below[split] - (sums[-1] - sums[split]) / above[split]
    return float(edges[1:][split][np.argmax(below[split] * above[split] * gap * gap)])


def demix(
    masks: DataFrame, area_min: int, concavity: float = 10.0, eccentricity: float = 0.98, intensity: float = 0.0, activity: float = 0.0,
    binarize: float = 0.95, least: float = 0.8, reach: int = 3, keys: tuple[str, ...] = ("grp",),
) -> DataFrame:
    """``keys, component, y, x`` of overlapping time-varying masks ``keys, seg, y, x`` by repeated rank-one factorization.

    Each round takes the leading non-negative pair of the mask matrix and cuts its
    footprint at Otsu's threshold.  Connected parts are accepted by area,
    concavity (convex over own area), eccentricity, mean image intensity and
    activity (intensity times mean probability); columns ``img`` and ``prb`` of
    ``masks`` hold a pixel's image value and mean probability, 0 if there are none.
    What the accepted parts and their surroundings of ``reach`` pixels explain is
    taken off and the rest is binarized, until nothing is accepted, too little is
    explained or the rest stays the same (it only ever shrinks).  A group is one
    cluster of touching masks, bound by its box, to which one pixel of background
    belongs on each side.
    """
    with_values = {"img", "prb"} <= set(masks.columns)
    disk = _disk(reach)

    def over(frame: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(frame["y"].min()) - 1, int(frame["x"].min()) - 1
        height, width = int(frame["y"].max()) - y0 + 2, int(frame["x"].max()) - x0 + 2
        segs = {s: i for i, s in enumerate(sorted(set(frame["seg"])))}
        place = ((frame["y"] - y0) * width + frame["x"] - x0).to_numpy()
        x = np.zeros((len(segs), height * width))
        x[[segs[s] for s in frame["seg"]], place] = 1.0
        img, prb = np.zeros(height * width), np.zeros(height * width)
        if with_values:
            img[place], prb[place] = frame["img"], frame["prb"]

        def accepted(ys: np.ndarray, xs: np.ndarray) -> bool:
            if len(ys) < area_min or _eccentricity(ys, xs) > eccentricity:
                return False
            if _hull_area(list(zip(ys.tolist(), xs.tolist(), strict=True))) > concavity * len(ys):
                return False
            own = ys * width + xs
            mean = img[own].mean()
            return mean >= intensity and mean * prb[own].mean() >= activity

        found: list[tuple[int, int, int]] = []
        n = 0
        while x.any():
            u, s, vt = np.linalg.svd(x, full_matrices=False)
            weight, image = np.abs(u[:, 0]) * s[0], np.abs(vt[0])
            ys, xs = np.divmod(np.flatnonzero(image >= _otsu(image)), width)
            labels = _labelled([], 8)(pd.DataFrame({"y": ys, "x": xs})) if len(ys) else pd.DataFrame({"label": []})
            near = np.zeros((height, width), bool)
            for _, part in labels.groupby("label"):
                py, px = part["y"].to_numpy(), part["x"].to_numpy()
                if accepted(py, px):
                    found += [(n, y0 + int(a), x0 + int(b)) for a, b in zip(py, px, strict=True)]
                    for dy, dx in disk:
                        near[np.clip(py + dy, 0, height - 1), np.clip(px + dx, 0, width - 1)] = True
                    n += 1
            explained = np.outer(weight, np.where(near.ravel(), image, 0))
            if not near.any() or explained.max() < least:
                break
            rest = (x - explained > binarize).astype(float)
            if np.array_equal(rest, x):
                break
            x = rest
        out = pd.DataFrame(found, columns=["component", "y", "x"], dtype=np.int64)
        for k in keys:
            out[k] = frame[k].iloc[0]
        return out

    schema = ", ".join(f"{k} {dict(masks.dtypes)[k]}" for k in keys) + ", component long, y long, x long"
    return masks.groupBy(*keys).applyInPandas(over, schema)


def foreground(
    image: DataFrame, keys: list[str], height: int, width: int, sigma: float = 10.0, edge: float = 1.0, threshold: float = 0.003, reach: int = 3
) -> tuple[DataFrame, DataFrame]:
    """``(pixels, image)``: where images ``keys, y, x, v`` stand out from their smoothed background, and the images less it.

    Near the border, where smoothing darkens, pixels are weighted down by a
    vignette of width ``edge`` (none for 0) before they are held against the
    background; what is left is dilated by a disk of ``reach`` and its holes are
    filled.
    """
    smooth = gaussian_blur(image, keys, sigma, height, width).withColumnRenamed("v", "_ground")
    both = image.select(*keys, *_PIXEL, F.col("v").cast("double").alias("v")).join(smooth, [*keys, *_PIXEL])
    fall = F.get(F.lit(_vignette(height, edge)), F.col("y").cast("int")) * F.get(F.lit(_vignette(width, edge)), F.col("x").cast("int"))
    high = both.where(F.col("v") * fall - F.col("_ground") > threshold).select(*keys, *_PIXEL)
    return fill_holes(dilate(high, reach, height, width), keys, height, width), both.withColumn("v", F.col("v") - F.col("_ground")).drop("_ground")


def _vignette(n: int, edge: float) -> list[float]:
    """A row of ones, smoothed by a Gaussian with nothing beyond its ends."""
    if edge <= 0:
        return [1.0] * n
    radius = int(4 * edge + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / edge) ** 2)
    return np.convolve(np.ones(n + 2 * radius) * np.pad(np.ones(n), radius), kernel / kernel.sum(), "valid").tolist()


def contour_edges(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, y0, x0, y1, x1``: the pixel sides between a region and its outside, each with the region on its left.

    The outline at level one half, as edges; sides between two members of the
    region cancel out.
    """
    sides = [((0, 0), (1, 0), (0, -1)), ((1, 0), (1, 1), (1, 0)), ((1, 1), (0, 1), (0, 1)), ((0, 1), (0, 0), (-1, 0))]
    each = F.explode(F.array(*[
        F.struct(
            (F.col("y") + a[0]).alias("y0"), (F.col("x") + a[1]).alias("x0"), (F.col("y") + b[0]).alias("y1"), (F.col("x") + b[1]).alias("x1"),
            (F.col("y") + n[0]).alias("ny"), (F.col("x") + n[1]).alias("nx"),
        )
        for a, b, n in sides
    ])).alias("e")
    members = pixels.select(*keys, *_PIXEL).distinct()
    edges = members.select(*keys, each).select(*keys, "e.*")
    there = members.select(*keys, F.col("y").alias("ny"), F.col("x").alias("nx"))
    return edges.join(there, [*keys, "ny", "nx"], "left_anti").select(*keys, "y0", "x0", "y1", "x1")
