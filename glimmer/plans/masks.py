"""The mask pipeline: probability maps to demixed neuron masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.operators import morphology, tiles


def compute_masks(
    prob: DataFrame, image: DataFrame, height: int, width: int, threshold: float = 0.5, area_min: int = 0, area_max: int = 10000,
    concavity: float = 10.0, intensity: float = 0.0, activity: float = 0.0, background_sigma: float = 10.0, background_edge: float = 1.0,
    background_threshold: float = 0.003, dilation: int = 0, out_shape: tuple[int, int] | None = None, eccentricity: float = 0.98,
    keys: list[str] | None = None,
) -> DataFrame:
    """``keys, roi, y, x`` from probability maps ``keys, seg, y, x, p`` and mean images ``keys, y, x, v``.

    ``keys`` name the dataset, if there are several; each is handled by itself.
    Pixels count where the image stands out from its smoothed background.  Per
    segment the thresholded map is labelled and its regions filtered by area and
    shape; regions that touch over time make one cluster each, which is demixed by
    itself.  The parts found are dilated and brought to ``out_shape``; regions are
    numbered from 0 in each dataset.
    """
    own = keys or ["_all"]
    if not keys:
        prob, image = prob.withColumn("_all", F.lit(0)), image.withColumn("_all", F.lit(0))
    ground, above = morphology.foreground(image, own, height, width, background_sigma, background_edge, background_threshold)
    mean = prob.groupBy(*own, "y", "x").agg(F.avg("p").alias("prb"))
    on = prob.where(F.col("p") > threshold).select(*own, "seg", "y", "x").join(ground, [*own, "y", "x"], "left_semi")
    parts = morphology.label_components(on, [*own, "seg"])
    kept = parts.join(_passing(parts, [*own, "seg", "label"], area_min, area_max, eccentricity), [*own, "seg", "label"], "left_semi")
    clusters = morphology.label_components(kept.select(*own, "y", "x"), own).withColumnRenamed("label", "_cluster")
    values = above.withColumnRenamed("v", "img").join(mean, [*own, "y", "x"])
    named = kept.join(clusters, [*own, "y", "x"]).join(values, [*own, "y", "x"])
    cluster = [*own, "_cluster"]
    masks = named.select(*cluster, "seg", "y", "x", "img", "prb")
    grown = morphology.demix(masks, area_min, concavity, eccentricity, intensity, activity, keys=tuple(cluster))
    region = [*cluster, "component"]
    if dilation:
        grown = morphology.dilate(grown.select(*region, "y", "x"), dilation, height, width)
    if out_shape and tuple(out_shape) != (height, width):
        grown = tiles.resize_masks(grown, region, (height, width), out_shape)
    # as many rows as there are regions; a dataset's are numbered by their place in its sorted list
    order = F.struct("_cluster", "component")
    lists = grown.select(*region).distinct().groupBy(*own).agg(F.array_sort(F.collect_list(order)).alias("_l"))
    numbered = lists.select(*own, F.posexplode("_l").alias("roi", "_o"))
    numbered = numbered.select(*own, F.col("roi").cast("long").alias("roi"), "_o.*")
    return grown.join(numbered, region).select(*(keys or []), "roi", "y", "x")


def _passing(parts: DataFrame, keys: list[str], area_min: int, area_max: int, eccentricity: float) -> DataFrame:
    """Keys of the regions whose area and shape pass."""
    a, b, c = F.var_pop("y") + 1 / 12, F.var_pop("x") + 1 / 12, F.covar_pop("y", "x")
    mid, span = (a + b) / 2, F.sqrt(F.pow((a - b) / 2, F.lit(2.0)) + c * c)
    shape = F.sqrt(F.greatest(F.lit(0.0), 1 - (mid - span) / (mid + span)))
    stats = parts.groupBy(*keys).agg(F.count("*").alias("_area"), shape.alias("_shape"))
    return stats.where(F.col("_area").between(area_min, area_max) & (F.col("_shape") <= eccentricity)).select(*keys)
