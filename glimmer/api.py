"""The pipeline's steps as functions of tables, and the pipeline itself.

A video is ``frame, y, x, v``; each function says what it returns.  A run over
many datasets applies the same steps to each; the steps' tables are written by
:mod:`glimmer.sources.tables`, partitioned by dataset.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.operators import frames, generators, matching, motion, rois, signals, spikes, tiles
from glimmer.params import Params
from glimmer.plans.masks import compute_masks as _masks
from glimmer.sources.shared import shared_path


def _kept(df: DataFrame, what: str) -> DataFrame:
    """A step's table, written once in the shared folder, so that later steps and retries read it."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def correct_video(video: DataFrame, height: int, width: int, params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """``(video, motion)``: intensity equalized and rescaled, motion taken out, shading taken off.

    ``motion`` is ``frame, mx, my, corr, valid``; frame 0 is the reference.
    """
    v = frames.skip_frames(video, params.first_frame)
    if params.normalize:
        v = frames.rescale(frames.equalize_frames(v, "v", "v"), "v", "v")
    v = _kept(v, "normalized")
    search = motion.Search(params.motion_search_size, params.motion_patch_size, params.motion_patch_offset, params.motion_x_range, params.motion_y_range)
    found = _kept(motion.estimate_motion(v, height, width, search, params.motion_search_level), "motion")
    gate = found.select(F.lit(0).cast("long").alias("roi"), F.col("frame").alias("t"), F.col("corr").alias("v"))
    valid = running_validity(gate, params.motion_corr_length)
    first = video.sparkSession.createDataFrame([(0, 0.0, 0.0, 0.0, True)], "frame long, mx double, my double, corr double, valid boolean")
    moves = first.unionByName(found.join(valid, "frame"))
    still = _kept(frames.shift_bilinear(v, moves.select("frame", "mx", "my"), height, width, "v", "v"), "still")
    return motion.shading_correction(still, moves, params.shading_period), moves


def running_validity(trace: DataFrame, length: int) -> DataFrame:
    """``frame, valid`` of correlations ``roi, t, v`` by the running median; a video's correlations are one ordered run."""
    return spikes.running_median_valid(trace, length).select(F.col("t").alias("frame"), "valid")


def preprocess_video(video: DataFrame, height: int, width: int, params: Params = Params()) -> DataFrame:
    """``seg, y, x, temporal, spatial`` of a corrected video.

    ``max-med`` and ``med-min`` smooth each frame first; the mean is taken of the
    frames as they are.  ``pca`` reduces the frame instead and gives patch
    components.
    """
    period = params.time_segment_size
    means = signals.segment_signals(video, period, value="v").select("seg", "y", "x", "spatial")
    if params.signal_method == "pca":
        small, h, w = video, height, width
        if params.signal_downsampling != 1.0:
            f = params.signal_downsampling
            small, h, w = frames.area_downsample(video, height, width, f, "v", "v"), int(height / f + 0.5), int(width / f + 0.5)
        parts = signals.patch_components(small, period, min(h, w, 8), max(1, min(h, w, 8) // 2), h, w, "v")
        back = tiles.resize_nearest(parts, (h, w), (height, width))
        return back.withColumnRenamed("v", "temporal").join(means, ["seg", "y", "x"])
    smooth = video
    if params.signal_scale >= 0.5:
        px = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda s: s["v"])
        rows = video.groupBy("frame").agg(px.alias("px")).select("frame", F.lit(height).alias("h"), F.lit(width).alias("w"), "px")
        each = signals.smooth_frames(rows, params.signal_scale).select("frame", F.posexplode("px").alias("p", "v"))
        smooth = each.select("frame", F.expr(f"cast(p div {width} as bigint)").alias("y"), F.expr(f"cast(p % {width} as bigint)").alias("x"), "v")
    return signals.segment_signals(smooth, period, params.signal_method, value="v").drop("spatial").join(means, ["seg", "y", "x"])


def segment(signal: DataFrame, height: int, width: int, params: Params = Params(), scorer: tiles.Scorer = tiles.contrast_scorer) -> DataFrame:
    """``seg, y, x, p``: tiles of the temporal signal scored by a model and merged."""
    shape = (min(height, params.tile_shape[0]), min(width, params.tile_shape[1]))
    grid = tiles.tile_grid(signal.sparkSession, height, width, shape, params.tile_strides, params.tile_margin)
    cut = tiles.normalize_tiles(tiles.extract_tiles(signal.select("seg", "y", "x", F.col("temporal").alias("v")), grid, shape)).fillna(0.0, ["v"])
    scored = tiles.score_tiles(cut, shape, scorer, params.batch_size)
    return tiles.merge_weighted(scored, shape, rois.pixel_grid(signal.sparkSession, height, width)).withColumnRenamed("v", "p")


def compute_masks(
    prob: DataFrame, signal: DataFrame, height: int, width: int, params: Params = Params(), out_shape: tuple[int, int] | None = None
) -> DataFrame:
    """``roi, y, x`` of the neurons in a probability map, at ``out_shape`` (the map's own, if none is given)."""
    image = signal.groupBy("y", "x").agg(F.avg("spatial").alias("v"))
    p = params
    return _masks(
        prob, image, height, width, p.probability_threshold, p.area_threshold_min, p.area_threshold_max, p.concavity_threshold,
        p.intensity_threshold, p.activity_threshold, p.background_sigma, p.background_edge, p.background_threshold, p.mask_dilation,
        out_shape, p.eccentricity_max,
    )


def detect_spikes(video: DataFrame, masks: DataFrame, params: Params = Params(), sigma: float = 100.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(potential, spikes, masks)``: traces of pixels that one neuron has alone, baseline off and scaled, and their peaks.

    With ``remove_inactive`` neurons without a spike go and the others are numbered
    anew.
    """
    raw = rois.extract_traces(video, rois.without_overlap(masks), "v").select("roi", F.col("frame").alias("t"), "v")
    flipped = raw.withColumn("v", F.col("v") * (1.0 if params.polarity >= 0 else -1.0))
    potential = _kept(spikes.center_and_scale(spikes.remove_baseline(flipped, sigma)), "potential")
    peaks = spikes.find_peaks(potential, params.spike_threshold)
    if params.remove_inactive:
        idle = masks.select("roi").distinct().join(peaks, "roi", "left_anti")
        return spikes.remove_inactive(potential, peaks), spikes.remove_inactive(peaks, peaks), rois.drop_and_renumber(masks, idle)
    return potential, peaks, masks


def evaluate_each(masks: DataFrame, reference: DataFrame, one_to_one: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(scores, iou)`` of masks against reference regions, over 100 thresholds."""
    iou = matching.iou_matrix(masks, reference)
    counts = matching.matched_counts(iou) if one_to_one else matching.threshold_counts(iou)
    return matching.scores(counts), iou


def evaluate_all(scored: DataFrame, representative_iou: float = 0.3, weighted: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(mean scores, each dataset's scores at the representative threshold)`` of ``dataset`` and score columns."""
    first = scored.where(F.col("threshold") >= representative_iou - 1e-12).groupBy("dataset").agg(F.min("threshold").alias("threshold"))
    return matching.aggregate_scores(scored, weighted), scored.join(first, ["dataset", "threshold"])


def create_synthetic_data(spark: SparkSession, frames_: int, height: int, width: int, neurons: int, seed: int) -> dict[str, DataFrame]:
    """``video``, ``masks``, ``spikes`` and the two label tables of a made-up recording."""
    video, masks, times = generators.synthetic_video(spark, frames_, height, width, neurons, seed)
    return {
        "video": video, "masks": masks, "spikes": times,
        "temporal": generators.temporal_labels(masks, times), "spatial": generators.spatial_labels(masks, times),
    }


decimate_video = signals.decimate


@dataclass
class Timer:
    """Seconds by stage; a skipped stage reuses the time that an earlier run has stored."""

    stored: dict[str, float] = field(default_factory=dict)
    times: dict[str, float] = field(default_factory=dict)
    _since: float = 0.0

    def start(self) -> None:
        self._since = time.perf_counter()

    def stop(self, stage: str) -> None:
        self.times[stage] = time.perf_counter() - self._since

    def skip(self, stage: str) -> None:
        self.times[stage] = self.stored.get(stage, 0.0)

    def table(self, spark: SparkSession, dataset: str, n_frames: int, n_bytes: int) -> DataFrame:
        """Rows ``dataset, stage, sec, frames, bytes``, frames and bytes with the first stage, for the roll-up."""
        rows = [(dataset, s, t, n_frames if i == 0 else 0, n_bytes if i == 0 else 0) for i, (s, t) in enumerate(self.times.items())]
        return spark.createDataFrame(rows, "dataset string, stage string, sec double, frames long, bytes long")


def run(video: DataFrame, height: int, width: int, params: Params = Params(), scorer: tiles.Scorer = tiles.contrast_scorer, reference: DataFrame | None = None,
        on_stage: Callable[[str, DataFrame], None] | None = None, sigma: float = 100.0) -> dict[str, DataFrame]:
    """All steps over one recording: the tables ``corrected, motion, signal, prob, masks, potential, spikes``, and ``scores``
    with a reference.  Each is written once before the next step reads it."""
    out: dict[str, DataFrame] = {}

    def keep(name: str, df: DataFrame) -> DataFrame:
        out[name] = _kept(df, name)
        if on_stage:
            on_stage(name, out[name])
        return out[name]

    corrected, moves = correct_video(video, height, width, params)
    corrected, _ = keep("corrected", corrected), keep("motion", moves)
    signal = keep("signal", preprocess_video(corrected, height, width, params))
    prob = keep("prob", segment(signal, height, width, params, scorer))
    found = keep("masks", compute_masks(prob, signal, height, width, params))
    potential, peaks, left = detect_spikes(corrected, found, params, sigma)
    keep("potential", potential)
    keep("spikes", peaks)
    out["masks"] = left
    if reference is not None:
        keep("scores", evaluate_each(left, reference)[0])
    return out
