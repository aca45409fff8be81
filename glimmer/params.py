"""Parameter sets: immutable, with the defaults and the named presets of the dataset groups."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class Params:
    """Parameters of the run pipeline.  Unknown names are an error; see ``PRESETS``."""

    # The defaults.
    first_frame: int = 0
    normalize: bool = True
    time_segment_size: int = 50
    motion_search_level: int = 2
    motion_search_size: int = 3
    motion_patch_size: int = 10
    motion_patch_offset: int = 7
    motion_x_range: float = 1.0
    motion_y_range: float = 1.0
    motion_corr_length: int = 1000
    shading_period: int = 1000
    signal_method: str = "max-med"
    signal_scale: float = 3.0
    signal_downsampling: float = 1.0
    tile_shape: tuple[int, int] = (64, 64)
    tile_strides: tuple[int, int] = (8, 8)
    tile_margin: tuple[float, float] = (0.0, 0.0)
    norm_channel: int = 1
    norm_shifts: tuple[bool, bool] = (False, True)
    batch_size: int = 128
    probability_threshold: float = 0.5
    area_threshold_min: int = 0
    area_threshold_max: int = 10000
    concavity_threshold: float = 10.0
    eccentricity_max: float = 0.98
    intensity_threshold: float = 0.0
    activity_threshold: float = 0.0
    background_sigma: float = 10.0
    background_edge: float = 1.0
    background_threshold: float = 0.003
    mask_dilation: int = 0
    polarity: int = 1
    spike_threshold: float = 2.5
    remove_inactive: bool = False
    representative_iou: float = 0.3
    run_mode: str = "run"
    # What only training sets.
    image_shape: tuple[int, int] | None = None
    time_frames: int | None = None
    num_videos: int | None = None
    num_cells_min: int | None = None
    num_cells_max: int | None = None
    model_io_shape: tuple[int, int] | None = None
    num_darts: int | None = None
    epochs: int | None = None

    def with_overrides(self, user: dict[str, Any]) -> Params:
        """The user's values over these; names may be in upper case."""
        known = {f.name for f in fields(self)}
        lower = {k.lower(): v for k, v in user.items()}
        if unknown := set(lower) - known:
            raise ValueError(f"no such parameters: {sorted(unknown)}")
        return replace(self, **lower)

    def as_rows(self) -> list[tuple[str, str]]:
        return [(k, str(v)) for k, v in sorted(asdict(self).items())]


# The overrides for the groups of recordings and for training data.
PRESETS: dict[str, dict[str, Any]] = {
    "l1": {
        "motion_y_range": 0.5, "signal_method": "med-min", "tile_strides": (8, 8), "probability_threshold": 0.2,
        "area_threshold_min": 20, "area_threshold_max": 200, "concavity_threshold": 1.3, "intensity_threshold": 0.02,
        "activity_threshold": 0.0, "background_edge": 2.0, "background_threshold": 0.003, "mask_dilation": 1, "polarity": -1,
    },
    "teg": {
        "motion_x_range": 0.5, "motion_y_range": 0.5, "signal_method": "med-min", "tile_strides": (12, 12),
        "probability_threshold": 0.2, "area_threshold_min": 120, "area_threshold_max": 600, "concavity_threshold": 1.5,
        "intensity_threshold": 0.005, "activity_threshold": 0.0, "background_edge": 3.0, "background_threshold": 0.003,
        "mask_dilation": 2, "polarity": -1,
    },
    "hpc": {
        "first_frame": 50, "signal_downsampling": 1.5, "tile_strides": (4, 4), "probability_threshold": 0.2,
        "area_threshold_min": 250, "area_threshold_max": 500, "concavity_threshold": 1.3, "intensity_threshold": 0.01,
        "activity_threshold": 0.0, "background_edge": 1.0, "background_threshold": 0.003, "mask_dilation": 0,
    },
    "hpc2": {
        "motion_x_range": 0.7, "tile_strides": (8, 16), "tile_margin": (0.0, 0.2), "norm_shifts": (True, True),
        "probability_threshold": 0.95, "area_threshold_min": 110, "area_threshold_max": 1000, "concavity_threshold": 1.5,
        "intensity_threshold": 0.01, "activity_threshold": 0.001, "background_edge": 1.0, "background_threshold": 0.003,
        "mask_dilation": 1, "spike_threshold": 2.5, "remove_inactive": True,
    },
    "train": {
        "run_mode": "train", "image_shape": (128, 128), "time_frames": 1000, "num_videos": 1000, "num_cells_min": 5,
        "num_cells_max": 30, "model_io_shape": (64, 64), "num_darts": 10, "batch_size": 128, "epochs": 20,
        "tile_strides": (16, 16), "probability_threshold": 0.5, "area_threshold_min": 50, "area_threshold_max": 1000,
        "concavity_threshold": 1.5, "background_edge": 0.0, "background_threshold": 0.0,
    },
}


def preset(name: str) -> Params:
    return Params().with_overrides(PRESETS[name])
