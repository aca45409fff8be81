import pytest
from pyspark.sql import functions as F

from glimmer import api
from glimmer.params import PRESETS, Params, preset


def test_params():
    p = Params().with_overrides({"SIGNAL_METHOD": "med-min", "polarity": -1})
    assert (p.signal_method, p.polarity, p.time_segment_size) == ("med-min", -1, 50)
    with pytest.raises(ValueError):
        Params().with_overrides({"no_such": 1})
    assert all(preset(n) for n in PRESETS) and preset("hpc").first_frame == 50
    assert ("polarity", "-1") in p.as_rows()


# What each set of parameters has to say.
EXPECTED = {
    None: "first_frame=0 motion_search_level=2 motion_search_size=3 motion_patch_size=10 motion_patch_offset=7 motion_x_range=1.0 motion_y_range=1.0 "
    "shading_period=1000 signal_downsampling=1.0 signal_scale=3.0 signal_method=max-med tile_shape=(64,64) tile_strides=(8,8) batch_size=128 norm_channel=1 "
    "probability_threshold=0.5 area_threshold_min=0 area_threshold_max=10000 concavity_threshold=10.0 intensity_threshold=0.0 activity_threshold=0.0 "
    "background_sigma=10.0 background_edge=1.0 background_threshold=0.003 mask_dilation=0 polarity=1 spike_threshold=2.5 remove_inactive=False "
    "representative_iou=0.3 time_segment_size=50 normalize=True norm_shifts=(False,True) tile_margin=(0.0,0.0) run_mode=run",
    "l1": "motion_x_range=1.0 motion_y_range=0.5 signal_method=med-min tile_strides=(8,8) probability_threshold=0.2 area_threshold_min=20 area_threshold_max=200 "
    "concavity_threshold=1.3 intensity_threshold=0.02 background_edge=2.0 mask_dilation=1 polarity=-1 spike_threshold=2.5",
    "teg": "motion_x_range=0.5 motion_y_range=0.5 signal_method=med-min tile_strides=(12,12) probability_threshold=0.2 area_threshold_min=120 "
    "area_threshold_max=600 concavity_threshold=1.5 intensity_threshold=0.005 background_edge=3.0 mask_dilation=2 polarity=-1",
    "hpc": "first_frame=50 signal_downsampling=1.5 tile_strides=(4,4) probability_threshold=0.2 area_threshold_min=250 area_threshold_max=500 "
    "concavity_threshold=1.3 intensity_threshold=0.01 background_edge=1.0 mask_dilation=0 polarity=1 shading_period=1000",
    "hpc2": "motion_x_range=0.7 tile_strides=(8,16) tile_margin=(0.0,0.2) norm_shifts=(True,True) probability_threshold=0.95 area_threshold_min=110 "
    "area_threshold_max=1000 concavity_threshold=1.5 intensity_threshold=0.01 activity_threshold=0.001 mask_dilation=1 remove_inactive=True",
    "train": "run_mode=train image_shape=(128,128) time_frames=1000 num_videos=1000 num_cells_min=5 num_cells_max=30 model_io_shape=(64,64) num_darts=10 epochs=20 "
    "tile_strides=(16,16) area_threshold_min=50 area_threshold_max=1000 concavity_threshold=1.5 background_edge=0.0 background_threshold=0.0 shading_period=1000",
}


@pytest.mark.parametrize("name", EXPECTED)
def test_every_value_of_the_sets(name):
    p = preset(name) if name else Params()
    for item in EXPECTED[name].split():
        key, _, value = item.partition("=")
        assert str(getattr(p, key)).replace(" ", "") == value, key
    assert set(PRESETS) == set(EXPECTED) - {None}


def test_whole_run(spark):
    data = api.create_synthetic_data(spark, 40, 24, 24, 4, 5)
    params = Params().with_overrides({
        "time_segment_size": 20, "motion_search_level": 1, "motion_search_size": 1, "motion_patch_size": 3, "motion_patch_offset": 4,
        "tile_shape": (16, 16), "tile_strides": (4, 4), "area_threshold_min": 3, "background_sigma": 5.0, "background_threshold": -1.0, "shading_period": 40, "signal_scale": 0.8,
    })
    seen = []
    out = api.run(data["video"], 24, 24, params, reference=data["masks"], on_stage=lambda n, df: seen.append(n), sigma=3.0)
    assert seen == ["corrected", "motion", "signal", "prob", "masks", "potential", "spikes", "scores"]
    assert out["corrected"].count() == 40 * 24 * 24 and out["motion"].count() == 40
    assert out["signal"].count() == 2 * 24 * 24 and out["prob"].agg(F.max("p")).first()[0] <= 1
    assert out["scores"].count() == 100 and out["masks"].count() > 0
    each = out["scores"].withColumn("dataset", F.lit("a")).unionByName(out["scores"].withColumn("dataset", F.lit("b")))
    mean, rep = api.evaluate_all(each, 0.3)
    assert mean.count() == 100 and {round(r.threshold, 2) for r in rep.collect()} == {0.3}
    pca = api.preprocess_video(out["corrected"], 24, 24, params.with_overrides({"signal_method": "pca", "signal_downsampling": 1.5}))
    assert pca.count() == 2 * 24 * 24


def test_inactive_neurons_go(spark):
    rows = [(f, 0, x, float(f % 7 == 3) * 5 + 0.01 * (f % 3) if x == 0 else 1.0) for f in range(60) for x in range(2)]
    video = spark.createDataFrame(rows, "frame long, y long, x long, v double")
    masks = spark.createDataFrame([(0, 0, 1), (1, 0, 0)], "roi long, y long, x long")
    params = Params(spike_threshold=1.0, remove_inactive=True)
    potential, peaks, left = api.detect_spikes(video, masks, params, sigma=5.0)
    assert {r.roi for r in left.collect()} == {0} == {r.roi for r in potential.collect()} and left.first().x == 0
    assert {r.t for r in peaks.collect()} >= {10, 17, 24}


def test_timer(spark):
    t = api.Timer(stored={"mask": 2.5})
    t.start()
    t.stop("correct")
    t.skip("mask")
    rows = t.table(spark, "d", 10, 100).collect()
    assert [(r.stage, r.frames) for r in rows] == [("correct", 10), ("mask", 0)] and rows[1].sec == 2.5
