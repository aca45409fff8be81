"""Queries without SQL give rows for their whole table."""

import pytest

from glimmer.operators import morphology
from glimmer.plans import registry

SF = "/root/testdata/sf0.001"


def frames(spark):
    return {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()}


@pytest.mark.parametrize("name", ["estimate_motion", "shading_regress"])
def test_motion_covers_all_frames(spark, name):
    got = {r.frame for r in registry.queries()[name](spark, SF).select("frame").distinct().collect()}
    assert max(got) >= 60 and got | {0} == frames(spark)


def test_demix_goes_on_beyond_twenty_rounds(spark):
    rows, seg = [], 0
    for i in range(30):  # squares that are active alone, each in more segments than the one before
        for _ in range(i + 1):
            rows += [(0, seg, 3 * (i // 6) + a, 3 * (i % 6) + b) for a in (0, 1) for b in (0, 1)]
            seg += 1
    got = morphology.demix(spark.createDataFrame(rows, "grp long, seg long, y long, x long"), 3).collect()
    parts = {}
    for r in got:
        parts.setdefault(r.component, set()).add((r.y, r.x))
    want = [{(3 * (i // 6) + a, 3 * (i % 6) + b) for a in (0, 1) for b in (0, 1)} for i in range(30)]
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, want))


def test_tv_denoise_covers_all_frames(spark):
    got = {r.seg for r in registry.queries()["tv_denoise"](spark, SF).select("seg").distinct().collect()}
    assert max(got) >= 20 and got == frames(spark)


@pytest.mark.parametrize("name", ["lstsq_traces", "peak_to_peak"])
def test_traces_cover_all_regions(spark, name):
    sf = "/root/testdata/sf0.01"  # more than 21 suppliers
    rois = {r.s_suppkey for r in spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey").collect()}
    got = {r.roi for r in registry.queries()[name](spark, sf).select("roi").distinct().collect()}
    assert max(got) > 20 and got == rois


def test_matched_counts_take_all_regions(spark):
    sf = "/root/testdata/sf0.01"
    from glimmer.operators import matching
    from glimmer.sources.views import ev, gt

    assert ev(spark, sf).select("roi").distinct().count() == spark.read.parquet(f"{sf}/supplier.parquet").count()
    want = matching.matched_counts(matching.iou_matrix(ev(spark, sf), gt(spark, sf))).collect()
    assert sorted(registry.queries()["matched_counts"](spark, sf).collect()) == sorted(want)
