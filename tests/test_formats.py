import zipfile

import numpy as np

from glimmer.sources import contours, tables, tiff


def test_tiff_round_trip(spark, tmp_path):
    rnd = np.random.default_rng(1)
    for kind in ("u1", "u2", "f4"):
        pages = rnd.integers(0, 200, (3, 4, 5)).astype(kind)
        assert np.array_equal(np.stack(list(tiff.decode(tiff.encode(pages)))), pages)
    (tmp_path / "a.tif").write_bytes(tiff.encode(pages))
    (tmp_path / "b.TIFF").write_bytes(tiff.encode(pages[:1]))
    (tmp_path / "c.txt").write_bytes(b"no")
    rows = tiff.read(spark, str(tmp_path)).collect()
    assert len(rows) == 80 and all(r.v == pages[r.frame, r.y, r.x] for r in rows if r.dataset == "a")
    assert {r.frame for r in tiff.read(spark, str(tmp_path / "a.tif"), skip=1).collect()} == {0, 1}
    packed = tiff.pack(tiff.read(spark, str(tmp_path / "a.tif")), 4, 5).first()
    assert np.array_equal(np.stack(list(tiff.decode(bytes(packed.content)))), pages)
    assert list(tiff.decode(tiff.encode(pages[:0]))) == []


def test_masks_as_pages(spark, tmp_path):
    rows = [("d", 0, 1, 1), ("d", 0, 1, 2), ("d", 2, 0, 0)]
    masks = spark.createDataFrame(rows, "dataset string, roi long, y long, x long")
    none = tiff.masks_to_pages(masks.limit(0), masks.select("dataset").distinct())
    assert [p.tolist() for p in tiff.decode(tiff.pack(none, 3, 4, "u1").first().content)] == [[[0] * 4] * 3]
    content = tiff.pack(tiff.masks_to_pages(masks), 3, 4, "u1").first().content
    (tmp_path / "d.tif").write_bytes(bytes(content))
    back = contours.read_regions(spark, str(tmp_path / "d.tif"), 3, 4)
    assert sorted(map(tuple, back.collect())) == rows


def test_contours(spark, tmp_path):
    square, far = contours.encode([1, 4, 4, 1], [2, 2, 5, 5]), contours.encode([-2, 1, 1, -2], [0, 0, 1, 1])
    assert contours.decode(square) == ([1.0, 4.0, 4.0, 1.0], [2.0, 2.0, 5.0, 5.0])
    with zipfile.ZipFile(tmp_path / "set.zip", "w") as z:
        z.writestr("1.roi", square)
        z.writestr("2.roi", far)
    (tmp_path / "one.roi").write_bytes(square)
    got = {tuple(r) for r in contours.read_regions(spark, str(tmp_path / "set.zip"), 8, 8).collect()}
    assert got == {("set", 0, y, x) for y in (2, 3, 4) for x in (1, 2, 3)} | {("set", 1, 0, 0)}
    assert contours.read_regions(spark, str(tmp_path / "one.roi"), 8, 8).count() == 9
    assert contours.read_regions(spark, str(tmp_path / "missing.roi"), 8, 8).count() == 0
    (tmp_path / "x.abc").write_bytes(b"?")
    assert contours.read_regions(spark, str(tmp_path / "x.abc"), 8, 8).count() == 0


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 0.25)], "dataset string, n long, v double")
    tables.write_table(df, str(tmp_path / "t"))
    assert sorted(map(tuple, tables.read_table(spark, str(tmp_path / "t")).select("dataset", "n", "v").collect())) == [("a", 1, 0.5), ("b", 2, 0.25)]
    for sep in (",", " "):
        tables.write_csv(df, str(tmp_path / "c"), sep)
        assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "c"), "dataset string, n long, v double", sep).collect())) == [("a", 1, 0.5), ("b", 2, 0.25)]
    assert [r.ext for r in tables.list_files(spark, str(tmp_path / "c"), "*.csv").collect()] == [".csv"]
    iou = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.0), (1, 1, 1.0)], "eval_id long, gt_id long, iou double")
    assert [tuple(r) for r in tables.wide_iou(iou, [0, 1]).orderBy("Prediction").collect()] == [("Prediction_00", 0.5, 0.0), ("Prediction_01", None, 1.0)]
