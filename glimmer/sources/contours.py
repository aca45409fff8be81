"""Region files: polygon contours (.roi, .zip of them) and mask stacks (.tif), by their ending."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.operators.rois import rasterize

from . import tiff

# The header of an ImageJ contour file.
_MAGIC, _POINTS_AT, _SUBPIXEL, _KINDS = b"Iout", 64, 128, {0: "polygon", 7: "freehand", 8: "traced"}


def decode(data: bytes) -> tuple[list[float], list[float]]:
    """``xs, ys`` of a contour file; a rectangle is its four corners."""
    if data[:4] != _MAGIC:
        raise ValueError("not a contour file")
    kind = data[6]
    top, left, bottom, right, n = struct.unpack(">hhhhH", data[8:18])
    (options,) = struct.unpack(">h", data[50:52])
    if kind == 1:
        return [float(v) for v in (left, right, right, left)], [float(v) for v in (top, top, bottom, bottom)]
    if kind not in _KINDS:
        raise ValueError(f"contours of kind {kind} aren't read")
    if options & _SUBPIXEL and len(data) >= _POINTS_AT + 12 * n:
        values = struct.unpack(f">{2 * n}f", data[_POINTS_AT + 4 * n : _POINTS_AT + 12 * n])
        return list(values[:n]), list(values[n:])
    values = struct.unpack(f">{2 * n}h", data[_POINTS_AT : _POINTS_AT + 4 * n])
    return [float(v + left) for v in values[:n]], [float(v + top) for v in values[n:]]


def encode(xs: list[int], ys: list[int]) -> bytes:
    """A polygon contour file of whole-pixel points."""
    left, top, n = min(xs), min(ys), len(xs)
    head = bytearray(_POINTS_AT)
    head[:4] = _MAGIC
    struct.pack_into(">hB", head, 4, 227, 0)
    struct.pack_into(">hhhhH", head, 8, top, left, max(ys), max(xs), n)
    return bytes(head) + struct.pack(f">{2 * n}h", *[x - left for x in xs], *[y - top for y in ys])


def _members(path: str, data: bytes) -> Iterator[bytes]:
    if path.lower().endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for name in sorted(z.namelist()):
                if name.lower().endswith(".roi"):
                    yield z.read(name)
    else:
        yield data


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """``dataset, roi, xs, ys`` of all .roi and .zip files of a path."""
    files = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(r"\.(roi|zip)$"))

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, data in zip(f["path"], f["content"], strict=True):
                for i, member in enumerate(_members(p, data)):
                    xs, ys = decode(member)
                    rows.append((p.rpartition("/")[2].rpartition(".")[0], i, xs, ys))
            yield pd.DataFrame(rows, columns=["dataset", "roi", "xs", "ys"])

    out = files.select("path", "content").mapInPandas(over, "dataset string, roi long, xs array<double>, ys array<double>")
    return out


def read_regions(spark: SparkSession, path: str, height: int, width: int) -> DataFrame:
    """``dataset, roi, y, x`` of a path's region files; no rows if there are none or their ending isn't known."""
    empty = spark.createDataFrame([], "dataset string, roi long, y long, x long")
    name = path.lower()
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return empty
    if name.endswith((".roi", ".zip")):
        polygons = read_polygons(spark, path)
        keyed = polygons.withColumn("roi", F.struct("dataset", "roi"))
        return rasterize(keyed, height, width).select("roi.dataset", F.col("roi.roi").alias("roi"), "y", "x")
    if name.endswith((".tif", ".tiff")):
        return tiff.pages_to_masks(tiff.read(spark, path))
    return empty
