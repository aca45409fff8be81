"""Multipage TIFF stacks, uncompressed and grey: read through Spark's binary files, written back from voxels.

Canonical storage of videos is Parquet; this is for import and export.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# TIFF tags and sample formats (TIFF 6.0).
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _PHOTOMETRIC, _OFFSETS, _SAMPLES, _ROWS, _COUNTS, _FORMAT = (
    256, 257, 258, 259, 262, 273, 277, 278, 279, 339,
)
_SIZES = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 16: ("Q", 8)}
_KINDS = {(8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (32, 3): "f4", (64, 3): "f8", (16, 2): "i2", (32, 2): "i4"}


def decode(data: bytes) -> Iterator[np.ndarray]:
    """The pages of a TIFF file, one by one."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a classic TIFF file")
    (at,) = struct.unpack(order + "I", data[4:8])
    while at:
        (n,) = struct.unpack(order + "H", data[at : at + 2])
        tags: dict[int, tuple[int, ...]] = {}
        for i in range(n):
            tag, kind, count, _ = struct.unpack(order + "HHII", data[at + 2 + 12 * i : at + 14 + 12 * i])
            if kind not in _SIZES:
                continue
            code, size = _SIZES[kind]
            place = at + 10 + 12 * i
            if size * count > 4:
                (place,) = struct.unpack(order + "I", data[place : place + 4])
            if code != "c":
                tags[tag] = struct.unpack(f"{order}{count}{code}", data[place : place + size * count])
        if tags.get(_COMPRESSION, (1,))[0] != 1 or tags.get(_SAMPLES, (1,))[0] != 1:
            raise ValueError("only uncompressed grey pages are read")
        kind = order + _KINDS[tags[_BITS][0], tags.get(_FORMAT, (1,))[0]]
        h, w = tags[_HEIGHT][0], tags[_WIDTH][0]
        strips = [data[o : o + c] for o, c in zip(tags[_OFFSETS], tags[_COUNTS], strict=True)]
        yield np.frombuffer(b"".join(strips), kind).reshape(h, w)
        (at,) = struct.unpack(order + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])


def encode(pages: np.ndarray) -> bytes:
    """A little-endian TIFF file of (pages, rows, columns)."""
    kind = pages.dtype.str[1:]
    bits, form = next(k for k, v in _KINDS.items() if v == kind)
    out = [struct.pack("<2sHI", b"II", 42, 8 if len(pages) else 0)]
    at = 8
    for i, page in enumerate(pages):
        h, w = page.shape
        body = page.astype("<" + kind).tobytes()
        entries = [(_WIDTH, w), (_HEIGHT, h), (_BITS, bits), (_COMPRESSION, 1), (_PHOTOMETRIC, 1), (_OFFSETS, at + 2 + 12 * 10 + 4),
                   (_SAMPLES, 1), (_ROWS, h), (_COUNTS, len(body)), (_FORMAT, form)]
        head = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in entries)
        pad = b"\0" * (len(body) % 2)
        after = at + len(head) + 4 + len(body) + len(pad)
        out += [head, struct.pack("<I", after if i + 1 < len(pages) else 0), body, pad]
        at = after
    return b"".join(out)


def read(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """``dataset, frame, y, x, v`` of all TIFF files of a path; ``dataset`` is the file's name without ending.

    Files are read side by side; pages are turned into rows one by one.
    """
    files = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(r"\.tiff?$"))
    named = files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("dataset"), "content")

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, data in zip(f["dataset"], f["content"], strict=True):
                for i, page in enumerate(decode(data)):
                    if i >= skip:
                        ys, xs = np.mgrid[0 : page.shape[0], 0 : page.shape[1]]
                        yield pd.DataFrame({"dataset": name, "frame": i - skip, "y": ys.ravel(), "x": xs.ravel(), "v": page.ravel().astype(float)})

    return named.mapInPandas(over, "dataset string, frame long, y long, x long, v double")


def pack(video: DataFrame, height: int, width: int, kind: str = "f4") -> DataFrame:
    """``dataset, content``: a TIFF file for each dataset; a dataset's stack must fit in one task's memory."""

    def over(f: pd.DataFrame) -> pd.DataFrame:
        pages = np.zeros((int(f["frame"].max()) + 1, height, width), kind)
        pages[f["frame"], f["y"], f["x"]] = f["v"]
        return pd.DataFrame({"dataset": [f["dataset"].iloc[0]], "content": [encode(pages)]})

    return video.groupBy("dataset").applyInPandas(over, "dataset string, content binary")


def masks_to_pages(rois: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    """Member pixels as 8-bit pages, for :func:`pack`: 255 inside.

    Each of ``datasets`` (``dataset``) without a region has one black page.
    """
    pages = rois.select("dataset", F.col("roi").cast("long").alias("frame"), "y", "x", F.lit(255.0).alias("v"))
    if datasets is None:
        return pages
    empty = datasets.select("dataset").distinct().join(rois, "dataset", "left_anti")
    corner = F.lit(0).cast("long")
    return pages.unionByName(empty.select("dataset", corner.alias("frame"), corner.alias("y"), corner.alias("x"), F.lit(0.0).alias("v")))


def pages_to_masks(video: DataFrame) -> DataFrame:
    """Pages back to member pixels; black pages are no regions."""
    return video.where("v > 0").select("dataset", F.col("frame").alias("roi"), "y", "x")
