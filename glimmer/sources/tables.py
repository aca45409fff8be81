"""Tables on disk: videos, motion, spikes, scores and times, and small text exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition: str | None = "dataset") -> None:
    """Parquet, partitioned by dataset where there is one, so that a dataset's query reads its own files."""
    writer = df.write.mode("overwrite")
    if partition and partition in df.columns:
        writer = writer.partitionBy(partition)
    writer.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """One file with a header; for score and time tables."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``path, name, stem, ext, length`` of the files that match, in order; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(
        "path", name.alias("name"), F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("stem"),
        F.regexp_extract("path", r"(\.[^./]*)$", 1).alias("ext"), "length",
    ).orderBy("path")


def wide_iou(iou: DataFrame, gt_ids: list[int]) -> DataFrame:
    """``Prediction`` rows by ``GT_nn`` columns."""
    wide = iou.groupBy("eval_id").pivot("gt_id", gt_ids).agg(F.first("iou"))
    names = [F.col(str(g)).alias(f"GT_{g:02d}") for g in gt_ids]
    return wide.select(F.format_string("Prediction_%02d", "eval_id").alias("Prediction"), *names)
