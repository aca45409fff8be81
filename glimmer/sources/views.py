"""Imaging tables as views of the test tables; see FIXTURES.md for their definition.

``video``   frame, y, x, adu: one row for each voxel
``gt``, ``ev``   roi, y, x: member pixels of the reference and the evaluated ROIs
``trace``   roi, t, v: one value for each ROI and time
``runs``    dataset, stage, sec, frames, bytes
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Height and width of the video view.
SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frame, h, w, px``: a frame in one row, row-major, for array kernels."""
    adu = F.transform("embedding", lambda v: F.floor((v.cast("double") + 1) * 1000).cast("double"))
    side = F.lit(SIDE)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), side.alias("h"), side.alias("w"), adu.alias("px"))


def voxels(embeddings: DataFrame) -> DataFrame:
    """A row for each voxel of vectors taken as frames."""
    each = embeddings.select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("p", "v"))
    return each.select(
        "frame",
        F.expr(f"cast(p div {SIDE} as bigint)").alias("y"),
        F.expr(f"cast(p % {SIDE} as bigint)").alias("x"),
        F.floor((F.col("v").cast("double") + 1) * 1000).alias("adu"),
    )


def video(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels(table(spark, sf_dir, "embeddings"))


def _squares(rows: DataFrame, key: str, y0: str, x0: str) -> DataFrame:
    corner = rows.select(F.col(key).cast("long").alias("roi"), F.expr(y0).alias("y0"), F.expr(x0).alias("x0"))
    each = corner.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(8))))
    return each.select("roi", F.expr("cast(y0 + i div 3 as bigint)").alias("y"), F.expr("cast(x0 + i % 3 as bigint)").alias("x"))


def gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _squares(table(spark, sf_dir, "nation"), "n_nationkey", "n_nationkey % 6", "(n_nationkey div 6) % 6")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _squares(table(spark, sf_dir, "supplier"), "s_suppkey", "(s_suppkey * 7 + 1) % 6", "(s_suppkey div 4) % 6")


#: Height and width of the frame of ``wide_gt`` and ``wide_ev``, which regions cover in part only.
WIDE = 64


def wide_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _squares(table(spark, sf_dir, "nation"), "n_nationkey", "(n_nationkey * 37) % 62", "(n_nationkey * 11) % 61")


def wide_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _squares(table(spark, sf_dir, "supplier"), "s_suppkey", "(s_suppkey * 38 + 1) % 62", "(s_suppkey * 11) % 61")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_time = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("roi"),
        (F.row_number().over(in_time) - 1).cast("long").alias("t"),
        F.round(F.col("value") * 100).cast("long").alias("v"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("dataset"), F.col("l_linenumber").alias("stage"))
        .agg(F.sum("l_quantity").alias("sec"), F.count("*").alias("frames"), F.sum(cents).alias("bytes"))
    )


#: The same views in SQL, for the oracles.
SQL = {
    "video": """SELECT vec_id AS frame, (i-1)//8 AS y, (i-1)%8 AS x,
        CAST(floor((CAST(embedding[i] AS DOUBLE)+1)*1000) AS BIGINT) AS adu
        FROM embeddings, unnest(range(1,65)) AS u(i)""",
    "gt": """SELECT CAST(n_nationkey AS BIGINT) AS roi, CAST(n_nationkey%6 + i//3 AS BIGINT) AS y,
        CAST((n_nationkey//6)%6 + i%3 AS BIGINT) AS x FROM nation, range(9) t(i)""",
    "ev": """SELECT s_suppkey AS roi, CAST((s_suppkey*7+1)%6 + i//3 AS BIGINT) AS y,
        CAST((s_suppkey//4)%6 + i%3 AS BIGINT) AS x FROM supplier, range(9) t(i)""",
    "wide_gt": """SELECT CAST(n_nationkey AS BIGINT) AS roi, CAST((n_nationkey*37)%62 + i//3 AS BIGINT) AS y,
        CAST((n_nationkey*11)%61 + i%3 AS BIGINT) AS x FROM nation, range(9) t(i)""",
    "wide_ev": """SELECT s_suppkey AS roi, CAST((s_suppkey*38+1)%62 + i//3 AS BIGINT) AS y,
        CAST((s_suppkey*11)%61 + i%3 AS BIGINT) AS x FROM supplier, range(9) t(i)""",
    "trace": """SELECT user_id AS roi, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS t,
        CAST(round(value*100) AS BIGINT) AS v FROM events""",
    "runs": """SELECT l_suppkey AS dataset, l_linenumber AS stage, CAST(sum(l_quantity) AS DOUBLE) AS sec, count(*) AS frames,
        CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS BIGINT) AS bytes FROM lineitem GROUP BY ALL""",
    "iou": """SELECT e.roi AS eval_id, g.roi AS gt_id,
        coalesce(i.n, 0) / CAST(nullif(e.n + g.n - coalesce(i.n, 0), 0) AS DOUBLE) AS iou
        FROM (SELECT roi, count(*) AS n FROM ev GROUP BY roi) e CROSS JOIN (SELECT roi, count(*) AS n FROM gt GROUP BY roi) g
        LEFT JOIN (SELECT ev.roi AS a, gt.roi AS b, count(*) AS n FROM ev JOIN gt USING (y, x) GROUP BY ALL) i
        ON i.a = e.roi AND i.b = g.roi""",
    "counts": """SELECT t.i / 100.0::DOUBLE AS threshold, count(DISTINCT CASE WHEN iou >= t.i / 100.0::DOUBLE THEN eval_id END) AS tp,
        count(DISTINCT eval_id) - count(DISTINCT CASE WHEN iou >= t.i / 100.0::DOUBLE THEN eval_id END) AS fp,
        count(DISTINCT gt_id) - count(DISTINCT CASE WHEN iou >= t.i / 100.0::DOUBLE THEN gt_id END) AS fn
        FROM iou, range(1, 101) t(i) GROUP BY t.i""",
}
_NEEDS = {"iou": ("ev", "gt"), "counts": ("ev", "gt", "iou")}


def sql(query: str, *views: str) -> str:
    """A query over views, as one statement."""
    wanted: list[str] = []
    for v in views:
        wanted += [n for n in (*_NEEDS.get(v, ()), v) if n not in wanted]
    return "WITH " + ", ".join(f"{v} AS ({SQL[v]})" for v in wanted) + ("," if query.lstrip().startswith("+") else "") + query.lstrip().lstrip("+")
