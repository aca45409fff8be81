"""What the vector searches share: valid vectors, copies, merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valid(table: DataFrame, id_col: str, vector_col: str, zero: bool = True) -> DataFrame:
    """``id, v`` (doubles) of the rows whose vector and components are there and finite; all-zero ones only if ``zero``.

    A row with a null id takes no part either.
    """
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x))
    keep = v.isNotNull() & F.col(id_col).isNotNull() & F.coalesce(finite, F.lit(False))
    if not zero:
        keep = keep & F.exists(v, lambda x: x != 0)
    return table.where(keep).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def padded(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """Shorter vectors with zeros behind, the number of rows and that of components."""
    r = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    dim = r.dim or 0
    zeros = F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v"))
    return rows.withColumn("v", F.concat("v", zeros)), r.n, dim


def first_copies(rows: DataFrame, copies: int) -> DataFrame:
    """Of each distinct vector the ``copies`` rows with the smallest ids; equal rows count once.

    No list of up to ``copies`` neighbours can hold another one: equal vectors
    score alike, and ties go to smaller ids.  Spark trims each task's rows before
    the shuffle, so a vector that a third of the table shares doesn't meet in one
    task.
    """
    window = Window.partitionBy("v").orderBy("id")
    nth = F.row_number().over(window)
    return rows.distinct().withColumn("_nth", nth).where(F.col("_nth") <= copies).drop("_nth")


def askers(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct query vectors ``rep, v`` (the smallest id that asks), and who asks for which: ``query_id, rep``."""
    reps = queries.groupBy("v").agg(F.min("id").alias("rep"))
    return reps.select("rep", "v"), queries.distinct().join(reps, "v").select(F.col("id").alias("query_id"), "rep")


def ranked(found: DataFrame, asked: DataFrame, k: int, score: str, best_first: bool) -> DataFrame:
    """``query_id, rank, vec_id, score`` from ``rep, vec_id, score`` rows that hold each query's k + 1 best.

    A query's own row isn't among its results; ties go to the smaller id.
    """
    by_score = F.desc(score) if best_first else F.asc(score)
    per_rep = Window.partitionBy("rep").orderBy(by_score, "vec_id")
    top = found.withColumn("_nth", F.row_number().over(per_rep)).where(F.col("_nth") <= k + 1)
    joined = asked.join(top, "rep").where("query_id <> vec_id")
    per_query = Window.partitionBy("query_id", "rep").orderBy("_nth")
    out = joined.withColumn("rank", F.row_number().over(per_query)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", score)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A column of equally long lists as the rows of a matrix."""
    return np.asarray(column.flatten()).reshape(-1, dim)
