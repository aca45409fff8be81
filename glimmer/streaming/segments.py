"""Streaming forms of the segment operators, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """Timestamps without zone are cast: a watermark needs a timestamp."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def tumbling(events: DataFrame, width: str, late: str, time: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """``start, key, n, total`` of each window; windows close when the watermark passes them."""
    groups = _timed(events, time, late).groupBy(F.window(time, width), key)
    out = groups.agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), key, "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str, time: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """The same over overlapping windows."""
    groups = _timed(events, time, late).groupBy(F.window(time, width, step), key)
    out = groups.agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, gap: str, late: str, time: str = "ts", key: str = "user_id") -> DataFrame:
    """``key, start, stop, n`` of runs of events no further apart than ``gap``."""
    groups = _timed(events, time, late).groupBy(F.session_window(time, gap), key)
    out = groups.agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def frame_segments(frames: DataFrame, period: int, late: str, time: str = "ts") -> DataFrame:
    """``seg, y, x, low, high, mean`` of each segment of whole frames, for a stream of voxels with a time."""
    seg = F.expr(f"frame div {period}").alias("seg")
    groups = _timed(frames, time, late).groupBy(seg, "y", "x")
    return groups.agg(F.min("adu").alias("low"), F.max("adu").alias("high"), F.avg("adu").alias("mean"))


def running_median(events: DataFrame, length: int, factor: float, key: str = "user_id", value: str = "value", warm_up: int = 10) -> DataFrame:
    """``key, n, value, median, valid``: the running upper median of a key's last ``length`` values, in order of arrival.

    The state of a key is its ring of values, ``length`` at most.  A batch's rows
    are taken in order of their ``event_id``.
    """
    out_schema = f"{key} long, n long, value double, median double, valid boolean"

    def update(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ring = state.get if state.exists else (0, [])
        ring = list(ring)
        rows = pd.concat(list(batches)).sort_values("event_id")
        out = []
        for v in rows[value].tolist():
            ring = [*ring, v][-length:]
            n += 1
            median = sorted(ring)[len(ring) // 2]
            out.append((keys[0], n, v, median, n < warm_up or abs(median - v) < factor * median))
        state.update((n, ring))
        yield pd.DataFrame(out, columns=[key, "n", "value", "median", "valid"])

    return events.groupBy(key).applyInPandasWithState(
        update, out_schema, "n long, ring array<double>", "append", GroupStateTimeout.NoTimeout
    )


def run_to_end(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process all that is there now and return what was written: a table under ``path``, with its checkpoint beside it.

    ``append`` writes files exactly once; ``complete`` replaces the table with
    each batch.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{path}/table")
    else:
        writer = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/table"))
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def score_batches(stream: DataFrame, path: str, score: Callable[[DataFrame], DataFrame]) -> None:
    """Apply a batch operator to each micro-batch and keep the result under the batch's number, so a repeated batch
    replaces itself."""
    query = (
        stream.writeStream.option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(lambda df, n: score(df).write.mode("overwrite").parquet(f"{path}/table/batch={n}"))
        .start()
    )
    query.awaitTermination()
