"""Queries of the streaming operators: the events table as a stream, run to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from glimmer.operators import frames
from glimmer.plans.registry import query
from glimmer.sources.shared import shared_path
from glimmer.sources.views import table, voxels
from glimmer.streaming import segments


def _stream(spark, d, name):
    """A table, be it a file or a folder of files, as a stream of files.

    The path is a pattern, since a stream takes a plain path for a folder.
    """
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def _events(spark, d):
    return _stream(spark, d, "events")


def _text(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


@query("stream_tumbling", """SELECT strftime(time_bucket(INTERVAL '1 day', ts, TIMESTAMP '2024-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total
    FROM events GROUP BY ALL""")
def stream_tumbling(spark, d):
    out = segments.run_to_end(segments.tumbling(_events(spark, d), "1 day", "1 hour"), shared_path(spark, "tumbling"), "complete")
    return out.select(_text("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_sliding", """WITH w AS (SELECT time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '2024-01-01') - k.i * INTERVAL '12 hours' AS s, event_type, value FROM events, range(2) k(i))
    SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL""")
def stream_sliding(spark, d):
    out = segments.run_to_end(segments.sliding(_events(spark, d), "1 day", "12 hours", "1 hour"), shared_path(spark, "sliding"), "complete")
    return out.select(_text("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_session", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '6 hours' THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g),
    z AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL '6 hours' AS b, count(*) AS n FROM s GROUP BY user_id, s)
    SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS start, strftime(b, '%Y-%m-%d %H:%M:%S') AS stop, n FROM z
    WHERE b <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)""")
def stream_session(spark, d):
    out = segments.run_to_end(segments.sessions(_events(spark, d), "6 hours", "1 hour"), shared_path(spark, "sessions"))
    return out.select("user_id", _text("start"), _text("stop"), "n")


@query("stream_running_median", """WITH r AS (SELECT user_id, value, row_number() OVER w AS n, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) AS l
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, n, value, l[len(l) // 2 + 1] AS median, n < 10 OR abs(l[len(l) // 2 + 1] - value) < 0.5 * l[len(l) // 2 + 1] AS valid FROM r""")
def stream_running_median(spark, d):
    out = segments.running_median(_events(spark, d), 20, 0.5)
    return segments.run_to_end(out, shared_path(spark, "median"))


@query("stream_scoring", """SELECT vec_id AS frame, (i-1)//8 AS y, (i-1)%8 AS x, round(CAST(floor((CAST(embedding[i] AS DOUBLE)+1)*1000) AS BIGINT) / avg(CAST(floor((CAST(embedding[i] AS DOUBLE)+1)*1000) AS BIGINT)) OVER (PARTITION BY vec_id), 6) AS v
    FROM embeddings, unnest(range(1,65)) AS u(i)""")
def stream_scoring(spark, d):
    path = shared_path(spark, "scoring")

    segments.score_batches(_stream(spark, d, "embeddings"), path, lambda batch: frames.equalize_frames(voxels(batch)))
    out = spark.read.schema("frame long, y long, x long, v double").parquet(f"{path}/table")
    return out.select("frame", "y", "x", F.round("v", 6).alias("v"))

