"""Queries of the evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from glimmer.operators import matching
from glimmer.plans.registry import query
from glimmer.sources.views import ev, gt, runs, sql, table


def _iou(spark, d):
    return matching.iou_matrix(ev(spark, d), gt(spark, d))


def _by_region(spark, d):
    """Counts by region of the nation that a reference region comes from."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("roi"), F.col("n_regionkey").alias("dataset"))
    reference = gt(spark, d).join(nation, "roi")
    evaluated = ev(spark, d).join(F.broadcast(nation.select("dataset").distinct()))  # the same masks for five datasets
    iou = matching.iou_matrix(evaluated, reference, ("dataset",))
    return matching.threshold_counts(iou, keys=("dataset",))


@query("iou_matrix", sql("SELECT * FROM iou", "iou"))
def iou_matrix(spark, d):
    return _iou(spark, d)


@query("threshold_counts", sql("SELECT * FROM counts", "counts"))
def threshold_counts(spark, d):
    return matching.threshold_counts(_iou(spark, d))


_SCORED = """SELECT threshold, tp, fp, fn, coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS precision,
    coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0) AS recall FROM counts"""
_F1 = "CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END"


@query("precision_recall_f1", sql(f"SELECT threshold, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round({_F1}, 9) AS f1 FROM ({_SCORED})", "counts"))
def precision_recall_f1(spark, d):
    out = matching.scores(matching.threshold_counts(_iou(spark, d)))
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("representative_f1", sql(f"SELECT threshold, round({_F1}, 9) AS f1 FROM ({_SCORED}) WHERE threshold >= 0.3 ORDER BY threshold LIMIT 1", "counts"))
def representative_f1(spark, d):
    out = matching.at_threshold(matching.scores(matching.threshold_counts(_iou(spark, d))), 0.3)
    return out.select("threshold", F.round("f1", 9).alias("f1"))


@query("matched_counts")
def matched_counts(spark, d):
    return matching.matched_counts(matching.iou_matrix(ev(spark, d), gt(spark, d)))


_REGIONAL = """+ i AS (SELECT n_regionkey AS dataset, iou.* FROM iou JOIN nation ON n_nationkey = gt_id),
    c AS (SELECT dataset, t.i / 100.0::DOUBLE AS threshold, count(DISTINCT CASE WHEN iou >= t.i / 100.0::DOUBLE THEN eval_id END) AS tp,
      count(DISTINCT eval_id) - count(DISTINCT CASE WHEN iou >= t.i / 100.0::DOUBLE THEN eval_id END) AS fp,
      count(DISTINCT gt_id) - count(DISTINCT CASE WHEN iou >= t.i / 100.0::DOUBLE THEN gt_id END) AS fn
      FROM i, range(1, 101) t(i) GROUP BY dataset, t.i),
    p AS (SELECT *, coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS precision, coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0) AS recall FROM c),
    f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM p)"""


@query("aggregate_scores", sql(f"{_REGIONAL} SELECT threshold, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1 FROM f GROUP BY threshold", "iou"))
def aggregate_scores(spark, d):
    out = matching.aggregate_scores(matching.scores(_by_region(spark, d)))
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("weighted_scores", sql(f"""{_REGIONAL}, s AS (SELECT threshold, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM f GROUP BY threshold),
    q AS (SELECT *, coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS precision, coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0) AS recall FROM s)
    SELECT threshold, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round({_F1}, 9) AS f1 FROM q""", "iou"))
def weighted_scores(spark, d):
    out = matching.aggregate_scores(matching.scores(_by_region(spark, d)), weighted=True)
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("iou_histogram", sql("SELECT least(39, CAST(floor(iou * 40) AS BIGINT)) AS bin, count(*) AS n FROM iou GROUP BY ALL", "iou"))
def iou_histogram(spark, d):
    return matching.histogram(_iou(spark, d), "iou", 40)


@query("score_stats", sql("SELECT eval_id, round(avg(iou), 9) AS mean, round(stddev_samp(iou), 9) AS sd FROM iou GROUP BY eval_id", "iou"))
def score_stats(spark, d):
    return _iou(spark, d).groupBy("eval_id").agg(F.round(F.avg("iou"), 9).alias("mean"), F.round(F.stddev_samp("iou"), 9).alias("sd"))


def annotators(spark, d):
    """Three annotators' regions: both sets, and the reference one column further right."""
    a = ev(spark, d).withColumn("annotator", F.lit(0))
    b = gt(spark, d).withColumn("annotator", F.lit(1))
    c = b.withColumns({"x": F.col("x") + 1, "annotator": F.lit(2)})
    return a.unionByName(b).unionByName(c).select("annotator", "roi", "y", "x")


_SETS = """+ sets AS (SELECT 0 AS annotator, roi, y, x FROM ev UNION ALL SELECT 1, roi, y, x FROM gt UNION ALL SELECT 2, roi, y, x + 1 FROM gt),
    n AS (SELECT annotator, roi, count(*) AS n FROM sets GROUP BY ALL),
    i AS (SELECT a.annotator AS ref, a.roi AS ref_roi, b.annotator AS tgt, b.roi AS tgt_roi, count(*) AS i FROM sets a JOIN sets b USING (y, x) WHERE a.annotator <> b.annotator GROUP BY ALL),
    u AS (SELECT ref, ref_roi, tgt, tgt_roi, i / CAST(p.n + q.n - i AS DOUBLE) AS iou FROM i JOIN n p ON p.annotator = ref AND p.roi = ref_roi JOIN n q ON q.annotator = tgt AND q.roi = tgt_roi),
    b AS (SELECT *, row_number() OVER (PARTITION BY ref, ref_roi, tgt ORDER BY iou DESC, tgt_roi) AS r FROM u),
    m AS (SELECT x.ref, x.ref_roi, x.tgt, x.tgt_roi, x.iou FROM b x JOIN b y ON x.r = 1 AND y.r = 1 AND x.ref = y.tgt AND x.ref_roi = y.tgt_roi AND x.tgt = y.ref AND x.tgt_roi = y.ref_roi)"""


@query("mutual_best_match", sql(f"{_SETS} SELECT * FROM m", "ev", "gt"))
def mutual_best_match(spark, d):
    return matching.mutual_best(annotators(spark, d))


@query("majority_vote", sql(f"""{_SETS}, e AS (SELECT ref AS a, ref_roi AS r, tgt AS annotator, tgt_roi AS roi FROM m UNION ALL SELECT annotator, roi, annotator, roi FROM n),
    l AS (SELECT a, r, string_agg(annotator || ':' || roi, ',' ORDER BY annotator, roi) AS consensus, count(*) AS k FROM e GROUP BY a, r),
    z AS (SELECT DISTINCT consensus, k, annotator, roi FROM l JOIN e USING (a, r) WHERE k * 2 > 3)
    SELECT consensus, y, x FROM z JOIN sets USING (annotator, roi) GROUP BY consensus, k, y, x HAVING count(*) * 2 > k""", "ev", "gt"))
def majority_vote(spark, d):
    return matching.majority_vote(annotators(spark, d))


_STAGES = ", ".join(f"sum(CASE WHEN stage = {s} THEN sec END) AS stage_{s}" for s in range(1, 8))


@query("timing_rollup", sql(f"""SELECT dataset, {_STAGES}, sum(sec) AS total, CAST(sum(frames) AS BIGINT) AS frames, round(sum(sec) * 1000 / sum(frames), 9) AS ms_per_frame,
    round(CAST(sum(frames) AS DOUBLE) / nullif(sum(sec), 0), 9) AS fps, round(sum(bytes) / 1073741824.0::DOUBLE, 9) AS gib,
    round(sum(sec) / (sum(bytes) / 1073741824.0::DOUBLE), 6) AS sec_per_gib FROM runs GROUP BY dataset""", "runs"))
def timing_rollup(spark, d):
    out = matching.stage_times(runs(spark, d), list(range(1, 8)))
    return out.withColumns({c: F.round(c, 9) for c in ("ms_per_frame", "fps", "gib")}).withColumn("sec_per_gib", F.round("sec_per_gib", 6))


@query("repeat_stats", """SELECT l_suppkey AS dataset, count(*) AS n, round(avg(l_quantity), 9) AS mean, round(stddev_samp(l_quantity), 9) AS sd FROM lineitem GROUP BY ALL
    UNION ALL SELECT -1, count(*), round(avg(l_quantity), 9), round(stddev_samp(l_quantity), 9) FROM lineitem""")
def repeat_stats(spark, d):
    runs_ = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("dataset"), F.col("l_quantity").alias("sec"))
    out = matching.repeat_stats(runs_)
    return out.select(F.coalesce("dataset", F.lit(-1).cast("long")).alias("dataset"), "n", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"))


@query("reuse_times", sql("SELECT a.dataset, a.stage, coalesce(CASE WHEN a.stage % 2 = 0 THEN a.sec END, b.sec + 1) AS sec FROM runs a LEFT JOIN runs b ON a.dataset = b.dataset AND a.stage = b.stage AND b.stage < 6", "runs"))
def reuse_times(spark, d):
    r = runs(spark, d)
    now = r.withColumn("sec", F.when(F.col("stage") % 2 == 0, F.col("sec")))
    return matching.reuse_times(now, r.where("stage < 6").withColumn("sec", F.col("sec") + 1))
