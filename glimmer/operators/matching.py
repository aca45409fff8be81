"""Comparing region sets: IoU, thresholds, matching, scores, consensus."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimmer.functions.columns import ratio


def iou_matrix(evaluated: DataFrame, reference: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, eval_id, gt_id, iou`` of every pair of two sets of regions; 0 where both are empty.

    ``keys`` (such as ``dataset``) keep recordings apart.  Intersections come from
    an equi-join on pixels.  The matrix has a row for each pair of regions of one
    recording by definition, like the table of scores that it feeds; areas are
    small tables beside the pixels.
    """
    k = list(keys)
    a = evaluated.groupBy(*k, F.col("roi").alias("eval_id")).agg(F.count("*").alias("_a"))
    b = reference.groupBy(*k, F.col("roi").alias("gt_id")).agg(F.count("*").alias("_b"))
    left = evaluated.select(*k, F.col("roi").alias("eval_id"), "y", "x")
    both = left.join(reference.select(*k, F.col("roi").alias("gt_id"), "y", "x"), [*k, "y", "x"])
    both = both.groupBy(*k, "eval_id", "gt_id").agg(F.count("*").alias("_i"))
    pairs = (a.join(b, k) if k else a.crossJoin(b)).join(both, [*k, "eval_id", "gt_id"], "left")
    shared = F.coalesce("_i", F.lit(0))
    iou = F.coalesce(F.try_divide(shared.cast("double"), (F.col("_a") + F.col("_b") - shared).cast("double")), F.lit(0.0))
    return pairs.select(*k, "eval_id", "gt_id", iou.alias("iou"))


def thresholds(spark, n: int = 100) -> DataFrame:
    """``threshold``: 1/n, 2/n, ... 1."""
    return spark.range(1, n + 1).select((F.col("id") / float(n)).alias("threshold"))


def threshold_counts(iou: DataFrame, n: int = 100, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, threshold, tp, fp, fn``: regions with a partner of at least that IoU, without one-to-one matching.

    A region's best IoU tells all its thresholds, so only best values meet the
    thresholds.
    """
    levels, k = thresholds(iou.sparkSession, n), list(keys)

    def hits(region: str, name: str) -> DataFrame:
        best = iou.groupBy(*k, region).agg(F.max("iou").alias("best"))
        met = best.crossJoin(F.broadcast(levels))  # n rows for each region
        hit = F.sum((F.col("best") >= F.col("threshold")).cast("long"))
        return met.groupBy(*k, "threshold").agg(hit.alias(name), (F.count("*") - hit).alias(f"no_{name}"))

    joined = hits("eval_id", "tp").join(hits("gt_id", "found"), [*k, "threshold"])
    return joined.select(*k, "threshold", "tp", F.col("no_tp").alias("fp"), F.col("no_found").alias("fn"))


def _largest_matching(pairs: list[tuple[int, int]]) -> int:
    """The size of a largest matching, by augmenting paths."""
    near: dict[int, list[int]] = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
    taken: dict[int, int] = {}

    def place(a: int, seen: set[int]) -> bool:
        for b in near[a]:
            if b not in seen:
                seen.add(b)
                if b not in taken or place(taken[b], seen):
                    taken[b] = a
                    return True
        return False

    return sum(place(a, set()) for a in near)


def matched_counts(iou: DataFrame, n: int = 100) -> DataFrame:
    """``threshold, tp, fp, fn`` with each region matched once: true positives are a largest matching.

    One small group for each threshold: the pairs of regions that reach it.
    """
    levels = thresholds(iou.sparkSession, n)
    sizes = iou.agg(F.countDistinct("eval_id").alias("_e"), F.countDistinct("gt_id").alias("_g"))
    met = iou.where("iou > 0").join(levels, F.col("iou") >= F.col("threshold"))

    def size(frame: pd.DataFrame) -> pd.DataFrame:
        pairs = sorted(zip(frame["eval_id"].tolist(), frame["gt_id"].tolist(), strict=True))
        return pd.DataFrame({"threshold": [frame["threshold"].iloc[0]], "tp": [_largest_matching(pairs)]})

    found = met.groupBy("threshold").applyInPandas(size, "threshold double, tp long")
    rows = levels.join(found, "threshold", "left").crossJoin(F.broadcast(sizes))
    tp = F.coalesce("tp", F.lit(0).cast("long"))
    return rows.select("threshold", tp.alias("tp"), (F.col("_e") - tp).alias("fp"), (F.col("_g") - tp).alias("fn"))


def scores(counts: DataFrame) -> DataFrame:
    """Counts with precision, recall and F1, each 0 where it has no denominator."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = ratio(2 * precision * recall, precision + recall)
    return counts.select("*", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def at_threshold(scored: DataFrame, least: float) -> DataFrame:
    """The row of the first threshold that is ``least`` or more."""
    first = scored.where(F.col("threshold") >= least - 1e-12).agg(F.min("threshold").alias("threshold"))
    return scored.join(F.broadcast(first), "threshold", "left_semi")


def aggregate_scores(scored: DataFrame, weighted: bool = False) -> DataFrame:
    """Scores of many datasets by threshold: the mean of each dataset's, or those of the summed counts."""
    groups = scored.groupBy("threshold")
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    if weighted:
        return scores(groups.agg(*sums))
    return groups.agg(*sums, *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def histogram(values: DataFrame, column: str, bins: int) -> DataFrame:
    """``bin, n`` of values in 0 to 1; the last bin holds 1 too.  Bins without values have no row."""
    place = F.least(F.floor(F.col(column) * bins), F.lit(bins - 1).cast("long"))
    return values.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def _by_region(sets: DataFrame) -> DataFrame:
    """Numbered regions' pixels, dealt by region: one shuffle that serves whatever takes a region's pixels together."""
    return sets.where("annotator IS NOT NULL AND roi IS NOT NULL").repartition("annotator", "roi")


def _smallest(sets: DataFrame) -> DataFrame:
    """``annotator, roi, area, y, x`` of each annotator's distinct sets of pixels, as the smallest region over each."""
    each = _by_region(sets).groupBy("annotator", "roi").agg(F.sort_array(F.collect_list(F.struct("y", "x"))).alias("p"))
    first = each.groupBy("annotator", "p").agg(F.min("roi").alias("roi"))
    return first.select("annotator", "roi", F.size("p").alias("area"), F.inline("p"))


def iou_between(sets: DataFrame) -> DataFrame:
    """``ref, ref_roi, tgt, tgt_roi, iou`` of the overlapping regions of different annotators of ``annotator, roi, area, y, x``.

    Each pair stands once, the smaller annotator first.  The pixels grow with
    their tables, whatever Spark takes their size for: neither side is broadcast.
    """
    side = lambda s: [F.col("annotator").alias(s), F.col("roi").alias(f"{s}_roi"), F.col("area").alias(f"{s}_area")]
    a, b = sets.select(*side("ref"), "y", "x"), sets.select(*side("tgt"), "y", "x")
    both = a.join(b.hint("merge"), ["y", "x"]).where("ref < tgt")
    both = both.groupBy("ref", "ref_roi", "ref_area", "tgt", "tgt_roi", "tgt_area").agg(F.count("*").alias("i"))
    iou = F.col("i") / (F.col("ref_area") + F.col("tgt_area") - F.col("i"))
    return both.select("ref", "ref_roi", "tgt", "tgt_roi", iou.alias("iou"))


def mutual_best(sets: DataFrame) -> DataFrame:
    """Pairs of regions of two annotators that are each other's best; ties go to the smaller region number.

    Of an annotator's regions over the same pixels only the smallest can be
    anyone's best, so only these are held against each other.  An IoU is the same
    from both sides, so a pair is placed among both regions' and turned at the end.
    """
    pairs = iou_between(_smallest(sets))

    def place(of: str, among: str) -> Column:
        return F.row_number().over(Window.partitionBy(of, f"{of}_roi", among).orderBy(F.desc("iou"), f"{among}_roi"))

    best = pairs.withColumns({"_a": place("ref", "tgt"), "_b": place("tgt", "ref")}).where("_a = 1 AND _b = 1")
    turned = F.struct(F.col("tgt").alias("ref"), F.col("tgt_roi").alias("ref_roi"), F.col("ref").alias("tgt"), F.col("ref_roi").alias("tgt_roi"), "iou")
    return best.select(F.inline(F.array(F.struct("ref", "ref_roi", "tgt", "tgt_roi", "iou"), turned)))


def _counted(sets: DataFrame) -> DataFrame:
    """``_n``: the number of annotators, as one row."""
    return F.broadcast(sets.select("annotator").distinct().agg(F.count("*").alias("_n")))


def _matched(sets: DataFrame) -> DataFrame:
    """``members``: each region with its mutual best matches, in annotator order, where that is more than half of the annotators."""
    member = F.struct(F.col("tgt").alias("annotator"), F.col("tgt_roi").alias("roi"))
    matches = mutual_best(sets).groupBy(F.col("ref").alias("annotator"), F.col("ref_roi").alias("roi")).agg(F.collect_set(member).alias("p"))
    members = F.array_sort(F.concat(F.array(F.struct("annotator", "roi")), "p"))
    return matches.select(members.alias("members")).join(_counted(sets), F.size("members") * 2 > F.col("_n")).select("members")


def majority_sets(sets: DataFrame) -> DataFrame:
    """``members``: distinct sets of regions, one of each annotator at most, that more than half of the annotators share.

    A set is a region with its mutual best matches, as an array in annotator order.
    A region without any is more than half of the annotators only where there is
    one annotator, so all regions are gone through in that case alone.
    """
    alone = sets.select("annotator", "roi").join(_counted(sets), F.col("_n") == 1)
    return _matched(sets).unionByName(alone.select(F.array(F.struct("annotator", "roi")).alias("members"))).distinct()


def _name(annotator: Column, roi: Column) -> Column:
    return F.concat_ws(":", annotator.cast("string"), roi.cast("string"))


def majority_vote(sets: DataFrame) -> DataFrame:
    """``consensus, y, x``: of each majority set the pixels that more than half of its members cover.

    Consensus regions are numbered by their member lists.  A set is found from
    several of its members; its copies meet where its members meet their pixels.
    Members are the smallest regions over their pixels, so only those vote; the
    regions of a single annotator are each a set of their own.
    """
    text = F.concat_ws(",", F.transform("members", lambda m: _name(m["annotator"], m["roi"])))
    found = _matched(sets).select(text.alias("consensus"), F.size("members").alias("_n"), F.inline("members"))
    found = found.repartition("annotator", "roi").distinct()
    votes = found.join(_smallest(sets).hint("merge"), ["annotator", "roi"]).groupBy("consensus", "_n", "y", "x").agg(F.count("*").alias("v"))
    alone = sets.where("annotator IS NOT NULL AND roi IS NOT NULL").join(_counted(sets), F.col("_n") == 1)
    alone = alone.select(_name(F.col("annotator"), F.col("roi")).alias("consensus"), "y", "x").distinct()
    return votes.where("v * 2 > _n").select("consensus", "y", "x").unionByName(alone)


def stage_times(runs: DataFrame, stages: list[int]) -> DataFrame:
    """A row for each dataset: seconds by stage, totals, time by frame, frame rate and time by size (GiB)."""
    by_stage = [F.sum(F.when(F.col("stage") == s, F.col("sec"))).alias(f"stage_{s}") for s in stages]
    sums = runs.groupBy("dataset").agg(*by_stage, F.sum("sec").alias("total"), F.sum("frames").alias("frames"), F.sum("bytes").alias("bytes"))
    gib = F.col("bytes") / float(1024**3)
    return sums.select(
        "dataset", *[f"stage_{s}" for s in stages], "total", "frames",
        (F.col("total") * 1000 / F.col("frames")).alias("ms_per_frame"),
        F.try_divide(F.col("frames").cast("double"), F.col("total")).alias("fps"),
        gib.alias("gib"), F.try_divide(F.col("total"), gib).alias("sec_per_gib"),
    )


def reuse_times(now: DataFrame, stored: DataFrame) -> DataFrame:
    """Stage times with those of skipped stages (null) taken from an earlier run."""
    before = stored.select("dataset", "stage", F.col("sec").alias("_old"))
    joined = now.join(before, ["dataset", "stage"], "left")
    return joined.select("dataset", "stage", F.coalesce("sec", "_old").alias("sec"))


def repeat_stats(runs: DataFrame) -> DataFrame:
    """``dataset, n, mean, sd`` of repeated timings, and a row over all with a null dataset, by one rollup."""
    return runs.rollup("dataset").agg(F.count("*").alias("n"), F.avg("sec").alias("mean"), F.stddev_samp("sec").alias("sd"))
