"""Splits, batches, picks and pairings of files and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmer.sources.shared import shared_path


def pair_channels(*listings: DataFrame, key: str = "name") -> DataFrame:
    """``key, path_0, path_1 ...`` of the names that every listing ``name, path`` has."""
    out = listings[0].select(key, F.col("path").alias("path_0"))
    for i, more in enumerate(listings[1:], 1):
        out = out.join(more.select(key, F.col("path").alias(f"path_{i}")), key)
    return out


def preferred_file(wanted: DataFrame, files: DataFrame, extensions: list[str]) -> DataFrame:
    """``stem, ext`` for every wanted stem: the first extension of the list that a file has, null if none."""
    rank = F.array_position(F.lit(extensions), F.col("ext"))
    ranked = files.where(rank > 0).groupBy("stem").agg(F.min_by("ext", rank).alias("ext"))
    return wanted.select("stem").join(ranked, "stem", "left")


def shuffled_split(items: DataFrame, key: str, seed: int, ratio: int) -> DataFrame:
    """Items with ``valid``: the last ``n // ratio`` in a shuffled order, which is that of an MD5 of seed and key.

    The rank is by a two-step count over hash prefixes, so no task sorts all items.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    hashed = items.withColumn("_h", digest).withColumn("_p", F.substring("_h", 1, 2))
    sizes = hashed.groupBy("_p").agg(F.count("*").alias("_n"))  # 256 rows at most
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(F.lit(0))
    bases = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(all_).alias("_all"))
    own = Window.partitionBy("_p").orderBy("_h", key)
    ranked = hashed.withColumn("_r", F.row_number().over(own)).join(F.broadcast(bases), "_p")
    place = F.col("_base") + F.col("_r") - 1
    valid = place >= F.col("_all") - F.expr(f"_all div {ratio}")
    return ranked.select(*items.columns, valid.alias("valid"))


def numbered(items: DataFrame, order: list[str], place: str, total: str) -> DataFrame:
    """Items with their ``place`` in the order, from 0, and the ``total`` of items.

    Ranges of the order are sorted side by side and written to the shared folder;
    a prefix sum of their sizes, one row for each range, gives the places.
    """
    path = shared_path(items.sparkSession, "numbered")
    at = F.monotonically_increasing_id()  # the range's number, and under 33 bits the place in it
    items.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at).write.parquet(path)
    rows = items.sparkSession.read.parquet(path)
    rows = rows.withColumns({"_p": F.shiftright("_at", 33), "_r": F.col("_at").bitwiseAND((1 << 33) - 1)})
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    bases = sizes.select("_p", base, F.sum("_n").over(Window.partitionBy(F.lit(0))).alias(total))
    # as many rows as there are ranges
    return rows.join(F.broadcast(bases), "_p").select(*items.columns, (F.col("_base") + F.col("_r")).alias(place), total)


def fold_of(items: DataFrame, key: str, folds: int) -> DataFrame:
    """Items with ``fold``: nearly equal runs of the key's order, the first ones longer by one."""
    nth = numbered(items, [key], "_place", "_n")
    size, extra = F.expr(f"_n div {folds}"), F.col("_n") % folds
    edge = extra * (size + 1)
    later = extra + F.floor(F.try_divide((F.col("_place") - edge).cast("double"), size.cast("double"))).cast("long")
    fold = F.when(F.col("_place") < edge, F.floor(F.col("_place") / (size + 1)).cast("long")).otherwise(later)
    return nth.select(*items.columns, fold.cast("long").alias("fold"))


def held_back(items: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Items that the other list doesn't have."""
    return items.join(other, key, "left_anti")


def best_by_loss(files: DataFrame, name: str = "name") -> DataFrame:
    """The one file with the least loss, which stands in its name after a ``v``; equal ones by name."""
    loss = F.regexp_extract(name, r"v([0-9]+(?:\.[0-9]+)?)", 1).cast("double")
    return files.where(F.regexp_like(name, F.lit(r"v[0-9]"))).select(F.col(name), loss.alias("loss")).orderBy("loss", name).limit(1)


def latest_run(runs: DataFrame, name: str = "name") -> DataFrame:
    """The last name in order."""
    return runs.agg(F.max(name).alias(name))


def batches(items: DataFrame, order: list[str], size: int) -> DataFrame:
    """Items with their ``batch``: runs of ``size`` items in order, the last one as long as it comes."""
    return numbered(items, order, "_place", "_n").select(*items.columns, F.expr(f"_place div {size}").alias("batch"))


def epoch_order(items: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """Items in an order that changes with the epoch and is the same for the same seed."""
    return items.orderBy(F.xxhash64(F.lit(seed), F.lit(epoch), F.col(key)), key)


def overlay_parameters(defaults: DataFrame, user: DataFrame) -> DataFrame:
    """``name, value`` of both, the user's value where both have one."""
    u = user.select("name", F.col("value").alias("_u"))
    return defaults.join(u, "name", "full").select("name", F.coalesce("_u", "value").alias("value"))


def exposure_rate(texts: DataFrame, text: str) -> DataFrame:
    """``rate``: whole frames in a second, from a line like ``Exposure1 = 0.0025 s``; null without one."""
    seconds = F.regexp_extract(text, r"Exposure1\s*=\s*([0-9.]+)\s*s", 1)
    number = F.expr("try_cast(_s as double)")
    out = texts.withColumn("_s", seconds).withColumn("_s", number)
    return out.withColumn("rate", F.floor(F.try_divide(F.lit(1.0), "_s") + 1e-9)).drop("_s")


def fill_template(rows: DataFrame, template: str, values: dict[str, str]) -> DataFrame:
    """A template column with each ``@@@KEY`` replaced."""
    column = F.col(template)
    for k in sorted(values, key=len, reverse=True):
        column = F.replace(column, F.lit(f"@@@{k}"), F.lit(values[k]))
    return rows.withColumn(template, column)
