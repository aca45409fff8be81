"""Queries of listing, split and parameter operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from glimmer.operators import sampling
from glimmer.plans.registry import query
from glimmer.sources.views import table


def _parts(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), "p_brand", "p_size", "p_type")


@query("channel_pairing", """SELECT a.p_partkey AS name, 'a/' || a.p_partkey AS path_0, 'b/' || b.p_partkey AS path_1 FROM part a JOIN part b
    ON a.p_partkey = b.p_partkey WHERE a.p_size < 30 AND b.p_size > 10""")
def channel_pairing(spark, d):
    p = table(spark, d, "part")

    def listing(prefix, rows):
        return rows.select(F.col("p_partkey").alias("name"), F.concat(F.lit(prefix), F.col("p_partkey").cast("string")).alias("path"))

    return sampling.pair_channels(listing("a/", p.where("p_size < 30")), listing("b/", p.where("p_size > 10")))


@query("label_preference", """WITH f AS (SELECT p_partkey % 300 AS stem, CASE p_partkey % 5 WHEN 0 THEN '.roi' WHEN 1 THEN '.zip' WHEN 2 THEN '.tif' ELSE '.txt' END AS ext FROM part WHERE p_partkey % 7 < 4),
    w AS (SELECT DISTINCT p_partkey % 320 AS stem FROM part),
    r AS (SELECT stem, ext, row_number() OVER (PARTITION BY stem ORDER BY CASE ext WHEN '.zip' THEN 1 WHEN '.roi' THEN 2 ELSE 3 END) AS n FROM f WHERE ext <> '.txt')
    SELECT w.stem, r.ext FROM w LEFT JOIN r ON r.stem = w.stem AND r.n = 1""")
def label_preference(spark, d):
    p = table(spark, d, "part")
    kind = F.expr("CASE p_partkey % 5 WHEN 0 THEN '.roi' WHEN 1 THEN '.zip' WHEN 2 THEN '.tif' ELSE '.txt' END")
    files = p.where("p_partkey % 7 < 4").select((F.col("p_partkey") % 300).alias("stem"), kind.alias("ext"))
    wanted = p.select((F.col("p_partkey") % 320).alias("stem")).distinct()
    return sampling.preferred_file(wanted, files, [".zip", ".roi", ".tif"])


@query("shuffled_split", """WITH h AS (SELECT p_partkey, md5('3:' || p_partkey) AS h FROM part), n AS (SELECT count(*) AS n FROM part)
    SELECT p_partkey, row_number() OVER (ORDER BY h, p_partkey) - 1 >= n - n // 5 AS valid FROM h, n""")
def shuffled_split(spark, d):
    return sampling.shuffled_split(table(spark, d, "part").select("p_partkey"), "p_partkey", 3, 5)


@query("kfold_split", """WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS r, count(*) OVER () AS n FROM part)
    SELECT p_partkey, CAST(CASE WHEN r < (n % 13) * (n // 13 + 1) THEN r // (n // 13 + 1) ELSE n % 13 + (r - (n % 13) * (n // 13 + 1)) // (n // 13) END AS BIGINT) AS fold FROM r""")
def kfold_split(spark, d):
    return sampling.fold_of(table(spark, d, "part").select("p_partkey"), "p_partkey", 13)


@query("held_back", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 0)")
def held_back(spark, d):
    used = table(spark, d, "orders").where("o_orderkey % 10 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return sampling.held_back(table(spark, d, "customer").select("c_custkey"), used, "c_custkey")


@query("model_pick", """SELECT 'model-' || p_partkey || '-v' || (p_size + p_partkey % 10) || '.h5' AS name, CAST(p_size + p_partkey % 10 AS DOUBLE) AS loss
    FROM part ORDER BY 2, 1 LIMIT 1""")
def model_pick(spark, d):
    p = table(spark, d, "part")
    number = (F.col("p_size") + F.col("p_partkey") % 10).cast("string")
    name = F.concat(F.lit("model-"), F.col("p_partkey").cast("string"), F.lit("-v"), number, F.lit(".h5"))
    return sampling.best_by_loss(p.select(name.alias("name")))


@query("latest_run", "SELECT max('hpc' || o_orderdate) AS name FROM orders".replace("'hpc' || o_orderdate", "strftime(o_orderdate, 'run_%Y%m%dT%H%M%S')"))
def latest_run(spark, d):
    names = table(spark, d, "orders").select(F.date_format("o_orderdate", "'run_'yyyyMMdd'T'HHmmss").alias("name"))
    return sampling.latest_run(names)


@query("batch_split", "SELECT p_partkey, (row_number() OVER (ORDER BY p_size, p_partkey) - 1) // 128 AS batch FROM part")
def batch_split(spark, d):
    return sampling.batches(table(spark, d, "part").select("p_partkey", "p_size"), ["p_size", "p_partkey"], 128).select("p_partkey", "batch")


@query("params_overlay", """SELECT coalesce(u.c_name, t.c_name) AS name, coalesce(u.c_mktsegment, t.c_mktsegment || '-default') AS value
    FROM (SELECT * FROM customer WHERE c_custkey % 2 = 0) t FULL JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) u ON t.c_name = u.c_name""")
def params_overlay(spark, d):
    c = table(spark, d, "customer")
    defaults = c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("name"), F.concat("c_mktsegment", F.lit("-default")).alias("value"))
    return sampling.overlay_parameters(defaults, c.where("c_custkey % 3 = 0").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("value")))


@query("metadata_regex", """WITH m AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'no exposure' ELSE 'Camera x' || chr(10) || 'Exposure1 = ' || (p_size / 10000.0::DOUBLE) || ' s' END AS meta FROM part)
    SELECT p_partkey, CAST(floor(1 / TRY_CAST(nullif(regexp_extract(meta, 'Exposure1\\s*=\\s*([0-9.]+)\\s*s', 1), '') AS DOUBLE) + 1e-9) AS BIGINT) AS rate FROM m""")
def metadata_regex(spark, d):
    p = table(spark, d, "part")
    line = F.concat(F.lit("Camera x\nExposure1 = "), F.format_number(F.col("p_size") / 10000, 4), F.lit(" s"))
    meta = F.when(F.col("p_size") % 4 == 0, "no exposure").otherwise(line)
    return sampling.exposure_rate(p.select("p_partkey", meta.alias("meta")), "meta").select("p_partkey", "rate")


@query("template_fill", "SELECT r_regionkey, 'in ' || r_name || ' at @@@ONE of DATA/x' AS cell FROM region".replace("@@@ONE", "1"))
def template_fill(spark, d):
    r = table(spark, d, "region").select("r_regionkey", F.concat(F.lit("in "), F.col("r_name"), F.lit(" at @@@T of @@@TOP/x")).alias("cell"))
    return sampling.fill_template(r, "cell", {"T": "1", "TOP": "DATA"})
