"""The queries ``opN_<name>`` over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .covertree import top_k

    table = _table(spark, sf_dir, "embeddings")
    return top_k(table, table.where("vec_id % 20 = 0"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .common import held_out
    from .toxicity import fit, score

    docs, out = _table(spark, sf_dir, "documents"), held_out("doc_id", 5, 0)
    found = score(docs, fit(docs, _table(spark, sf_dir, "labels").where(~out)))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return found.select("doc_id", out.alias("held_out"), "score", predicted)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import round_trip_digests

    return round_trip_digests(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import held_out
    from .langid import fit, identify

    docs = _table(spark, sf_dir, "documents")
    out = held_out("doc_id", 3, 1)
    found = identify(docs, fit(docs.where(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .binary import read_documents, write
    from .common import shared_path

    path = shared_path(spark, "tokens")
    write(_table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=2)
    return read_documents(spark, path)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import digests

    return digests(_table(spark, sf_dir, "documents"))


def op9_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .graph import nearest

    table = _table(spark, sf_dir, "embeddings")
    return nearest(table, table.where("vec_id % 100 = 0"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .secrets import RULES, listed, scan

    found, _ = scan(_table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    spans = listed(F.col("spans"))
    return found.select(
        "doc_id", *[count(r.kind) for r in RULES], F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = globals()
    return {k: own[k] for k in sorted((k for k in own if k.startswith("op")), key=lambda k: int(k[2:].split("_")[0]))}


_ASSIGN = r"""(?i)((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""


def _op10_sql() -> str:
    """Spans from the pieces between matches, by running sums of lengths."""
    kinds = (("assign", 0, _ASSIGN, 2, 12), ("access", 1, "(AKIA[A-Z0-9]+)", 1, 18), ("hex", 2, "([0-9a-f]+)", 1, 16))
    parts = []
    for kind, nth, pattern, group, least in kinds:
        p = pattern.replace("'", "''")
        parts.append(f"""
          SELECT doc_id, '{kind}' AS kind, {nth} AS nth, stop - length(m) AS start, stop, v FROM (
            SELECT doc_id, m, v, sum(length(b) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
              SELECT doc_id, unnest(string_split_regex(text, '{p}')[1:len(ms)]) AS b, unnest(ms) AS m,
                     unnest(regexp_extract_all(text, '{p}', {group})) AS v, unnest(range(len(ms))) AS i
              FROM (SELECT doc_id, text, regexp_extract_all(text, '{p}', 0) AS ms FROM t)))
          WHERE length(v) >= {least}""")
    return f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        s AS ({" UNION ALL ".join(parts)}),
        g AS (
          SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c,
                 count(*) FILTER (kind = 'hex') AS h,
                 string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, nth) AS spans
          FROM s GROUP BY doc_id)
        SELECT t.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
               sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM t LEFT JOIN g USING (doc_id)"""


_OP2_SQL = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
    SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20"""


_OP8_SQL = """
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
    g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM s),
    f AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h),
    r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (h) WHERE doc_id > least),
    p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
    k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.p) AS kept, count(*) AS n
          FROM p ANTI JOIN r ON p.doc_id = r.doc_id AND p.p = r.p GROUP BY p.doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
           sha256(coalesce(k.kept, '')) AS kept_sha256
    FROM d LEFT JOIN k ON d.doc_id = k.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": _OP2_SQL, "op8_substrings": _OP8_SQL, "op10_secrets": _op10_sql()}
