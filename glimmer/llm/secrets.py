"""Secret scans with a ledger of content-addressed blobs, in DataFrame functions only.

A text is addressed by its SHA-256.  The ledger holds, for each blob and rule
version that has been scanned, the spans found; a scan looks at those pairs only
that the ledger doesn't hold yet, however many documents or versions share a
blob, and findings are joined back to every document that has the blob.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched from the left without overlap; matches of which ``keep`` fails are dropped.

    ``value`` is the group whose length must be ``least`` characters or more.
    """

    kind: str
    version: int
    pattern: str
    value: int
    least: int


# The base rules, in the order in which their spans are listed.
RULES = (
    Rule(
        "assign",
        1,
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]+", 0, 16),
)
SPAN = "struct<kind:string,nth:int,start:int,stop:int>"


def _spans(text: Column, rule: Rule, nth: int) -> Column:
    """The spans of one rule, in code points.

    The pieces between matches and the matches themselves take turns from the
    text's start; a span begins where all pieces and matches before it end.
    """
    pattern = _screened(rule)
    matches = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(rule.value + 1))
    between = F.split(text, pattern, -1)
    sized = F.zip_with(
        F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("m"))),
        values,
        lambda s, v: F.struct(s["b"].alias("b"), s["m"].alias("m"), F.length(v).alias("v")),
    )
    empty = F.lit([]).cast(f"array<{SPAN}>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def step(state: Column, m: Column) -> Column:
        begin = state["at"] + m["b"]
        span = F.struct(
            F.lit(rule.kind).alias("kind"), F.lit(nth).alias("nth"), begin.alias("start"), (begin + m["m"]).alias("stop")
        )
        found = F.when(m["v"] >= rule.least, F.concat(state["found"], F.array(span))).otherwise(state["found"])
        return F.struct((begin + m["m"]).alias("at"), found.alias("found"))

    found = F.aggregate(sized, start, step, lambda state: state["found"])
    # most texts have no match that counts: one look tells, without arrays
    return F.when(text.rlike(pattern), found).otherwise(empty)


def _screened(rule: Rule) -> str:
    """The pattern with its least length inside, where that changes no match that counts.

    Holds for a run of one class that is taken whole: a shorter run can't hold a
    longer one.  Not for an assignment, whose short value may hold a key's name.
    """
    head, _, tail = rule.pattern.partition("[")
    if rule.value == 0 and re.fullmatch(r"[A-Za-z0-9]*", head) and re.fullmatch(r"[A-Za-z0-9-]+\]\+", tail):
        return f"{rule.pattern[:-1]}{{{max(1, rule.least - len(head))},}}"
    return rule.pattern


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, kind, version, spans`` of each row ``blob, text`` and each rule."""
    made = [
        F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), _spans(F.col("text"), r, i).alias("spans"))
        for i, r in enumerate(rules)
    ]
    return blobs.select("blob", F.explode(F.array(*made)).alias("r")).select("blob", "r.kind", "r.version", "r.spans")


def address(text: Column) -> Column:
    """The content address of a text; a null text is an empty one."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def update_ledger(
    docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text"
) -> DataFrame:
    """The rows to append to ``ledger`` (``blob, kind, version, spans``) so that it covers ``docs``.

    Each distinct text is scanned once for each rule version that it hasn't been
    scanned for.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    blobs = docs.select(address(F.col(text_col)).alias("blob"), text.alias("text")).dropDuplicates(["blob"])
    if ledger is None:
        return scan_blobs(blobs, rules)
    parts = []
    for rule in rules:  # a blob may be new to one rule and known to another
        seen = ledger.where((F.col("kind") == rule.kind) & (F.col("version") == rule.version)).select("blob")
        parts.append(scan_blobs(blobs.join(seen, "blob", "left_anti"), (rule,)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def spans_by_blob(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, spans`` of the blobs in which any rule found something: all spans by start, then in the rules' order."""
    wanted = F.lit(False)
    for r in rules:
        wanted = wanted | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
    hits = ledger.where(wanted & (F.size("spans") > 0)).groupBy("blob")
    hits = hits.agg(F.flatten(F.collect_list("spans")).alias("spans"))  # at most one row for each rule
    ordered = F.array_sort(
        F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["nth"].alias("nth"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    )
    # a table, so that the join's two sides are plain exchanges and a blob that many documents share can be split
    return materialize(hits.select("blob", ordered.alias("spans")), "hits")


def findings(
    docs: DataFrame,
    ledger: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col, blob, spans`` of every row of ``docs``: all spans by start, then in the rules' order.

    Only ledger rows that hold a span take part, so a text without findings
    costs its address and nothing more.
    """
    hits = spans_by_blob(ledger, rules)
    narrow = docs.select(F.col(id_col), address(F.col(text_col)).alias("blob"))
    none = F.lit([]).cast("array<struct<start:int,nth:int,stop:int,kind:string>>")
    return narrow.join(hits, "blob", "left").select(id_col, "blob", F.coalesce("spans", none).alias("spans"))


def scan(
    docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Findings for every row of ``docs``, and the ledger that covers them.

    Null and empty texts have no spans; repeated rows come back as often as they
    came; rows with a null id keep it; texts of any length are taken whole; other
    columns, whatever their names, play no part; an empty table gives empty tables.
    """
    new = materialize(update_ledger(docs, ledger, rules, text_col), "ledger")
    whole = new if ledger is None else ledger.unionByName(new)
    return findings(docs, whole, rules, id_col, text_col), whole


def scan_into(
    docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Findings for every row of ``docs``, with a ledger that is kept at ``path`` from run to run.

    Only blob and rule-version pairs that no earlier run has scanned are scanned;
    they are appended to the ledger before findings are joined, so that a run that
    is broken off is taken up where it was.
    """
    spark = docs.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    before = spark.read.schema(_LEDGER).parquet(path) if known else None
    update_ledger(docs, before, rules, text_col).write.mode("append").parquet(path)
    return findings(docs, spark.read.schema(_LEDGER).parquet(path), rules, id_col, text_col)


_LEDGER = f"blob string, kind string, version int, spans array<{SPAN}>"


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])))


def redact(
    docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", mark: str = "[secret]"
) -> DataFrame:
    """``docs`` with each run of overlapping spans replaced by ``mark``; other texts, null ones too, stay as they are.

    ``ledger`` covers the same table; rows meet by the content address, so that
    an id that stands twice is no matter.  All other columns stay, whatever their
    names.
    """
    # grows with the table: no broadcast at any size
    hits = spans_by_blob(ledger, rules).select(F.struct("blob", "spans").alias("hit")).hint("merge")
    # one column that holds all others: no name of theirs can clash
    rows = docs.select(F.struct(*docs.columns).alias("doc"), address(F.col(text_col)).alias("at"))
    text = F.col("doc").getField(text_col)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        apart = F.concat(state["out"], gap, F.lit(mark))
        out = F.when(s["start"] >= state["at"], apart).otherwise(state["out"])
        return F.struct(out.alias("out"), F.greatest(state["at"], s["stop"]).alias("at"))

    whole = F.aggregate("hit.spans", start, step, lambda x: F.concat(x["out"], F.substring(text, x["at"] + 1, F.length(text))))
    joined = rows.join(hits, F.col("at") == F.col("hit.blob"), "left")
    masked = F.when(F.col("hit").isNull(), text).otherwise(whole)
    return joined.select(*[(masked if c == text_col else F.col("doc").getField(c)).alias(c) for c in docs.columns])
