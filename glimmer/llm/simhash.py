"""Near-duplicate classes by SimHash, with meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, components, materialize

#: Seed of the XXH64 shingle hashes.
SEED = 42
#: Hashes whose bits are counted at a time.
_BLOCK = 1 << 16


def fingerprint(text: bytes | None, shingle_words: int = 3) -> int:
    """The unsigned 64-bit SimHash of a UTF-8 text; 0 for a text without words."""
    words = (text or b"").lower().split()  # A-Z only, and splits at \x20 \x09-\x0D
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle_words + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    ends = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        hashes = np.array(
            [digest(joined[s:e], SEED) for s, e in zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK], strict=True)],
            dtype="<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """``id_col, fp`` (the fingerprint as a signed long) of every row."""

    def rows(columns):
        fps = np.array([fingerprint(t, shingle_words) for t in columns["text"]], np.uint64)
        yield {"id": columns["id"], "fp": fps.view(np.int64)}

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return arrow_map(narrow, rows, "id long, fp long", weight="text").withColumnRenamed("id", id_col)


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges ``a, b`` that connect the distinct fingerprints ``fp`` within ``radius`` bits.

    Each distinct fingerprint emits all its variants within half the radius; two
    fingerprints meet on a variant if and only if they differ in ``radius`` bits
    or fewer.  The members of a variant's bucket are the variant with at most
    that many bits flipped, so a bucket has at most as many members as a
    fingerprint has variants (65 at radius 2), however many copies there are.
    All members of a bucket are within the radius of each other; they are linked
    to the least member, which connects the same classes as all pairs would.
    """
    if radius not in (0, 2, 4):
        raise ValueError("radius must be 0, 2 or 4")
    masks = [sum(1 << i for i in flips) for k in range(radius // 2 + 1) for flips in combinations(range(64), k)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    # copies emit the same rows, which each task combines before the shuffle
    variants = fps.select("fp", F.explode(F.lit(signed)).alias("mask")).select(
        "mask", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant")
    )
    if radius <= 2:  # one bit names a member: a bucket is one long, combined before the shuffle
        buckets = variants.groupBy("variant").agg(
            F.bit_or("mask").alias("flips"), F.max(F.col("mask") == 0).alias("itself")
        )
        buckets = buckets.where(F.bit_count("flips") + F.col("itself").cast("int") > 1)
        ones = F.filter(F.lit(signed[1:]), lambda m: F.col("flips").bitwiseAND(m) != 0)
        flips = F.when(F.col("itself"), F.concat(F.array(F.lit(0).cast("long")), ones)).otherwise(ones)
    else:
        buckets = variants.groupBy("variant").agg(F.collect_set("mask").alias("flips")).where(F.size("flips") > 1)
        flips = F.col("flips")
    members = F.array_sort(F.transform(flips, lambda m: F.col("variant").bitwiseXOR(m)))
    pairs = buckets.select(members.alias("members")).select(
        F.col("members")[0].alias("a"), F.explode(F.slice("members", 2, len(masks))).alias("b")
    )
    # the colliding pairs, once each, held against the fingerprints themselves
    return pairs.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, radius: int = 2
) -> DataFrame:
    """``id_col, fingerprint, component_id`` for every row of ``docs``.

    Rows are linked if their fingerprints differ in ``radius`` bits or fewer;
    ``component_id`` is the smallest id reachable over links.  Null and empty
    texts have fingerprint zero and are linked like any other; repeated rows
    come back as often as they came; a null id is never a ``component_id``
    unless its whole class has none; an empty table gives an empty table.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle_words), "fps")
    roots = components(links(fps, radius))
    classes = fps.groupBy("fp").agg(F.min(id_col).alias("low"))
    classes = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    classes = classes.select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    labelled = classes.select("fp", "root").join(least, "root").select("fp", "component_id")
    joined = fps.join(labelled, "fp")
    return joined.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
