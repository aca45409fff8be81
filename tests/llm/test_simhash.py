import re

import xxhash
from pyspark.sql import functions as F

from glimmer.llm.simhash import fingerprint, near_duplicates


def slow_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                up[top(i)] = top(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        out.append((doc, f"{fps[i]:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, near_duplicates(df).collect()), key=str)


def test_fingerprint_is_the_defined_one():
    for text in (None, "", " \t\n", "one", "ONE two", "ÄÖ x É y z w", "a b c d e f g A B C", "x " * 500):
        assert fingerprint(None if text is None else text.encode()) == slow_fingerprint(text)


def test_engine_hash(spark):
    texts = ["", "abc", "ü ü ü", "a longer text than the thirty-two bytes of a stripe"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] % (1 << 64) for r in df.select(F.xxhash64("t")).collect()] == [
        xxhash.xxh64_intdigest(t.encode(), 42) for t in texts
    ]


def test_classes_match_all_pairs(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(i, base.replace(f"w{i * 7} ", "other ")) for i in range(30)]
    rows += [(100 + i, base) for i in range(20)]
    rows += [(200 + i, f"text number {i} " * 3) for i in range(20)]
    rows += [(300, None), (301, ""), (302, " "), (300, None), (None, base), (None, "alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    df = df.withColumn("component_id", F.lit("clash"))
    assert found(df) == slow_classes(rows)


def test_chain_of_links(spark):
    from glimmer.llm.common import components
    from glimmer.llm.simhash import links

    fps = [(1 << (2 * i)) - 1 for i in range(32)]  # neighbours differ in two bits
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for radius, classes in ((0, 0), (2, 1), (4, 1)):
        rows = components(links(df, radius)).collect()
        assert len({r.root for r in rows}) == classes
        assert len(rows) == 32 * classes


def test_empty(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []
