import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from glimmer.llm import queries
from glimmer.llm.common import held_out
from glimmer.llm.langid import fit, grams, identify, sure

SYLLABLES = {"xa": "ka ro mi te lu", "yb": "sch ung ber ein acht", "zc": "ción que lla ñor ío"}


def text(rnd, lang, n):
    own = SYLLABLES[lang].split()
    return " ".join("".join(rnd.choice(own) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def corpus(n=300):
    rnd = random.Random(2)
    return [(i, text(rnd, lang, rnd.randint(5, 60)), lang) for i, lang in enumerate(rnd.choices(sorted(SYLLABLES), k=n))]


def test_learns_and_backs_off(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = fit(df)
    assert model.languages == ["xa", "yb", "zc"]
    unseen = [(1, "karomitelukaromi lutekaromi", None), (2, "scheinungachtberung", None), (3, "quellañorío", "?"), (3, "quellañorío", "?")]
    odd = [(4, None, None), (5, "", None), (6, "123 ²³ … !!", None), (7, "日本", None), (None, "karomi", None), (8, "schung " * 20000, None)]
    rows = spark.createDataFrame(unseen + odd, "doc_id long, text string, lang string")
    got = {(r.doc_id, r.lang_pred) for r in identify(rows, model).collect()}
    assert got == {(1, "xa"), (2, "yb"), (3, "zc"), (4, "und"), (5, "und"), (6, "und"), (7, "xa"), (None, "xa"), (8, "yb")}
    assert all(0 <= r.score <= 1 for r in identify(rows, model).collect())
    assert identify(rows, model).count() == len(unseen + odd)
    left = sure(rows.withColumn("sure", F.lit("clash")).withColumn("c0", F.lit(1)), model, 0.5)
    assert left.columns == ["doc_id", "text", "lang", "sure", "c0"] and {r.doc_id for r in left.collect()} == {1, 2, 3, None, 8}


def test_word_beats_grams(spark):
    model = fit(spark.createDataFrame([(1, "kato kato", "xa"), (2, "kati kati kat", "yb")], "doc_id long, text string, lang string"))
    assert [lang for lang, _ in model.predict_all(["kato", "kat"])] == ["xa", "yb"]
    assert grams("ab", 2) == ["^a", "ab", "b$"] and grams("ab", 5) == []


def test_without_training_rows(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, "xa")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in identify(df, fit(df)).collect()] == ["und", "und"]
    assert identify(df.limit(0), fit(df.limit(0))).count() == 0


def test_sample_is_bounded_by_language(spark):
    rows = corpus(3000) + [(5000 + i, "raro lengua unica", "rr") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    small, whole = fit(df, most=100), fit(df, most=10_000)
    assert len(small.tables[0]) < len(whole.tables[0]) and small.languages == ["rr", "xa", "yb", "zc"]
    assert [lang for lang, _ in small.predict_all(["karomite", "unica lengua"])] == ["xa", "rr"]  # a rare language keeps all


def slow_predictions(rows):
    """Of each ``(doc_id, text, lang)`` the language and score, by plain counting over the rows that may be learned from."""

    def words(text):
        return re.findall(r"[^\W\d_]+", (text or "").lower())

    def parts(word, order):
        marked = word if order == 1 else f"^{word}$"
        return [marked[i : i + order] for i in range(len(marked) - order + 1)] if order else [word]

    learned = [(t, lang) for d, t, lang in rows if lang and t is not None and zlib.crc32(str(d).encode()) % 3 != 1]
    counts = {lang: [Counter() for _ in range(6)] for lang in sorted({lang for _, lang in learned})}
    for text, lang in learned:
        for w in words(text):
            for order in range(6):
                counts[lang][order].update(parts(w, order))
    entries = [set().union(*(c[order] for c in counts.values())) for order in range(6)]
    totals = {lang: [sum(c.values()) for c in by_order] for lang, by_order in counts.items()}

    def log(lang, order, part):
        return math.log((counts[lang][order][part] + 0.5) / (totals[lang][order] + 0.5 * max(1, len(entries[order]))))

    def predicted(text):
        own = words(text)
        if not counts or not any(c.isalpha() for w in own for c in w):
            return "und", 0.0
        total = dict.fromkeys(counts, 0.0)
        for w in own:
            for order in (0, 5, 4, 3, 2, 1):
                known = [p for p in parts(w, order) if p in entries[order]]
                if known:
                    for lang in total:
                        total[lang] += sum(log(lang, order, p) for p in known) / len(known)
                    break
        scale, top = min(1.0, 20 / len(own)), max(total.values())
        return max(total, key=total.get), 1 / sum(math.exp((v - top) * scale) for v in total.values())

    return [predicted(t) for _, t, _ in rows]


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.op5_language(spark, sf).collect()}
    assert len(got) == len(rows)
    for (doc, _, _), (lang, score) in zip(rows, slow_predictions(rows), strict=True):
        assert got[doc].held_out == (zlib.crc32(str(doc).encode()) % 3 == 1)
        assert abs(got[doc].score - score) < 1e-3 and (got[doc].lang_pred == lang or score < 0.51)


def test_folds(spark):
    df = spark.range(100).withColumnRenamed("id", "doc_id")
    got = {r[0]: r[1] for r in df.select("doc_id", held_out("doc_id", 3, 1)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(100)}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op5_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = [r for r in found.collect() if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
