import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from glimmer.llm import queries
from glimmer.llm.toxicity import Model, entries_of, fit, fold, phrases, score


def test_folding():
    assert fold("You 1d10t, M0R0N!! $tupid cl@wn") == " you idiot moron stupid clawn "
    assert fold("іdіоt сlоwn") == " idiot clown "  # Cyrillic letters
    assert entries_of(" abcdef ab ") == {" abcdef ", " ab ", " abcd", " abcde", " abcdef"}


def test_whole_alphabets_stay_whole_words():
    cyrillic = "абвгдежзийклмнопрстуфхцчшщъыьэюяёђѓєѕіїјљњћќўџґ"
    greek = "αβγδεζηθικλμνξοπρστυφχψω"
    for letters in (cyrillic, cyrillic.upper(), greek, greek.upper(), "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœłđ"):
        assert len(fold(letters).split()) == 1
        for c in letters:
            assert len(fold(f"x{c}x").split()) == 1
    assert fold("забава") == " eababa " and fold("азбука") == " aebyka "
    assert fold("ЗАБАВА") == fold("забава")


def test_disguises():
    assert fold("ｉｄｉｏｔ ＩＤＩＯＴ") == " idiot idiot "  # full width
    assert fold("id\u200bi\u00adot i\u2060diot \ufeffidiot") == " idiot idiot idiot "  # no width
    assert fold("ídïôt İDİOT i\u0301diot") == " idiot idiot idiot "  # accents
    assert fold("in 2024 and 100 of 1d10ts") == " in and of idiots "  # a number is no word
    assert fold("日本語 한국어") == " 日本語 한국어 "
    assert fold("") == "  " and fold("123 !!") == "  "


def test_phrases():
    assert phrases(" a trash can ", 2, 8) == [" a trash ", " trash can "]
    assert phrases(" trash ", 0, 6) == []


def corpus(n=1200):
    rnd, plain = random.Random(1), [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = []
    for i in range(n):
        words, toxic = rnd.choices(plain, k=rnd.randint(5, 200)), int(rnd.random() < 0.2)
        if toxic:
            for _ in range(max(1, len(words) // 20)):
                words.insert(rnd.randint(0, len(words)), rnd.choice(["trash", "idiot", "grumfel", "grumfax", "grumfop", "grumfiz"]))
        elif rnd.random() < 0.04:
            words += ["trash", "can"]
        rows.append((i, " ".join(words), toxic))
    return rows


def test_learns_entries_stems_and_exceptions(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = fit(docs, labels)
    assert " trash can " in model.exceptions and " idiot " in model.weights and " grumf" in model.weights
    probe = [(1, "what an idiot you are"), (2, "put it in the trash can please"), (3, "M0R0N 1d10t"), (4, "grumfzzz said the worda"),
             (5, None), (6, ""), (7, "worda wordb " * 20000), (7, "x"), (None, "idiot")]
    got = {r.doc_id: r.score for r in score(spark.createDataFrame(probe, "doc_id long, text string"), model).collect()}
    assert got[1] > 0.5 and got[3] > 0.5 and got[4] > 0.5 and got[None] > 0.5
    assert max(got[2], got[5], got[6], got[7]) < 0.5
    assert all(0 <= v <= 1 for v in got.values())


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "idiot"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, toxic int")
    assert [r.score for r in score(docs, fit(docs, labels)).collect()] == [0.0, 0.0]
    assert score(docs.limit(0), Model()).count() == 0


def slow_scores(rows, labels):
    """Of each ``(doc_id, text)`` the score, by plain counting and search, from the labels that may be learned from."""
    texts = dict(rows)
    learned = {d: y for d, y in labels if zlib.crc32(str(d).encode()) % 5 and y in (0, 1) and d in texts}
    words = {d: fold(texts[d] or "").split() for d in texts}

    def entries(own):
        return {f" {w} " for w in own} | {f" {w[:n]}" for w in own for n in (4, 5, 6, 7, 8) if len(w) >= n}

    counts = (Counter(), Counter())
    for d, y in learned.items():
        counts[y].update(entries(words[d]))
    n = Counter(learned.values())
    weight = {e: math.log((k + 0.5) / (n[1] + 1)) - math.log((counts[0][e] + 0.5) / (n[0] + 1)) for e, k in counts[1].items() if k >= 4}
    weight = {e: w for e, w in weight.items() if w >= 1.5}

    def best(w):
        return max((weight[e] for e in entries([w]) if e in weight), default=0.0)

    near = (Counter(), Counter())
    pairs = {}
    for d, own in words.items():
        pairs[d] = [{tuple(p) for p in (own[max(0, i - 1) : i + 1], own[i : i + 2]) if len(p) == 2} if best(w) else set() for i, w in enumerate(own)]
        if d in learned:
            near[learned[d]].update(set().union(*pairs[d]))
    excused = {p for p, k in near[0].items() if k >= 4 and near[1][p] / (k + near[1][p]) <= 0.1}

    def features(d):
        own = words[d]
        hits = [(w, best(w)) for w, p in zip(own, pairs[d], strict=True) if best(w) and not p & excused]
        total, distinct, size = sum(b for _, b in hits), len({w for w, _ in hits}), max(1, len(own))
        return [math.log1p(total), math.log1p(distinct), math.log1p(1000 * total / size), 1000 * distinct / (size + 100), math.log1p(size)]

    x, y = np.array([features(d) for d in learned]), np.array([*learned.values()], float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z, w = np.c_[(x - mean) / scale, np.ones(len(x))], np.zeros(6)
    penalty = np.array([1.0] * 5 + [1e-6])
    for _ in range(200):
        p = 1 / (1 + np.exp(-(z @ w)))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(penalty), z.T @ (p - y) + penalty * w)
    return {d: 1 / (1 + math.exp(-(np.append((np.array(features(d)) - mean) / scale, 1) @ w))) for d in texts}


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    got = {r.doc_id: r for r in queries.op3_toxicity(spark, sf).collect()}
    want = slow_scores(rows, labels)
    assert len(got) == len(rows) and max(want.values()) > 0.5
    for d, score in want.items():
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert abs(got[d].score - score) < 1e-6 and got[d].predicted == (got[d].score >= 0.5)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"  # sf0.01 holds 11 positive rows out, some of them marked at random
    rows = queries.op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [(r.score, r.toxic) for r in rows if r.held_out]
    pos, neg = [s for s, t in held if t], [s for s, t in held if not t]
    assert np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]) > 0.93
