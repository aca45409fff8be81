import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.llm import substrings
from glimmer.llm.fmindex import FmIndex, WaveletMatrix
from glimmer.llm.substrings import anchors, deduplicate, digests, word_hashes

SCHEMA = "doc_id long, text string, uid int"


def test_wavelet_rank():
    rnd = np.random.default_rng(0)
    for symbols in (2, 3, 17, 300):
        seq = rnd.integers(0, symbols, 500)
        at, c = rnd.integers(0, 501, 400), rnd.integers(0, symbols, 400)
        assert WaveletMatrix(seq, symbols).rank(c, at).tolist() == [int((seq[:i] == s).sum()) for i, s in zip(at, c, strict=True)]


@pytest.mark.parametrize("window", [1, 2, 3, 5, 8, 13, 17])
def test_matching_statistics(window):
    rnd = np.random.default_rng(window)
    seqs = [rnd.integers(1, 4, rnd.integers(0, 40)) for _ in range(30)]
    values = rnd.permutation(30)
    index = FmIndex.from_bytes(FmIndex(seqs, values, 4, window).to_bytes())
    streamed = seqs[:9] + [rnd.choice([-1, 1, 2, 3], 50) for _ in range(9)]  # most windows of these aren't there
    length, least = index.matches(np.concatenate(streamed), np.array([len(s) for s in streamed]))
    held: dict[tuple, int] = {}
    for s, v in zip(seqs, values.tolist(), strict=True):
        for i in range(len(s)):
            for n in range(1, min(window, len(s) - i) + 1):
                held[tuple(s[i : i + n].tolist())] = min(v, held.get(tuple(s[i : i + n].tolist()), v))
    want = []
    for s in (s.tolist() for s in streamed):
        for i in range(len(s)):
            n = max((n for n in range(window + 1) if i + n <= len(s) and (n == 0 or tuple(s[i : i + n]) in held)), default=0)
            want.append((n, held[tuple(s[i : i + window])] if n == window else np.iinfo(np.int64).max))
    assert list(zip(length.tolist(), least.tolist(), strict=True)) == want


def test_index_is_small():
    seqs = list(np.random.default_rng(0).integers(1, 1000, (5000, 20)))
    index = FmIndex(seqs, np.arange(5000), 1000, 13)
    held = sum(a.nbytes for a in [*index.wavelet.words, *index.wavelet.before, index._common_packed, index.least])
    assert held < 12 * index.n and len(index.to_bytes()) < 4 * index.n  # a suffix array alone has 8 bytes a place


def test_equal_windows_have_equal_anchors():
    rnd = random.Random(1)
    words = [rnd.choice([b"a", b"b", b"cc", b"dd"]) for _ in range(400)]
    seen = {}
    for i, a in enumerate(anchors(b" ".join(words), 6, 2).tolist()):
        assert seen.setdefault(tuple(words[i : i + 6]), a) == a


def test_word_hashes(monkeypatch):
    words = [b"a", b"b", b"ab", b"ba", b"aa", b"\x00", b"\x00\x00", "é".encode(), b"a", b"x" * 300, b"x" * 300, b"x" * 299]
    hashes = word_hashes(b" ".join(words))
    assert len(hashes) == len(words) and len(set(hashes.tolist())) == len(set(words))
    assert hashes[0] == hashes[8] and hashes[9] == hashes[10]
    monkeypatch.setattr(substrings, "_BLOCK", 64)  # the same in other blocks, but for words longer than one
    assert word_hashes(b" ".join(words)).tolist()[:9] == hashes.tolist()[:9]
    assert word_hashes(b"").tolist() == []


def brute(rows, window):
    seen = {}
    split = [(NO if d is None else d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            seen[key] = min(seen.get(key, NO), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((None if d == NO else d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


NO = substrings.NO_ID


def corpus():
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", " x", "ünï"]
    passages = [" ".join(rnd.choices(vocabulary, k=rnd.randint(13, 30))) for _ in range(8)]
    rows = []
    for i in range(150):
        parts = [rnd.choice(passages) if rnd.random() < 0.4 else " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 25))) for _ in range(rnd.randint(0, 5))]
        rows.append((i * 3 - 50, rnd.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(1000 + i, rows[20][1]) for i in range(20)]  # copies
    rows += [(2000, None), (2001, ""), (2002, "same " * 500), (2003, "same " * 300), (2003, "same " * 300), (None, passages[0]), (2004, rows[30][1] + " more words")]
    return rows


@pytest.mark.parametrize("shard_words", [500_000, 2000, 60])
def test_matches_brute_force(spark, monkeypatch, shard_words):
    monkeypatch.setattr(substrings, "SHARD_WORDS", shard_words)  # at 60 most anchors are dealt out by windows
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA).repartition(4)
    assert sorted(map(tuple, digests(df).collect()), key=str) == brute(rows, 13)


def test_a_line_repeated_in_many_documents(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_WORDS", 5000)
    monkeypatch.setattr(substrings, "STRETCH", 8)
    line = " ".join(f"word{i}" for i in range(20))
    rows = [(i, f"{line}\n" * (5000 if i % 4 == 0 else 3) + f"own{i}") for i in range(40)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA).repartition(4)
    assert sorted(map(tuple, digests(df).collect()), key=str) == brute(rows, 13)


def test_one_anchor_among_other_words(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_WORDS", 3000)
    rnd = random.Random(5)

    def around(letter):
        return " ".join(f"{letter}{rnd.randint(0, 9**9)}" for _ in range(9))

    rows = [(i, f"{around('a')} the same five words here {around('b')}") for i in range(400)]
    rows += [(1000 + i, f"x {rows[7 * i][1]} y") for i in range(40)]
    stored = substrings._store(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 13, 5, [])
    weights = stored.selectExpr("explode(arrays_zip(anchors, weights)) a").groupBy("a.anchors").sum("a.weights").collect()
    assert len(weights) > 400
    got = digests(spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 13)


def test_deduplicate_texts(spark):
    line = " ".join(f"word{i}" for i in range(20))
    rows = [(1, f"a b {line}\nc", 0), (2, f"x  y\n{line} z", 0), (3, "untouched  text", 0), (4, f"a b {line}\nc", 0), (5, None, 0)]
    out = {r.doc_id: r.text for r in deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {1: f"a b {line}\nc", 2: "x y z", 3: "untouched  text", 4: "", 5: None}
    clash = spark.createDataFrame(rows, SCHEMA)
    for name in ("row", "doc", "words", "kept", "is_null", "_text_is_null", "carried_0", "spans"):
        clash = clash.withColumn(name, F.lit(name))
    got = deduplicate(clash).collect()
    assert {r.doc_id: r.text for r in got} == out and all(r[c] == c for r in got for c in clash.columns[3:])


def test_repeated_rows_and_ids(spark):
    line = " ".join(f"word{i}" for i in range(20))
    rows = [(5, line), (5, line), (5, f"{line} more"), (9, f"{line} more"), (9, f"{line} more"), (9, None), (None, line), (None, line)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, digests(df).collect()), key=str) == brute(rows, 13)


def test_empty(spark):
    assert digests(spark.createDataFrame([], SCHEMA)).count() == 0
