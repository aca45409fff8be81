import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glimmer.llm.packing import Plan, assemble, best_subset, pack
from glimmer.llm.tokens import crc32, encode

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def test_best_subset_is_optimal():
    rnd = random.Random(0)
    for _ in range(300):
        counts = {rnd.randint(1, 30): rnd.randint(0, 3) for _ in range(rnd.randint(0, 5))}
        room = rnd.randint(0, 60)
        chosen = best_subset(counts, room)
        assert all(counts[n] >= k for n, k in chosen.items())
        sums = {sum(n * k for n, k in zip(counts, ks, strict=True)) for ks in itertools.product(*(range(c + 1) for c in counts.values()))}
        assert sum(n * k for n, k in chosen.items()) == max(s for s in sums if s <= room)


@pytest.mark.parametrize("capacity", [2, 16, 100])
def test_plan_places_every_token_once(capacity):
    rnd = random.Random(capacity)
    for trial in range(60):
        lengths = [rnd.randint(1, capacity) for _ in range(rnd.choice([0, 1, 5, 200]))]
        if trial % 3 == 0:
            lengths = [max(1, capacity * 3 // 4)] * len(lengths)  # nothing fits together
        histogram = {n: lengths.count(n) for n in set(lengths)}
        plan = Plan(histogram, capacity)
        items = [(n, r) for n, c in histogram.items() for r in range(c)]
        a = np.array([n for n, _ in items], np.int64)
        seqs, covered = {}, [[] for _ in items]
        for which, start, size, seq, off in plan.place(a, np.array([r for _, r in items], np.int64)):
            for w, s, z, q, o in zip(*(x.tolist() for x in (which, start, size, seq, off)), strict=True):
                covered[w].append((s, z))
                seqs.setdefault(q, []).append((o, z))
        for (n, _), parts in zip(items, covered, strict=True):
            at = 0
            for s, z in sorted(parts):
                assert s == at
                at += z
            assert at == n
        for parts in seqs.values():
            at = 0
            for o, z in sorted(parts):
                assert o == at
                at += z
            assert at == capacity or at & (at - 1) == 0
        assert sorted(seqs) == list(range(plan.sequences))
        assert len(seqs) <= sum(lengths) // capacity + capacity.bit_length()


def test_pack_documents(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice("the cat sat on a mat anea thon".split()) for _ in range(rnd.randint(0, 90)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "word " * 700), (7, "a second text of one id"), (8, rows[8][1]), (None, "no id here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1)).repartition(3)
    got = [r.asDict() for r in pack(df, PATH, 2, capacity=64).collect()]
    ids = {}
    for doc, text in rows:
        ids.setdefault(doc, []).append(np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2], "<u4"))
    assert sum(r["length"] for r in got) == sum(len(x) for v in ids.values() for x in v)
    for r in got:
        assert any(
            len(x) == r["doc_tokens"] and crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
            for x in ids[r["doc_id"]]
        )
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == 64 or at & (at - 1) == 0
    assert pack(df.limit(0), PATH, 2).count() == 0


def test_assemble(spark):
    df = spark.createDataFrame([(i, f"the cat {i} sat " * (i % 30)) for i in range(60)], "doc_id long, text string")
    packed = pack(df, PATH, 2, capacity=128).cache()
    tokens = encode(df, PATH, end_id=2).cache()
    whole = {r.doc_id: r.ids for r in tokens.collect()}
    rows = packed.collect()
    for r in assemble(tokens, packed).collect():
        mine = sorted((p.offset, whole[p.doc_id][4 * p.start : 4 * (p.start + p.length)]) for p in rows if p.sequence_id == r.sequence_id)
        assert bytes(r.ids) == b"".join(bytes(x) for _, x in mine)
