import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glimmer.llm import bpe as module
from glimmer.llm.bpe import Bpe
from glimmer.llm.tokens import decode, encode, round_trip_digests

NAMES = ("word_bpe_49k.json", "byte_bpe_50k.json")
BOTH = {n: (Bpe(public_tokenizers.path(n)), Tokenizer.from_file(public_tokenizers.path(n))) for n in NAMES}
ODD = [
    "", " ", "\n\n a  b c\x1c\x1d d\x85e", "<|endoftext|>", "x<|startoftext|>y <|endoftext|>z", "<|foo|> it's They'LL 'S",
    "ΑΣ ΣΑΣ. Σ", "İstanbul", "é ẞ̣", "​zero width", "日本語テキスト", "a" * 5000 + "b" * 300,
    "ha" * 3000, "🎉👩‍👩‍👧 ok", "ﬁₕ֋", "don't DON'T 123 4.5", "aaa aaaa aaaaa aaaaaa",
]


def check(name, texts):
    own, library = BOTH[name]
    for text, ids, wanted in zip(texts, own.ids(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == wanted.ids, ascii(text[:200])
        assert own.decode(ids) == library.decode(wanted.ids, skip_special_tokens=False)


@pytest.mark.parametrize("name", NAMES)
def test_odd_texts(name):
    check(name, ODD)


@pytest.mark.parametrize("name", NAMES)
def test_every_character(name):
    chars = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    check(name, ["a" + "b".join(chars[i : i + 64]) + " z" for i in range(0, len(chars), 64)])


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aabinthers é'1\n", max_size=60), max_size=5))
def test_random_texts(name, texts):
    check(name, texts)


@pytest.mark.parametrize("name", NAMES)
def test_pair_test_is_exact(name):
    own, _ = BOTH[name]
    rnd, vocab = random.Random(3), list(own.vocab)
    firsts = [t for t in vocab if not own.suffix or not t.endswith(own.suffix)]
    lasts = [t for t in vocab if not own.suffix or t.endswith(own.suffix)]
    pairs = [(rnd.choice(firsts), rnd.choice(lasts)) for _ in range(3000)]
    pairs += [(a, b) for a, b in list(own._ranks)[:3000] if not own.suffix or b.endswith(own.suffix)]
    got = own.fits(np.array([own.vocab[a] for a, _ in pairs]), np.array([own.vocab[b] for _, b in pairs]))
    for (a, b), fit in zip(pairs, got.tolist(), strict=True):
        assert fit == (own.merge((a + b).removesuffix(own.suffix)) == [own.vocab[a], own.vocab[b]]), (a, b)


def test_merge_short_and_long_agree(monkeypatch):
    own, _ = BOTH[NAMES[1]]
    words = ["thanedble", "ththintinthng", "aaaaaaaaaaaaaaa", "banananananas"]
    short = [own.merge(w) for w in words]
    monkeypatch.setattr(module, "_SHORT", 0)
    assert [own.merge(w) for w in words] == short


@pytest.mark.parametrize("name", NAMES)
def test_long_words_are_proposed_and_verified_too(name):
    own, library = Bpe(public_tokenizers.path(name)), BOTH[name][1]
    words = ["information" * 40, "a" * 200, "then" * 500, "qxz" * 100]
    made = own.encode_words(words)
    assert own.counts["merged"] < len(words)
    for w in words:
        assert np.frombuffer(made[w], "<u4").tolist() == library.encode(w, add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
def test_without_speculation(name):
    own, library = Bpe(public_tokenizers.path(name), speculate=False), BOTH[name][1]
    rnd = random.Random(4)
    texts = [*ODD, *("".join(rnd.choice("aabinthers é'1\n") for _ in range(300)) for _ in range(200))]
    for ids, wanted in zip(own.ids(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == wanted.ids


def test_small_store_of_words(monkeypatch):
    monkeypatch.setattr(module, "WORDS_KEPT", 5)
    own = Bpe(public_tokenizers.path(NAMES[0]))
    texts = [f"word{i} then word{i + 1} and again the word" for i in range(50)]
    wanted = BOTH[NAMES[0]][1].encode_batch(texts, add_special_tokens=False)
    for text, w in zip(texts, wanted, strict=True):
        assert np.frombuffer(own.ids([text])[0], "<u4").tolist() == w.ids


def test_query_over_documents(spark):
    path, (own, library) = public_tokenizers.path(NAMES[0]), BOTH[NAMES[0]]
    rows = [(i, t) for i, t in enumerate(ODD)] + [(1, ODD[1]), (None, "no id"), (99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {(r.doc_id, r.ids_sha256, r.n_tokens, r.decoded_sha256) for r in round_trip_digests(df, path).collect()}
    for doc, text in rows:
        e = library.encode(text or "", add_special_tokens=False)
        raw, back = np.array(e.ids, "<u4").tobytes(), library.decode(e.ids, skip_special_tokens=False)
        assert (doc, hashlib.sha256(raw).hexdigest(), len(e.ids), hashlib.sha256(back.encode()).hexdigest()) in got
    coded = encode(df, path, end_id=2)
    assert {r.doc_id: r.n_tokens for r in coded.collect()}[99] == 1
    back = {r.doc_id: r.text for r in decode(encode(df, path), path).collect()}
    assert back[5] == own.decode(own.ids([ODD[5]])[0])
    assert encode(df.limit(0), path).count() == 0
