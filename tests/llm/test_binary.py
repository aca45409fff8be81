import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from glimmer.llm import binary
from glimmer.llm.tokens import crc32

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def coded(text):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def test_round_trip(spark, tmp_path, monkeypatch):
    rows = [(7 * i - 50, f"document {i} says {'so ' * (i % 9)}") for i in range(100)]
    rows += [(1000, None), (1001, ""), (1002, "x " * 20000), (1003, "\0\0 zero bytes \0"), (1003, "\0\0 zero bytes \0"), (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for dtype in ("<u2", "<u4"):
        path = f"file://{tmp_path}/{dtype[1:]}"
        files = binary.write(df, path, PATH, 2, dtype, tokens_per_file=100, task_bytes=4000)
        got = sorted(map(tuple, binary.read_documents(spark, path).collect()), key=lambda r: r[1])
        want, start = [], 0
        for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
            ids = coded(text)
            want.append((doc, start, len(ids), crc32(ids.tobytes())))
            start += len(ids)
        assert got == want
        store = binary.TokenStore(path)
        assert len(store) == len(rows) and files.count() == len(store.files) > 3
        flat = np.concatenate([i for i in store._ids])
        assert flat.dtype == np.dtype(dtype)
        assert flat.tolist() == np.concatenate([coded(t) for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0]))]).tolist()
        for i in (0, 1, 50, len(rows) - 1):
            doc, ids = store.document(i)
            assert (None if doc == binary.NULL_ID else doc, crc32(ids.astype("<u4").tobytes())) == (want[i][0], want[i][3])
        assert [f["n_tokens"] for f in store.files] == [len(i) for i in store._ids]
    bare = f"{tmp_path}/u4"  # without a scheme: on the session's own file system
    assert sorted(map(tuple, binary.read_documents(spark, bare).collect()), key=lambda r: r[1]) == want
    monkeypatch.setattr(binary, "local_file", lambda path: None)  # a file system that can't be mapped
    assert sorted(map(tuple, binary.read_documents(spark, path).collect()), key=lambda r: r[1]) == want


def test_one_id_and_one_row_many_times_are_split(spark, tmp_path):
    rows = [(5, f"text {i}") for i in range(300)] + [(5, "the same again")] * 300 + [(None, "no id")] * 200 + [(-1, "first"), (9, "last")]
    df = spark.createDataFrame([(i, t, -1, "x", 0.5) for i, t in rows], "doc_id long, text string, row int, hash string, doc double")
    path = f"file://{tmp_path}/hot"
    files = binary.write(df.repartition(3), path, PATH, 2, tokens_per_file=200, task_bytes=500).orderBy("file_no").collect()
    assert max(f.n_docs for f in files) < 200 and len({f.file_no >> 32 for f in files}) > 10
    assert [f.base for f in files] == [sum(g.n_tokens for g in files[:i]) for i in range(len(files))]
    assert all(f.n_tokens < 200 + max(len(coded(t)) for _, t in rows) for f in files)
    got = binary.read_documents(spark, path).orderBy("start").collect()
    assert [r.start for r in got] == [sum(s.n_tokens for s in got[:i]) for i in range(len(got))]
    assert [r.doc_id for r in got] == [None] * 200 + [-1] + [5] * 600 + [9]
    assert sorted(r.ids_crc32 for r in got) == sorted(crc32(coded(t).tobytes()) for _, t in rows)


def test_empty_and_errors(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    binary.write(df, f"file://{tmp_path}/none", PATH, 2)
    assert binary.read_documents(spark, f"file://{tmp_path}/none").count() == 0
    with pytest.raises(ValueError):
        binary.write(df, f"file://{tmp_path}/bad", PATH, 300)
