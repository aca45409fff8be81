"""Token files: flat unsigned integers, and 64-bit document offsets.

A store is a folder with

``kind=ids/file_no=K/*``
    the ids of file K's documents, one after the other, little-endian unsigned
    16- or 32-bit integers and nothing else;
``kind=offsets/file_no=K/*``
    three little-endian 64-bit integers for each document of file K: its id, the
    place of its first token in file K and the place after its last;
``kind=sizes/file_no=0/*``
    three little-endian 64-bit integers for each file: its number, its tokens and
    its documents, as the tasks that wrote them counted;
``files``
    a table ``file_no, base, n_tokens, n_docs, dtype``; ``base`` is the number of
    tokens in all files before, the prefix sum of their sizes.

Documents stand in ascending id order over all files, and none crosses a file's
end.  A file is closed by the document that brings it to its number of tokens, so
its size depends neither on the number nor on the length of documents.  All files
are written by Spark's own writer in one pass over the encoded texts, so a lost
executor's tasks are simply run again, and any file system that Spark writes to
will do.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import ENCODED_BYTES, bpe
from .common import slices, spread
from .tokens import crc32

#: Tokens that close a file.
TOKENS_PER_FILE = 1 << 24
#: Bytes of text for each writing task, and such tasks at most; beyond, tasks take more texts and write more files.
TASK_BYTES, TASKS = 16 << 20, 100_000
#: Files that a writing task may number.
_NUMBERS = 1 << 32
#: What stands for a null id, which comes first.
NULL_ID = -(1 << 63)


def write(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int,
    dtype: str = "<u2",
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens_per_file: int = TOKENS_PER_FILE,
    task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """Encode ``docs`` into a store at ``path`` and return its table of files.

    Each document's ids are followed by ``end_id``, which must be under 2**8
    (16-bit ids) or 2**24 (32-bit ids); ids over the type's range are an error.
    A null text is an empty one, which has its end id only; texts of any length
    are taken whole; rows of one id stand in the order of a hash of their texts;
    a null id comes first; other columns, whatever their names, play no part; an
    empty table gives a store without files.

    Rows are dealt out by ranges of id, hash and their own place in the table, so
    that an id or a row that stands many times is split, and sorted, then encoded
    in that order.  Each document becomes a row for the ids file and one for the
    offsets file, which the text writer sets side by side.  Every record's last
    byte is zero: it is left out and comes back as the writer's line end, so that
    the files hold the integers and nothing else.
    """
    spark = docs.sparkSession
    width = np.dtype(dtype).itemsize
    if not 0 <= end_id < 1 << (8 * width - 8):
        raise ValueError("the end id's last byte must be zero")
    top = np.iinfo(np.dtype(dtype)).max
    end = np.array([end_id], dtype).tobytes()

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() * _NUMBERS
        file_no, place, n = first, 0, 0
        own = bpe(vocabulary, speculate=False)

        def records(kinds: list[str], numbers: list[int], nth: list[int], values: list[bytes]) -> pa.RecordBatch:
            arrays = [pa.array(kinds), pa.array(numbers, pa.int64()), pa.array(nth, pa.int64()), pa.array(values, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["kind", "file_no", "nth", "value"])

        def size() -> pa.RecordBatch:
            return records(["sizes"], [0], [file_no - first], [_record(file_no, place, n)])

        for batch in batches:
            for part in slices(batch, "text", ENCODED_BYTES):
                texts = [(t or b"").decode("utf-8", "replace") for t in part.column("text").to_pylist()]
                data, offsets, numbers, nth = [], [], [], []
                for doc, ids in zip(part.column("doc").to_pylist(), own.ids(texts), strict=True):
                    if place >= tokens_per_file:
                        yield size()
                        file_no, place, n = file_no + 1, 0, 0
                    a = np.frombuffer(ids, "<u4")
                    if len(a) and a.max() > top:
                        raise ValueError(f"an id doesn't fit in {dtype}")
                    data.append((a.astype(dtype).tobytes() + end)[:-1])
                    offsets.append(_record(doc, place, place + len(a) + 1))
                    numbers.append(file_no)
                    nth.append(n)
                    place, n = place + len(a) + 1, n + 1
                k = len(data)
                yield records(["ids"] * k + ["offsets"] * k, numbers * 2, nth * 2, data + offsets)
        if n:
            yield size()

    found = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col(text_col))).alias("bytes")).first()
    if not found.n:
        spark.createDataFrame([], _FILES).write.parquet(f"{path}/files")
        return spark.read.parquet(f"{path}/files")
    n_tasks = min(TASKS, -(-((found.bytes or 0) + found.n) // task_bytes))
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc")
    text = F.col(text_col).cast("binary").alias("text")
    keys = ["doc", "hash", "row"]
    dealt = docs.select(doc, text, F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"))
    dealt = dealt.repartitionByRange(n_tasks, *keys).sortWithinPartitions(*keys).select("doc", "text")
    rows = dealt.mapInArrow(over, "kind string, file_no long, nth long, value binary")
    rows = rows.sortWithinPartitions("kind", "file_no", "nth")
    rows = rows.select("kind", "file_no", F.col("value").cast("string").alias("value"))
    rows.write.partitionBy("kind", "file_no").option("lineSep", "\0").text(path)

    def sizes(frames):
        for frame in frames:
            for content in frame["content"]:
                yield pd.DataFrame(np.frombuffer(content, "<i8").reshape(-1, 3), columns=["file_no", "n_tokens", "n_docs"])

    counted = spark.read.format("binaryFile").load(f"{path}/kind=sizes/file_no=0").select("content")
    counted = counted.mapInPandas(sizes, "file_no long, n_tokens long, n_docs long")
    # one row for each file: a short table, whatever the documents
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base")
    files = counted.select("file_no", base, "n_tokens", "n_docs", F.lit(dtype).alias("dtype"))
    files.write.parquet(f"{path}/files")
    return spark.read.parquet(f"{path}/files")


def _record(*values: int) -> bytes:
    """Three 64-bit integers without the last byte, which the writer's line end stands for."""
    return np.array(values, "<i8").tobytes()[:-1]


_FILES = "file_no long, base long, n_tokens long, n_docs long, dtype string"


def _contents(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``file_no`` and the bytes of every file of a kind, which Spark lists and reads."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/kind={kind}")
    number = F.regexp_extract("path", r"file_no=(\d+)", 1).cast("long").alias("file_no")
    return found.select(number, F.col("content").alias(kind))


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the file system on which Spark finds it."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(own).toString()


def local_file(path: str) -> str | None:
    """The place of a ``file:`` path, which a machine sees by itself, or None."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else None


def _mapped(root: str, kind: str, file_no: int, dtype: str) -> np.ndarray:
    """A file of a store in a folder that this machine sees, memory-mapped."""
    folder = f"{root}/kind={kind}/file_no={file_no}"
    (name,) = [x for x in os.listdir(folder) if x.startswith("part-")]
    return np.memmap(f"{folder}/{name}", dtype=dtype, mode="r")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files of a store.

    Checksums are over the ids as little-endian unsigned 32-bit integers.  Each
    task memory-maps the offsets and the ids of its files, which it finds by their
    numbers; where the store's file system can't be mapped, Spark brings their
    bytes.  A null id is null again; an empty store gives an empty table.
    """
    files = spark.read.parquet(f"{path}/files")
    n_files = files.count()
    if not n_files:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    root = local_file(qualified(spark, path))
    if root is None:
        tables = files.join(_contents(spark, path, "offsets"), "file_no").join(_contents(spark, path, "ids"), "file_no")
    else:
        tables = files

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                (row,) = batch.slice(at, 1).to_pylist()
                if root is None:
                    ids, table = np.frombuffer(row["ids"], row["dtype"]), np.frombuffer(row["offsets"], "<i8")
                else:
                    ids, table = (_mapped(root, k, row["file_no"], t) for k, t in (("ids", row["dtype"]), ("offsets", "<i8")))
                table = table.reshape(-1, 3)
                if len(ids) != row["n_tokens"] or len(table) != row["n_docs"]:
                    raise ValueError(f"file {row['file_no']} is not as long as the table of files says")
                crcs = [crc32(ids[a:b].astype("<u4").tobytes()) for _, a, b in table.tolist()]
                columns = [table[:, 0], table[:, 1] + row["base"], table[:, 2] - table[:, 1], crcs]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    one = spread(tables, "file_no", n_files)
    out = one.mapInArrow(over, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))


class TokenStore:
    """A store in a folder that this machine sees, memory-mapped, for random access by a trainer."""

    def __init__(self, path: str) -> None:
        import pyarrow.dataset as ds

        root = local_file(path) or path
        files = ds.dataset(f"{root}/files", format="parquet", exclude_invalid_files=True).to_table()
        self.files = files.sort_by("file_no").to_pylist()
        self._ids = [_mapped(root, "ids", f["file_no"], f["dtype"]) for f in self.files]
        self._offsets = [_mapped(root, "offsets", f["file_no"], "<i8") for f in self.files]
        self._first_doc = np.cumsum([0, *(f["n_docs"] for f in self.files)])

    def __len__(self) -> int:
        return int(self._first_doc[-1])

    def document(self, i: int) -> tuple[int, np.ndarray]:
        """The id and the tokens of the document at place ``i`` of the id order."""
        k = int(np.searchsorted(self._first_doc, i, side="right")) - 1
        doc, start, stop = self._offsets[k].reshape(-1, 3)[i - self._first_doc[k]].tolist()
        return doc, self._ids[k][start:stop]
