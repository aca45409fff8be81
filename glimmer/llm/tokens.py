"""Encoding whole texts to token ids and back, by document."""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ENCODED_BYTES, bpe
from .common import arrow_map


def _texts(columns: dict[str, list]) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in columns["text"]]


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))


def encode(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None
) -> DataFrame:
    """``id_col, ids, n_tokens`` of every row: ids as little-endian unsigned 32-bit integers.

    ``vocabulary`` is the path of a vocabulary file, the same on every machine.
    A null text is an empty one, which has no ids but ``end_id`` if one is
    given; repeated rows come back as often as they came.
    """
    end = b"" if end_id is None else end_id.to_bytes(4, "little")

    def rows(columns):
        ids = [i + end for i in bpe(vocabulary).ids(_texts(columns))]
        yield {"id": columns["id"], "ids": ids, "n_tokens": [len(i) // 4 for i in ids]}

    out = arrow_map(_narrow(docs, id_col, text_col), rows, "id long, ids binary, n_tokens long", weight="text", slice_bytes=ENCODED_BYTES)
    return out.withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, text``: the text of each row's ids, special tokens included; null ids give an empty text."""

    def rows(columns):
        own = bpe(vocabulary)
        yield {"id": columns["id"], "text": [own.decode(i or b"") for i in columns["ids"]]}

    narrow = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return arrow_map(narrow, rows, "id long, text string", weight="ids").withColumnRenamed("id", id_col)


def round_trip_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256``: encodes and decodes without leaving the task."""

    def rows(columns):
        own = bpe(vocabulary)
        ids = own.ids(_texts(columns))
        yield {
            "id": columns["id"],
            "n_tokens": [len(i) // 4 for i in ids],
            "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
            "decoded_sha256": [hashlib.sha256(own.decode(i).encode()).hexdigest() for i in ids],
        }

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return arrow_map(_narrow(docs, id_col, text_col), rows, schema, weight="text", slice_bytes=ENCODED_BYTES).withColumnRenamed("id", id_col)


def crc32(data: bytes) -> int:
    """Unsigned CRC-32."""
    return zlib.crc32(data) & 0xFFFFFFFF
