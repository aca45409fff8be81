"""Exact substring deduplication: repeated windows of words, found by FM-indexes.

Every window of words has an anchor, the least hash among the short word groups
inside it.  Equal windows have equal anchors, so only stretches whose anchor
stands in several documents can hold a repeated window; they are dealt out to
shards by their anchor.  In each shard the stretches of the smaller documents are
indexed and those of larger documents are streamed through: backward search gives
their matching statistics, and the intervals where a match reaches the window are
reported.

An anchor whose stretches would outgrow a shard is dealt out by whole windows
instead: its distinct windows are spread over index shards by their hash, and the
documents' windows are streamed through them in as many blocks as they need.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, materialize, trim
from .fmindex import FmIndex

#: Words of a window, and of the groups whose least hash is a window's anchor.
WINDOW, GROUP = 13, 5
#: Words of a shard's stretches, about; an anchor whose stretches hold more is dealt out by windows.
SHARD_WORDS = 400_000
#: Windows of a stretch at most; a longer one is cut, into stretches that overlap by a window less one word.
STRETCH = 64
#: Parts of a shard, by document: each is indexed, and the parts after it are streamed through.
PARTS = 2
#: Bytes of compressed texts that are unpacked side by side.
PACKED_BYTES = 300_000
#: What stands for a null id: larger than all, so that it is no other document's smaller one.
NO_ID = (1 << 63) - 1

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64) | 1 for i in range(32)], np.uint64)
#: Bytes whose words are hashed together, the base of their polynomial, and its powers and their inverses.
_BLOCK, _BASE = 1 << 18, 0xD6E8FEB86659FD93


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    up, down = (np.full(_BLOCK, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(joined: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text that are joined by single spaces.

    A word's hash is a polynomial of its bytes modulo 2**64, a difference of two
    prefix sums.  Words that share a hash make stretches meet that needn't; what
    is equal is decided by the words themselves.
    """
    if not joined:
        return np.zeros(0, np.uint64)
    text = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero(text == 0x20)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(text))
    up, down = _powers()
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        first = int(starts[at])
        stop = int(np.searchsorted(ends, first + _BLOCK, side="right"))
        if stop == at:  # longer than a block
            out[at] = xxhash.xxh64_intdigest(joined[first : int(ends[at])])
            at += 1
            continue
        part = text[first : int(ends[stop - 1])]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        s, e = starts[at:stop] - first, ends[at:stop] - first
        out[at:stop] = (sums[e] - sums[s]) * down[s]
        at = stop
    return out


def anchors(joined: bytes, window: int = WINDOW, group: int = GROUP) -> np.ndarray:
    """The anchor of each window of a text whose words are joined by single spaces, as signed longs."""
    h = word_hashes(joined)
    if len(h) < window:
        return np.zeros(0, np.int64)
    n = len(h) - group + 1
    g = np.zeros(n, np.uint64)
    for i in range(group):
        g += h[i : i + n] * _MULTIPLIERS[i]
    g ^= g >> np.uint64(31)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(29)
    least, span = g, 1
    while span * 2 <= window - group + 1:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    rest = window - group + 1 - span
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    return least.view(np.int64)


def _runs(anchor: np.ndarray, chosen: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of windows with one anchor, among those that are chosen: first window, and the one after the last."""
    edge = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]))) if len(anchor) else np.zeros(0, np.int64)
    stops = np.append(edge[1:], len(anchor))
    for a, b in zip(edge[chosen[edge]].tolist(), stops[chosen[edge]].tolist(), strict=True):
        for at in range(a, b, STRETCH):
            yield at, min(b, at + STRETCH)


def _weights(anchor: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct anchors, and the words of each one's stretches."""
    if not len(anchor):
        return anchor, anchor
    edge = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    words = np.diff(np.append(edge, len(anchor))) + window - 1
    own, which = np.unique(anchor[edge], return_inverse=True)
    return own, np.bincount(which, words).astype(np.int64)


def _store(docs: DataFrame, id_col: str, text_col: str, window: int, group: int, carry: list[str]) -> DataFrame:
    """A table of each row's text, compressed, with its anchors, under a number ``row`` of its own.

    ``digest`` is the text's SHA-256.  The columns ``carry`` go along as
    ``carried_0`` and so on.  The texts are neither shuffled nor sorted here.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    along = [F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)]
    names = [f"carried_{i}" for i in range(len(carry))]
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), doc, text.cast("binary").alias("text"), F.col(text_col).isNull().alias("is_null"), *along
    )

    def over(columns):
        out = {k: [] for k in ("digest", "n_words", "sha", "words", "anchors", "weights")}
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for t in columns["text"]:
            words = t.split()
            joined = b" ".join(words)
            own, weights = _weights(anchors(joined, window, group), window)
            sha = hashlib.sha256(joined).hexdigest()
            made = (hashlib.sha256(t).digest(), len(words), sha, squeeze(t), own.tolist(), weights.tolist())
            for k, v in zip(out, made, strict=True):
                out[k].append(v)
        yield out | {k: columns[k] for k in ("row", "doc", "is_null", *names)}

    schema = "row long, doc long, is_null boolean, digest binary, n_words long, sha string, words binary, anchors array<long>, weights array<int>"
    schema += "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, carry, strict=True))
    return materialize(arrow_map(rows, over, schema, weight="text"), "words")


def _copies(stored: DataFrame) -> DataFrame:
    """``row, doc, of, of_doc`` of the rows whose text stands elsewhere too: ``of`` is its first row, by document.

    A row whose text a smaller document has word for word needs no search: it
    loses all its words if it has a window of them.  One that stands again in its
    own document fares as the first.
    """
    narrow = stored.select("row", "doc", "digest")
    first = narrow.groupBy("digest").agg(F.min(F.struct("doc", "row")).alias("first"), F.count("*").alias("n"))
    # tables, so that the join's two sides are plain exchanges and a text that many documents share can be split
    first = materialize(first.where("n > 1").select("digest", F.col("first.row").alias("of"), F.col("first.doc").alias("of_doc")), "first")
    return materialize(narrow.join(first, "digest").where("row <> of").select("row", "doc", "of", "of_doc"), "copies")


def _text(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob) if blob else b""


def repeated(stored: DataFrame, copies: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """``row, start, stop``: stretches of words covered by windows that also start in a document with a smaller id.

    Rows of ``copies`` take no part.
    """
    sought = stored.join(copies.select("row"), "row", "left_anti")
    each = sought.select("row", F.explode(F.arrays_zip("anchors", "weights")).alias("a")).select("row", "a.anchors", "a.weights")
    common = each.groupBy("anchors").agg(F.count("*").alias("n"), F.sum("weights").alias("n_words")).where("n > 1")
    # blocks of windows that an anchor needs: 0 for those that go to a shard whole
    blocks = F.when(F.col("n_words") > SHARD_WORDS, F.ceil(F.col("n_words") / SHARD_WORDS)).otherwise(0).cast("int")
    common = materialize(common.select("anchors", "n_words", blocks.alias("blocks")), "common")
    lists = each.join(common, "anchors").groupBy("row").agg(F.collect_list(F.struct("anchors", "blocks")).alias("shared"))
    lists = materialize(lists, "lists")  # of each row at most as many as it has anchors
    sizes = common.agg(
        F.sum(F.when(F.col("blocks") == 0, F.col("n_words"))).alias("cold"), F.sum(F.when(F.col("blocks") > 0, F.col("n_words"))).alias("hot")
    ).first()
    n_cold, n_hot = (max(1, -(-(n or 0) // SHARD_WORDS)) for n in (sizes.cold, sizes.hot))

    def stretches(columns):
        out = {k: [] for k in ("row", "doc", "shard", "block", "starts", "content")}
        for row, doc, blob, shared in zip(*(columns[k] for k in ("row", "doc", "words", "shared")), strict=True):
            words = _text(blob).split()
            own = anchors(b" ".join(words), window, group)
            blocks = {s["anchors"]: s["blocks"] for s in shared}
            kind = np.fromiter((blocks.get(a, -1) for a in own.tolist()), np.int64, len(own))
            made: dict[tuple[int, int, bytes], list[int]] = {}  # a stretch that comes again in a document counts once
            for a, b in _runs(own, kind == 0):
                made.setdefault((int(own[a]) % n_cold, 0, b" ".join(words[a : b + window - 1])), []).append(a)
            for i in np.flatnonzero(kind > 0).tolist():
                content = b" ".join(words[i : i + window])
                shard = n_cold + xxhash.xxh3_64_intdigest(content) % n_hot
                block = xxhash.xxh3_64_intdigest(row.to_bytes(8, "little")) % int(kind[i])
                made.setdefault((shard, block, content), []).append(i)
            out["row"] += [row] * len(made)
            out["doc"] += [doc] * len(made)
            for k, values in zip(("shard", "block", "content"), zip(*made, strict=True) if made else ((),) * 3, strict=True):
                out[k] += values
            out["starts"] += made.values()
        yield out

    schema = "row long, doc long, shard long, block int, starts array<int>, content binary"
    with_lists = stored.select("row", "doc", "words").join(lists, "row")
    found = arrow_map(with_lists, stretches, schema, weight="words", slice_bytes=PACKED_BYTES)
    if sizes.hot:
        found = materialize(found, "stretches")
    cold = found.where(F.col("shard") < n_cold).drop("block").repartition(_tasks(n_cold), "shard")
    out, used = cold.groupBy("shard").applyInArrow(lambda rows: _search(rows, window), _SPANS), [common, lists]
    if sizes.hot:
        hot = found.where(F.col("shard") >= n_cold)
        least = hot.groupBy("shard", "content").agg(F.min("doc").alias("doc"))  # combined before the shuffle
        indexes = least.groupBy("shard").applyInArrow(lambda rows: _built(rows, window), "shard long, index binary")
        indexes = materialize(indexes, "indexes")
        asked = materialize(hot.select("shard", "block").distinct().join(indexes, "shard"), "asked")
        keys = ("shard", "block")
        n = _tasks(asked.count())
        both = asked.repartition(n, *keys).groupBy(*keys).cogroup(hot.repartition(n, *keys).groupBy(*keys))
        out = out.unionByName(both.applyInArrow(lambda index, rows: _streamed(index, rows, window), _SPANS))
        used += [found, indexes, asked]
    out = materialize(out, "repeated")
    discard(*used)
    return out


_SPANS = "row long, start long, stop long"


def _tasks(n_groups: int) -> int:
    """Partitions for so many groups of bounded size."""
    return max(1, min(100_000, n_groups))


def _numbered(contents: list[bytes], alphabet: dict[bytes, int], new: bool) -> list[np.ndarray]:
    """Sequences of symbols; words that the alphabet hasn't are added to it, or else -1."""
    if new:
        return [np.fromiter((alphabet.setdefault(w, len(alphabet) + 1) for w in c.split()), np.int64) for c in contents]
    return [np.fromiter((alphabet.get(w, -1) for w in c.split()), np.int64) for c in contents]


def _covered(index: FmIndex, sequences: list[np.ndarray], below: np.ndarray, window: int) -> list[np.ndarray]:
    """Of each sequence, of each window, whether the index has it with a value under the sequence's ``below``."""
    sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
    length, least = index.matches(np.concatenate(sequences) if sequences else np.zeros(0, np.int64), sizes)
    smaller = (length >= window) & (least < np.repeat(below, sizes))
    return [smaller[stop - n : stop - window + 1] for n, stop in zip(sizes.tolist(), np.cumsum(sizes).tolist(), strict=True)]


def _spans(row: np.ndarray, starts: list[list[int]], covered: list[np.ndarray], window: int) -> pa.Table:
    """The intervals of covered windows, wherever a row has the stretch."""
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    for r, at, smaller in zip(row.tolist(), starts, covered, strict=True):
        if not smaller.any():
            continue
        turns = np.flatnonzero(np.diff(np.concatenate([[False], smaller, [False]])))
        for a, b in turns.reshape(-1, 2).tolist():
            for s in at:
                out[0].append(r)
                out[1].append(s + a)
                out[2].append(s + b - 1 + window)
    return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("row", "start", "stop"), out, strict=True)})


def _search(rows: pa.Table, window: int) -> pa.Table:
    """One shard.  A stretch that smaller documents have too is covered; the first ones are searched for their windows.

    The documents are taken in ``PARTS`` parts of about as many words, smaller
    ids first.  Of each part those stretches are indexed that aren't covered yet;
    its own and all later stretches are streamed through the index.
    """
    doc, row = (rows.column(k).to_numpy() for k in ("doc", "row"))
    contents = rows.column("content").to_pylist()
    number: dict[bytes, int] = {}
    which = np.fromiter((number.setdefault(c, len(number)) for c in contents), np.int64, len(doc))
    least = np.full(len(number), NO_ID, np.int64)
    np.minimum.at(least, which, doc)
    alphabet: dict[bytes, int] = {}
    sequences = _numbered(list(number), alphabet, new=True)
    covered = [np.zeros(len(s) - window + 1, bool) for s in sequences]
    order = np.argsort(least, kind="stable")
    sizes = np.fromiter((len(sequences[i]) for i in order.tolist()), np.int64, len(order))
    part = (np.cumsum(sizes) - 1) * PARTS // max(1, int(sizes.sum()))
    by_doc = least[order]
    part = part[np.searchsorted(by_doc, by_doc)]  # a document is in one part
    for p in range(PARTS):
        own = [i for i in order[part == p].tolist() if not covered[i].all()]
        later = [i for i in order[part > p].tolist() if not covered[i].all()]
        if not own:
            continue
        index = FmIndex([sequences[i] for i in own], least[own], len(alphabet) + 1, window)
        asked = own + later
        for i, smaller in zip(asked, _covered(index, [sequences[i] for i in asked], least[asked], window), strict=True):
            covered[i] |= smaller
    trim()
    whole = [np.ones(len(c), bool) for c in covered]
    answers = [whole[w] if d > least[w] else covered[w] for w, d in zip(which.tolist(), doc.tolist(), strict=True)]
    return _spans(row, rows.column("starts").to_pylist(), answers, window)


def _built(rows: pa.Table, window: int) -> pa.Table:
    """The index of one shard's distinct windows with the least document of each, as bytes."""
    alphabet: dict[bytes, int] = {}
    contents = rows.column("content").to_pylist()
    sequences = _numbered(contents, alphabet, new=True)
    index = FmIndex(sequences, rows.column("doc").to_numpy(), len(alphabet) + 1, window)
    names = zstandard.ZstdCompressor(level=1).compress(b" ".join(alphabet))
    data = len(names).to_bytes(8, "little") + names + index.to_bytes()
    return pa.table({"shard": pa.array([rows.column("shard")[0].as_py()], pa.int64()), "index": pa.array([data], pa.binary())})


def _streamed(index: pa.Table, rows: pa.Table, window: int) -> pa.Table:
    """Documents' windows, streamed through a shard's index."""
    if not rows.num_rows:
        return _spans(np.zeros(0, np.int64), [], [], window)
    data = index.column("index")[0].as_py()
    cut = 8 + int.from_bytes(data[:8], "little")
    alphabet = {w: i + 1 for i, w in enumerate(zstandard.ZstdDecompressor().decompress(data[8:cut]).split())}
    doc, row = (rows.column(k).to_numpy() for k in ("doc", "row"))
    sequences = _numbered(rows.column("content").to_pylist(), alphabet, new=False)
    covered = _covered(FmIndex.from_bytes(data[cut:]), sequences, doc, window)
    return _spans(row, rows.column("starts").to_pylist(), covered, window)


def _kept(docs: DataFrame, id_col: str, text_col: str, window: int, group: int, carry: list[str] | None = None) -> DataFrame:
    """``doc, n_words, n_removed, kept_sha256`` of every row; with ``carry`` its text and those columns too."""
    stored = _store(docs, id_col, text_col, window, group, carry or [])
    names = [f"carried_{i}" for i in range(len(carry or []))]
    copies = _copies(stored)
    found = repeated(stored, copies, window, group)
    spans = materialize(found.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")
    again = copies.join(spans.withColumnRenamed("row", "of"), "of", "left")
    again = again.select("row", (F.col("doc") > F.col("of_doc")).alias("copy"), "spans")
    known = materialize(spans.select("row", F.lit(False).alias("copy"), "spans").unionByName(again), "known")
    discard(found, spans, copies)

    def finish(columns):
        out = {k: [] for k in ("doc", "n_words", "n_removed", "kept_sha256", "kept")}
        for i, doc in enumerate(columns["doc"]):
            n, spans, copy = columns["n_words"][i], columns["spans"][i], columns["copy"][i]
            removed, sha, kept = 0, columns["sha"][i], None
            if copy and n >= window:
                removed, sha, kept = n, _SHA_OF_NONE, b""
            elif spans and not copy:
                words = _text(columns["words"][i]).split()
                gone = np.zeros(n + 1, np.int64)
                np.add.at(gone, [s["start"] for s in spans], 1)
                np.add.at(gone, [s["stop"] for s in spans], -1)
                there = np.cumsum(gone[:-1]) == 0
                kept = b" ".join([words[j] for j in np.flatnonzero(there).tolist()])
                removed, sha = n - int(there.sum()), hashlib.sha256(kept).hexdigest()
            elif carry is not None:
                kept = _text(columns["words"][i])
            kept = kept.decode("utf-8", "replace") if carry is not None and not columns["is_null"][i] else None
            for k, v in zip(out, (None if doc == NO_ID else doc, n, removed, sha, kept), strict=True):
                out[k].append(v)
        yield out | {k: columns[k] for k in names}

    schema = "doc long, n_words long, n_removed long, kept_sha256 string, kept string"
    schema += "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, carry or [], strict=True))
    joined = stored.select("row", "doc", "is_null", "n_words", "sha", "words", *names).join(known, "row", "left")
    return arrow_map(joined, finish, schema, weight="words", slice_bytes=PACKED_BYTES)


_SHA_OF_NONE = hashlib.sha256().hexdigest()


def digests(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group: int = GROUP
) -> DataFrame:
    """``id_col, n_words, n_removed, kept_sha256`` of every row.

    Each word that a window covers whose words also start in a document with a
    smaller id is removed; windows are judged on the input.  A null text has no
    words; a document of fewer words than a window keeps them; rows of one id
    don't remove each other's words, and repeated rows come back as often as they
    came; a null id is larger than all others; texts of any length are taken
    whole; an empty table gives an empty table; other columns, whatever their
    names, play no part.
    """
    out = _kept(docs, id_col, text_col, window, group)
    return out.select(F.col("doc").alias(id_col), "n_words", "n_removed", "kept_sha256")


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group: int = GROUP
) -> DataFrame:
    """``docs`` with the removed words taken out; texts that lose none stay as they are, others are joined by one space.

    A null text stays null.  All other columns, whatever their names, go along
    with the texts, so that nothing is joined back.
    """
    others = [c for c in docs.columns if c != text_col]
    out = _kept(docs, id_col, text_col, window, group, others)
    back = {c: F.col(f"carried_{i}") for i, c in enumerate(others)} | {text_col: F.col("kept")}
    return out.select(*[back[c].alias(c) for c in docs.columns])
