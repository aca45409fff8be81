"""Packing documents into sequences by minimum bin slack over a length histogram.

Documents are cut at multiples of the capacity; what is planned is only the
histogram of the pieces' lengths, which has as many entries as a window has
tokens at most, however many documents there are.  Ranks within a length come
from a range-partitioned sort and prefix sums, so no length, however common,
meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import ENCODED_BYTES, bpe
from .common import arrow_map, materialize
from .tokens import crc32

#: Pieces that one task ranks.
PIECES_PER_RUN = 50_000
#: Place of a class in the sorted keys of the plan: class * _STRIDE + rank.
_STRIDE = 1 << 48


def best_subset(counts: dict[int, int], room: int) -> dict[int, int]:
    """Of the multiset ``counts`` (length: how many) the sub-multiset whose sum is nearest to ``room`` from below.

    Subset sums are bits of an integer; each length ORs in its copies by doubling
    steps, and the counts are found by walking back.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n in counts if n <= room and counts[n] > 0), reverse=True):
        left, k, before = min(counts[length], room // length), 1, reach
        while left:
            k = min(k, left)
            reach |= (reach << (length * k)) & mask
            left -= k
            k *= 2
        if reach != before:
            steps.append((length, before))
        if reach >> room:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        while not before >> at & 1:
            at -= length
            chosen[length] = chosen.get(length, 0) + 1
    return chosen


class Plan:
    """Where the pieces of each length go.

    ``records``: (length, first rank, how many, first sequence, offset, cut).  The
    r-th piece after the first goes to the r-th sequence after the first, at that
    offset: whole if ``cut`` is 0, else its first ``cut`` tokens, while the rest
    is a new piece of the remaining length, whose ranks follow those there were.
    """

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        if any(not 0 < n <= capacity for n in histogram):
            raise ValueError("pieces must have 1 to capacity tokens")
        self.capacity, self.sequences = capacity, 0
        self.records: list[tuple[int, int, int, int, int, int]] = []
        self._left = {n: c for n, c in sorted(histogram.items()) if c > 0}
        self._next = dict.fromkeys(self._left, 0)
        self._total = dict(self._left)
        while self._left:
            self._step()
        table = np.array(sorted(self.records), np.int64).reshape(-1, 6)
        self.keys, self.table = table[:, 0] * _STRIDE + table[:, 1], table

    def _take(self, length: int, times: int, sequence: int, offset: int, cut: int = 0) -> None:
        first = self._next[length]
        self.records.append((length, first, times, sequence, offset, cut))
        self._next[length] = first + times
        self._left[length] -= times
        if not self._left[length]:
            del self._left[length]
        if cut:  # the rests come back as pieces of their own length
            rest = length - cut
            self._left[rest] = self._left.get(rest, 0) + times
            self._next.setdefault(rest, 0)
            self._total[rest] = self._total.get(rest, 0) + times

    def _step(self) -> None:
        """One kind of window, as often as there are pieces for it."""
        largest = max(self._left)
        rest = dict(self._left)
        rest[largest] -= 1
        chosen = best_subset(rest, self.capacity - largest)
        chosen[largest] = chosen.get(largest, 0) + 1
        slack = self.capacity - sum(n * k for n, k in chosen.items())
        times = min(self._left[n] // k for n, k in chosen.items())
        cut = None
        if slack:
            over = {n: c - chosen.get(n, 0) for n, c in self._left.items() if c > chosen.get(n, 0)}
            if not over:  # the last pieces of all
                self._last()
                return
            cut = max(over)  # each is longer than the slack, or the subset would hold it
            times = min(times, self._left[cut] // (chosen.get(cut, 0) + 1))
        sequence, offset = self.sequences, 0
        for length in sorted(chosen, reverse=True):
            for _ in range(chosen[length]):
                self._take(length, times, sequence, offset)
                offset += length
        if cut:
            self._take(cut, times, sequence, offset, slack)
        self.sequences += times

    def _last(self) -> None:
        """What is left fills less than a window: sequences of powers of two, which need no padding."""
        total = sum(n * c for n, c in self._left.items())
        sizes = [1 << b for b in range(total.bit_length()) if total >> b & 1][::-1]
        for size in sizes:
            offset = 0
            while offset < size:
                length = max(self._left)
                cut = 0 if length <= size - offset else size - offset
                self._take(length, 1, self.sequences, offset, cut)
                offset += cut or length
            self.sequences += 1

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Rounds of (which piece, start within it, length, sequence, offset) for pieces given by length and rank."""
        which, start = np.arange(len(lengths)), np.zeros(len(lengths), np.int64)
        while len(which):
            row = self.table[np.searchsorted(self.keys, lengths * _STRIDE + ranks, side="right") - 1]
            nth, cut = ranks - row[:, 1], row[:, 5]
            size = np.where(cut > 0, cut, lengths)
            yield which, start, size, row[:, 3] + nth, row[:, 4]
            again = cut > 0
            first = self._rests(row[again])
            which, start = which[again], (start + size)[again]
            lengths, ranks = (lengths - size)[again], nth[again] + first

    def _rests(self, rows: np.ndarray) -> np.ndarray:
        """The rank of the first rest of each record that cuts."""
        return np.array([self.first_rest[tuple(r)] for r in rows.tolist()], np.int64)

    @property
    def first_rest(self) -> dict[tuple, int]:
        if not hasattr(self, "_first_rest"):
            had = {n: c for n, c in self._total.items()}
            found = {}
            for r in reversed(self.records):  # the last rests that came have the last ranks
                if r[5]:
                    had[r[0] - r[5]] -= r[2]
                    found[r] = had[r[0] - r[5]]
            self._first_rest = found
        return self._first_rest


def pieces(
    docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, key, start, length, crc, doc_tokens`` of all documents cut at multiples of ``capacity``.

    ``key`` is a hash of the text, which tells rows of one id apart.
    """
    end = end_id.to_bytes(4, "little")

    def rows(columns):
        out = {k: [] for k in ("doc", "key", "start", "length", "crc", "doc_tokens")}
        texts = [(t or b"").decode("utf-8", "replace") for t in columns["text"]]
        for doc, key, ids in zip(columns["doc"], columns["key"], bpe(vocabulary, speculate=False).ids(texts), strict=True):
            ids += end
            for at in range(0, len(ids), 4 * capacity):
                part = ids[at : at + 4 * capacity]
                for k, v in zip(out, (doc, key, at // 4, len(part) // 4, crc32(part), len(ids) // 4), strict=True):
                    out[k].append(v)
        yield out

    schema = "doc long, key long, start long, length long, crc long, doc_tokens long"
    return arrow_map(_keyed(docs, id_col, text_col), rows, schema, weight="text", slice_bytes=ENCODED_BYTES)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("key"), text.alias("text"))


def pack(
    docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Packs every document's ids and ``end_id`` into sequences of at most ``capacity`` tokens.

    Returns for each piece ``id_col, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``.  All sequences are full but the last few, which have
    powers of two of tokens, so that none is padded.  A null text is an empty one
    (a piece of the end id alone); repeated rows and null ids are packed like any
    other; an empty table gives no piece.
    """
    if not 2 <= capacity <= 1 << 20:
        raise ValueError("capacity must be 2 to 2**20")
    spark = docs.sparkSession
    natural = materialize(pieces(docs, vocabulary, end_id, capacity, id_col, text_col), "pieces")
    histogram = {r.length: r.n for r in natural.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity
    plan = Plan(histogram, capacity)
    total, begins, so_far = sum(histogram.values()), {}, 0
    for length in sorted(histogram):
        begins[length] = so_far
        so_far += histogram[length]
    class_begin = np.zeros(capacity + 1, np.int64)
    for length, at in begins.items():
        class_begin[length] = at

    columns = ["doc", "key", "start", "length", "crc", "doc_tokens"]
    run_schema = "doc long, key long, start long, length long, crc long, doc_tokens long, run long, nth long"

    def number(batches):
        run, n = TaskContext.get().partitionId(), 0
        for b in batches:
            more = [pa.array(np.full(b.num_rows, run, np.int64)), pa.array(np.arange(n, n + b.num_rows))]
            n += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*columns, "run", "nth"])

    order = ["length", "doc", "start", "key"]
    ranged = natural.repartitionByRange(max(1, -(-total // PIECES_PER_RUN)), *order).sortWithinPartitions(*order)
    ranged = materialize(ranged.mapInArrow(number, run_schema), "ranged")
    sizes = ranged.groupBy("run").agg(F.count("*").alias("n"))  # one row for each run
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def placed(c):
        lengths = np.array(c["length"], np.int64)
        ranks = np.array(c["base"], np.int64) + np.array(c["nth"], np.int64) - class_begin[lengths]
        starts = np.array(c["start"], np.int64)
        for which, start, size, sequence, offset in plan.place(lengths, ranks):
            whole = size == lengths[which]
            yield {
                **{k: [c[k][i] for i in which.tolist()] for k in ("doc", "key", "doc_tokens")},
                "start": starts[which] + start,
                "length": size,
                "crc": [c["crc"][i] if w else None for i, w in zip(which.tolist(), whole.tolist(), strict=True)],
                "sequence_id": sequence,
                "offset": offset,
            }

    out_schema = (
        "doc long, key long, doc_tokens long, start long, length long, crc long, sequence_id long, offset long"
    )
    out = materialize(arrow_map(ranged.join(bases, "run"), placed, out_schema), "placed")

    # Pieces that the plan has cut: their ids are taken from the texts once more, by whole documents.
    cut = materialize(out.where("crc is null").groupBy("doc", "key").agg(F.collect_set(F.struct("start", "length")).alias("cuts")), "cuts")
    end = end_id.to_bytes(4, "little")

    def again(c):
        made = {k: [] for k in ("doc", "key", "start", "length", "crc")}
        texts = [(t or b"").decode("utf-8", "replace") for t in c["text"]]
        for doc, key, cuts, ids in zip(c["doc"], c["key"], c["cuts"], bpe(vocabulary, speculate=False).ids(texts), strict=True):
            ids += end
            for x in cuts:
                s, n = x["start"], x["length"]
                for k, v in zip(made, (doc, key, s, n, crc32(ids[4 * s : 4 * (s + n)])), strict=True):
                    made[k].append(v)
        yield made

    keyed = _keyed(docs, id_col, text_col).alias("d")
    same = F.col("d.doc").eqNullSafe(F.col("c.doc")) & (F.col("d.key") == F.col("c.key"))
    found = keyed.join(cut.alias("c"), same).select("d.doc", "d.key", "d.text", "c.cuts")
    crcs = arrow_map(found, again, "doc long, key long, start long, length long, crc long", weight="text").distinct()
    on = F.col("o.doc").eqNullSafe(F.col("k.doc"))
    for name in ("key", "start", "length"):
        on = on & (F.col(f"o.{name}") == F.col(f"k.{name}"))
    whole, parts = out.where("crc is not null"), out.where("crc is null")
    mended = parts.alias("o").join(crcs.alias("k"), on).select("o.doc", "o.key", "o.doc_tokens", "o.start", "o.length", "k.crc", "o.sequence_id", "o.offset")
    done = whole.unionByName(mended)
    return done.select(
        F.col("doc").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def assemble(tokens: DataFrame, packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``sequence_id, ids``: the sequences of :func:`pack` themselves, unpadded.

    ``tokens`` has ``id_col`` (unique) and ``ids`` with the end id, as
    little-endian unsigned 32-bit integers.
    """
    part = F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))").alias("part")
    rows = packed.join(tokens.select(id_col, "ids"), id_col).select("sequence_id", "offset", part)
    grouped = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "part"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["part"]))
    return grouped.select("sequence_id", joined.alias("ids"))
