"""A compressed FM-index over symbol sequences, and matching statistics of streamed sequences."""

from __future__ import annotations

import pickle

import numpy as np
import zstandard


class WaveletMatrix:
    """Rank queries over a sequence of symbols: a packed bit vector for each bit, most significant first."""

    def __init__(self, sequence: np.ndarray, symbols: int) -> None:
        self.n, self.bits = len(sequence), max(1, int(symbols - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        seq = sequence
        for b in range(self.bits - 1, -1, -1):
            ones = (seq >> b & 1).astype(bool)
            packed = np.packbits(np.append(ones, np.zeros(-len(ones) % 64 + 64, bool)), bitorder="little").view("<u8")
            counts = np.bitwise_count(packed).astype(np.int32)
            self.words.append(packed)
            self.before.append(np.cumsum(counts, dtype=np.int32) - counts)
            self.zeros.append(len(ones) - int(counts.sum()))
            seq = np.concatenate([seq[~ones], seq[ones]])
        every = np.arange(symbols)
        self.first = self._descend(every, np.zeros(symbols, np.int64)).astype(np.int32)

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the first ``at`` places of the sequence end for a symbol, in the last level's order."""
        for b, words, before, zeros in zip(range(self.bits - 1, -1, -1), self.words, self.before, self.zeros, strict=True):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[word] + np.bitwise_count(words[word] & below)
            at = np.where(symbol >> b & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._descend(symbol, at) - self.first[symbol]


class FmIndex:
    """Sequences of symbols 1 to ``symbols`` - 1, each followed by a 0, with a value each.

    Holds the wavelet matrix of the Burrows-Wheeler transform, the symbols'
    counts, the common prefixes of neighbouring suffixes in half a byte each
    (cut off at ``window``), and one value, the least, for each class of suffixes
    that share ``window`` symbols; the suffix array and the sequences are let go.

    Suffixes are sorted by their first symbols only, more of them than a search
    looks at; the interval of a pattern no longer than that is the same as in the
    full order.
    """

    def __init__(self, sequences: list[np.ndarray], values: np.ndarray, symbols: int, window: int) -> None:
        self.window = window
        sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
        text = np.zeros(int(sizes.sum()) + len(sequences), np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        inside = np.ones(len(text), bool)
        inside[starts + sizes] = False
        text[inside] = np.concatenate(sequences) if sequences else text[:0]
        n = self.n = len(text)
        ranks, known = [text.astype(np.int32)], 1  # by the first 1, 2, 4 ... symbols
        while known <= window:
            ahead, rank = np.zeros(n, np.int64), ranks[-1].astype(np.int64)
            ahead[: n - known] = rank[known:] + 1
            key = rank * (int(ahead.max(initial=0)) + 1) + ahead
            order = np.argsort(key, kind="stable")
            key = key[order]
            made = np.empty(n, np.int32)
            made[order] = np.cumsum(np.append(0, key[1:] != key[:-1]))[:n]
            ranks.append(made)
            known *= 2
        order = np.argsort(ranks.pop(), kind="stable")
        common = self._common(order, ranks, known)
        owner = np.repeat(values, sizes + 1)[order]
        first = np.flatnonzero(common < window)
        self.least = np.minimum.reduceat(owner, first) if n else owner
        self._common_packed = common[0::2] | np.append(common, np.uint8(0))[1::2][: len(common[0::2])] << 4 if window < 16 else common
        counts = np.bincount(text, minlength=symbols)
        self.smaller = np.cumsum(counts) - counts
        self.wavelet = WaveletMatrix(text[order - 1] if n else text, symbols)

    def _common(self, order: np.ndarray, ranks: list[np.ndarray], known: int) -> np.ndarray:
        """How many symbols each suffix shares with the one before it, cut off at the window; 0 for the first."""
        n = self.n
        a, b = order[:-1].copy(), order[1:].copy()
        shared = np.zeros(max(0, n - 1), np.int64)
        for rank in reversed(ranks):  # 2**k symbols at a time, the longest first
            known //= 2
            inside = np.flatnonzero((a < n) & (b < n))
            same = inside[rank[a[inside]] == rank[b[inside]]]
            shared[same] += known
            a[same] += known
            b[same] += known
        return np.minimum(np.append(0, shared)[:n], self.window).astype(np.uint8)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_borders"}

    def to_bytes(self) -> bytes:
        """The index as bytes, compressed."""
        return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(self, 5))

    @staticmethod
    def from_bytes(data: bytes) -> FmIndex:
        return pickle.loads(zstandard.ZstdDecompressor().decompress(data))

    def borders(self, length: int) -> np.ndarray:
        """Where suffixes begin to differ from those before in their first ``length`` symbols."""
        made = self.__dict__.setdefault("_borders", {})
        if length not in made:
            common = self._common_packed
            if self.window < 16:
                common = np.column_stack([common & 15, common >> 4]).ravel()[: self.n]
            made[length] = np.append(np.flatnonzero(common < length), self.n).astype(np.int32)
        return made[length]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the intervals of the patterns with a symbol in front."""
        base = self.smaller[symbol]
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return base + both[: len(symbol)], base + both[len(symbol) :]

    def matches(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of streamed sequences, which stand one after the other in ``flat``.

        Of each place the length of the longest match with the index that begins
        there, cut off at the window, and the least value of the indexed
        sequences that hold the window (the largest integer, if none does).
        Symbols that the index hasn't are -1.

        All sequences are searched side by side from right to left.  Where a
        match can't be extended it gives up its last symbols, one after the other
        (the interval widens to the shorter pattern's), until it can.
        """
        w, none = self.window, np.iinfo(np.int64).max
        length, least = np.zeros(len(flat), np.int64), np.full(len(flat), none, np.int64)
        lanes = np.argsort(-sizes, kind="stable")
        if not len(flat) or not self.n:
            return length, least
        size, ends = sizes[lanes], np.cumsum(sizes)[lanes]
        low, high = np.zeros(len(lanes), np.int64), np.full(len(lanes), self.n, np.int64)
        have = np.zeros(len(lanes), np.int64)
        for step in range(int(size.max())):
            live = int(np.searchsorted(-size, -step, side="left"))  # lanes that are longer than `step`
            at = ends[:live] - 1 - step
            symbol = flat[at]
            lo, hi, n = low[:live], high[:live], have[:live]
            self._shorten(lo, hi, n, np.flatnonzero(n >= w), w - 1)
            todo = np.flatnonzero(symbol >= 0)
            unknown = np.flatnonzero(symbol < 0)
            lo[unknown], hi[unknown], n[unknown] = 0, self.n, 0
            while len(todo):
                a, b = self.extend(symbol[todo], lo[todo], hi[todo])
                found = a < b
                hit, miss = todo[found], todo[~found]
                lo[hit], hi[hit] = a[found], b[found]
                n[hit] += 1
                # a symbol that isn't there at all leaves an empty match
                todo = miss[n[miss] > 0]
                for k in np.unique(n[todo]).tolist():
                    self._shorten(lo, hi, n, todo[n[todo] == k], k - 1)
            length[at] = n
            full = np.flatnonzero(n == w)
            least[at[full]] = self.least[np.searchsorted(self.borders(w)[:-1], lo[full], side="right") - 1]
        return length, least

    def _shorten(self, low: np.ndarray, high: np.ndarray, have: np.ndarray, lanes: np.ndarray, length: int) -> None:
        """Widen the lanes' intervals to those of their patterns' first ``length`` symbols."""
        if not len(lanes):
            return
        if length == 0:
            low[lanes], high[lanes], have[lanes] = 0, self.n, 0
            return
        borders = self.borders(length)
        at = np.searchsorted(borders, low[lanes], side="right")
        low[lanes], high[lanes], have[lanes] = borders[at - 1], borders[at], length
