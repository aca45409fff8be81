"""BPE encoding by speculation and verification, and decoding.

Words that aren't known yet are encoded together.  Greedy longest match proposes
the tokens of each; a proposal is the exact result if and only if every adjacent
pair of its tokens is one that merging would leave apart, and that is tested for
all pairs of all words at once in numpy.  Only words with a failing pair are
merged step by step.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import regex

from .common import holding

#: Words of which a worker keeps the ids, in each of two halves of its store; a full half replaces the older one.
WORDS_KEPT = 300_000
#: Bytes of texts that are encoded together: the more, the fewer words are looked up twice.
ENCODED_BYTES = 4_000_000
#: Longest word whose ids are kept, and that is merged beside others if its proposal fails, in characters.
LONGEST_KEPT = 64
_PAIR_SLOTS = 1 << 20
#: Slots of the table of merges, and what spreads its keys over them.
_SLOTS, _SPREAD = 1 << 19, 0x9E3779B1
_NO_RANK = 1 << 30
#: Words that are merged side by side.
_MERGED_AT_ONCE = 8192
#: Symbols up to which the least rank is looked for without a heap.
_SHORT = 32

# The patterns that split text before merging, as the vocabulary files define them.
_LOWER_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BYTE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters of whose classes, cases and compositions all Unicode versions agree; other texts are split by the library.
_PLAIN = r"[\x00-\u02af\u0370-\u0377\u037a-\u037e\u0384-\u052f\u1e00-\u1eff\u2010-\u2027\u2030-\u205e\u20ac]*"
# The same for texts of ASCII, and of Latin, characters, where plain classes do.  A word of letters starts with
# none of the other kinds' first characters, so it can be looked for first.
_CLASSES = {
    "ascii": {"L": "A-Za-z", "N": "0-9", "S": r" \t-\r"},
    "latin": {"L": "A-Za-zªµºÀ-ÖØ-öø-\u02af", "N": "0-9²³¹¼½¾", "S": r" \t-\r\x85\xa0"},
}
_LATIN = r"[\x00-\u02af]*"
_LOWER_PLAIN = r"[{L}]+|'s|'t|'re|'ve|'m|'ll|'d|[{N}]|[^{S}{L}{N}]+"
_BYTE_PLAIN = r" ?[{L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: itself if it prints, else the next from U+0100."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printing)]
    return {b: chr(b) for b in printing} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Bpe:
    """A vocabulary file's BPE: ``ids`` encodes, ``decode`` decodes.

    Lower-casing vocabularies with word ends and byte-level ones are told apart
    by the file.  Truncation, padding and special-token templates are not used;
    special tokens' strings in a text become their ids.

    Without ``speculate`` all new words are merged exactly, side by side.
    """

    def __init__(self, path: str, speculate: bool = True) -> None:
        self.speculate = speculate
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.lower = bool(spec.get("normalizer"))
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: t for t, i in (self.vocab | self.special).items()}
        pattern, plain = (_LOWER_WORDS, _LOWER_PLAIN) if self.lower else (_BYTE_WORDS, _BYTE_PLAIN)
        self._words = regex.compile(pattern).findall
        self._ascii_words, self._latin_words = (re.compile(plain.format(**c)).findall for c in _CLASSES.values())
        self._latin = re.compile(_LATIN).fullmatch
        self._plain, self._path, self._library = re.compile(_PLAIN).fullmatch, path, None
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._table = byte_characters()
        self._bytes = {c: b for b, c in self._table.items()}
        self._ranks: dict[tuple[str, str], int] = {}
        made: dict[str, tuple[int, str, str]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            if a + b not in made:
                made[a + b] = (rank, a, b)
            self._ranks[a, b] = rank
        self._longest = max(len(t) for t in self.vocab)
        # For the pair test: of each token the merge that makes it and its two parts (itself, if none).
        size = max(self.vocab.values()) + 1
        self._rank_of = np.full(size, -1, np.int64)
        self._left, self._right = np.arange(size), np.arange(size)
        for token, (rank, a, b) in made.items():
            i = self.vocab[token]
            self._rank_of[i], self._left[i], self._right[i] = rank, self.vocab[a], self.vocab[b]
        keys = np.array([self.vocab[a] * size + self.vocab[b] for a, b in self._ranks], np.int64)
        self._slot_keys, self._slot_ranks = self._hashed(keys, np.array(list(self._ranks.values()), np.int64))
        self._merged = np.array([self.vocab[a + b] for a, b in self._ranks], np.int64)
        self._base = np.array([self.vocab[c] for _, c in sorted(self._table.items())], np.int64)
        self._base_end = np.array([self.vocab[c + self.suffix] for _, c in sorted(self._table.items())], np.int64)
        self._size = size
        self._seen_keys, self._seen_fit = np.full(_PAIR_SLOTS, -1, np.int64), np.zeros(_PAIR_SLOTS, bool)
        self._kept: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        #: Words encoded anew, and of those the ones that failed the test.
        self.counts = {"words": 0, "merged": 0}

    # ---- text to words

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if text.isascii():
            return self._ascii_words(text.lower() if self.lower else text)
        if self.lower and not self._plain(text):
            return self._odd_words(text)
        if self.lower:
            # one character at a time, without the rule for a sigma that ends a word
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self._latin_words(text) if self._latin(text) else self._words(text)

    def _odd_words(self, text: str) -> list[str]:
        """The same by the tokenizers library's own normalizer and splitter."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        pieces = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        back = self._bytes
        return [bytes(map(back.__getitem__, p)).decode() for p, _ in pieces]

    # ---- words to ids

    @staticmethod
    def _hashed(keys: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An open table of the pairs' ranks; a key stands at its slot or the next free one."""
        slot_keys, slot_ranks = np.full(_SLOTS, -1, np.int64), np.full(_SLOTS, _NO_RANK, np.int64)
        for key, rank, at in zip(keys.tolist(), ranks.tolist(), ((keys * _SPREAD) % _SLOTS).tolist(), strict=True):
            while slot_keys[at] >= 0:
                at = (at + 1) % _SLOTS
            slot_keys[at], slot_ranks[at] = key, rank
        return slot_keys, slot_ranks

    def _rank(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, _NO_RANK if there is none."""
        at = (keys * _SPREAD) % _SLOTS
        there = self._slot_keys[at]
        out = np.where(there == keys, self._slot_ranks[at], _NO_RANK)
        more = np.flatnonzero((there != keys) & (there >= 0))
        while len(more):
            at[more] = (at[more] + 1) % _SLOTS
            there = self._slot_keys[at[more]]
            hit = there == keys[more]
            out[more[hit]] = self._slot_ranks[at[more[hit]]]
            more = more[~hit & (there >= 0)]
        return out

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Exact merging of many short words at once: in each round, every word's best pair."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        base = self._base[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(sizes)
        last = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)
        base[ends - 1] = self._base_end[last]
        out: list[bytes] = [b""] * len(words)
        order = np.argsort(sizes, kind="stable")
        for block in np.array_split(order, -(-len(words) // _MERGED_AT_ONCE)):  # of about the same length
            width = int(sizes[block].max())
            columns = np.arange(width)
            there = columns < sizes[block][:, None]
            tokens = np.full((len(block), width + 1), -1, np.int32)
            tokens[:, :width][there] = base[((ends - sizes)[block][:, None] + columns)[there]]
            self._merge_block(block, tokens, out)
        return out

    def _merge_block(self, block: np.ndarray, tokens: np.ndarray, out: list[bytes]) -> None:
        """Rows of token ids, -1 after the last, merged until no pair has a rank."""
        size, columns = self._size, np.arange(tokens.shape[1])
        a, b = tokens[:, :-1], tokens[:, 1:]
        ranks = np.full(tokens.shape, _NO_RANK, np.int32)
        both = b >= 0
        ranks[:, :-1][both] = self._rank(a[both].astype(np.int64) * size + b[both])
        while len(block):
            best = ranks.argmin(axis=1)
            rows = np.arange(len(block))
            rank = ranks[rows, best]
            going = rank < _NO_RANK
            if not going.all():
                done = tokens[~going]
                kept = done >= 0
                raw, stops = done[kept].astype("<u4").tobytes(), (np.cumsum(kept.sum(axis=1)) * 4).tolist()
                start = 0
                for i, stop in zip(block[~going].tolist(), stops, strict=True):
                    out[i] = raw[start:stop]
                    start = stop
                block, tokens, ranks = block[going], tokens[going], ranks[going]
                best, rank, rows = best[going], rank[going], rows[: len(block)]
                if not len(block):
                    return
            after = columns[:-1] > best[:, None]
            np.copyto(tokens[:, :-1], tokens[:, 1:].copy(), where=after)
            tokens[:, -1] = -1
            made = self._merged[rank]
            tokens[rows, best] = made
            np.copyto(ranks[:, :-1], ranks[:, 1:].copy(), where=after)
            ranks[:, -1] = _NO_RANK
            # the pairs of the new token with the one before and the one after
            before, behind = tokens[rows, best - 1].astype(np.int64), tokens[rows, best + 1].astype(np.int64)
            new = self._rank(np.where(behind >= 0, made * size + behind, -2))
            ranks[rows, best] = new
            inner = np.flatnonzero(best)
            ranks[inner, best[inner] - 1] = self._rank(before[inner] * size + made[inner])

    def fits(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging leaves each pair of tokens apart where they stand side by side.

        Takes the two tokens apart again, the later merge first.  At any time the
        two parts that touch across the border would be merged if that merge came
        before the one that used up one of them.
        """
        keys = first * self._size + second
        slots = (keys * 0x9E3779B1) % _PAIR_SLOTS
        known = self._seen_keys[slots] == keys
        out = np.where(known, self._seen_fit[slots], True)
        if known.all():
            return out
        new, back = np.unique(keys[~known], return_inverse=True)
        fit = np.ones(len(new), bool)
        at = np.arange(len(new))
        a, b = new // self._size, new % self._size
        limit = np.full(len(new), _NO_RANK)
        while len(at):
            pair = a * self._size + b
            merged = self._rank(pair) < limit
            fit[at[merged]] = False
            ra, rb = self._rank_of[a], self._rank_of[b]
            go = ~merged & ((ra >= 0) | (rb >= 0))
            # among equal merges the left one comes first: of `a` it precedes the border's, of `b` it follows
            undo_a = ra >= rb
            limit = np.where(undo_a, ra, rb + 1)[go]
            a, b = np.where(undo_a, self._right[a], a)[go], np.where(undo_a, b, self._left[b])[go]
            at = at[go]
        slots = (new * 0x9E3779B1) % _PAIR_SLOTS
        self._seen_keys[slots], self._seen_fit[slots] = new, fit
        # two new pairs may share a slot: the later one stands there, and the key tells
        out[~known] = fit[back]
        return out

    def _greedy(self, symbols: str) -> list[int] | None:
        """Longest match from the left; the last token bears the word's end."""
        vocab, end, n, out, i = self.vocab, self.suffix, len(symbols), [], 0
        while i < n:
            j = n
            if (token := vocab.get(symbols[i:] + end)) is None:
                j = min(n - 1, i + self._longest)
                while j > i and (token := vocab.get(symbols[i:j])) is None:
                    j -= 1
                if j == i:
                    return None
            out.append(token)
            i = j
        return out

    def merge(self, symbols: str) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost of equal ones."""
        parts = [*symbols[:-1], symbols[-1] + self.suffix]
        ranks, n = self._ranks, len(parts)
        if n <= _SHORT:
            none = len(ranks)
            near = [ranks.get(p, none) for p in zip(parts, parts[1:], strict=False)]
            while near and (rank := min(near)) < none:
                i = near.index(rank)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del near[i]
                if i < len(near):
                    near[i] = ranks.get((parts[i], parts[i + 1]), none)
                if i:
                    near[i - 1] = ranks.get((parts[i - 1], parts[i]), none)
            return [self.vocab[p] for p in parts]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or ranks.get((parts[i], parts[j])) != rank:
                continue  # one of the two has gone since
            parts[i], parts[j] = parts[i] + parts[j], ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return [self.vocab[p] for p in parts if p]

    def _symbols(self, word: str) -> str:
        if word.isascii() and word.isalnum():
            return word
        return "".join(map(self._table.__getitem__, word.encode()))

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Of each word, however long, the ids as little-endian unsigned 32-bit integers."""
        words = list(words)
        out, failed = self._verified(words) if self.speculate else ({}, words)
        short = [w for w in failed if len(w) <= LONGEST_KEPT]  # merged side by side, where a long one would widen all
        if short:
            out.update(zip(short, self.merge_many([w.encode() for w in short]), strict=True))
        out.update((w, np.array(self.merge(self._symbols(w)), "<u4").tobytes()) for w in failed if len(w) > LONGEST_KEPT)
        self.counts["words"] += len(words)
        self.counts["merged"] += len(failed)
        return out

    def _verified(self, words: list[str]) -> tuple[dict[str, bytes], list[str]]:
        """The proposals of which all pairs fit, and the words whose proposal fails."""
        proposed = [self._greedy(self._symbols(w)) for w in words]
        sizes = np.fromiter((len(p) if p else 0 for p in proposed), np.int64, len(words))
        flat = np.fromiter((t for p in proposed if p for t in p), np.int64, int(sizes.sum()))
        word_of = np.repeat(np.arange(len(words)), sizes)
        bad = sizes == 0
        if len(flat) > 1:
            inner = np.flatnonzero(word_of[1:] == word_of[:-1])
            apart = self.fits(flat[inner], flat[inner + 1])
            bad[word_of[inner[~apart]]] = True
        raw, stops = flat.astype("<u4").tobytes(), np.cumsum(sizes) * 4
        spans = zip(words, (stops - sizes * 4).tolist(), stops.tolist(), bad.tolist(), strict=True)
        out = {w: raw[start:stop] for w, start, stop, fails in spans if not fails}
        return out, [w for w, fails in zip(words, bad.tolist(), strict=True) if fails]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Of each text (null: empty) the ids as little-endian unsigned 32-bit integers."""
        split: list[list[list[str] | int]] = []
        for text in texts:
            if not text:
                split.append([])
            elif any(map(text.__contains__, self.special)):
                pieces = self._special.split(text)
                split.append([self.special[p] if i % 2 else self.words(p) for i, p in enumerate(pieces)])
            else:
                split.append([self.words(text)])
        new: set[str] = set()
        for parts in split:
            for p in parts:
                if not isinstance(p, int):
                    new.update(p)
        if len(self._kept) > WORDS_KEPT:  # words that come again move on from the older half
            self._older, self._kept = self._kept, {}
        kept, older = self._kept, self._older
        new.difference_update(kept)
        again = new.intersection(older)
        kept.update(zip(again, map(older.__getitem__, again), strict=True))
        new.difference_update(again)
        made = self.encode_words(new) if new else {}
        long = {w: made.pop(w) for w in [w for w in made if len(w) > LONGEST_KEPT]}
        kept.update(made)
        get = (lambda w: long[w] if len(w) > LONGEST_KEPT else kept[w]) if long else kept.__getitem__
        out = []
        for parts in split:
            pieces = [p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(get, p)) for p in parts]
            out.append(pieces[0] if len(pieces) == 1 else b"".join(pieces))
        return out

    # ---- ids to text

    @functools.cached_property
    def _pieces(self) -> np.ndarray:
        size = max(self.strings) + 1
        return np.array([self.strings.get(i, "") for i in range(size)], object)

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included.

        Without a decoder in the vocabulary file tokens are joined by a space;
        a byte-level one gives the bytes back, undecodable ones replaced.
        """
        pieces = self._pieces[np.frombuffer(ids, "<u4")].tolist()
        if self.suffix:
            return " ".join(pieces)
        back = self._bytes
        raw = b"".join(p.encode() if p in self.special else bytes(map(back.__getitem__, p)) for p in pieces)
        return raw.decode("utf-8", "replace")


_loaded = functools.cache(Bpe)


def bpe(path: str, speculate: bool = True) -> Bpe:
    """The worker's encoder for a vocabulary file; its store of words lasts until another operator needs the room."""
    holding("bpe", _loaded.cache_clear)
    return _loaded(path, speculate)
