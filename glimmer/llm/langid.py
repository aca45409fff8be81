"""Language identification by words first, then ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_beside, arrow_map, holding, materialize, named

#: Documents of each language that a model is fitted on, about, at most; it keeps all their words and n-grams.
TRAINING_DOCS = 1_000
#: Lengths of the character n-grams that stand in for unseen words, longest first.
ORDERS = (5, 4, 3, 2, 1)
#: Words whose scores a worker keeps before it starts anew.
WORDS_KEPT = 200_000
#: Words beyond which more evidence doesn't make the score surer.
SURE_WORDS = 20
UNDETERMINED = "und"

_letters = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    """The runs of letters of a text, in lower case."""
    return _letters(text.lower())


def has_letter(words: list[str]) -> bool:
    """Whether any is a letter indeed: a superscript digit isn't."""
    return any(c.isalpha() for w in words for c in w)


def grams(word: str, order: int) -> list[str]:
    """The n-grams of a word with its borders; the single characters without them."""
    if order == 1:
        return list(word)
    marked = f"^{word}$"
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


@dataclass
class Model:
    """Per-language log frequencies of words (order 0) and n-grams."""

    languages: list[str]
    tables: dict[int, dict[str, int]]  # order: gram: row of `logs`
    logs: np.ndarray  # rows of log frequencies by language

    def __post_init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        """Let go of the words whose scores are kept."""
        self._place: dict[str, int] = {}
        self._rows = np.zeros((1, len(self.languages)), np.float32)

    def _score(self, new: list[str]) -> np.ndarray:
        """The scores of words: their own, or else the mean of their longest n-grams that are known."""
        out = np.zeros((len(new), len(self.languages)), np.float32)
        known = self.tables[0]
        left = []
        for i, w in enumerate(new):
            if (row := known.get(w)) is None:
                left.append(i)
            else:
                out[i] = self.logs[row]
        for order in ORDERS:
            get, rows, sizes, hit, rest = self.tables[order].get, [], [], [], []
            for i in left:
                own = [r for r in map(get, grams(new[i], order)) if r is not None]
                if own:
                    rows += own
                    sizes.append(len(own))
                    hit.append(i)
                else:
                    rest.append(i)
            if hit:
                n = np.array(sizes)
                sums = np.add.reduceat(self.logs[rows], np.cumsum(n) - n, axis=0)
                out[hit] = sums / n[:, None]
            left = rest
        return out

    def predict_all(self, texts: list[str]) -> list[tuple[str, float]]:
        """Of each text the likeliest language and its share of the likelihood."""
        out = []
        for at in range(0, len(texts), 256):
            part = [words_of(t) for t in texts[at : at + 256]]
            new = list({w for words in part for w in words}.difference(self._place))
            if len(self._place) + len(new) > WORDS_KEPT:
                self._place.clear()
                new = list({w for words in part for w in words})
            start = len(self._place)
            if start + len(new) > len(self._rows):
                more = np.zeros((max(WORDS_KEPT, start + len(new)), len(self.languages)), np.float32)
                more[:start] = self._rows[:start]
                self._rows = more
            self._rows[start : start + len(new)] = self._score(new)
            self._place.update(zip(new, range(start, start + len(new)), strict=True))
            out += [self._best(words) for words in part]
        return out

    def _best(self, words: list[str]) -> tuple[str, float]:
        if not self.languages or not has_letter(words):
            return UNDETERMINED, 0.0
        rows = np.fromiter(map(self._place.__getitem__, words), np.int64, len(words))
        total = self._rows[rows].sum(axis=0, dtype=np.float64) * min(1.0, SURE_WORDS / len(words))
        share = np.exp(total - total.max())
        share /= share.sum()
        best = int(np.argmax(share))
        return self.languages[best], float(min(1.0, share[best]))


def _each_sampled(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows of each language at most, by a hash of the id: a rare language keeps all."""
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    span = 1 << 40
    above = {lang: int(most / n * span) for lang, n in sizes.items() if n > most}
    if not above:
        return rows
    place = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(span))
    limits = F.create_map(*[F.lit(x) for pair in sorted(above.items()) for x in pair])
    return rows.where(place < F.coalesce(limits[F.col("lang")], F.lit(span)))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", most: int = TRAINING_DOCS) -> Model:
    """A model of the rows of ``docs`` with text and language, on about ``most`` rows of each language at most, chosen by a hash.

    Words are counted where the rows lie and summed; n-grams are taken of the
    distinct words.  The model keeps every word and n-gram of the sample, which is
    what bounds it.  Rows without text or language play no part; without any the
    model knows no language.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = _each_sampled(rows, most).select("lang", F.col("text").cast("binary").alias("text"))

    def count(columns):
        by_lang: dict[str, Counter] = {}
        for lang, text in zip(columns["lang"], columns["text"], strict=True):
            by_lang.setdefault(lang, Counter()).update(words_of(text.decode("utf-8", "replace")))
        yield {
            "lang": [lang for lang, words in by_lang.items() for _ in words],
            "word": [w for words in by_lang.values() for w in words],
            "n": [n for words in by_lang.values() for n in words.values()],
        }

    counted = arrow_map(rows, count, "lang string, word string, n long", weight="text")
    words = materialize(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "counts")
    languages = sorted(r[0] for r in words.select("lang").distinct().collect())
    tables: dict[int, dict[str, int]] = {}
    logs: list[np.ndarray] = []
    for order in (0, *ORDERS):  # one order's entries at a time; JVM-side, and the driver gets each entry's counts once
        part = words.withColumn("gram", F.explode(_grams_of(F.col("word"), order))) if order else words.withColumnRenamed("word", "gram")
        by_lang = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}") for i, lang in enumerate(languages)]
        kept = part.groupBy("gram").agg(F.count("*").alias("all"), *by_lang).orderBy("gram").toArrow()
        n = np.array([kept.column(f"n{i}").to_numpy() for i in range(len(languages))], float).reshape(len(languages), kept.num_rows).T
        start = sum(map(len, logs))
        tables[order] = {g: start + i for i, g in enumerate(kept.column("gram").to_pylist())}
        logs.append(np.log((n + 0.5) / (n.sum(axis=0) + 0.5 * max(1, len(n)))).astype(np.float32))
    return Model(languages, tables, np.concatenate(logs))


def _grams_of(word: Column, order: int) -> Column:
    """:func:`grams` as an expression."""
    text = word if order == 1 else F.concat(F.lit("^"), word, F.lit("$"))
    many = F.length(text) - (order - 1)
    each = F.transform(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), lambda i: F.substring(text, i, order))
    return F.when(many > 0, each)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score`` of every row's whole text.

    A text that is null or has no letter is ``und`` with score 0; so is every
    text if the model has seen no language.  Equal scores go to the language
    that comes first in the alphabet.  Repeated rows come back as often as they
    came, and a null id stays null; texts of any length are taken whole; an empty
    table gives an empty table; other columns, whatever their names, play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that it is fitted on

    def rows(columns):
        own = shared.value
        holding("language", own.forget)
        found = own.predict_all([(t or b"").decode("utf-8", "replace") for t in columns["text"]])
        yield {"id": columns["id"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    out = arrow_map(narrow, rows, "id long, lang_pred string, score double", weight="text")
    return out.withColumnRenamed("id", id_col)


def sure(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is found with a score of ``least`` or more.

    Texts that are null or have no letter go; repeated rows stay as often as they
    came.  Columns go through the tasks beside their texts, so nothing is joined.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(texts):
        own = shared.value
        holding("language", own.forget)
        found = own.predict_all([(t or b"").decode("utf-8", "replace") for t in texts])
        return {"sure": [lang != UNDETERMINED and score >= least for lang, score in found]}

    return named(arrow_beside(docs, text_col, rows, "sure boolean").where("sure"), docs.columns)
