"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, sampled

#: Labelled documents that a model is fitted on, about, at most.
TRAINING_DOCS = 20_000
#: Toxic documents that must have an entry, and how much oftener toxic documents must have it (natural logarithm).
LEAST_DOCS, LEAST_WEIGHT = 4, 1.5
#: Lengths of the word beginnings that are entries besides whole words.
STEMS = (4, 5, 6, 7, 8)
#: Share of toxic documents among those that have a phrase, up to which it excuses the entry in it.
EXCUSED_SHARE = 0.1

# Letters of other alphabets that look like Latin ones, with the letter each looks like.
_LOOK_ALIKES = {
    "а": "a", "б": "b", "в": "b", "г": "r", "е": "e", "з": "e", "и": "u", "к": "k", "м": "m", "н": "h", "о": "o",
    "п": "n", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ь": "b", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k",
    "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l",
    "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t",
}
# Digits and signs that stand for letters.
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
_SIGNS = {"@": "a", "$": "s", "!": "i"}

_to_latin, _to_letters = str.maketrans(_LOOK_ALIKES), str.maketrans(_DIGITS)
# accents that stand by themselves after decomposition, soft hyphens, and signs without width
_invisible = re.compile("[\u0300-\u036f\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]+")
_inner_sign = re.compile(r"(?<=[^\W_])[@$!]+(?=[^\W_])|(?<![^\W_@$!])[@$](?=[^\W_])")
_with_digit = re.compile(r"[^\W_]*\d[^\W_]*")
_letters = re.compile(r"[^\W\d_]+").findall


def _spelt(run: re.Match) -> str:
    """A run of letters and digits with its digits as letters; a number stays one."""
    return run[0].translate(_to_letters) if _letters(run[0]) else run[0]


def fold(text: str) -> str:
    """The words of a text with a space around each, lower case, look-alikes and digits folded.

    Full-width and other compatibility forms, accents and signs without width go
    first; then letters of other alphabets become the Latin ones they look like
    (others stay, so no word is torn); then signs between letters, and the digits
    of words that have a letter, become letters.
    """
    text = text.lower()
    if not text.isascii():
        text = _invisible.sub("", unicodedata.normalize("NFKD", text)).lower()
        text = unicodedata.normalize("NFC", text).translate(_to_latin)
    if "@" in text or "$" in text or "!" in text:
        text = _inner_sign.sub(lambda m: "".join(map(_SIGNS.__getitem__, m[0])), text)
    return f" {' '.join(_letters(_with_digit.sub(_spelt, text)))} "


def entries_of(folded: str) -> set[str]:
    """The entries of a folded text: `` word `` for whole words, `` stem`` for beginnings."""
    words = set(folded.split())
    found = {f" {w} " for w in words}
    for n in STEMS:
        found.update(" " + w[:n] for w in words if len(w) >= n)
    return found


@dataclass
class Model:
    """A lexicon with weights, phrases that excuse entries, and a calibration."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    coefficients: list[float] = field(default_factory=list)
    bias: float = -2.0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"}

    @property
    def automaton(self) -> ahocorasick.Automaton:
        """The matcher, built once where it is used."""
        if "_automaton" not in self.__dict__:
            made = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                made.add_word(entry, (entry, weight))
            if len(made):
                made.make_automaton()
            self._automaton = made
        return self._automaton

    def features(self, text: str) -> list[float]:
        """What the calibration sees: weight in all, distinct words hit, and both by length.

        Of the entries that begin at one word only the weightiest counts; a word
        in an exception phrase doesn't count.
        """
        folded = fold(text)
        best: dict[int, float] = {}
        if len(self.automaton):
            for stop, (entry, weight) in self.automaton.iter(folded):
                start = stop - len(entry) + 1
                if weight > best.get(start, 0.0):
                    best[start] = weight
        total, words = 0.0, set()
        for start, weight in best.items():
            end = folded.index(" ", start + 1)
            if self.exceptions and any(p in self.exceptions for p in phrases(folded, start, end)):
                continue
            total += weight
            words.add(folded[start + 1 : end])
        n = max(1, folded.count(" ") - 1)
        return [
            math.log1p(total), math.log1p(len(words)), math.log1p(1000 * total / n), 1000 * len(words) / (n + 100),
            math.log1p(n),
        ]

    def score(self, text: str) -> float:
        """0 to 1; a text without any hit gets the calibration's value for none."""
        if not self.coefficients:
            return 0.0
        x = (np.array(self.features(text)) - self.mean) / self.scale
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(x @ self.coefficients) + self.bias)))))


def phrases(folded: str, start: int, end: int) -> list[str]:
    """The word from ``start`` (the space before it) to ``end`` with the word before, and with the word after."""
    found = []
    if start > 0:
        found.append(folded[folded.rindex(" ", 0, start) : end + 1])
    if end < len(folded) - 1:
        found.append(folded[start : folded.index(" ", end + 1) + 1])
    return found


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Ridge-regularised logistic regression by Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _as_dict(counted: DataFrame) -> dict[str, int]:
    table = counted.select("entry", "n").toArrow()
    return dict(zip(table.column("entry").to_pylist(), table.column("n").to_pylist(), strict=True))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAINING_DOCS
) -> Model:
    """A model of the documents that ``labels`` marks 0 or 1, about ``most`` labels at most, chosen by a hash of the id.

    Entries are all words and word beginnings that LEAST_DOCS toxic documents
    have, much oftener than others.  Both passes count where the documents lie;
    the driver gets the entries and phrases that stand in several documents of the
    sample, and a row of features for each.  Without documents of both labels the
    model scores 0.
    """
    marked = labels.where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    chosen = materialize(sampled(marked, id_col, most, seed=3), "labels")
    narrow = docs.select(id_col, F.coalesce(text_col, F.lit("")).cast("binary").alias("text"))
    rows = materialize(narrow.join(F.broadcast(chosen), id_col).select("label", "text"), "marked")  # <= most rows

    def toxic(columns):
        found: Counter = Counter()
        for text in columns["text"]:
            found.update(entries_of(fold(text.decode("utf-8", "replace"))))
        yield {"entry": list(found), "n": list(found.values())}

    schema = "entry string, n long"
    counted = arrow_map(rows.where("label = 1").select("text"), toxic, schema, weight="text")
    counted = counted.groupBy("entry").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCS)
    candidates = _as_dict(counted)
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not candidates or 0 not in sizes or 1 not in sizes:
        return Model()
    wanted = rows.sparkSession.sparkContext.broadcast(frozenset(candidates))

    def clean(columns):
        found: Counter = Counter()
        for text in columns["text"]:
            found.update(entries_of(fold(text.decode("utf-8", "replace"))) & wanted.value)
        yield {"entry": list(found), "n": list(found.values())}

    counted = arrow_map(rows.where("label = 0").select("text"), clean, schema, weight="text")
    benign = _as_dict(counted.groupBy("entry").agg(F.sum("n").alias("n")))
    weights = {}
    for entry, n in candidates.items():
        weight = math.log((n + 0.5) / (sizes[1] + 1)) - math.log((benign.get(entry, 0) + 0.5) / (sizes[0] + 1))
        if weight >= LEAST_WEIGHT:
            weights[entry] = weight
    model = Model(dict(sorted(weights.items())))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def context(columns):
        found: dict[str, list[int]] = {}
        for label, text in zip(columns["label"], columns["text"], strict=True):
            own, folded = shared.value, fold(text.decode("utf-8", "replace"))
            if not len(own.automaton):
                continue
            starts = {stop - len(entry) + 1 for stop, (entry, _) in own.automaton.iter(folded)}
            for phrase in {p for s in starts for p in phrases(folded, s, folded.index(" ", s + 1))}:
                found.setdefault(phrase, [0, 0])[label] += 1
        yield {"phrase": list(found), "clean": [v[0] for v in found.values()], "toxic": [v[1] for v in found.values()]}

    near = arrow_map(rows, context, "phrase string, clean long, toxic long", weight="text")
    near = near.groupBy("phrase").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    excused = near.where((F.col("clean") >= LEAST_DOCS) & (F.expr("toxic / (clean + toxic)") <= EXCUSED_SHARE))
    model.exceptions = set(excused.select("phrase").toArrow().column("phrase").to_pylist())
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def features(columns):
        yield {
            "label": columns["label"],
            "x": [shared.value.features(t.decode("utf-8", "replace")) for t in columns["text"]],
        }

    seen = arrow_map(rows, features, "label int, x array<double>", weight="text").collect()  # <= most rows
    x, y = np.array([r.x for r in seen]), np.array([r.label for r in seen], float)
    model.mean, model.scale = x.mean(axis=0).tolist(), (x.std(axis=0) + 1e-9).tolist()
    w, model.bias = _logistic((x - model.mean) / model.scale, y)
    model.coefficients = w.tolist()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` (0 to 1) of every row's whole text, however long; a null text is an empty one.

    Repeated rows come back as often as they came; a null id stays null; an empty
    table gives an empty table; other columns, whatever their names, play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that it is fitted on

    def rows(columns):
        own = shared.value
        yield {"id": columns["id"], "score": [own.score((t or b"").decode("utf-8", "replace")) for t in columns["text"]]}

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return arrow_map(narrow, rows, "id long, score double", weight="text").withColumnRenamed("id", id_col)
