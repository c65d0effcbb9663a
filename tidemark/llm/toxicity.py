"""Toxicity from a weighted lexicon, matched by Aho-Corasick after folding.

Folding: compatibility forms and look-alike letters become plain ones, digits and signs inside words become the letters
they stand for, i and l become one letter; what is left is words between single spaces. The lexicon holds whole words and
word beginnings with weights (smoothed log odds), learned from labelled rows; one automaton finds all of them and the
exception phrases, which cancel the hits they cover. A word counts once, with its best entry. The sum of weights divided by
log2 of the word count, and the sum capped, go through a calibrated logistic curve.

Learning takes ``FIT_ROWS`` labelled rows of each class at most. An entry counts in distinct surroundings (word before and
after), so that copies of one text count once, and must pass a likelihood bound corrected for the number of entries tried.
Exception phrases are two-word phrases around a hit that are significant for clean rows by the same bound; more can be
given. The lexicon holds ``MAX_ENTRIES`` entries at most, the most significant, so its broadcast is bounded.

Null and empty texts: no words, no hits, the curve's value at zero. Null ids are scored, never held out. With a class
missing the score is a constant near the base rate. Repeated rows give repeated results; an empty table an empty one.
Only doc_id and text are read, and of labels doc_id and toxic.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterable
from functools import partial

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import labelled
from tidemark.llm.common import map_batches, written

FIT_ROWS, MAX_ENTRIES, MAX_PHRASES = 2000, 5000, 1000
LEAST_SEEN, LEAST_WEIGHT, MOST_WEIGHT, LEVEL = 3, 2.5, 6.0, 0.05
STEMS = (4, 5, 6, 7, 8)
#: Bytes of text whose terms a task holds at a time: a text gives many times its size.
SAMPLE_BYTES = 1 << 17

#: Look-alike letters of other scripts, in lower case, and the plain letters they pass for.
_LOOKS = {
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "l", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ѵ": "v",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "ι": "l", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "l", "ł": "l", "ø": "o", "đ": "d", "ɡ": "g", "ɑ": "a",
}
#: Digits and the letters they stand for.
_DIGITS = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
#: Signs inside or before words and the letters they stand for.
_SIGNS = {"@": "a", "$": "s", "€": "e", "!": "l", "|": "l"}
_HIDDEN = [*range(0x300, 0x370), 0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF]
_FOLD = str.maketrans(_LOOKS | _DIGITS | {"i": "l"} | {chr(c): None for c in _HIDDEN})
_SIGN = re.compile(r"[@$€](?=\w)|(?<=\w)[!|](?=\w)")
_WORD = re.compile(r"[^\W_]+")


def fold_words(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if any(s in text for s in _SIGNS):
        text = _SIGN.sub(lambda m: _SIGNS[m[0]], text)
    return _WORD.findall(text.translate(_FOLD))


def held(id_col: Column) -> Column:
    return labelled.held_out(id_col, 4, 2)


class Lexicon:
    """The automaton over ' word ' and ' beginning' patterns and exception phrases."""

    def __init__(self, entries: dict[str, float], phrases: Iterable[str] = ()):
        self.automaton = ahocorasick.Automaton()
        for pattern, weight in entries.items():
            self.automaton.add_word(pattern, (len(pattern), weight))
        for phrase in phrases:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
        self.some = len(self.automaton) > 0
        if self.some:
            self.automaton.make_automaton()

    def hits(self, words: list[str]) -> dict[int, float]:
        """Start of each word that is hit (in the words joined by spaces, one space before) and its weight."""
        found: dict[int, float] = {}
        covered: list[tuple[int, int]] = []
        if self.some and words:
            text = f" {' '.join(words)} "
            for end, (length, weight) in self.automaton.iter(text):
                start = end - length + 1
                if weight is None:
                    covered.append((start, end))
                elif weight > found.get(start, 0.0) and (text[end] == " " or text[end + 1] != " "):  # beginnings are of longer words
                    found[start] = weight
        for start, end in covered:
            for hit in [h for h in found if start <= h < end]:
                del found[hit]
        return found

    def features(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), 2))
        for i, text in enumerate(texts):
            words = fold_words(text)
            total = sum(self.hits(words).values())
            out[i] = total / math.log2(2 + len(words)), min(total, MOST_WEIGHT)
        return out


def _hash(before: str, after: str) -> int:
    return zlib.crc32(f"{before} {after}".encode("utf-8", "surrogatepass"))


def _terms(words: list[str]) -> dict[str, int]:
    """Each entry that the words could give, with a hash of the surroundings where it first stands."""
    found: dict[str, int] = {}
    around = ["", *words, ""]
    for i, word in enumerate(words):
        if len(word) < 3 or f" {word} " in found:
            continue
        context = _hash(around[i], around[i + 2])
        found[f" {word} "] = context
        for n in STEMS:
            if len(word) > n:
                found.setdefault(f" {word[:n]}", context)
    return found


def _counted(pairs: DataFrame, classes: tuple[int, int], own: int) -> DataFrame:
    """(term, a, b, gain): surroundings in class ``own`` and in the other, and the log likelihood gain over the share."""
    seen = pairs.distinct().groupBy("term").agg(F.sum((F.col("label") == own).cast("long")).alias("a"), F.sum((F.col("label") != own).cast("long")).alias("b"))
    share = max(1e-9, min(1 - 1e-9, classes[own] / max(1, sum(classes))))
    n, a = (F.col("a") + F.col("b")).cast("double"), F.col("a").cast("double")
    rate = a / n
    part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    return seen.where(F.col("a") >= LEAST_SEEN).withColumn("gain", F.when(rate > share, n * (part(rate, F.lit(share)) + part(1 - rate, F.lit(1 - share)))).otherwise(0.0))


def _significant(counted: DataFrame, most: int) -> list:
    """Entries whose gain passes the bound for as many tries, the most significant first."""
    counted = written(counted.sparkSession, counted, "toxicity-counts")
    bound = math.log(max(1, counted.count()) / LEVEL)
    return counted.where(F.col("gain") > bound).orderBy(F.desc("gain"), "term").limit(most).collect()  # bounded by ``most``


def choose_entries(rows: list, classes: tuple[int, int]) -> dict[str, float]:
    """Weights; of an entry and a longer one that extends it, one stays: the longer if it explains nearly as much."""
    scored = {}
    for r in rows:
        weight = math.log((r["a"] + 0.5) / (classes[1] + 1)) - math.log((r["b"] + 0.5) / (classes[0] + 1))
        if weight >= LEAST_WEIGHT:
            scored[r["term"]] = (r["a"], min(weight, MOST_WEIGHT))
    kept = dict(scored)
    for term in sorted(scored, key=len, reverse=True):
        for n in STEMS:
            stem = term[: n + 1]
            if stem != term and stem in kept and term in kept:
                del kept[stem if scored[term][0] >= 0.9 * scored[stem][0] else term]
    return {t: w for t, (_, w) in kept.items()}


def _phrases(words: list[str], lexicon: Lexicon) -> dict[str, int]:
    """Two-word phrases around hits, each with a hash of its surroundings."""
    hits = lexicon.hits(words)
    if not hits:
        return {}
    found, at, around = {}, 0, ["", "", *words, "", ""]
    for i, word in enumerate(words):
        if at in hits:
            if i:
                found.setdefault(f"{words[i - 1]} {word}", _hash(around[i], around[i + 3]))
            if i + 1 < len(words):
                found.setdefault(f"{word} {words[i + 1]}", _hash(around[i + 1], around[i + 4]))
        at += len(word) + 1
    return found


def _emit(function: Callable[[list[str]], dict[str, int]]):
    def run(columns: dict[str, list], _: object) -> dict[str, list]:
        found = [(t, c, label) for text, label in zip(columns["text"], columns["label"], strict=True) for t, c in function(fold_words(text)).items()]
        return {"term": [f[0] for f in found], "context": [f[1] for f in found], "label": [f[2] for f in found]}

    return run


def _make_scorer(model: tuple) -> Callable[[list], np.ndarray]:
    entries, phrases, calibration = model
    lexicon = Lexicon(entries, phrases)
    return lambda texts: labelled.logistic(calibration, lexicon.features(texts))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, exceptions: Iterable[str] = ()) -> Callable[[], Callable[[list], np.ndarray]]:
    """A scorer to hand to ``labelled.score_rows`` or ``labelled.keep_rows``."""
    sample = labelled.sample(docs, labels, "toxic", held, rows)
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    classes = (counts.get(0, 0), counts.get(1, 0))
    schema = "term string, context long, label int"
    entries = choose_entries(_significant(_counted(map_batches(sample, _emit(_terms), schema, None, SAMPLE_BYTES), classes, 1), MAX_ENTRIES), classes)
    near_hits = map_batches(sample, lambda c, lexicon: _emit(lambda words: _phrases(words, lexicon))(c, None), schema, partial(Lexicon, entries), SAMPLE_BYTES)
    phrases = [r["term"] for r in _significant(_counted(near_hits, classes, 0), MAX_PHRASES)]
    phrases += [" ".join(fold_words(p)) for p in exceptions]

    def measured(columns: dict[str, list], lexicon: Lexicon) -> dict[str, list]:
        return {"label": columns["label"], "features": lexicon.features(columns["text"]).tolist()}

    seen = map_batches(sample, measured, "label int, features array<double>", partial(Lexicon, entries, phrases), SAMPLE_BYTES).collect()  # bounded by ``rows``
    seen.sort(key=lambda r: (r["features"], r["label"]))
    calibration = labelled.fit_logistic(np.array([r["features"] for r in seen]).reshape(-1, 2), np.array([r["label"] for r in seen], float))
    return partial(_make_scorer, (entries, phrases, calibration))


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return labelled.score_rows(docs, fit(docs, labels), held)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return labelled.keep_rows(docs, fit(docs, labels), positive=False)
