"""Toxicity by a weighted lexicon, matched by one Aho-Corasick automaton over folded text.

Folding undoes disguises: case, compatibility forms, look-alike letters of other scripts, accents, digits and
signs in place of letters, and invisible characters. The lexicon holds words and word beginnings (stems) with
log-odds weights; a match inside an exception phrase does not count. The weights of a text's matches are
summed, divided by its length (damped), and a logistic regression makes a probability of it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import Work, logistic, map_rows, sampled, sigmoid, text_column, whole_text
from siftwell.llm.quality import per_text

# Letters of other scripts that look like Latin ones, and digits and signs written for letters.
LOOKALIKES = dict(zip("авгеёікмнорстухьѕїјԁһԛԝαβγεηικνορτυχωıłø", "abreeikmhopctyxbsijdhqwabyenikvoptuxwilo", strict=True))
WRITTEN = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "l": "i"}  # 1 is i and l alike


def _fold_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))[0].lower()
        table[code] = base
    table |= {ord(a): b for a, b in LOOKALIKES.items()} | {ord(a): b for a, b in WRITTEN.items()}
    table |= {code: None for code in (0xAD, *range(0x300, 0x370), *range(0x200B, 0x2010), 0x2060, 0xFEFF)}
    return {code: WRITTEN.get(letter, letter) if letter else letter for code, letter in table.items()}


FOLD = _fold_table()
WORD = re.compile(r"\w+")
STEMS = (4, 5, 6)


def fold(text: str) -> str:
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return text.lower().translate(FOLD)


@dataclass
class Model:
    """Folded terms with weights (`stem` terms match the beginnings of words), exception phrases, calibration."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [0.0, 0.0])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"}

    def automaton(self) -> ahocorasick.Automaton:
        if "_automaton" not in self.__dict__:
            made = ahocorasick.Automaton()
            terms: dict[str, list] = {}
            for term, weight in self.words.items():
                terms.setdefault(term, []).append((len(term), weight, True, False))
            for term, weight in self.stems.items():
                terms.setdefault(term, []).append((len(term), weight, False, False))
            for phrase in self.exceptions:
                terms.setdefault(phrase, []).append((len(phrase), 0.0, True, True))
            for term, kinds in terms.items():
                made.add_word(term, kinds)
            if terms:
                made.make_automaton()
            self._automaton = made
        return self._automaton

    def matches(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the terms in a folded text that count."""
        found, spared = [], []
        if not len(self.automaton()):
            return found
        for last, kinds in self.automaton().iter(text):
            end = last + 1
            for size, weight, whole, exception in kinds:
                start = end - size
                if start and text[start - 1].isalnum() or whole and end < len(text) and text[end].isalnum():
                    continue
                (spared if exception else found).append((start, end, weight))
        if spared:  # a match is spared if of the phrases that begin no later one ends no earlier
            spared.sort()
            starts, ends = [a for a, _, _ in spared], list(accumulate((b for _, b, _ in spared), max))
            found = [f for f in found if not (at := bisect_right(starts, f[0])) or ends[at - 1] < f[1]]
        return found

    def feature(self, text: str) -> float:
        """The summed weights of a text over its length in hundreds of characters, damped by a logarithm."""
        folded = fold(text)
        total = sum(weight for _, _, weight in self.matches(folded))
        return total / (1.0 + math.log1p(len(folded) / 100))

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.feature(t) for t in texts], float)
        return sigmoid(self.weights[0] + self.weights[1] * x)


def term_counts(rows: DataFrame, spared: list[str]) -> DataFrame:
    """(term, stem, toxic, clean): documents by term of (label, text) outside the spared phrases, counted per batch before the shuffle."""
    phrases = re.compile("|".join(rf"\b{re.escape(p)}\b" for p in spared)) if spared else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[Counter, Counter] = Counter(), Counter()
            for label, text in zip(batch.column(0).to_pylist(), text_column(batch, "text"), strict=True):
                folded = fold(text)
                words = {w for w in WORD.findall(phrases.sub(" ", folded) if phrases else folded) if len(w) >= 3}
                counts[label].update((w, False) for w in words)
                counts[label].update({(w[:n], True) for w in words for n in STEMS if len(w) > n})
            terms = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in terms], pa.string()), pa.array([s for _, s in terms], pa.bool_()),
                 pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())], ["term", "stem", "toxic", "clean"])

    return map_rows(rows.select("label", "text"), count, "term string, stem boolean, toxic long, clean long").groupBy("term", "stem").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


REST, NEXT = re.compile(r"\w*"), re.compile(r"\w* \w+")


def begin_of_word(text: str, space: int) -> int:
    """Where the word before a space begins; the place itself if there is no space or no word before it."""
    if space < 0 or text[space] != " ":
        return space
    at = space
    while at and (text[at - 1].isalnum() or text[at - 1] == "_"):
        at -= 1
    return at


def contexts(rows: DataFrame, model: Model) -> DataFrame:
    """(phrase, toxic, clean): documents by word pair around a term."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for label, text in zip(batch.column(0).to_pylist(), text_column(batch, "text"), strict=True):
                folded, phrases = fold(text), set()
                for start, end, _ in model.matches(folded):
                    rest, after = REST.match(folded, end), NEXT.match(folded, end)
                    if (before := begin_of_word(folded, start - 1)) < start - 1:
                        phrases.add(folded[before:start] + folded[start:end] + rest[0])
                    if after:
                        phrases.add(folded[start:end] + after[0])
                out += [(p, label) for p in phrases]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([k for _, k in out], pa.int32())], ["phrase", "label"])

    return map_rows(rows.select("label", "text"), count, "phrase string, label int").groupBy("phrase").agg(
        F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = 5000,
    support: int = 5, least: float = 3.0, exceptions: tuple[str, ...] = (),
) -> Model:
    """Learn terms, exceptions and calibration from a bounded sample: at most `rows` labelled texts per label.

    A term is kept when at least `support` toxic texts hold it and its log-odds are at least `least`; so there are
    at most as many as the sample's toxic texts have terms, over `support`. A stem gives way to a word that makes up nearly all of it, and covers its
    other words. Words inside the given exception phrases are not counted; a word pair around a term that
    occurs in `support` clean texts and in no toxic one becomes an exception, too. Without rows of both labels the lexicon is empty and every score the same.
    """
    work = Work(docs.sparkSession, "toxicity")
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(key), F.col(label).cast("int").alias("label"))
    known = known.join(docs.select(F.col(key).alias("__key")).distinct(), F.col(key) == F.col("__key"), "left_semi")
    counts = dict(known.groupBy("label").count().collect())
    if len(counts) < 2:
        share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
        return Model(weights=[math.log(share / (1 - share)), 0.0])
    chosen = work.stage(sampled(known, key, "label", rows, seed=8), "chosen")
    given = work.stage(docs.select(key, whole_text(text).alias("text")).join(F.broadcast(chosen), key).select("label", "text"), "texts")
    size = dict(given.groupBy("label").count().collect())
    toxic, clean = size.get(1, 0), size.get(0, 0)
    support = min(support, max(2, toxic // 10))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    spared = sorted({fold(e) for e in exceptions})
    heavy = term_counts(given, spared).withColumn("weight", odds).where((F.col("toxic") >= support) & (F.col("weight") >= min(least, math.log(max(clean, 2)))))
    found = heavy.orderBy(F.desc(F.col("weight") * F.log("toxic")), "term", "stem").collect()
    words = {r["term"]: (r["toxic"], r["weight"]) for r in found if not r["stem"]}
    stems = {r["term"]: (r["toxic"], r["weight"]) for r in found if r["stem"]}
    for stem in sorted(stems, key=len, reverse=True):
        inner = [n for w, (n, _) in words.items() if w.startswith(stem)]
        longer = [n for s, (n, _) in stems.items() if len(s) > len(stem) and s.startswith(stem)]
        if max(inner + longer, default=0) >= 0.9 * stems[stem][0]:
            del stems[stem]
    for stem in sorted(stems, key=len):
        for longer in [s for s in stems if len(s) > len(stem) and s.startswith(stem)]:
            del stems[longer]
    model = Model({w: x for w, (_, x) in words.items() if not any(w.startswith(s) for s in stems)}, {s: x for s, (_, x) in stems.items()})
    pairs = contexts(given, model).where((F.col("toxic") == 0) & (F.col("clean") >= support)).orderBy(F.desc("clean"), "phrase").collect()
    model.exceptions = sorted({*spared, *(r["phrase"] for r in pairs)})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.feature(t) for t in text_column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.float64())], ["label", "x"])

    measured = map_rows(given, measure, "label int, x double").toPandas().sort_values(["label", "x"])
    y = measured["label"].to_numpy(float)
    weight = np.where(y == 1, counts[1] / max(toxic, 1), counts[0] / max(clean, 1))
    weight *= len(y) / weight.sum()
    model.weights = logistic(measured[["x"]].to_numpy(), y, weight).tolist()
    model.weights[1] = max(model.weights[1], 0.0)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """All columns and the probability of label 1 of each whole text. Null and empty texts score like a text without a
    match; repeated rows score alike; texts of any length are matched whole; an empty table gives none; a given column of that name
    is replaced."""
    return per_text(docs, text, column, model.scores)
