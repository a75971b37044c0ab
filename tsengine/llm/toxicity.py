"""Toxicity from a weighted lexicon.

Texts are folded first: lower case, look-alike letters of other scripts to the Latin
ones, digits and signs inside a word to the letters they stand for, invisible
characters away, anything that is no letter to one blank. The lexicon holds words
and beginnings of words with log-odds weights; one Aho-Corasick automaton finds all
entries in a single run over the text. An entry inside an exception phrase doesn't
count. Weights are added up and set against the length; a logistic function of that
is the score.

Lexicon, exceptions and the function's three coefficients are learned from labelled
documents: at most ``Spec.sample`` of them, the first by a hash of the id. Everything
else sees every row and every whole text.

Defined results: NULL and empty texts have no hits and get the score of a text
without hits; without labels of both kinds the lexicon is empty and all texts get the
smoothed share of toxic labels; a document with several labels is toxic if one says
so; repeated rows are scored one by one; columns beyond those named are not read.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from tsengine.llm.common import fold, packed_rows, small_batches, unpacked_rows

# Task code travels with the job, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Letters that look like Latin ones, by the Latin letter.
LOOK_ALIKES = {
    "a": "аαａ", "b": "ьｂ", "c": "сϲｃ", "d": "ԁｄ", "e": "еεｅ", "f": "ｆ", "g": "ɡｇ", "h": "һｈ", "i": "іιıｉ", "j": "јϳｊ",
    "k": "кκｋ", "l": "ӏｌ", "m": "мｍ", "n": "ոｎ", "o": "оοօｏ", "p": "рρｐ", "q": "ԛｑ", "r": "гｒ", "s": "ѕｓ", "t": "тτｔ",
    "u": "υսｕ", "v": "ѵνｖ", "w": "ԝωｗ", "x": "хχｘ", "y": "уγｙ", "z": "ᴢｚ",
}
# Digits and signs that stand for letters, and characters that can't be seen.
STAND_INS = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i",
}
# Those that may stand for an l as well.
TWO_WAYS = {"1": "l", "|": "l"}
INVISIBLE = "­​‌‍⁠﻿"

_FOLDED = str.maketrans({c: k for k, v in LOOK_ALIKES.items() for c in v} | dict.fromkeys(INVISIBLE))
_FOREIGN = re.compile(f"[{''.join(LOOK_ALIKES.values())}{INVISIBLE}]")
# After a letter to the word's end, or before a letter at its beginning; a mark such as "!" only before a letter.
_STOOD_IN = re.compile(r"(?<=[^\W\d_])(?:[013456789@$!|]+(?=[^\W\d_])|[013456789@$]+)|(?<![^\W])[013456789@$!|]+(?=[^\W\d_])")
_LETTERS, _OTHERS = str.maketrans(STAND_INS), str.maketrans(STAND_INS | TWO_WAYS)
_GAP = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Spec:
    """``sample``: labelled documents learned from; ``entries``: size of the lexicon; ``starts``: letters of word beginnings."""

    sample: int = 20_000
    entries: int = 5_000
    least_docs: int = 4
    least_weight: float = 1.5
    starts: tuple[int, ...] = (4, 5, 6, 7)
    threshold: float = 0.5


@dataclass
class Model:
    """``lexicon``: entry to weight, an entry begins with a blank and a whole word ends with one."""

    lexicon: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    coefficients: tuple[float, float, float] = (0.0, 0.0, 0.0)


def readings(text: str | None) -> list[str]:
    """Words of folded letters with a blank before and after each; two of them, equally long, where a sign can be read two ways."""
    low = (text or "").lower()
    if _FOREIGN.search(low):
        low = low.translate(_FOLDED)
    ways = [_STOOD_IN.sub(lambda m: m[0].translate(_LETTERS), low)]
    if any(c in low for c in TWO_WAYS):
        ways.append(_STOOD_IN.sub(lambda m: m[0].translate(_OTHERS), low))
        if ways[0] == ways[1]:
            ways.pop()
    return [f" {_GAP.sub(' ', way).strip()} " for way in ways]


def folded(text: str | None) -> str:
    """The first reading of a text."""
    return readings(text)[0]


class Matcher:
    """The automaton of a model."""

    def __init__(self, model: Model):
        self.automaton = ahocorasick.Automaton()
        for entry, weight in model.lexicon.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in model.exceptions:
            self.automaton.add_word(phrase, (len(phrase), 0.0))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, *texts: str) -> list[tuple[int, int, float]]:
        """First and last position, and weight, of the heaviest entry at each place where entries begin, in any reading.

        An entry inside an exception phrase of the same reading doesn't count.
        """
        best: dict[int, tuple[int, float]] = {}
        for text in texts if len(self.automaton) else ():
            spared, found = [], []
            for last, (size, weight) in self.automaton.iter(text):
                (found if weight else spared).append((last - size + 1, last, weight))
            spared.sort()
            found.sort()
            # Both ascend: the phrase that reaches furthest, of those that begin no later, is the one that can hold the entry.
            at, reach = 0, -1
            for first, last, weight in found:
                while at < len(spared) and spared[at][0] <= first:
                    reach = max(reach, spared[at][1])
                    at += 1
                if last > reach and (first not in best or weight > best[first][1]):
                    best[first] = (last, weight)
        return [(first, last, weight) for first, (last, weight) in best.items()]

    def facts(self, text: str | None) -> tuple[float, float]:
        """Log of the weight of all hits, and weight by the length of the text."""
        ways = readings(text)
        weight = sum(h[2] for h in self.hits(*ways))
        return math.log1p(weight), weight / math.sqrt(ways[0].count(" "))


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, sample: int) -> DataFrame:
    """Texts and labels of at most ``sample`` labelled documents outside the held-out remainder."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
    known = known.agg(F.max(label).cast("int").alias("y")).where(fold(F.col("doc_id"), modulus) != held)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("_id"), "y")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "y")


def _features(words: list[str], starts: tuple[int, ...]) -> set[str]:
    found = set()
    for word in words:
        found.add(f" {word} ")
        for k in starts:
            if len(word) > k:
                found.add(f" {word[:k]}")
    return found


def _counted(rows: DataFrame, keys_of) -> DataFrame:
    """Documents with a key, toxic ones and others; ``keys_of`` gives the keys of a text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums = {0: Counter(), 1: Counter()}
            for text, y in zip(batch["text"], batch["y"]):
                sums[int(y > 0)].update(keys_of(text))
            keys = list(sums[0].keys() | sums[1].keys())
            if keys:
                yield pd.DataFrame({"key": keys, "bad": [sums[1][k] for k in keys], "good": [sums[0][k] for k in keys]})

    counted = rows.mapInPandas(count, "key string, bad long, good long")
    return counted.groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def learn_lexicon(rows: DataFrame, totals: tuple[int, int], spec: Spec) -> dict[str, float]:
    """Entries by evidence; a word that a chosen beginning explains as well is left out."""
    starts = spec.starts
    counted = _counted(rows, lambda text: _features(sorted(set(folded(text).split())), starts))
    bad, good = totals
    weight = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    scored = counted.where(f"bad >= {spec.least_docs}").withColumn("w", weight).where(f"w >= {spec.least_weight}")
    # How far the weight is from 0, in standard errors.
    scored = scored.withColumn("z", F.col("w") / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))).where("z >= 3")
    best = scored.orderBy(F.desc("z"), "key").limit(spec.entries).select("key", "w").collect()
    found = {r["key"]: r["w"] for r in best}
    return {
        key: w
        for key, w in found.items()
        if not any(found.get(key[: k + 1], -1.0) >= w - 1.0 for k in starts if k + 1 < len(key.rstrip()))
    }


def learn_exceptions(rows: DataFrame, lexicon: dict[str, float], spec: Spec) -> list[str]:
    """Phrases of a lexicon word and a neighbour that stand in clean documents nearly always."""
    matcher = Matcher(Model(lexicon))

    def phrases(text: str) -> set[str]:
        low, found = folded(text), set()
        for first, last, _ in matcher.hits(low):
            end = low.index(" ", max(last, first + 1))
            before, after = low.rfind(" ", 0, first), low.find(" ", end + 1)
            if before >= 0:
                found.add(low[before : end + 1])
            if after >= 0:
                found.add(low[first : after + 1])
        return found

    clean = _counted(rows, phrases).where(f"good >= {spec.least_docs} AND good >= 19 * bad")
    return [r["key"] for r in clean.orderBy(F.desc("good"), "key").limit(spec.entries).collect()]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Coefficients by Newton's method; the first column is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, spec: Spec = Spec(), modulus: int = 5, held: int = 0) -> Model:
    rows = labelled(docs, labels, "toxic", modulus, held, spec.sample)
    counts = {r["bad"]: r["n"] for r in rows.groupBy((F.col("y") > 0).alias("bad")).agg(F.count("*").alias("n")).collect()}
    bad, good = counts.get(True, 0), counts.get(False, 0)
    base = math.log((bad + 1) / (good + 19))
    if not bad or not good:
        return Model(coefficients=(base, 0.0, 0.0))
    lexicon = learn_lexicon(rows, (bad, good), spec)
    model = Model(lexicon, learn_exceptions(rows, lexicon, spec) if lexicon else [])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(model)
        for batch in batches:
            facts = [matcher.facts(text) for text in batch["text"]]
            yield pd.DataFrame({"a": [f[0] for f in facts], "b": [f[1] for f in facts], "y": (batch["y"] > 0).astype(float)})

    # At most Spec.sample rows of three numbers.
    seen = rows.mapInPandas(measure, "a double, b double, y double").toPandas().to_numpy()
    weights = logistic(np.column_stack([np.ones(len(seen)), seen[:, 0], seen[:, 1]]), seen[:, 2])
    model.coefficients = tuple(float(w) for w in weights)
    return model


def score(text: Column, model: Model) -> Column:
    """Probability that a text is toxic."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher, (c, a, b) = Matcher(model), model.coefficients
        for batch in batches:
            facts = (matcher.facts(t) for t in batch)
            yield pd.Series([1 / (1 + math.exp(-max(-30.0, min(30.0, c + a * x + b * y)))) for x, y in facts], dtype=float)

    return scored(text)


def keep_clean(docs: DataFrame, labels: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """Rows of documents that aren't toxic, all columns."""
    model = learn(docs, labels, spec)
    scored = packed_rows(docs, "text").withColumn("score", score(F.col("text"), model))
    return unpacked_rows(scored.where(F.col("score") < spec.threshold), docs.columns)
