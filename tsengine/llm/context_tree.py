"""Code lengths of texts by context-tree weighting, next to a word unigram baseline.

A text is the byte string of its words (ASCII letters in lower case, separated by one
blank, a line feed as the end); word sequences and these strings are one to one.

``language_scores`` takes the probabilities of ``byte_tree``: contexts are the bytes
themselves, all eight bits of a byte are decided in the mixed tree, and a context is a
node if it was met twice, whatever the size of the corpus. No part of it is broadcast.

The baseline needs a count for each word of each text. Words go the way of the grams: the
different words of a span are counted, dealt by their hash and come back with the counts
of the corpus, at most ``hot`` in a message.

Defined results: NULL and empty texts are the end alone; without training documents
all decisions are even and all counts 0; repeated rows count and are scored one by
one; a NULL id is in no remainder, so such rows are scored as held out; columns
beyond ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from tsengine.llm import byte_tree
from tsengine.llm.common import fold, settle, small_batches

# Task code travels with the job, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

@dataclass(frozen=True)
class Spec:
    """``depth``: bytes of the longest context; ``hot``: most different words in a message."""

    depth: int = 8
    hot: int = 200_000


def text_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def byte_string(words: list[bytes]) -> bytes:
    return b" ".join(words) + b"\n"


ROWS = "doc_id string, held_out boolean, n_tokens long, n_known long, logs double, score double"


def score_texts(texts: DataFrame, spec: Spec) -> tuple[DataFrame, tuple[int, int, int]]:
    """A row per text: code length, words that are known, log10 of all words' counts; and the totals of the counts."""
    def rows_of(group: pd.DataFrame, scores: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> pd.DataFrame:
        of = np.repeat(np.arange(len(group)), sizes)
        known, logs = np.bincount(of[counts > 0], minlength=len(group)), np.bincount(of, weights=np.log10(counts + 0.5), minlength=len(group))
        return group[["doc_id", "held_out"]].assign(n_tokens=sizes + 1, n_known=known, logs=logs, score=scores)

    # The ids as strings: pandas has no whole numbers besides NULL.
    narrow = texts.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "held_out")
    string_of = lambda text: byte_string(text_words(text))
    return byte_tree.scored(narrow, string_of, rows_of, ROWS, spec.depth, most=spec.hot)


def language_scores(docs: DataFrame, spec: Spec = Spec(), modulus: int = 5, held: int = 1) -> DataFrame:
    """``score`` (log10 probability by the tree), ``base_score`` (by word counts) and what they rest on, per document."""
    small_batches(docs.sparkSession)
    remainder = fold(F.col("doc_id"), modulus)
    texts = docs.select("doc_id", "text", F.coalesce(remainder == held, F.lit(True)).alias("held_out"))
    rows, (words, different, ends) = score_texts(texts, spec)
    n, v = words + ends, different + (1 if ends else 0)
    whole = math.log10(n + 0.5 * (v + 1))
    return settle(rows, "scores").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "held_out",
        "n_tokens",
        (F.col("n_known") + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + math.log10(ends + 0.5) - F.col("n_tokens") * whole).alias("base_score"),
        "score",
    )
