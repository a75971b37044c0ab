"""Document quality from the lines of a text.

A linear-chain conditional random field labels the lines good or bad. A line's
features are its own measures and those of the lines before and after it. Forward
and backward sums give each line's probability of being good; their mean, weighted
by line length, is the document's quality.

The field is fitted to labelled documents whose label stands for each of their
lines: at most ``Spec.sample`` documents, the first by a hash of the id, of at most
``Spec.lines`` lines. Scores see every row and every whole text.

Defined results: NULL and empty texts are one empty line; without labels of both
kinds all texts get the smoothed share of good labels; repeated rows are scored one
by one; columns beyond those named are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from tsengine.llm.toxicity import labelled

# Task code travels with the job, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MEASURES = 15
FEATURES = 3 * MEASURES + 3


@dataclass(frozen=True)
class Spec:
    """``sample``: documents, ``lines``: most lines of one, to learn from; ``slab``: bytes of text measured at once."""

    sample: int = 4_000
    lines: int = 1_000
    steps: int = 120
    slab: int = 1 << 20
    threshold: float = 0.7


@dataclass
class Model:
    """Weights of the features for good against bad, of staying and of switching; ``share`` stands in where nothing was learned."""

    weights: np.ndarray | None
    switch: np.ndarray | None
    share: float


def _class_table() -> np.ndarray:
    """Byte to class: 0 other, 1 blank, 2 lower, 3 upper, 4 digit, 5 sign, 6 bar, 7 exclamation, 8 stop, 9 beyond ASCII."""
    table = np.zeros(256, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = 1
    table[ord("a") : ord("z") + 1] = 2
    table[ord("A") : ord("Z") + 1] = 3
    table[ord("0") : ord("9") + 1] = 4
    table[[ord(c) for c in "#*$%&<>"]] = 5
    table[ord("|")], table[ord("!")] = 6, 7
    table[[ord(c) for c in ".?:;"]] = 8
    table[128:] = 9
    return table


CLASSES = _class_table()
POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def measure_lines(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of all lines, their weights (characters), and the number of lines of each text."""
    parts = [(t or "").encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    newline = data == 10
    ends = np.flatnonzero(newline)
    starts = np.concatenate([[0], ends[:-1] + 1])
    n_lines = np.add.reduceat(newline.astype(np.int64), np.cumsum(sizes) - sizes)
    kind = CLASSES[data]
    counts = [np.add.reduceat((kind == c).astype(np.int32), starts).astype(float) for c in range(1, 10)]
    blank, lower, upper, digit, sign, bar, bang, stop, beyond = counts
    length = (ends - starts).astype(float)
    blank -= 1  # the newline
    solid = np.maximum(length - blank, 1)
    # Words: runs of bytes that are no blanks; the newline ends the last of a line.
    filled = (kind != 1).astype(np.int8)
    edge = np.diff(np.concatenate([[0], filled, [0]]))
    first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lines = len(starts)
    line_of = np.searchsorted(starts, first, side="right") - 1
    words = np.bincount(line_of, minlength=lines).astype(float)
    repeated, signed, line_hash = np.zeros(lines), np.zeros(lines), np.zeros(lines, np.uint64)
    if len(first):
        word_of = np.maximum(np.cumsum(edge[:-1] == 1) - 1, 0)
        place = np.arange(len(data)) - first[word_of]
        value = (data.astype(np.uint64) + np.uint64(1)) * POWERS[place & 63] * filled.astype(np.uint64)
        value ^= value >> np.uint64(31)
        value *= filled.astype(np.uint64)
        hashes = np.add.reduceat(value, first)
        again = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])])
        repeated = np.bincount(line_of, weights=again, minlength=lines)
        signed = np.bincount(line_of, weights=np.isin(kind[after - 1], (5, 6)), minlength=lines)
        order = np.arange(len(first), dtype=np.uint64) - np.repeat(
            np.searchsorted(line_of, np.arange(lines)), words.astype(np.int64)
        ).astype(np.uint64)
        np.add.at(line_hash, line_of, hashes * (np.uint64(2) * order + np.uint64(1)))
    doc_of = np.repeat(np.arange(len(parts)), n_lines)
    same = np.zeros(lines)
    same[1:] = (line_hash[1:] == line_hash[:-1]) & (doc_of[1:] == doc_of[:-1]) & (words[1:] > 0)
    _, which, copies = np.unique(np.stack([doc_of.astype(np.uint64), line_hash]), axis=1, return_inverse=True, return_counts=True)
    copied = (copies[which.reshape(-1)] > 1) & (words > 0)
    last = data[np.maximum(ends - 1, 0)]
    per_word = np.maximum(words, 1)
    measures = np.column_stack(
        [
            np.log1p(words) / 5,
            words == 0,
            upper / solid,
            digit / solid,
            sign / solid,
            bar / solid,
            bang / solid,
            stop / solid,
            beyond / solid,
            np.minimum(solid / per_word / 10, 3),
            repeated / per_word,
            signed / per_word,
            np.maximum(same, copied),
            (CLASSES[last] == 8) & (length > 0),
            lower / solid,
        ]
    ).astype(np.float32)
    return measures, np.maximum(length, 1), n_lines


def features(measures: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Own measures, those of the neighbouring lines (0 beyond the text), whether there are any, and a constant."""
    total = len(measures)
    stops = np.cumsum(n_lines)
    before, after = np.zeros_like(measures), np.zeros_like(measures)
    before[1:], after[:-1] = measures[:-1], measures[1:]
    is_first, is_last = np.zeros(total, bool), np.zeros(total, bool)
    is_first[stops - n_lines] = True
    is_last[stops - 1] = True
    before[is_first], after[is_last] = 0, 0
    return np.column_stack([measures, before, after, is_first, is_last, np.ones(total)])


def chain(unary: np.ndarray, n_lines: np.ndarray, switch: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Probabilities of good lines, expected pairs of labels, and the log of the sum over all labellings.

    ``unary``: a line's weight for good against bad. Texts run side by side, one line
    of each at a step, longest first; a step of a text that has ended is not taken.
    """
    order = np.argsort(-n_lines, kind="stable")
    offset = (np.cumsum(n_lines) - n_lines)[order]
    sizes = n_lines[order]
    steps = int(sizes[0])
    alive = np.searchsorted(-sizes, -np.arange(steps), side="left")
    forward = np.zeros((len(unary), 2))
    backward = np.zeros((len(unary), 2))
    scores = np.column_stack([np.zeros(len(unary)), unary])
    for t in range(steps):
        at = offset[: alive[t]] + t
        if t == 0:
            forward[at] = scores[at]
        else:
            reach = forward[at - 1][:, :, None] + switch
            forward[at] = np.logaddexp(reach[:, 0], reach[:, 1]) + scores[at]
    for t in range(steps - 2, -1, -1):
        at = offset[: alive[t + 1]] + t
        reach = switch + (scores[at + 1] + backward[at + 1])[:, None, :]
        backward[at] = np.logaddexp(reach[:, :, 0], reach[:, :, 1])
    ends = offset + sizes - 1
    whole = np.logaddexp(forward[ends, 0], forward[ends, 1])
    spread = np.empty(len(n_lines))
    spread[order] = whole
    total = np.repeat(spread, n_lines)
    good = np.exp(forward[:, 1] + backward[:, 1] - total)
    inner = np.ones(len(unary), bool)
    inner[(np.cumsum(n_lines) - n_lines)] = False
    at = np.flatnonzero(inner)
    pairs = np.zeros((2, 2))
    if len(at):
        joint = forward[at - 1][:, :, None] + switch + (scores[at] + backward[at])[:, None, :] - total[at][:, None, None]
        pairs = np.exp(joint).sum(axis=0)
    return np.clip(good, 0, 1), pairs, float(whole.sum())


def fit(x: np.ndarray, n_lines: np.ndarray, y: np.ndarray, spec: Spec) -> Model:
    """Conditional maximum likelihood by Adam. ``y``: the documents' labels, held by all their lines."""
    share = float((y.sum() + 1) / (len(y) + 2))
    if not len(y) or y.min() == y.max():
        return Model(None, None, share)
    label = np.repeat(y, n_lines).astype(float)
    stays = n_lines - 1
    seen = np.diag([float(stays[y == 0].sum()), float(stays[y == 1].sum())])
    weights, switch = np.zeros(x.shape[1]), np.zeros((2, 2))
    moments = [np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros((2, 2)), np.zeros((2, 2))]
    size = len(label)
    for step in range(1, spec.steps + 1):
        good, pairs, _ = chain(x @ weights, n_lines, switch)
        # Switching between labels never occurs in the weak labels; the penalty keeps its weight finite.
        slopes = [x.T @ (label - good) / size - 1e-5 * weights, (seen - pairs) / size - 1e-3 * switch]
        for k, (value, slope) in enumerate(zip((weights, switch), slopes)):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (slope - m)
            v += 0.01 * (slope * slope - v)
            value += 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(weights, switch, share)


def slabs(texts: list[str | None], size: int) -> Iterator[list[str | None]]:
    """Runs of texts of about ``size`` characters."""
    run, held = [], 0
    for text in texts:
        run.append(text)
        held += len(text or "") + 1
        if held >= size:
            yield run
            run, held = [], 0
    if run:
        yield run


def score_texts(texts: list[str | None], model: Model, spec: Spec = Spec()) -> np.ndarray:
    out = []
    for run in slabs(texts, spec.slab):
        if model.weights is None:
            out.append(np.full(len(run), model.share))
            continue
        measures, length, n_lines = measure_lines(run)
        good, _, _ = chain(features(measures, n_lines) @ model.weights, n_lines, model.switch)
        starts = np.cumsum(n_lines) - n_lines
        out.append(np.add.reduceat(good * length, starts) / np.add.reduceat(length, starts))
    return np.concatenate(out) if out else np.empty(0)


def learn(docs: DataFrame, labels: DataFrame, spec: Spec = Spec(), modulus: int = 4, held: int = 2) -> Model:
    rows = labelled(docs, labels, "quality", modulus, held, spec.sample)
    short = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^\n]+", "")) < spec.lines
    most = spec.lines

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = 0
            for run in slabs(list(batch["text"]), spec.slab):
                measures, _, n_lines = measure_lines(run)
                parts = np.split(measures, np.cumsum(n_lines)[:-1])
                y = batch["y"].iloc[at : at + len(run)].to_numpy()
                at += len(run)
                yield pd.DataFrame({"m": [p[:most].tobytes() for p in parts], "y": y})

    # At most Spec.sample documents of Spec.lines lines.
    seen = rows.where(short).mapInPandas(measured, "m binary, y int").toPandas()
    if not len(seen):
        return Model(None, None, 0.5)
    seen = seen.sort_values(["y", "m"], kind="stable")  # the same sums whatever task ended first
    parts = [np.frombuffer(m, np.float32).reshape(-1, MEASURES) for m in seen["m"]]
    n_lines = np.array([len(p) for p in parts])
    return fit(features(np.concatenate(parts), n_lines), n_lines, (seen["y"] > 0).to_numpy(int), spec)


def score(text: Column, model: Model, spec: Spec = Spec()) -> Column:
    """Quality of a text, 0 to 1."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(score_texts(list(batch), model, spec), dtype=float)

    return scored(text)
