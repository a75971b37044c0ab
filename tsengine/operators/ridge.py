"""Direct multi-step forecast by ridge regression on an instance-normalised context.

Each task adds up the cross products of its own windows; only those fixed-size
sums are shuffled and added. The solved coefficients, (context + 1) x horizon
numbers, are a model of fixed size and travel in the task closure.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tsengine.operators.chunks import SIZE
from tsengine.operators.instance_norm import EPS

# Task code travels with the job, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 4096  # windows handled at once inside a task
Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def _window_blocks(batch: pa.RecordBatch, length: int, size: int, value: str) -> Iterator[Block]:
    """Row numbers, starts and values of the windows of a batch of chunks, in blocks."""
    lists = batch.column(value)
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    chunk, base = batch.column("chunk").to_numpy(), batch.column("base").to_numpy()
    low = np.maximum(chunk * size, base)
    high = np.minimum(chunk * size + size - 1, base + np.diff(offsets) - length)
    held: list[Block] = []
    count = 0
    for i in np.flatnonzero(high >= low):
        view = np.lib.stride_tricks.sliding_window_view(flat[offsets[i] : offsets[i + 1]], length)
        view = view[low[i] - base[i] : high[i] - base[i] + 1]
        for at in range(0, len(view), BLOCK):
            part = view[at : at + BLOCK]
            first = low[i] + at
            held.append((np.full(len(part), i), np.arange(first, first + len(part)), part))
            count += len(part)
            if count >= BLOCK:
                yield tuple(map(np.concatenate, zip(*held)))
                held, count = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _normalise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean = x.mean(axis=1, keepdims=True)
    scale = np.sqrt(x.var(axis=1, keepdims=True) + EPS)
    return (x - mean) / scale, mean, scale


def _lists(values: np.ndarray) -> pa.ListArray:
    rows, width = values.shape
    offsets = np.arange(0, (rows + 1) * width, width, dtype="int32")
    return pa.ListArray.from_arrays(offsets, np.ascontiguousarray(values).ravel())


def score(
    chunks: DataFrame,
    fn: Callable[[np.ndarray], np.ndarray],
    context: int,
    horizon: int,
    keep: Sequence[str],
    value: str = "v",
    first: str | None = None,
    size: int = SIZE,
) -> DataFrame:
    """Apply a user's forecaster to every window: ``window_id``, ``pred`` and ``true`` arrays.

    ``fn`` maps contexts [windows, context] to forecasts [windows, horizon]. The
    chunks stay where they are; no window is shuffled.
    """
    names = list(keep)
    fields = list(chunks.select(*names).schema.fields)
    lists = ArrayType(DoubleType())
    schema = StructType(
        [*fields, StructField("window_id", LongType()), StructField("pred", lists), StructField("true", lists)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, starts, windows in _window_blocks(batch, context + horizon, size, value):
                forecast = np.asarray(fn(windows[:, :context]), dtype="float64")
                if forecast.shape != (len(rows), horizon):
                    raise ValueError(f"forecaster gave shape {forecast.shape}, not {(len(rows), horizon)}")
                index = pa.array(rows)
                origin = batch.column(first).to_numpy()[rows] if first else 0
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(name).take(index) for name in names],
                        pa.array(starts - origin, pa.int64()),
                        _lists(forecast),
                        _lists(windows[:, context:]),
                    ],
                    names=[*names, "window_id", "pred", "true"],
                )

    columns = [*names, "chunk", "base", value] + ([first] if first and first not in names else [])
    return chunks.select(*columns).mapInArrow(run, schema)


def unpack(scored: DataFrame) -> DataFrame:
    """Scored arrays to one row per step."""
    rest = [c for c in scored.columns if c not in ("pred", "true")]
    pairs = scored.select(*rest, F.posexplode(F.arrays_zip("pred", "true")).alias("_i", "_pair"))
    return pairs.select(
        *rest, (F.col("_i") + 1).alias("step"), F.col("_pair")["pred"].alias("pred"), F.col("_pair")["true"].alias("true")
    )


@dataclass(frozen=True)
class Ridge:
    """Fitted coefficients: ``weights`` [context, horizon] and ``intercept`` [horizon]."""

    context: int
    horizon: int
    weights: np.ndarray
    intercept: np.ndarray
    normalised: bool = True

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.normalised:
            return x @ self.weights + self.intercept
        z, mean, scale = _normalise(x)
        return (z @ self.weights + self.intercept) * scale + mean

    def transform(self, chunks: DataFrame, keep: Sequence[str], **options) -> DataFrame:
        return unpack(score(chunks, self.predict, self.context, self.horizon, keep, **options))

    def rolled_out(self, horizon: int) -> Ridge:
        """Recursive forecast of a one-step model: predict, append, repeat.

        Each step is linear in the context, so the recursion is done once on the
        coefficients and not on every window.
        """
        if self.horizon != 1:
            raise ValueError("only a one-step model can be rolled out")
        known = np.vstack([np.eye(self.context), np.zeros((1, self.context))])  # last row: constants
        step = self.weights[:, 0]
        for _ in range(horizon):
            following = known[:, -self.context :] @ step
            following[-1] += self.intercept[0]
            known = np.column_stack([known, following])
        made = known[:, self.context :]
        return replace(self, horizon=horizon, weights=made[:-1], intercept=made[-1])


def partial_sums(
    chunks: DataFrame, context: int, horizon: int, normalised: bool = True, value: str = "v", size: int = SIZE
) -> DataFrame:
    """Per task: rows i of [X 1]'[X 1 Y], each a fixed-size array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((context + 1, context + 1 + horizon))
        for batch in batches:
            for _, _, windows in _window_blocks(batch, context + horizon, size, value):
                x, y = windows[:, :context], windows[:, context:]
                if normalised:
                    x, mean, scale = _normalise(x)
                    y = (y - mean) / scale
                design = np.hstack([x, np.ones((len(x), 1))])
                total += design.T @ np.hstack([design, y])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(context + 1)), _lists(total)], names=["i", "sums"])

    return chunks.select("chunk", "base", value).mapInArrow(run, "i long, sums array<double>")


def _add_up(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {name: [pdf[name].iloc[0]] for name in by}
        out["sums"] = [np.sum(np.stack(pdf["sums"].to_numpy()), axis=0)]
        return pd.DataFrame(out)

    fields = [f for f in parts.schema.fields if f.name in (*by, "sums")]
    return parts.groupBy(*by).applyInPandas(add, StructType(fields))


def fit(
    chunks: DataFrame,
    context: int,
    horizon: int,
    penalty: float = 1.0,
    normalised: bool = True,
    value: str = "v",
    size: int = SIZE,
    fan_in: int = 64,
) -> Ridge:
    """Fit pooled over all given chunks. Sums are added in two levels of bounded groups."""
    parts = partial_sums(chunks, context, horizon, normalised, value, size)
    salted = parts.withColumn("salt", F.spark_partition_id() % fan_in)
    sums = _add_up(_add_up(salted, ["i", "salt"]), ["i"])
    rows = sorted(sums.collect(), key=lambda r: r["i"])  # context + 1 rows of fixed width
    total = np.array([r["sums"] for r in rows])
    gram, cross = total[:, : context + 1], total[:, context + 1 :]
    ridge = np.eye(context + 1) * penalty
    ridge[-1, -1] = 0.0
    solved = np.linalg.lstsq(gram + ridge, cross, rcond=None)[0]
    return Ridge(context, horizon, solved[:-1], solved[-1], normalised)
