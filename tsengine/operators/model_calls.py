"""A user's model on whole windows: all channels, time marks and the decoder's input.

The model gets what a sequence-to-sequence network gets: contexts, their marks, the
label part followed by zeros, and the marks of label and horizon. Windows of all
channels are views of one matrix per chunk; nothing is copied per window, marks come
once per window and no window is shuffled.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tsengine.operators.chunks import SIZE
from tsengine.operators.gram import chunk_windows

# Task code travels with the job, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Model = Callable[[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray | None], np.ndarray]


def _stacked(batch: pa.RecordBatch, i: int, channels: Sequence[str], length: int, size: int, marks: str | None):
    """First start, windows [windows, length, channels] and, with marks, [windows, length, marks]."""
    rows = np.stack([batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in channels], axis=1)
    whole = pa.ListArray.from_arrays([0, len(rows)], pa.FixedSizeListArray.from_arrays(rows.ravel(), len(channels)).cast(pa.list_(pa.float64())))
    columns = [batch.column("chunk").slice(i, 1), batch.column("base").slice(i, 1), whole]
    names = ["chunk", "base", "_all"]
    if marks:
        columns.append(batch.column(marks).slice(i, 1))
        names.append(marks)
    low, views = chunk_windows(pa.RecordBatch.from_arrays(columns, names=names), 0, length, size, names[2:])
    return low, views.get("_all"), views.get(marks) if marks else None


def score_windows(
    arrays: DataFrame,
    model: Model,
    channels: Sequence[str],
    context: int,
    label: int,
    horizon: int,
    keep: Sequence[str],
    marks: str | None = None,
    outputs: Sequence[str] | None = None,
    first: str = "first",
    size: int = SIZE,
    block: int = 1024,
) -> DataFrame:
    """``window_id``, ``pred`` and ``true``: forecasts of every window, step by step, ``outputs`` within a step.

    ``arrays`` has a row per chunk and an array per channel. ``model(x, x_mark, dec,
    y_mark)`` gets at most ``block`` windows: contexts [windows, context, channels],
    marks [windows, context, marks], the last ``label`` rows and zeros [windows, label +
    horizon, channels], marks of the same rows; it returns [windows, horizon, outputs].
    """
    if not 0 <= label <= context:
        raise ValueError("label must lie between 0 and the context length")
    names, chosen = list(keep), list(outputs or channels)
    picked = [list(channels).index(c) for c in chosen]
    lists = ArrayType(DoubleType())
    fields = [*arrays.select(*names).schema.fields, StructField("window_id", LongType())]
    schema = StructType([*fields, StructField("pred", lists), StructField("true", lists)])

    def flat(values: np.ndarray) -> pa.ListArray:
        width = horizon * len(picked)
        return pa.ListArray.from_arrays(np.arange(0, (len(values) + 1) * width, width, dtype="int32"), np.ascontiguousarray(values, "float64").ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                low, windows, marked = _stacked(batch, i, channels, context + horizon, size, marks)
                if windows is None:
                    continue
                origin = batch.column(first)[i].as_py()
                for at in range(0, len(windows), block):
                    part = windows[at : at + block]
                    x, truth = part[:, :context], part[:, context:, picked]
                    dec = np.zeros((len(part), label + horizon, len(channels)))
                    dec[:, :label] = x[:, context - label :]
                    both = (None, None) if marked is None else (marked[at : at + block, :context], marked[at : at + block, context - label :])
                    forecast = np.asarray(model(x, both[0], dec, both[1]), dtype="float64")
                    if forecast.shape != truth.shape:
                        raise ValueError(f"model gave shape {forecast.shape}, not {truth.shape}")
                    rows = pa.array(np.full(len(part), i))
                    ids = pa.array(np.arange(low + at, low + at + len(part)) - origin, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(k).take(rows) for k in names], ids, flat(forecast), flat(truth)], names=[*names, "window_id", "pred", "true"]
                    )

    wanted = dict.fromkeys([*names, "chunk", "base", first, *channels, *([marks] if marks else [])])
    return arrays.select(*wanted).mapInArrow(run, schema)


def unpack(scored: DataFrame, outputs: Sequence[str]) -> DataFrame:
    """Scored arrays to one row per step and channel."""
    rest = [c for c in scored.columns if c not in ("pred", "true")]
    each = scored.select(*rest, F.posexplode(F.arrays_zip("pred", "true")).alias("_i", "_s"))
    names = F.array(*map(F.lit, outputs))
    return each.select(
        *rest,
        (F.expr(f"_i div {len(outputs)}") + 1).cast("int").alias("step"),
        F.element_at(names, F.col("_i") % len(outputs) + 1).alias("channel"),
        F.col("_s")["pred"].alias("pred"),
        F.col("_s")["true"].alias("true"),
    )
