"""Sliding context/target windows cut lazily from chunk arrays.

The usual order is ``chunks.chunked`` -> ``by_channel`` -> ``starts`` ->
``contexts`` / ``pairs``. Only the chunks are ever shuffled. A window of
``context`` + ``horizon`` rows needs chunks made with
``after = context + horizon - 1``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tsengine.functions.permutation import permuted
from tsengine.operators.chunks import SIZE, explode_range


def halo(context: int, horizon: int) -> int:
    return context + horizon - 1


def count_windows(rows: Column, context: int, horizon: int) -> Column:
    """Number of stride-1 windows in that many rows."""
    return F.greatest(rows - (context + horizon - 1), F.lit(0).cast("bigint"))


def starts(
    chunks: DataFrame,
    length: int,
    size: int = SIZE,
    value: str = "v",
    first: str | None = None,
    stride: int = 1,
) -> DataFrame:
    """One row per window that begins in the chunk: ``start`` and ``window_id``.

    ``first`` names the column with the first position of the split; windows
    are counted from there. Short windows at the end of the series do not exist.
    """
    origin = F.col(first) if first else F.lit(0).cast("bigint")
    low = F.greatest(F.col("chunk") * size, F.col("base"))
    aligned = low + F.pmod(origin - low, F.lit(stride).cast("bigint")) if stride > 1 else low
    high = F.least(F.col("chunk") * size + (size - 1), F.col("base") + F.size(value) - length)
    windows = explode_range(chunks, aligned, high, "start", stride)
    offset = F.col("start") - origin
    return windows.withColumn("window_id", offset if stride == 1 else F.expr("0L") + F.floor(offset / stride))


def piece(value: str | Column, shift: int, length: int) -> Column:
    """Slice of the chunk array ``shift`` rows after the window start."""
    v = F.col(value) if isinstance(value, str) else value
    return F.slice(v, (F.col("start") - F.col("base") + (1 + shift)).cast("int"), F.lit(length))


def contexts(
    windows: DataFrame,
    context: int,
    label: int,
    horizon: int,
    value: str = "v",
    marks: str | None = None,
) -> DataFrame:
    """Arrays ``x`` (context) and ``y`` (last ``label`` context rows, then the horizon).

    With ``marks``, also ``x_mark`` and ``y_mark`` over the same rows.
    """
    if not 0 <= label <= context:
        raise ValueError("label must lie between 0 and the context length")
    out = windows.withColumn("x", piece(value, 0, context)).withColumn(
        "y", piece(value, context - label, label + horizon)
    )
    if marks:
        out = out.withColumn("x_mark", piece(marks, 0, context)).withColumn(
            "y_mark", piece(marks, context - label, label + horizon)
        )
    return out.drop(value, *([marks] if marks else []), "base", "chunk")


def steps(windows: DataFrame, horizon: int) -> DataFrame:
    """One row per window and step 1..horizon."""
    return windows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))


def at(context: int, value: str = "v", ahead: Column | int = 0) -> Column:
    """Chunk value ``ahead`` rows after the last context row of the window."""
    shift = F.lit(ahead) if isinstance(ahead, int) else ahead
    return F.element_at(F.col(value), (F.col("start") - F.col("base") + context + shift).cast("int"))


def decoder_input(y: Column, label: int, horizon: int) -> Column:
    """The label part of ``y``, then zeros in place of the horizon."""
    return F.concat(F.slice(y, 1, label), F.array_repeat(F.lit(0.0), horizon))


def target_part(y: Column, horizon: int) -> Column:
    """The last ``horizon`` rows of ``y``."""
    return F.slice(y, -horizon, horizon)


def output_channels(channels: Sequence[str], mode: str) -> list[str]:
    """Channels a run is scored on: the last one (the target) for ``MS``, else all."""
    return list(channels[-1:]) if mode == "MS" else list(channels)


def patches(x: Column, length: int, stride: int, padding: int) -> Column:
    """Pad by repeating the last value, then cut patches every ``stride``."""
    padded = F.concat(x, F.array_repeat(F.element_at(x, -1), padding))
    last = F.size(x) + padding - length
    begins = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(begins, lambda i: F.slice(padded, i + 1, F.lit(length)))


def batch_id(size: int, window: str = "window_id") -> Column:
    """Batch of a window when taken in order; the last one may be short."""
    return F.expr(f"`{window}` div {size}")


def shuffled(
    windows: DataFrame, keys: Sequence[str], seed: int, count: Column, epoch: int | Column = 0, batch: int | None = None
) -> DataFrame:
    """Adds ``place``: the window's position in the order of that epoch, and with ``batch`` its batch.

    ``count`` is the number of the series' windows. Place and batch are arithmetic on the
    window's number, so nothing is sorted; another epoch or seed gives another order.
    """
    at = F.lit(epoch) if isinstance(epoch, int) else epoch
    key = F.concat_ws("/", F.lit(str(seed)), at.cast("string"), *[F.col(k).cast("string") for k in keys])
    placed = windows.withColumn("place", permuted(F.col("window_id"), count, key))
    return placed.withColumn("batch_id", batch_id(batch, "place")) if batch else placed


def plot_frames(
    windows: DataFrame, batch: int, every: int, context: int, horizon: int, prediction: Column, value: str = "v"
) -> DataFrame:
    """Context followed by truth and by prediction, for the first window of every n-th batch.

    The windows are filtered before any array is cut.
    """
    picked = windows.filter(F.col("window_id") % (batch * every) == 0)
    x = piece(value, 0, context)
    truth = F.concat(x, piece(value, context, horizon))
    forecast = F.concat(x, prediction)
    kept = [c for c in windows.columns if c not in (value, "base", "chunk", "start")]
    return picked.select(*kept, F.posexplode(F.arrays_zip(truth.alias("t"), forecast.alias("p"))).alias("pos", "_pair")).select(
        *kept, "pos", F.col("_pair")["t"].alias("truth"), F.col("_pair")["p"].alias("prediction")
    )
