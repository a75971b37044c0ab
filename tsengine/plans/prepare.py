"""Prepared windows of one split: order, index, split, scale, marks, chunk, cut."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tsengine.functions.calendar import mark_array
from tsengine.operators import chunks, scaling, splits, windows


@dataclass(frozen=True)
class Spec:
    """Window and split settings of a run."""

    context: int = 336
    label: int = 24
    horizon: int = 96
    train: float = 0.7
    test: float = 0.2
    scale: bool = True
    freq: str | None = "h"  # None: integer calendar marks
    batch: int = 32
    size: int = chunks.SIZE

    @property
    def length(self) -> int:
        return self.context + self.horizon

    @property
    def halo(self) -> int:
        return windows.halo(self.context, self.horizon)


def split_arrays(
    panel: DataFrame,
    keys: Sequence[str],
    channels: Sequence[str],
    split: str,
    spec: Spec,
    ts: str | None,
    stats: DataFrame | None,
) -> DataFrame:
    """Scaled chunk arrays of one split, one row per (series, chunk) with an array per channel.

    The rows are shuffled once, by (series, chunk): the statistics join and the
    arrays share that partitioning.
    """
    if spec.scale and stats is None:
        stats = scaling.fit(panel, keys, channels, spec.train)
    values = list(channels)
    base = panel
    if ts:
        base = base.withColumn("marks", mark_array(F.col(ts), spec.freq))
        values.append("marks")
    part = splits.rows(base, split, spec.context, train=spec.train, test=spec.test)
    haloed = chunks.with_halo(part.select(*keys, "rn", "n", "first", *values), spec.size, after=spec.halo)
    if spec.scale:
        haloed = scaling.apply(haloed, stats, keys, channels, spec.size)
    return chunks.collect_chunks(haloed, keys, values, spec.size, constant=["n", "first"])


def split_chunks(
    panel: DataFrame,
    keys: Sequence[str],
    channels: Sequence[str],
    split: str,
    spec: Spec,
    ts: str | None = None,
    stats: DataFrame | None = None,
) -> DataFrame:
    """Scaled chunk arrays of one split, one row per (series, chunk, channel).

    ``panel`` has ``rn`` and ``n``. With ``ts``, an array of time marks per row
    comes along as ``marks``.
    """
    return chunks.by_channel(split_arrays(panel, keys, channels, split, spec, ts, stats), channels)


def split_windows(
    panel: DataFrame,
    keys: Sequence[str],
    channels: Sequence[str],
    split: str,
    spec: Spec,
    ts: str | None = None,
    stats: DataFrame | None = None,
) -> DataFrame:
    """The same, one row per window; chunk arrays still attached, nothing cut yet."""
    arrays = split_chunks(panel, keys, channels, split, spec, ts, stats)
    return windows.starts(arrays, spec.length, spec.size, first="first")


def prepare_split(
    panel: DataFrame,
    keys: Sequence[str],
    channels: Sequence[str],
    split: str,
    spec: Spec,
    ts: str | None = None,
    stats: DataFrame | None = None,
) -> DataFrame:
    """Materialised samples: x, y (and marks), ``window_id`` and ``batch_id``."""
    indexed = split_windows(panel, keys, channels, split, spec, ts, stats)
    cut = windows.contexts(indexed, spec.context, spec.label, spec.horizon, marks="marks" if ts else None)
    return cut.withColumn("batch_id", windows.batch_id(spec.batch)).drop("n", "first", "start")


def prepare_matrix(
    panel: DataFrame,
    keys: Sequence[str],
    channels: Sequence[str],
    split: str,
    spec: Spec,
    ts: str | None = None,
    stats: DataFrame | None = None,
) -> DataFrame:
    """Samples with all channels in one row: ``x`` and ``y`` hold one array per channel, in order.

    The time marks come once per window and not once per channel.
    """
    arrays = split_arrays(panel, keys, channels, split, spec, ts, stats)
    indexed = windows.starts(arrays, spec.length, spec.size, value=channels[0], first="first")
    skip, length = spec.context - spec.label, spec.label + spec.horizon
    cut = {
        "x": F.array(*[windows.piece(c, 0, spec.context) for c in channels]),
        "y": F.array(*[windows.piece(c, skip, length) for c in channels]),
        "batch_id": windows.batch_id(spec.batch),
    }
    if ts:
        cut |= {"x_mark": windows.piece("marks", 0, spec.context), "y_mark": windows.piece("marks", skip, length)}
    return indexed.withColumns(cut).select(*keys, "window_id", *cut)
