"""Standard scaling fitted on the training rows only."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tsengine.functions.numeric import missing
from tsengine.operators.chunks import SIZE, join_facts
from tsengine.operators.splits import part_sizes

EPSILON = sys.float_info.epsilon


def guarded_std(mean: Column, std: Column, count: Column) -> Column:
    """Population deviation, 1 where it is zero up to rounding error."""
    variance = std * std
    bound = count * EPSILON * variance + F.pow(count * mean * EPSILON, F.lit(2.0))
    return F.when(variance <= bound, F.lit(1.0)).otherwise(std)


def fit(
    df: DataFrame, keys: Sequence[str], channels: Sequence[str], train: float = 0.7, rn: str = "rn", n: str = "n"
) -> DataFrame:
    """One row per series: ``n`` and ``<channel>_mean`` / ``<channel>_std`` of its training rows.

    NULL and NaN are left out. One pass with map-side partial aggregation, so a
    hot series costs no more than its share of rows.
    """
    n_train, _, _ = part_sizes(F.col(n), train)
    in_train = F.col(rn) < n_train
    aggregates = []
    for c in channels:
        value = F.when(in_train & ~missing(F.col(c)), F.col(c).cast("double"))
        aggregates += [F.avg(value).alias(f"_m_{c}"), F.stddev_pop(value).alias(f"_s_{c}"), F.count(value).alias(f"_c_{c}")]
    fitted = df.groupBy(*keys).agg(F.max(n).alias(n), *aggregates)
    columns = []
    for c in channels:
        m, s, k = F.col(f"_m_{c}"), F.col(f"_s_{c}"), F.col(f"_c_{c}")
        columns += [m.alias(f"{c}_mean"), guarded_std(m, s, k).alias(f"{c}_std")]
    return fitted.select(*keys, n, *columns)


def long_stats(stats: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Statistics as one row per (series, channel)."""
    pairs = [
        F.struct(F.lit(c).alias("channel"), F.col(f"{c}_mean").alias("mean"), F.col(f"{c}_std").alias("std"))
        for c in channels
    ]
    return stats.select(*keys, F.inline(F.array(*pairs)))


def scaled(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / std


def unscaled(x: Column, mean: Column, std: Column) -> Column:
    return x * std + mean


def _with_stats(df, stats, keys, channels, size, formula):
    joined = join_facts(df, stats, keys, size)
    changed = {c: formula(F.col(c), F.col(f"{c}_mean"), F.col(f"{c}_std")) for c in channels}
    return joined.withColumns(changed).select(*df.columns)


def apply(df: DataFrame, stats: DataFrame, keys: Sequence[str], channels: Sequence[str], size: int = SIZE) -> DataFrame:
    """Standardise every row of a panel that has ``rn`` (or already ``chunk``)."""
    return _with_stats(df, stats, keys, channels, size, scaled)


def invert(df: DataFrame, stats: DataFrame, keys: Sequence[str], channels: Sequence[str], size: int = SIZE) -> DataFrame:
    """Undo ``apply``."""
    return _with_stats(df, stats, keys, channels, size, unscaled)
