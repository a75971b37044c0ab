"""Experiment grid and bookkeeping of finished runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# Horizons, modes and window lengths of the experiments.
HORIZONS = [96, 192, 336, 720]
MODES = ["M", "S"]
CONTEXT = 336
LABEL = 24

# Dataset, number of channels, frequency, batch size.
DATASETS = [
    ("ETTh1", 7, "h", 128), ("ETTh2", 7, "h", 256), ("ETTm1", 7, "t", 256), ("ETTm2", 7, "t", 256),
    ("weather", 21, "t", 256), ("solar", 137, "t", 128), ("electricity", 321, "h", 32), ("traffic", 862, "h", 32),
]


def experiment_grid(
    datasets: DataFrame, modes: Sequence[str] = tuple(MODES), horizons: Sequence[int] = tuple(HORIZONS)
) -> DataFrame:
    """One row per dataset, mode and horizon; the two short lists are exploded in place."""
    return datasets.withColumn("features", F.explode(F.array(*map(F.lit, modes)))).withColumn(
        "pred_len", F.explode(F.array(*map(F.lit, horizons)))
    )


def pending(grid: DataFrame, results: DataFrame, key: str = "run_id") -> DataFrame:
    """Runs of the grid that have no result yet."""
    return grid.join(results.select(key).distinct(), key, "left_anti")
