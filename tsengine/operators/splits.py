"""Chronological splits by position, with the lookback of the later parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

SPLITS = ("train", "val", "test")


def part_sizes(n: Column, train: float = 0.7, test: float = 0.2) -> tuple[Column, Column, Column]:
    """Row counts of train, val and test; double product, cut towards zero."""
    n_train = F.floor(n * F.lit(float(train))).cast("bigint")
    n_test = F.floor(n * F.lit(float(test))).cast("bigint")
    return n_train, n - n_train - n_test, n_test


def bounds(n: Column, split: str, lookback: int, train: float = 0.7, test: float = 0.2) -> tuple[Column, Column]:
    """First position and end of a split; val and test begin ``lookback`` rows early.

    A series too short for the lookback raises.
    """
    n_train, n_val, n_test = part_sizes(n, train, test)
    low, high = {
        "train": (F.lit(0).cast("bigint"), n_train),
        "val": (n_train - lookback, n_train + n_val),
        "test": (n - n_test - lookback, n),
    }[split]
    if split == "train":
        return low, high
    message = F.concat(F.lit(f"series too short for a lookback of {lookback}: "), n.cast("string"), F.lit(" rows"))
    return F.when(low >= 0, low).otherwise(F.raise_error(message).cast("bigint")), high


def sizes(df: DataFrame, keys: Sequence[str], train: float = 0.7, test: float = 0.2) -> DataFrame:
    """Length and part sizes of every series; one counting pass."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    n_train, n_val, n_test = part_sizes(F.col("n"), train, test)
    return counted.select(*keys, "n", n_train.alias("n_train"), n_val.alias("n_val"), n_test.alias("n_test"))


def rows(
    df: DataFrame, split: str, lookback: int, rn: str = "rn", n: str = "n", train: float = 0.7, test: float = 0.2
) -> DataFrame:
    """Rows of one split, with its first position as ``first``; needs ``rn`` and ``n``."""
    low, high = bounds(F.col(n), split, lookback, train, test)
    return df.withColumn("first", low).filter((F.col(rn) >= F.col("first")) & (F.col(rn) < high))


def position_range(df: DataFrame, low: int, high: int, rn: str = "rn") -> DataFrame:
    """Rows with low <= rn < high."""
    return df.filter((F.col(rn) >= low) & (F.col(rn) < high))
