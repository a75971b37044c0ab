"""Per-window, per-channel normalisation and its inverse, on arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tsengine.functions.numeric import array_mean, let

EPS = 1e-5


def statistics(x: Column, last: bool = False, eps: float = EPS) -> Column:
    """Struct of ``center`` (mean, or last value) and ``scale`` = sqrt(population variance + eps)."""

    def with_mean(mean: Column) -> Column:
        squares = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean))
        scale = F.sqrt(squares / F.size(x) + eps)
        return F.struct((F.element_at(x, -1) if last else mean).alias("center"), scale.alias("scale"))

    return let(array_mean(x), with_mean)


def norm(x: Column, stats: Column, weight: float = 1.0, bias: float = 0.0) -> Column:
    """Normalised array; ``stats`` is the struct of ``statistics``."""
    return let(stats, lambda s: F.transform(x, lambda v: (v - s["center"]) / s["scale"] * weight + bias))


def denorm(y: Column, stats: Column, weight: float = 1.0, bias: float = 0.0, eps: float = EPS) -> Column:
    """Back to the original scale; exact up to ``eps`` squared."""
    divisor = weight + eps * eps
    return let(stats, lambda s: F.transform(y, lambda v: (v - bias) / divisor * s["scale"] + s["center"]))


def recompose(trend: Column, season: Column) -> Column:
    """Element-wise sum of the two parts, both still normalised."""
    return F.zip_with(trend, season, lambda a, b: a + b)
