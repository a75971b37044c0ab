"""Numeric helpers that hold under ANSI mode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# What counts as a number in a text cell.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INFINITY = r"^[+-]?[iI][nN][fF]([iI][nN][iI][tT][yY])?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Without it the optimizer may inline a per-row statistic into a per-element
    lambda and compute it again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def safe_div(a: Column, b: Column) -> Column:
    """IEEE division: x/0 is +-inf, 0/0 is NaN, instead of an ANSI error."""
    at_zero = (
        F.when((a == 0) | F.isnan(a), F.lit(float("nan")))
        .when(a > 0, F.lit(float("inf")))
        .otherwise(F.lit(float("-inf")))
    )
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, at_zero).otherwise(
        a / F.when(b != 0, b)
    )


def softplus(x: Column) -> Column:
    """ln(1 + e^x), linear above 20 so that e^x cannot overflow."""
    return F.when(x > 20, x).otherwise(F.log1p(F.exp(F.least(x, F.lit(20.0)))))


def coerce_number(text: Column) -> Column:
    """Text to double; whatever is not a number, and NaN, becomes NULL."""
    t = F.trim(text)
    inf = F.when(t.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(t.rlike(NUMBER), t.try_cast("double")).when(t.rlike(INFINITY), inf)


def array_mean(x: Column) -> Column:
    """Mean of an array of doubles; NULL for an empty one."""
    total = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
    return total / F.nullif(F.size(x), F.lit(0))


def missing(v: Column) -> Column:
    """True for NULL and NaN."""
    return v.isNull() | F.isnan(v)
