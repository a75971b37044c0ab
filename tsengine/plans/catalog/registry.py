"""Registration of queries, and helpers shared by them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r(value: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; the added zero turns -0.0 into 0.0."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column, digits) + 0.0


def digest(array: str, digits: tuple[int, int] = (5, 4)) -> list[Column]:
    """Length, sum and position-weighted sum of an array, to compare without arrays."""
    a = F.col(array)
    total = F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    weighted = F.aggregate(
        F.transform(a, lambda v, i: v * (i + 1)), F.lit(0.0), lambda acc, v: acc + v
    )
    return [F.size(a).alias(f"{array}_n"), r(total, digits[0]).alias(f"{array}_sum"), r(weighted, digits[1]).alias(f"{array}_weighted")]


def digest_sql(name: str, value: str = "v", pos: str = "pos") -> str:
    """The same three figures over exploded rows; ``pos`` counts from 0."""
    return (
        f"count(*)::int AS {name}_n, round(sum({value}),5)+0.0 AS {name}_sum, "
        f"round(sum(({pos}+1)*{value}),4)+0.0 AS {name}_weighted"
    )
