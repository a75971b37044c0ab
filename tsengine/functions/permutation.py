"""Keyed draws and permutations from MD5, so that any engine can repeat them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: hex digits of a digest that make one number (60 bits).
DIGITS = 15
ROUNDS = 4


def hashed(*parts: Column) -> Column:
    """A whole number of 60 bits from the parts' text, joined by colons."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("bigint")


def uniform(*parts: Column) -> Column:
    """A number strictly between 0 and 1 from the parts."""
    return (hashed(*parts).cast("double") + 0.5) / float(2 ** (4 * DIGITS))


def _sides(count: Column) -> tuple[Column, Column]:
    """A rectangle of at least ``count`` cells, with fewer spare cells than its longer side."""
    a = F.ceil(F.sqrt(count.cast("double"))).cast("bigint")
    return a, F.expr("0L") + F.ceil(count / a).cast("bigint")


def _stirred(x: Column, a: Column, b: Column, key: Column) -> Column:
    """A bijection on the cells of the rectangle: each side is shifted by a hash of the other, in turn."""
    left, right = F.floor(x / b).cast("bigint"), x % b
    for i in range(ROUNDS):
        if i % 2 == 0:
            left = (left + hashed(key, F.lit(i), right)) % a
        else:
            right = (right + hashed(key, F.lit(i), left)) % b
    return left * b + right


def permuted(number: Column, count: Column, key: Column) -> Column:
    """Place of ``number`` (0 to ``count`` - 1) in a pseudo-random order that ``key`` names.

    A bijection for every key and count, computed row by row: no sort, no shuffle. A
    number that lands on a spare cell is stirred on until it doesn't; that ends after at
    most as many times as there are spare cells, and few numbers land there at all.
    """
    a, b = _sides(count)
    first = _stirred(number, a, b, key)
    again = F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), F.greatest(a * b - count, F.lit(1))),
        first,
        lambda x, _: F.when(x < count, x).otherwise(_stirred(x, a, b, key)),
    )
    return F.when(first < count, first).otherwise(again)
