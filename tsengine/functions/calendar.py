"""Calendar features of a timestamp column, chosen by frequency."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

Feature = Callable[[Column], Column]


def _centred(part: Feature, low: int, span: int) -> Feature:
    """Map ``part``, which runs from ``low`` over ``span`` steps, onto [-0.5, 0.5]."""
    return lambda ts: (part(ts) - low) / F.lit(float(span)) - 0.5


# First value and span of every calendar part.
FEATURES: dict[str, Feature] = {
    "second_of_minute": _centred(F.second, 0, 59),
    "minute_of_hour": _centred(F.minute, 0, 59),
    "hour_of_day": _centred(F.hour, 0, 23),
    "day_of_week": _centred(F.weekday, 0, 6),
    "day_of_month": _centred(F.dayofmonth, 1, 30),
    "day_of_year": _centred(F.dayofyear, 1, 365),
    "month_of_year": _centred(F.month, 1, 11),
    "week_of_year": _centred(F.weekofyear, 1, 52),
}

_DAY = ["day_of_week", "day_of_month", "day_of_year"]

# Features of each frequency, in order.
BY_FREQUENCY: dict[str, list[str]] = {
    "year": [],
    "quarter": ["month_of_year"],
    "month": ["month_of_year"],
    "week": ["day_of_month", "week_of_year"],
    "day": _DAY,
    "business day": _DAY,
    "hour": ["hour_of_day", *_DAY],
    "minute": ["minute_of_hour", "hour_of_day", *_DAY],
    "second": ["second_of_minute", "minute_of_hour", "hour_of_day", *_DAY],
}

# Frequency aliases (an anchor such as -MON or -DEC may follow W, Q and Y).
ALIASES: dict[str, str] = {
    "A": "year", "a": "year", "Y": "year", "y": "year", "YE": "year",
    "Q": "quarter", "q": "quarter", "QE": "quarter",
    "M": "month", "m": "month", "ME": "month",
    "W": "week", "w": "week",
    "D": "day", "d": "day",
    "B": "business day", "b": "business day",
    "H": "hour", "h": "hour",
    "T": "minute", "t": "minute", "min": "minute",
    "S": "second", "s": "second",
}

_custom: dict[str, Feature] = {}


def register_feature(name: str, feature: Feature) -> None:
    """Add a named user feature; it may then be used in ``feature_columns``."""
    if name in FEATURES:
        raise ValueError(f"{name} is a built-in feature")
    _custom[name] = feature


def resolve(freq: str) -> str:
    """Frequency text such as ``15min``, ``h`` or ``W-MON`` to its base unit."""
    match = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+)(-[A-Za-z]{3})?\s*", freq)
    unit = ALIASES.get(match.group(2)) if match else None
    anchored = {"week", "quarter", "year"}
    if unit is None or (match.group(3) and unit not in anchored):
        raise ValueError(f"unsupported frequency {freq!r}; known aliases: {', '.join(ALIASES)}")
    return unit


def feature_names(freq: str) -> list[str]:
    return list(BY_FREQUENCY[resolve(freq)])


def feature_columns(ts: Column, freq: str | None = None, names: list[str] | None = None) -> list[Column]:
    """Named feature columns, either of a frequency or of an explicit list."""
    chosen = names if names is not None else feature_names(freq)
    known = {**FEATURES, **_custom}
    return [known[name](ts).alias(name) for name in chosen]


def feature_array(ts: Column, freq: str) -> Column:
    """The same features as one ARRAY<DOUBLE>; empty for yearly data."""
    columns = feature_columns(ts, freq)
    return F.array(*columns) if columns else F.array().cast("array<double>")


def calendar_marks(ts: Column) -> list[Column]:
    """Integer month, day, weekday (Monday 0) and hour."""
    return [
        F.month(ts).alias("month"),
        F.dayofmonth(ts).alias("day"),
        F.weekday(ts).alias("weekday"),
        F.hour(ts).alias("hour"),
    ]


def mark_array(ts: Column, freq: str | None) -> Column:
    """Time marks of a row: features of ``freq``, or the integer marks when it is None."""
    if freq is not None:
        return feature_array(ts, freq)
    return F.array(*[c.cast("double") for c in calendar_marks(ts)])
