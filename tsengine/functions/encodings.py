"""Sinusoidal position and calendar codes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tsengine.functions.numeric import let

# Wavelength base and longest position of the code.
BASE = 10000.0
MAX_POSITION = 5000


def sinusoid(position: Column, width: int, bounded: bool = True) -> Column:
    """Array of ``width`` values, sine at even and cosine at odd indexes.

    Positions beyond the table length raise, unless ``bounded`` is False.
    """
    if width < 2 or width % 2:
        raise ValueError("width must be even")
    p = position.cast("double")
    if bounded:
        p = F.when(position < MAX_POSITION, p).otherwise(
            F.raise_error(F.concat(F.lit(f"position must be below {MAX_POSITION}: "), position.cast("string")))
        )
    rates = [BASE ** (-2.0 * i / width) for i in range(width // 2)]
    return let(p, lambda q: F.array(*[f(q * F.lit(rate)) for rate in rates for f in (F.sin, F.cos)]))


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p + q)


def calendar_code(ts: Column, width: int, quarter_hours: bool = False) -> Column:
    """Sum of the codes of hour, weekday, day and month, and of the quarter hour if asked."""
    parts = [F.hour(ts), F.weekday(ts), F.dayofmonth(ts), F.month(ts)]
    if quarter_hours:
        parts.append(F.floor(F.minute(ts) / 15))
    code = sinusoid(parts[0], width, bounded=False)
    for part in parts[1:]:
        code = _add(code, sinusoid(part, width, bounded=False))
    return code
