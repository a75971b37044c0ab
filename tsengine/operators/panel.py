"""Panel layouts: column order, channel choice, long and wide forms, checks, gap filling.

A panel has series key columns, a timestamp and one column per channel. A
single series is a panel with a constant key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from tsengine.operators.chunks import FAN_OUT, explode_range


def canonical_columns(df: DataFrame, target: str = "OT", ts: str = "date") -> DataFrame:
    """Timestamp first, the target last, all else between in its own order."""
    for name in (ts, target):
        if name not in df.columns:
            raise ValueError(f"column {name!r} is missing; have {df.columns}")
    others = [c for c in df.columns if c not in (ts, target)]
    return df.select(ts, *others, target)


def feature_mode(df: DataFrame, mode: str, target: str = "OT", ts: str = "date") -> DataFrame:
    """``M`` and ``MS`` keep every channel, ``S`` keeps the target only."""
    ordered = canonical_columns(df, target, ts)
    if mode in ("M", "MS"):
        return ordered
    if mode == "S":
        return ordered.select(ts, target)
    raise ValueError(f"mode must be M, MS or S, not {mode!r}")


def channels_of(df: DataFrame, ts: str = "date", keys: Sequence[str] = ()) -> list[str]:
    return [c for c in df.columns if c != ts and c not in keys]


def as_panel(df: DataFrame, name: str = "all", key: str = "series_id") -> DataFrame:
    """Give a single series a constant key."""
    return df.select(F.lit(name).alias(key), "*")


def to_long(df: DataFrame, ids: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """One row per channel; narrow."""
    return df.unpivot(list(ids), list(channels), "channel", "value")


def per_channel(column: str, channels: Sequence[str], value: str, how=F.sum) -> dict[str, Column]:
    """One conditional aggregate per channel: a pivot in a single shuffle."""
    return {c: how(F.when(F.col(column) == c, F.col(value))) for c in channels}


def to_wide(df: DataFrame, ids: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """One column per channel; the channel list is given, so no extra pass finds it."""
    cells = per_channel("channel", channels, "value", F.max)
    return df.groupBy(*ids).agg(*[agg.alias(c) for c, agg in cells.items()])


def violations(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Rows that cannot be placed in time: NULL keys or timestamps, and repeated timestamps."""
    bad_null = F.lit(False)
    for c in (*keys, ts):
        bad_null = bad_null | F.col(c).isNull()
    counts = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("copies"))
    kind = F.when(bad_null, F.lit("null key or timestamp")).when(F.col("copies") > 1, F.lit("repeated timestamp"))
    return counts.withColumn("problem", kind).filter("problem IS NOT NULL")


def validate(df: DataFrame, keys: Sequence[str], ts: str, channels: Sequence[str]) -> DataFrame:
    """Raise on missing or non-numeric channels and on rows without a clear position."""
    types = {f.name: f.dataType for f in df.schema.fields}
    for c in (*keys, ts, *channels):
        if c not in types:
            raise ValueError(f"column {c!r} is missing")
    for c in channels:
        if not isinstance(types[c], NumericType):
            raise ValueError(f"channel {c!r} is {types[c].simpleString()}, not a number")
    first = violations(df, keys, ts).limit(1).collect()
    if first:
        raise ValueError(f"bad row: {first[0].asDict()}")
    return df


def regular_panel(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    unit: str,
    values: dict[str, Column],
    fill: float | None = 0.0,
    out_ts: str = "date",
) -> DataFrame:
    """Aggregate to a fixed time step and fill the gaps between first and last step.

    ``values`` maps output names to aggregate expressions (see ``per_channel``).
    The result has ``rn`` and ``n`` already, since on a regular grid a position
    is plain arithmetic. Only observed steps are shuffled: they meet their series'
    span by (series, block of the calendar), and each fills the gap up to the next
    one where it lies. One long series is many blocks and does not fill one task.
    """
    stepped = df.withColumn(out_ts, F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz"))
    observed = stepped.groupBy(*keys, out_ts).agg(*[agg.alias(name) for name, agg in values.items()])
    # Whole steps from a fixed step of the calendar, so that no rounding comes in.
    origin = F.date_trunc(unit, F.lit("1970-01-01").cast("timestamp_ntz")).cast("timestamp_ntz")
    slot = lambda c: F.timestamp_diff(unit, origin, F.col(c))
    ends = stepped.groupBy(*keys).agg(F.min(out_ts).alias("_first"), F.max(out_ts).alias("_last"))
    span = ends.select(*keys, slot("_first").alias("_low"), slot("_last").alias("_high"), "_first")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = lambda c: F.floor(F.col(c) / FAN_OUT)
    blocks = explode_range(span, block("_low"), block("_high"), "_chunk").repartition(tasks, *keys, "_chunk")
    cells = observed.withColumn("_slot", slot(out_ts)).withColumn("_chunk", block("_slot"))
    ordered = F.sort_array(F.collect_list(F.struct("_slot", *values)))
    gathered = cells.filter("_chunk IS NOT NULL").groupBy(*keys, "_chunk").agg(ordered.alias("_cells"))
    joined = blocks.join(gathered, [*keys, "_chunk"], "left")
    low = F.greatest("_low", F.col("_chunk") * FAN_OUT)
    high = F.least("_high", F.col("_chunk") * FAN_OUT + (FAN_OUT - 1))
    held = F.coalesce("_cells", F.array().cast(joined.schema["_cells"].dataType))
    # A run of steps begins at the block's edge or at an observed step, and ends before the next one.
    begins, following = F.concat(F.array(low), held["_slot"]), F.concat(held["_slot"], F.array(high + 1))
    nothing = F.lit(None).cast(joined.schema["_cells"].dataType.elementType)
    seen = F.concat(F.array(nothing), held)
    runs = joined.select(
        *keys, "_low", "_high", "_first", F.inline(F.arrays_zip(begins.alias("_begin"), following.alias("_next"), seen.alias("_cell")))
    ).filter("_next > _begin")
    steps = runs.withColumn("_slot", F.explode(F.sequence("_begin", F.col("_next") - 1)))
    rn = F.col("_slot") - F.col("_low")
    value = lambda c: F.when(F.col("_slot") == F.col("_cell")["_slot"], F.col("_cell")[c])
    return steps.select(
        *keys,
        F.timestamp_add(unit, rn, F.col("_first")).cast("timestamp_ntz").alias(out_ts),
        rn.alias("rn"),
        (F.col("_high") - F.col("_low") + 1).alias("n"),
        *[(F.coalesce(value(c), F.lit(fill)) if fill is not None else value(c)).alias(c) for c in values],
    )


