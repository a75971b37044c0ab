"""Positions and chunks: how one long series is spread over many tasks.

Nothing here puts a whole series into one task. A series is cut by position
into chunks of ``size`` rows; the pair (series, chunk) is the shuffle key of
every ordered operator. Rows near a chunk edge are copied to the neighbour
(the halo), so that frames and windows never look outside their chunk. What
must travel along a whole series (offsets, running maxima, fitted statistics)
travels as one small row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SIZE = 4096
FAN_OUT = 4096


def explode_range(
    df: DataFrame, low: Column, high: Column, name: str, step: int = 1, spread: Sequence[str] | None = None
) -> DataFrame:
    """One row per integer of [low, high]; rows with high < low give none.

    Two levels, so that no long array is built; with ``spread`` the blocks are
    redistributed in between and the rows are made in parallel.
    """
    width = FAN_OUT * step
    blocks = (
        df.withColumn("_lo", low)
        .withColumn("_hi", high)
        .filter("_hi >= _lo")
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_hi - _lo) div {width}"))))
    )
    if spread is not None:
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        blocks = blocks.repartition(tasks, *spread, "_block")
    first = F.col("_lo") + F.col("_block") * width
    last = F.least(F.col("_hi"), first + (width - 1))
    return blocks.withColumn(name, F.explode(F.sequence(first, last, F.lit(step).cast("bigint")))).drop(
        "_lo", "_hi", "_block"
    )


def row_index(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    block: str | Column | Sequence[str | Column] = ("day", "minute"),
    rn: str = "rn",
    n: str = "n",
) -> DataFrame:
    """Position ``rn`` (from 0) of each row in its series, and the series length ``n``.

    Rows are numbered inside blocks and shifted by the rows of the earlier
    blocks. ``block`` lists nested blocks, coarse to fine: units for
    ``date_trunc``, or columns that grow with ``order``. Only the finest block
    of a series is ever sorted in one task, so a series, a day or a burst may
    hold any share of the rows. Offsets are summed level by level, over one row
    per block. Keys and order column must not be NULL.
    """
    given = [block] if isinstance(block, (str, Column)) else list(block)
    levels = [f"_block{i}" for i in range(len(given))]
    cut = [F.date_trunc(unit, F.col(order)) if isinstance(unit, str) else unit for unit in given]
    blocked = df.withColumns(dict(zip(levels, cut)))
    # Stated here, the joins below infer no further filters and share this aggregate.
    placed = blocked.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, *levels)))
    sizes = placed.groupBy(*keys, *levels).agg(F.count(F.lit(1)).alias("_rows"))
    offsets = _block_offsets(sizes, keys, levels, n).select(*keys, levels[-1], "_offset", n)
    finest = [*keys, levels[-1]]
    local = blocked.withColumn("_place", F.row_number().over(Window.partitionBy(*finest).orderBy(order)))
    return (
        local.join(offsets, finest)
        .withColumn(rn, F.col("_offset") + F.col("_place") - 1)
        .drop(*levels, "_place", "_offset")
    )


def _block_offsets(sizes: DataFrame, keys: Sequence[str], levels: Sequence[str], n: str) -> DataFrame:
    """Rows ahead of every block in its series (``_offset``), and rows of the series."""
    outer = [*keys, *levels[:-1]]
    ahead = Window.partitionBy(*outer).orderBy(levels[-1]).rowsBetween(Window.unboundedPreceding, -1)
    inside = sizes.withColumn("_offset", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)))
    if len(levels) == 1:
        return inside.withColumn(n, F.sum("_rows").over(Window.partitionBy(*keys)))
    totals = sizes.groupBy(*outer).agg(F.sum("_rows").alias("_rows"))
    above = _block_offsets(totals, keys, levels[:-1], n).select(*outer, F.col("_offset").alias("_above"), n)
    return inside.join(above, outer).withColumn("_offset", F.col("_offset") + F.col("_above"))


def with_chunk(df: DataFrame, size: int = SIZE, rn: str = "rn") -> DataFrame:
    return df.withColumn("chunk", F.expr(f"`{rn}` div {size}"))


def with_halo(df: DataFrame, size: int = SIZE, before: int = 0, after: int = 0, rn: str = "rn") -> DataFrame:
    """Add ``chunk``; copy edge rows to the chunks whose frames need them.

    Each chunk then also holds ``before`` rows ahead of it and ``after`` rows
    behind it. Copies cost (before + after) / size of the data.
    """
    if max(before, after) > size:
        raise ValueError(f"halo of {max(before, after)} rows needs chunks of at least that size, not {size}")
    if not before and not after:
        return with_chunk(df, size, rn)
    home, place = F.expr(f"`{rn}` div {size}"), F.col(rn) % size
    none = F.array().cast("array<bigint>")
    to_previous = F.when((place < after) & (home > 0), F.array(home - 1)).otherwise(none)
    to_next = F.when(place >= size - before, F.array(home + 1)).otherwise(none)
    parts = [F.array(home)] + ([to_previous] if after else []) + ([to_next] if before else [])
    return df.withColumn("chunk", F.explode(F.concat(*parts)))


def is_home(size: int = SIZE, rn: str = "rn") -> Column:
    """True for a chunk's own rows, False for halo copies."""
    return F.expr(f"`{rn}` div {size}") == F.col("chunk")


def collect_chunks(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    size: int = SIZE,
    rn: str = "rn",
    constant: Sequence[str] = (),
) -> DataFrame:
    """One row per (series, chunk): ``base`` position and one array per value column.

    An array holds at most size + halo elements, whatever the series length.
    ``constant`` columns have one value per series. Windows of any kind are
    slices of these arrays, made where they are used and never shuffled.
    """
    ordered = F.sort_array(F.collect_list(F.struct(F.col(rn).alias("_rn"), *values)))
    grouped = df.groupBy(*keys, "chunk").agg(ordered.alias("_rows"), *[F.max(c).alias(c) for c in constant])
    return grouped.select(
        *keys,
        "chunk",
        F.col("_rows")[0]["_rn"].alias("base"),
        *constant,
        *[F.col("_rows")[v].alias(v) for v in values],
    ).filter(F.col("base") + F.size(values[0]) > F.col("chunk") * size)


def chunked(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    size: int = SIZE,
    before: int = 0,
    after: int = 0,
    rn: str = "rn",
    constant: Sequence[str] = (),
) -> DataFrame:
    haloed = with_halo(df.select(*keys, rn, *values, *constant), size, before, after, rn)
    return collect_chunks(haloed, keys, values, size, rn, constant)


def by_channel(chunks: DataFrame, channels: Sequence[str], value: str = "v") -> DataFrame:
    """Turn one array column per channel into one row per channel; narrow."""
    rest = [c for c in chunks.columns if c not in channels]
    pairs = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias(value)) for c in channels])
    return chunks.select(*rest, F.inline(pairs))


def spread(facts: DataFrame, keys: Sequence[str], size: int = SIZE, n: str = "n") -> DataFrame:
    """Repeat one row per series once per chunk of that series."""
    return explode_range(facts, F.lit(0).cast("bigint"), F.expr(f"(`{n}` - 1) div {size}"), "chunk")


def join_facts(
    df: DataFrame, facts: DataFrame, keys: Sequence[str], size: int = SIZE, rn: str = "rn", n: str = "n"
) -> DataFrame:
    """Attach per-series facts to rows or chunks by (series, chunk).

    Joining by series alone would send a hot series to one task. The facts side
    has one row per chunk and is the hashed side. The inner join keeps every
    row: a series has facts exactly when it has rows.
    """
    has_chunk = "chunk" in df.columns
    left = df if has_chunk else with_chunk(df, size, rn)
    keep = [c for c in facts.columns if c not in df.columns and c not in keys]
    right = spread(facts, keys, size, n).select(*keys, "chunk", *keep).hint("shuffle_hash")
    joined = left.join(right, [*keys, "chunk"])
    return joined if has_chunk else joined.drop("chunk")


_FOLD = {"max": (F.max, F.greatest), "min": (F.min, F.least)}


def running(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    how: str,
    name: str,
    exclusive: bool = False,
    size: int = SIZE,
    rn: str = "rn",
) -> DataFrame:
    """Running max, min or sum along each series, NULLs skipped.

    Chunk totals are carried forward over one row per chunk, then combined with
    the running value inside the chunk.
    """
    has_chunk = "chunk" in df.columns
    staged = (df if has_chunk else with_chunk(df, size, rn)).withColumn("_value", value)
    fold = F.sum if how == "sum" else _FOLD[how][0]
    ahead = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        staged.groupBy(*keys, "chunk")
        .agg(fold("_value").alias("_part"))
        .select(*keys, "chunk", fold("_part").over(ahead).alias("_carry"))
    )
    end = -1 if exclusive else 0
    inside = Window.partitionBy(*keys, "chunk").orderBy(rn).rowsBetween(Window.unboundedPreceding, end)
    local = staged.withColumn("_local", fold("_value").over(inside))
    joined = local.join(carried.hint("shuffle_hash"), [*keys, "chunk"])
    if how == "sum":
        both = F.coalesce(F.col("_local") + F.col("_carry"), "_local", "_carry")
    else:
        both = _FOLD[how][1]("_local", "_carry")
    result = joined.withColumn(name, both).drop("_value", "_local", "_carry")
    return result if has_chunk else result.drop("chunk")
