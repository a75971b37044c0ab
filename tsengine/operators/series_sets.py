"""Collections of ragged series, one series per row as in the source files.

A row is one line of the source, so all of these are narrow: no shuffle but for
the two joins with dimension tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tsengine.functions.numeric import coerce_number
from tsengine.operators.chunks import row_index

# Horizon and frequency of every group.
GROUPS = [
    ("M3Year", 6, 1), ("M3Quart", 8, 4), ("M3Month", 18, 12), ("M3Other", 8, 1),
    ("Yearly", 6, 1), ("Quarterly", 8, 4), ("Monthly", 18, 12),
    ("Weekly", 13, 1), ("Daily", 14, 1), ("Hourly", 48, 24),
]


def group_meta(spark: SparkSession) -> DataFrame:
    """The ten groups with their horizon and frequency."""
    return spark.createDataFrame(GROUPS, "grp string, grp_horizon int, grp_frequency int")


def attach_meta(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Look up horizon and frequency by group; Spark broadcasts the table when its size allows."""
    return df.join(meta, "grp", "left")


def compact(values: Column) -> Column:
    """Drop missing observations anywhere; the rest close up."""
    return F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v))


def coerce_values(cells: Column) -> Column:
    """Text cells to the compacted numeric series."""
    return compact(F.transform(cells, coerce_number))


def longer_than(df: DataFrame, values: str, horizon: str | int) -> DataFrame:
    """Series strictly longer than their horizon."""
    h = F.col(horizon) if isinstance(horizon, str) else F.lit(horizon)
    return df.filter(F.size(values) > h)


def _checked(h: Column) -> Column:
    return F.when(h >= 1, h).otherwise(F.raise_error(F.lit("horizon must be at least 1")).cast("int"))


def train_part(values: Column, horizon: Column, times: int = 1) -> Column:
    """All but the last ``times`` * horizon values; empty when there are not so many.

    ``times`` 1 is the training subset, 2 the one for parameter search.
    """
    kept = F.size(values) - _checked(horizon) * times
    return F.slice(values, F.lit(1), F.greatest(kept, F.lit(0)))


def test_part(values: Column, horizon: Column) -> Column:
    """The last ``horizon`` values; the series must be longer than that."""
    return F.slice(values, -_checked(horizon), horizon)


test_part.__test__ = False


def holdout(df: DataFrame, values: str = "values", horizon: str = "horizon") -> DataFrame:
    """``train`` and ``test`` arrays instead of ``values``."""
    h = F.col(horizon).cast("int")
    return df.withColumns({"train": train_part(F.col(values), h), "test": test_part(F.col(values), h)}).drop(values)


def union_frequencies(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack tables of different widths by column name, in the given order."""
    numbered = [f.withColumn("file_ord", F.lit(i)) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def last_wins(series: DataFrame, key: str = "series_id", order: Sequence[str] = ("file_ord", "row_ord")) -> DataFrame:
    """One row per id: the last one read, with ``first_seen`` of the first.

    Only ids and order numbers are aggregated; the winning rows are then picked
    by their unique place, so repeated ids do not gather arrays in one task.
    """
    place = F.struct(*order)
    winners = series.groupBy(key).agg(F.max(place).alias("_last"), F.min(place).alias("first_seen"))
    wanted = winners.select(key, "first_seen", *[F.col("_last")[c].alias(c) for c in order])
    return series.join(wanted, [key, *order])


def attach_info(series: DataFrame, info: DataFrame, key: str = "series_id") -> DataFrame:
    """Full outer join with the info table.

    Ids of the info table without a series get an empty one; unknown ids follow
    at the end in the order first seen (``ord`` sorts that way).
    """
    joined = info.join(last_wins(series, key), key, "full")
    empty = F.array().cast("array<double>")
    unknown = F.col("info_ord").isNull()
    return joined.select(
        key,
        *[c for c in info.columns if c not in (key, "info_ord")],
        F.coalesce("values", empty).alias("values"),
        F.struct(unknown.alias("unknown"), F.col("info_ord"), F.col("first_seen")).alias("ord"),
    )


def output_order(joined: DataFrame, name: str = "position") -> DataFrame:
    """Position (from 0) of each row of ``attach_info`` in the order of its ``ord``.

    Rows are numbered inside a block of a file and shifted by the rows of earlier blocks
    and files: no task sorts the whole table.
    """
    seen, known = F.col("ord")["first_seen"], F.col("ord")["info_ord"]
    unknown = F.col("ord")["unknown"]
    source = F.when(unknown, seen["file_ord"]).otherwise(F.lit(-1))
    place = F.when(unknown, seen["row_ord"]).otherwise(known)
    levels = [F.struct(unknown, source.alias("source"))]
    levels.append(F.struct(unknown, source.alias("source"), place["file"].alias("file")))
    levels.append(F.struct(unknown, source.alias("source"), place["file"].alias("file"), place["block"].alias("block")))
    return row_index(joined, [], "ord", levels, rn=name, n="_n").drop("_n")


def export_columns(df: DataFrame, values: str = "values", ids: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """Rectangle with one column per position, NULL on the right of short series.

    The width, one number, is the only thing found out by an action.
    """
    width = df.agg(F.coalesce(F.max(F.size(values)), F.lit(0))).first()[0]
    return df.selectExpr(*[f"`{c}`" for c in ids], *[f"get(`{values}`, {i}) AS `{prefix}{i}`" for i in range(width)])
