"""Readers. Schemas are stated or taken from header lines, never inferred from the data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType, TimestampNTZType

from tsengine.operators.series_sets import coerce_values

# Leading descriptive columns of a grouped sheet.
SHEET_COLUMNS = 6


def _header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def wide_series(
    spark: SparkSession,
    path: str,
    ts: str = "date",
    target: str = "OT",
    format: str = "csv",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """One row per timestamp, one double column per channel.

    For CSV the header line gives the names (or ``columns`` does, which saves
    reading it); a cell that is no number is NULL. Other formats keep their
    types, but a text timestamp is parsed; one that cannot be is NULL.
    """
    if format != "csv":
        df = spark.read.format(format).load(path)
        names = df.columns
        if dict(df.dtypes).get(ts) == "string":
            df = df.withColumn(ts, F.col(ts).try_cast("timestamp_ntz"))
    else:
        names = list(columns) if columns else _header(spark, path)
        types = [TimestampNTZType() if c == ts else DoubleType() for c in names]
        schema = StructType([StructField(c, t) for c, t in zip(names, types)])
        df = spark.read.schema(schema).option("header", True).csv(path)
    for name in (ts, target):
        if name not in names:
            raise ValueError(f"column {name!r} is missing; have {names}")
    return df


BROKEN = "_broken_line"


def _place() -> Column:
    """Where a line stands: file (by path), block of the file, line order inside it.

    Taken while reading; later shuffles lose it.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )


def series_rows(spark: SparkSession, path: str, file_ord: int = 0, columns: Sequence[str] | None = None) -> DataFrame:
    """One series per line: ``series_id``, numeric ``values``, and the place of the line.

    ``path`` may be a folder of files; they follow each other by name. One file's header
    (or ``columns``, for files of several widths) gives the width. A line with more cells
    than that raises: its last values would be lost without a word.
    """
    names = list(columns) if columns else _header(spark, path)
    schema = StructType([StructField(c, StringType()) for c in [*names, BROKEN]])
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("columnNameOfCorruptRecord", BROKEN).csv(path)
    cells = [F.col(f"`{c}`") for c in names]
    # A line with fewer cells is broken to the parser too, and fine here: only what lies beyond the width is lost.
    quoted = r'"(?:[^"\\]|\\.|"")*"'
    bare = F.regexp_replace(F.col(BROKEN), quoted, "")
    over = F.length(bare) - F.length(F.translate(bare, ",", "")) >= len(names)
    message = F.concat(F.lit(f"a line has more than {len(names)} cells: "), F.substring(F.col(BROKEN), 1, 80))
    values = coerce_values(F.array(*cells[1:]))
    return raw.select(
        cells[0].alias("series_id"),
        F.when(F.coalesce(over, F.lit(False)), F.raise_error(message).cast("array<double>")).otherwise(values).alias("values"),
        F.lit(file_ord).alias("file_ord"),
        _place().alias("row_ord"),
    )


def series_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several such files of different widths, numbered in the given order."""
    return reduce(DataFrame.unionByName, [series_rows(spark, p, i) for i, p in enumerate(paths)])


INFO_SCHEMA = StructType(
    [
        StructField("M4id", StringType()),
        StructField("SP", StringType()),
        StructField("Frequency", IntegerType()),
        StructField("Horizon", IntegerType()),
    ]
)


def info(spark: SparkSession, path: str) -> DataFrame:
    """The info table, with ``info_ord`` in line order; other columns are not read."""
    names = _header(spark, path)
    wanted = {f.name: f.dataType for f in INFO_SCHEMA.fields}
    lacking = [c for c in wanted if c not in names]
    if lacking:
        raise ValueError(f"info table lacks {lacking}")
    schema = StructType([StructField(c, wanted.get(c, StringType())) for c in names])
    return (
        spark.read.schema(schema)
        .option("header", True)
        .csv(path)
        .select(
            F.col("M4id").alias("series_id"),
            F.col("SP").alias("grp"),
            F.col("Frequency").alias("frequency"),
            F.col("Horizon").alias("horizon"),
            _place().alias("info_ord"),
        )
    )


def grouped_sheets(spark: SparkSession, sheets: Sequence[tuple[str, str]]) -> DataFrame:
    """(group, path) sheets landed as CSV: id, stated horizon, group and numeric values."""

    def sheet(order: int, group: str, path: str) -> DataFrame:
        names = _header(spark, path)
        schema = StructType([StructField(c, StringType()) for c in names])
        raw = spark.read.schema(schema).option("header", True).csv(path)
        return raw.select(
            F.trim("Series").alias("series_id"),
            F.lit(group).alias("grp"),
            F.lit(order).alias("grp_ord"),
            F.trim("NF").try_cast("int").alias("horizon"),
            coerce_values(F.array(*[f"`{c}`" for c in names[SHEET_COLUMNS:]])).alias("values"),
        )

    return reduce(DataFrame.unionByName, [sheet(i, g, p) for i, (g, p) in enumerate(sheets)])
