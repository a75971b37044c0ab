"""What the operators of this subpackage share: words, settled tables, joins of checked size."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from tsengine.session import scratch_path

# White space that ends a word, and the ASCII letters.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A side of a join is broadcast up to this many (narrow) rows.
BROADCAST_ROWS = 200_000
#: Copies of the small side of a join that is too large to broadcast.
SALTS = 16


#: Rows of texts that a Python task holds at once.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Let Python tasks of this session take texts in small batches; a setting that is smaller already stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


@contextmanager
def small_tasks(spark: SparkSession):
    """Python tasks take texts in small batches while this is open; the session's setting is put back.

    For jobs that run inside it: a plan that is only built here doesn't keep the setting.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, "10000")
    small_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column, separator: str = SPACE) -> Column:
    """Array of the words between separators; NULL text has none."""
    return F.coalesce(F.array_remove(F.split(text, separator), ""), F.array().cast("array<string>"))


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the cluster's shared scratch folder and go on from there.

    A lost executor then costs a read, not the work before it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_checked(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join with a settled table that is usually small; NULL keys match each other.

    Up to ``BROADCAST_ROWS`` rows it is broadcast. Beyond that its rows are copied
    ``SALTS`` times, so that a key with a third of the big side's rows is spread.
    """
    right = small.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    drop = [f"_r_{k}" for k in keys]
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(right), on, how).drop(*drop)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*hashed_columns(big)), F.lit(SALTS)))
    # A generator can't stand inside a cast.
    right = right.withColumn("_r_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return left.join(right, [*on, F.col("_salt") == F.col("_r_salt")], how).drop(*drop, "_salt", "_r_salt")


def _hashable(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(_hashable(f.dataType) for f in kind)
    return _hashable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType))


def hashed_columns(df: DataFrame) -> list[Column]:
    """The columns that Spark can hash: no maps; of a struct with such a field its others."""
    found = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if _hashable(field.dataType):
            found.append(column)
        elif isinstance(field.dataType, StructType):
            found += [column[f.name] for f in field.dataType if _hashable(f.dataType)]
    return found


def packed_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """``row``, all of the user's columns as one, beside copies of those an operator reads.

    What an operator adds can then have any name; ``unpacked_rows`` undoes it.
    """
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)


def unpacked_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("row")[c].alias(c) for c in columns])


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether nothing may be learned from a row: its id has that remainder, or it has no id."""
    return F.coalesce(fold(doc_id, modulus) == remainder, F.lit(True))


def fold(text: Column, modulus: int) -> Column:
    """Remainder of the CRC-32 of an id written as text; NULL ids have none."""
    return F.pmod(F.crc32(text.cast("string").cast("binary")), F.lit(modulus))
