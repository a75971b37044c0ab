"""Build the two kinds of competition collections from landed files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tsengine.operators import series_sets
from tsengine.sources import readers, writers


def build_grouped(spark: SparkSession, sheets: Sequence[tuple[str, str]], out: str, export: bool = True) -> str:
    """Grouped sheets: cut each series by its group's horizon, keep those long enough, cache.

    The stated horizon of each series is kept beside it. Nothing is built if
    the cache is there. Returns the path of the cache.
    """
    cache = f"{out}/series"

    def build() -> DataFrame:
        read = readers.grouped_sheets(spark, sheets)
        known = series_sets.attach_meta(read, series_sets.group_meta(spark))
        kept = series_sets.longer_than(known, "values", "grp_horizon")
        return series_sets.holdout(kept, horizon="grp_horizon").drop("grp_frequency")

    writers.cached_series(spark, cache, build)
    if export:
        for part, training in (("train", True), ("test", False)):
            folder = f"{out}/{part}-csv"
            if not writers.committed(spark, folder):
                writers.export_wide(writers.load_series_cache(spark, cache, training), folder)
                writers.commit(spark, folder)
    return cache


def build_indexed(
    spark: SparkSession, info_path: str, train_paths: Sequence[str], test_paths: Sequence[str], out: str
) -> str:
    """Series files and an info table: one row per id for the train and the test files, cached.

    Ids come in info order, then unknown ones (see ``ord``). Returns the path of the cache.
    """
    cache = f"{out}/series"
    if not writers.committed(spark, cache):
        info = readers.info(spark, info_path)
        parts = [
            series_sets.attach_info(readers.series_files(spark, paths), info).withColumn("part", F.lit(part))
            for part, paths in (("train", train_paths), ("test", test_paths))
        ]
        writers.write_table(parts[0].unionByName(parts[1]), cache, "part")
    return cache


def export_combined(spark: SparkSession, paths: Sequence[str], out: str) -> None:
    """The raw files stacked by column name, as one CSV table."""
    frames = [spark.read.option("header", True).csv(p) for p in paths]
    series_sets.union_frequencies(frames).drop("file_ord").write.mode("errorifexists").option("header", True).csv(out)


def training_subset(series: DataFrame, times: int = 1) -> DataFrame:
    """Cached series without their last ``times`` * stated horizon values."""
    return series.withColumn("values", series_sets.train_part(F.col("values"), F.col("horizon"), times))
