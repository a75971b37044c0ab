"""Writers and their readers. What a job has written counts only once it is committed.

A table of several jobs holds forecasts in a folder per run, which a run replaces, and
results in a folder per batch of runs, of which a run's last one counts: doing a run
again after a crash leaves what doing it once leaves. A table of one job has a small
table beside the data, written last, that says so; without it the data is half a table,
and is built again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tsengine.operators.series_sets import export_columns

MARK = "_committed"
SHARE = "16m"
_ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def table_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def commit(spark: SparkSession, path: str) -> None:
    """Marks what is written below ``path`` as a whole table."""
    spark.range(1).select(F.current_timestamp().cast("string").alias("at")).coalesce(1).write.mode("overwrite").json(f"{path}/{MARK}")


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a whole table is there; the mark itself may be half written too."""
    try:
        return not spark.read.schema("at string").json(f"{path}/{MARK}").isEmpty()
    except AnalysisException:
        return False


def write_table(df: DataFrame, path: str, *partitions: str) -> None:
    """Replaces whatever is there, with its mark, and marks the new table once it is whole."""
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)
    commit(df.sparkSession, path)


def save_series_cache(held_out: DataFrame, path: str) -> None:
    """Write ``train`` and ``test`` arrays as two partitions of one table."""
    rest = [c for c in held_out.columns if c not in ("train", "test")]
    parts = F.array(
        F.struct(F.lit("train").alias("part"), F.col("train").alias("values")),
        F.struct(F.lit("test").alias("part"), F.col("test").alias("values")),
    )
    write_table(held_out.select(*rest, F.inline(parts)), path, "part")


def load_series_cache(spark: SparkSession, path: str, training: bool = True) -> DataFrame:
    """One part of the cache; the filter prunes the other part's files."""
    part = "train" if training else "test"
    return spark.read.parquet(path).filter(F.col("part") == part).drop("part")


def cached_series(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], training: bool = True
) -> DataFrame:
    """Load the cache, building it first unless a whole one is there."""
    if not committed(spark, path):
        save_series_cache(build(), path)
    return load_series_cache(spark, path, training)


def export_wide(df: DataFrame, path: str, values: str = "values", ids: tuple[str, ...] = (), prefix: str = "") -> None:
    """CSV with one column per position; short series are padded with empty cells."""
    export_columns(df, values, ids, prefix).write.mode("overwrite").option("header", True).csv(path)


def _replace_runs(df: DataFrame, path: str) -> None:
    """Replaces the folders of the runs that ``df`` holds and no others."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_id").parquet(path)


def save_forecasts(forecasts: DataFrame, path: str) -> None:
    """Predictions and truths in long form, one folder per run; a run written again replaces its own.

    Rebalancing gathers the small runs and splits the big ones, so that neither
    many tiny files nor one hot task comes of it. Forecasts shrink some ten times
    when shuffled and a task sorts its share, hence shares of ``SHARE`` as shuffled.
    """
    with _shares(forecasts.sparkSession, SHARE):
        _replace_runs(forecasts.hint("rebalance", "run_id"), path)


@contextmanager
def _shares(spark: SparkSession, size: str) -> Iterator[None]:
    """What adaptive execution gives to a task, for the queries run inside."""
    before = spark.conf.get(_ADVISORY, None)
    spark.conf.set(_ADVISORY, size)
    try:
        yield
    finally:
        spark.conf.unset(_ADVISORY) if before is None else spark.conf.set(_ADVISORY, before)


def load_forecasts(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(F.col("run_id") == run_id) if run_id is not None else df


RESULTS = "run_id string, mae double, mse double, rmse double, mape double, mspe double, batch long"


def append_results(metrics: DataFrame, path: str) -> None:
    """Add one row per run (run_id and the five metrics) to the results table; a run again replaces its row.

    Every call is a batch in a folder of its own, whatever the number of runs: nothing that is
    there is touched, and of a run's batches the last one counts. Calls follow one another.
    """
    spark = metrics.sparkSession
    last = spark.read.schema(RESULTS).parquet(path).agg(F.max("batch")).first()[0] if table_exists(spark, path) else None
    rows = metrics.select(F.col("run_id").cast("string").alias("run_id"), "mae", "mse", "rmse", "mape", "mspe")
    numbered = rows.withColumn("batch", F.lit(0 if last is None else last + 1).cast("long"))
    numbered.hint("rebalance").write.mode("append").partitionBy("batch").parquet(path)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """The results, each run as its last batch has it; run ids are text, whatever they look like."""
    every = spark.read.schema(RESULTS).parquet(path)
    newest = every.withColumn("_newest", F.max("batch").over(Window.partitionBy("run_id")))
    return newest.filter("batch = _newest").select("mae", "mse", "rmse", "mape", "mspe", "run_id")
