"""The given tables in the layouts the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tsengine.operators import chunks, panel

# Channels of the event panel (target last), groups, priorities.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
GROUP_NAMES = ["Yearly", "Quarterly", "Monthly", "Weekly", "Daily", "Hourly"]
GROUP_FREQUENCY = [1, 4, 12, 1, 1, 24]
GROUP_HORIZON = [6, 8, 18, 13, 14, 48]
KEY = ["series_id"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def hourly_wide(spark: SparkSession, folder: str) -> DataFrame:
    """One series with a channel per event type: hourly sums, gaps are 0."""
    events = panel.as_panel(table(spark, folder, "events").select("ts", "event_type", "value"))
    return panel.regular_panel(events, KEY, "ts", "hour", panel.per_channel("event_type", EVENT_TYPES, "value"))


def user_hourly(spark: SparkSession, folder: str) -> DataFrame:
    """One series per user: hourly sums between first and last event, gaps are 0."""
    events = table(spark, folder, "events").select(F.col("user_id").alias("series_id"), "ts", "value")
    return panel.regular_panel(events, KEY, "ts", "hour", {"v": F.sum("value")})


def orders_daily(spark: SparkSession, folder: str) -> DataFrame:
    """One series with a channel per order priority: daily sums, gaps are 0."""
    orders = panel.as_panel(table(spark, folder, "orders").select("o_orderdate", "o_orderpriority", "o_totalprice"))
    cells = panel.per_channel("o_orderpriority", PRIORITIES, "o_totalprice")
    names = {f"p{name[0]}": agg for name, agg in cells.items()}
    return panel.regular_panel(orders, KEY, "o_orderdate", "day", names)


def user_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as irregular series per user, with position and length."""
    events = table(spark, folder, "events").select(F.col("user_id").alias("series_id"), "ts", "event_type", "value")
    return chunks.row_index(events, KEY, "ts")


def anomaly_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Per user: gt marks large values, pred marks errors."""
    return user_events(spark, folder).select(
        "series_id",
        "rn",
        F.when(F.col("value") > 10, 1).otherwise(0).alias("gt"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("pred"),
    )


def loss_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events read as training losses: run = user, epoch = day, step = event number."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("run_id"),
        F.dayofmonth("ts").alias("epoch"),
        F.col("event_id").alias("step"),
        F.col("value").alias("loss"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as short one-channel series."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("series_id"), "label", F.col("embedding").cast("array<double>").alias("x")
    )


def _text_cell(i: int) -> str:
    """Cell of a series-per-row file: some empty, some not numbers, ragged on the right."""
    place = f"(series_id + {i})"
    return (
        f"CASE WHEN {i} >= 40 + series_id % 25 THEN NULL WHEN {place} % 17 = 0 THEN 'x' WHEN {place} % 13 = 0 THEN NULL "
        f"WHEN {place} % 29 = 0 THEN 'nan' ELSE CAST(round(get(x, {i}), 6) AS STRING) END"
    )


def series_file(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as a series-per-row table of text: ``V1`` is the id, ``V2`` on are cells."""
    cells = [f"{_text_cell(i)} AS V{i + 2}" for i in range(64)]
    return vectors(spark, folder).selectExpr("'S' || series_id AS V1", *cells)


def ragged(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as ragged numeric series with group, frequency and horizon."""
    g = (F.col("series_id") % 6).cast("int")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), g + 1)
    return vectors(spark, folder).select(
        "series_id",
        pick(GROUP_NAMES).alias("grp"),
        pick(GROUP_FREQUENCY).alias("frequency"),
        pick(GROUP_HORIZON).alias("horizon"),
        F.slice("x", F.lit(1), (40 + F.col("series_id") % 25).cast("int")).alias("values"),
    )
