"""Queries on panels: scan, order, index, split, scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsengine.operators import chunks, panel, scaling, splits, windows
from tsengine.plans.catalog import fragments as sql
from tsengine.plans.catalog.registry import query, r
from tsengine.plans.tables import EVENT_TYPES, KEY, PRIORITIES, hourly_wide, orders_daily, user_events, user_hourly
from tsengine.session import scratch_path
from tsengine.sources import readers

_ROUNDED = ", ".join(f'round("{c}",6)+0.0 AS "{c}"' for c in EVENT_TYPES)


@query("scan_wide_series", f"WITH {sql.HOURLY} SELECT date, {_ROUNDED} FROM hourly")
def scan_wide_series(spark, folder):
    path = scratch_path(spark, "wide")
    hourly_wide(spark, folder).select("date", *EVENT_TYPES).write.option("header", True).csv(path)
    df = readers.wide_series(spark, path, target="view")
    return df.select("date", *[r(c).alias(c) for c in EVENT_TYPES])


@query("canonical_columns", f"WITH {sql.HOURLY} SELECT date, {_ROUNDED} FROM hourly")
def canonical_columns(spark, folder):
    mixed = hourly_wide(spark, folder).select("view", "date", "click", "error", "purchase", "signup")
    ordered = panel.canonical_columns(mixed, target="view")
    return ordered.select(ordered.columns[0], *[r(c).alias(c) for c in ordered.columns[1:]])


@query("feature_mode_s", f'WITH {sql.HOURLY} SELECT date, round("view",6)+0.0 AS "view" FROM hourly')
def feature_mode_s(spark, folder):
    wide = hourly_wide(spark, folder).select("date", *EVENT_TYPES)
    return panel.feature_mode(wide, "S", target="view").select("date", r("view").alias("view"))


@query(
    "orders_daily_panel",
    f"WITH {sql.ORDERS} SELECT date, rn, n, {', '.join(f'round(p{p[0]},2)+0.0 AS p{p[0]}' for p in PRIORITIES)} FROM daily",
)
def orders_daily_panel(spark, folder):
    return orders_daily(spark, folder).select("date", "rn", "n", *[r(f"p{p[0]}", 2).alias(f"p{p[0]}") for p in PRIORITIES])


@query(
    "long_wide_roundtrip",
    f"""WITH {sql.HOURLY} SELECT date, {_ROUNDED} FROM hourly""",
)
def long_wide_roundtrip(spark, folder):
    long = panel.to_long(hourly_wide(spark, folder), ["date"], EVENT_TYPES)
    return panel.to_wide(long, ["date"], EVENT_TYPES).select("date", *[r(c).alias(c) for c in EVENT_TYPES])


@query(
    "row_index",
    """SELECT event_id, user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS rn,
       count(*) OVER (PARTITION BY user_id) AS n FROM events""",
)
def row_index(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet").select("event_id", F.col("user_id").alias("series_id"), "ts")
    return chunks.row_index(events, KEY, "ts").select("event_id", "series_id", "rn", "n")


@query(
    "row_index_single_series",
    "SELECT event_id, row_number() OVER (ORDER BY ts) - 1 AS rn, count(*) OVER () AS n FROM events",
)
def row_index_single_series(spark, folder):
    events = panel.as_panel(spark.read.parquet(f"{folder}/events.parquet").select("event_id", "ts"))
    return chunks.row_index(events, KEY, "ts", ("month", "hour")).select("event_id", "rn", "n")


@query(
    "split_sizes",
    f"""WITH {sql.USERS} SELECT series_id, any_value(n) AS n, {sql.NT.replace('n*', 'any_value(n)*')} AS n_train,
        any_value(n) - {sql.NT.replace('n*', 'any_value(n)*')} - {sql.NS.replace('n*', 'any_value(n)*')} AS n_val,
        {sql.NS.replace('n*', 'any_value(n)*')} AS n_test FROM users GROUP BY series_id""",
)
def split_sizes(spark, folder):
    return splits.sizes(user_hourly(spark, folder), KEY)


_PARTS = {s: sql.bounds(s, 24) for s in splits.SPLITS}


@query(
    "split_rows",
    f"WITH {sql.USERS} "
    + " UNION ALL ".join(
        f"SELECT '{s}' AS split, series_id, rn, rn-{low} AS pos, round(v,6)+0.0 AS v FROM users WHERE rn >= {low} AND rn < {high}"
        for s, (low, high) in _PARTS.items()
    ),
)
def split_rows(spark, folder):
    users = user_hourly(spark, folder)
    parts = [splits.rows(users, s, 24).withColumn("split", F.lit(s)) for s in splits.SPLITS]
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return stacked.select("split", "series_id", "rn", (F.col("rn") - F.col("first")).alias("pos"), r("v").alias("v"))


@query("position_range", f"WITH {sql.USERS} SELECT series_id, rn, round(v,6)+0.0 AS v FROM users WHERE rn >= 100 AND rn < 200")
def position_range(spark, folder):
    return splits.position_range(user_hourly(spark, folder), 100, 200).select("series_id", "rn", r("v").alias("v"))


@query(
    "scale_fit",
    f"WITH {sql.HOURLY_LONG}, {sql.SCALED} SELECT channel, round(m,8)+0.0 AS mean, round(s,8)+0.0 AS std FROM st",
)
def scale_fit(spark, folder):
    stats = scaling.fit(hourly_wide(spark, folder), KEY, EVENT_TYPES)
    return scaling.long_stats(stats, KEY, EVENT_TYPES).select("channel", r("mean", 8).alias("mean"), r("std", 8).alias("std"))


@query(
    "scale_fit_panel",
    f"WITH {sql.USERS}, {sql.SCALED} SELECT series_id, round(m,8)+0.0 AS mean, round(s,8)+0.0 AS std FROM st",
)
def scale_fit_panel(spark, folder):
    stats = scaling.fit(user_hourly(spark, folder), KEY, ["v"])
    return stats.select("series_id", r("v_mean", 8).alias("mean"), r("v_std", 8).alias("std"))


@query("scale_transform", f"WITH {sql.USERS}, {sql.SCALED} SELECT series_id, rn, round(v,6)+0.0 AS v FROM sc")
def scale_transform(spark, folder):
    users = user_hourly(spark, folder)
    stats = scaling.fit(users, KEY, ["v"])
    return scaling.apply(users, stats, KEY, ["v"]).select("series_id", "rn", r("v").alias("v"))


@query("scale_inverse", f"WITH {sql.USERS} SELECT series_id, rn, round(v,6)+0.0 AS v FROM users")
def scale_inverse(spark, folder):
    users = user_hourly(spark, folder)
    stats = scaling.fit(users, KEY, ["v"])
    back = scaling.invert(scaling.apply(users, stats, KEY, ["v"]), stats, KEY, ["v"])
    return back.select("series_id", "rn", r("v").alias("v"))


@query(
    "window_count",
    f"""WITH {sql.USERS} SELECT series_id, greatest(count(*)-36+1, 0) AS n_windows FROM users
        WHERE rn >= {sql.bounds('test', 24)[0]} GROUP BY series_id""",
)
def window_count(spark, folder):
    part = splits.rows(user_hourly(spark, folder), "test", 24)
    return part.groupBy("series_id").agg(windows.count_windows(F.count(F.lit(1)), 24, 12).alias("n_windows"))


@query(
    "panel_violations",
    """SELECT user_id AS series_id, date_trunc('day', ts) AS day, count(*) AS copies, 'repeated timestamp' AS problem
       FROM events GROUP BY 1, 2 HAVING count(*) > 1""",
)
def panel_violations(spark, folder):
    events = user_events(spark, folder).withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return panel.violations(events, KEY, "day")
