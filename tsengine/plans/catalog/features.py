"""Queries on calendar features, encodings and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsengine.functions import calendar, encodings, numeric, text
from tsengine.operators import instance_norm
from tsengine.plans.catalog.registry import query, r
from tsengine.plans.tables import table, vectors
from tsengine.session import scratch_path
from tsengine.streaming.files import transform_stream

# The checks state each feature anew, as SQL.
_SQL = {
    "second_of_minute": "floor(second(ts))/59.0-0.5",
    "minute_of_hour": "minute(ts)/59.0-0.5",
    "hour_of_day": "hour(ts)/23.0-0.5",
    "day_of_week": "(isodow(ts)-1)/6.0-0.5",
    "day_of_month": "(day(ts)-1)/30.0-0.5",
    "day_of_year": "(dayofyear(ts)-1)/365.0-0.5",
    "month_of_year": "(month(ts)-1)/11.0-0.5",
    "week_of_year": "(weekofyear(ts)-1)/52.0-0.5",
}


def _feature_sql(names):
    return "".join(f", round(({_SQL[n]})::DOUBLE,6)+0.0 AS {n}" for n in names)


def _features(freq):
    def run(spark, folder):
        events = table(spark, folder, "events")
        columns = calendar.feature_columns(F.col("ts"), freq)
        names = calendar.feature_names(freq)
        return events.select("event_id", *columns).select("event_id", *[r(n).alias(n) for n in names])

    return run


for _name, _freq in [("s", "s"), ("t", "15min"), ("h", "h"), ("d", "d"), ("b", "b"), ("w", "w"), ("m", "m"), ("q", "QE"), ("y", "y")]:
    query(f"time_features_{_name}", f"SELECT event_id{_feature_sql(calendar.feature_names(_freq))} FROM events")(_features(_freq))


@query(
    "time_features_array",
    " UNION ALL ".join(
        f"SELECT o_orderkey, {i} AS pos, round(({_SQL[n].replace('(ts)', '(o_orderdate)')})::DOUBLE,6)+0.0 AS feature FROM orders"
        for i, n in enumerate(calendar.feature_names("h"))
    ),
)
def time_features_array(spark, folder):
    orders = table(spark, folder, "orders")
    stacked = orders.select("o_orderkey", F.posexplode(calendar.feature_array(F.col("o_orderdate"), "h")).alias("pos", "feature"))
    return stacked.select("o_orderkey", "pos", r("feature").alias("feature"))


@query(
    "time_features_custom",
    "SELECT event_id, round((minute(ts)//15)/3.0-0.5,6)+0.0 AS quarter_of_hour, round(hour(ts)/23.0-0.5,6)+0.0 AS hour_of_day FROM events",
)
def time_features_custom(spark, folder):
    calendar.register_feature("quarter_of_hour", lambda ts: F.floor(F.minute(ts) / 15) / 3.0 - 0.5)
    names = ["quarter_of_hour", "hour_of_day"]
    events = table(spark, folder, "events")
    made = events.select("event_id", *calendar.feature_columns(F.col("ts"), names=names))
    return made.select("event_id", *[r(n).alias(n) for n in names])


@query("time_features_stream", f"SELECT event_id{_feature_sql(calendar.feature_names('h'))} FROM events")
def time_features_stream(spark, folder):
    sink, checkpoint = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")
    schema = table(spark, folder, "events").schema

    def features(df):
        return df.select("event_id", *calendar.feature_columns(F.col("ts"), "h"))

    transform_stream(spark, folder, schema, features, sink, checkpoint, "events.parquet")
    return spark.read.parquet(sink).select("event_id", *[r(n).alias(n) for n in calendar.feature_names("h")])


@query(
    "calendar_marks",
    "SELECT event_id, month(ts)::INT AS month, day(ts)::INT AS day, (isodow(ts)-1)::INT AS weekday, hour(ts)::INT AS hour FROM events",
)
def calendar_marks(spark, folder):
    return table(spark, folder, "events").select("event_id", *calendar.calendar_marks(F.col("ts")))


_WIDTH = 8
_CODE = " UNION ALL ".join(
    f"SELECT {{key}}, {2 * i + k} AS j, {f}({{p}}*pow(10000.0,-{2.0 * i}/{_WIDTH})) AS c FROM {{src}}"
    for i in range(_WIDTH // 2)
    for k, f in enumerate(("sin", "cos"))
)


_CODES = ", ".join(
    f"round({f}(j*pow(10000.0,-{2.0 * i}/{_WIDTH})),6)+0.0 AS c{2 * i + k}"
    for i in range(_WIDTH // 2)
    for k, f in enumerate(("sin", "cos"))
)


@query(
    "sinusoid_position",
    f"""WITH e AS (SELECT vec_id AS series_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding,1)-1 AS j FROM embeddings)
        SELECT series_id, j::INT AS pos, {_CODES} FROM e""",
)
def sinusoid_position(spark, folder):
    placed = vectors(spark, folder).select("series_id", F.posexplode("x").alias("pos", "v"))
    coded = placed.withColumn("code", encodings.sinusoid(F.col("pos"), _WIDTH))
    return coded.select("series_id", "pos", *[r(F.col("code")[i]).alias(f"c{i}") for i in range(_WIDTH)])


@query(
    "sinusoid_calendar",
    "WITH p AS (SELECT event_id, hour(ts) AS q FROM events UNION ALL SELECT event_id, isodow(ts)-1 FROM events "
    "UNION ALL SELECT event_id, day(ts) FROM events UNION ALL SELECT event_id, month(ts) FROM events "
    "UNION ALL SELECT event_id, minute(ts)//15 FROM events) "
    "SELECT event_id, j, round(sum(c),6)+0.0 AS code FROM (" + _CODE.format(key="event_id", p="q", src="p") + ") GROUP BY 1, 2",
)
def sinusoid_calendar(spark, folder):
    events = table(spark, folder, "events")
    code = encodings.calendar_code(F.col("ts"), _WIDTH, quarter_hours=True)
    coded = events.select("event_id", F.posexplode(code).alias("j", "code"))
    return coded.select("event_id", "j", r("code").alias("code"))


@query(
    "softplus",
    "SELECT event_id, round(CASE WHEN value-10>20 THEN value-10 ELSE ln(1+exp(value-10)) END,6)+0.0 AS s FROM events",
)
def softplus(spark, folder):
    return table(spark, folder, "events").select("event_id", r(numeric.softplus(F.col("value") - 10)).alias("s"))


@query(
    "recompose",
    """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding,1) AS j FROM embeddings)
       SELECT a.vec_id AS series_id, (a.j-1)::INT AS pos, round(a.v + b.v,6)+0.0 AS y
       FROM e a JOIN e b ON a.vec_id=b.vec_id AND b.j=65-a.j""",
)
def recompose(spark, folder):
    summed = vectors(spark, folder).select("series_id", F.posexplode(instance_norm.recompose(F.col("x"), F.reverse("x"))).alias("pos", "y"))
    return summed.select("series_id", "pos", r("y").alias("y"))


@query(
    "url_file_name",
    "SELECT page_id, CASE WHEN len(url)>0 THEN string_split(url,'/')[-1] ELSE '' END AS file_name FROM pages",
)
def url_file_name(spark, folder):
    return table(spark, folder, "pages").select("page_id", text.url_file_name(F.col("url")).alias("file_name"))


@query(
    "coerce_numeric",
    """SELECT event_id, round(try_cast(CASE WHEN regexp_full_match(c, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN c END AS DOUBLE),6)+0.0 AS number
       FROM (SELECT event_id, trim(CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN props WHEN 2 THEN '1d'
             ELSE ' ' || value::VARCHAR || ' ' END) AS c FROM events)""",
)
def coerce_numeric(spark, folder):
    events = table(spark, folder, "events")
    kind = F.col("event_id") % 5
    padded = F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" "))
    cell = F.when(kind == 0, F.col("event_type")).when(kind == 1, F.col("props")).when(kind == 2, F.lit("1d")).otherwise(padded)
    return events.select("event_id", r(numeric.coerce_number(cell)).alias("number"))
