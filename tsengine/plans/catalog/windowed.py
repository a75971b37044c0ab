"""Queries on windows, batches, patches and per-window normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsengine.operators import chunks, forecasts, instance_norm, splits, windows
from tsengine.plans.catalog import fragments as sql
from tsengine.plans.catalog.registry import digest, digest_sql, query, r
from tsengine.plans.prepare import Spec, prepare_matrix, prepare_split, split_windows
from tsengine.plans.tables import EVENT_TYPES, KEY, hourly_wide, user_hourly, vectors

# Small windows so that every series of the test tables has some in each split.
SPEC = Spec(context=24, label=12, horizon=12, batch=32)
ID = ["series_id", "channel", "window_id"]
_IDS = "series_id, channel, window_id"


def _prepared(spark, folder, split="test", spec=SPEC, ts=None):
    return prepare_split(user_hourly(spark, folder), KEY, ["v"], split, spec, ts)


def _two_digests(split: str, source: str = "sc") -> str:
    return (
        sql.cells(split, 24, 12, 0, 24, source, "cx")
        + ","
        + sql.cells(split, 24, 12, 12, 24, source, "cy")
        + f""",
dx AS (SELECT {_IDS}, {digest_sql('x')} FROM cx GROUP BY ALL),
dy AS (SELECT {_IDS}, {digest_sql('y')} FROM cy GROUP BY ALL)"""
    )


_UNSCALED = "raw AS (SELECT series_id, channel, date, rn, n, v FROM plong)"


@query(
    "windows_xy",
    f"WITH {sql.USERS}, {_UNSCALED}, {_two_digests('test', 'raw')} SELECT * FROM dx JOIN dy USING ({_IDS})",
)
def windows_xy(spark, folder):
    spec = Spec(context=24, label=12, horizon=12, scale=False)
    return _prepared(spark, folder, "test", spec).select(*ID, *digest("x"), *digest("y"))


@query(
    "windows_single_series",
    f"WITH {sql.HOURLY_LONG}, {_UNSCALED}, "
    + sql.cells("train", 24, 12, 0, 24, "raw", "cx")
    + f" SELECT {_IDS}, {digest_sql('x')} FROM cx GROUP BY ALL",
)
def windows_single_series(spark, folder):
    """One series over several chunks: chunk size 64 forces halo copies."""
    spec = Spec(context=24, label=12, horizon=12, scale=False, size=64)
    made = prepare_split(hourly_wide(spark, folder), KEY, EVENT_TYPES, "train", spec)
    return made.select(*ID, *digest("x"))


@query(
    "prepare_split",
    f"WITH {sql.USERS}, {sql.SCALED}, {_two_digests('val')} "
    f"SELECT *, window_id // 32 AS batch_id FROM dx JOIN dy USING ({_IDS})",
)
def prepared_split(spark, folder):
    return _prepared(spark, folder, "val").select(*ID, *digest("x"), *digest("y"), "batch_id")


_MARKS = "(hour(date)/23.0-0.5)::DOUBLE"


@query(
    "windows_marks",
    f"WITH {sql.USERS}, {sql.SCALED}, {sql.cells('test', 24, 12, 0, 24, 'sc', 'cx')}, {sql.cells('test', 24, 12, 12, 24, 'sc', 'cy')},"
    f"""
dx AS (SELECT {_IDS}, {digest_sql('hour_x', _MARKS)} FROM cx GROUP BY ALL),
dy AS (SELECT {_IDS}, {digest_sql('hour_y', _MARKS)} FROM cy GROUP BY ALL)
SELECT * FROM dx JOIN dy USING ({_IDS})""",
)
def windows_marks(spark, folder):
    made = _prepared(spark, folder, "test", ts="date")
    first = lambda c: F.transform(c, lambda m: m[0])
    hours = made.select(*ID, first("x_mark").alias("hour_x"), first("y_mark").alias("hour_y"))
    return hours.select(*ID, *digest("hour_x"), *digest("hour_y"))


@query(
    "windows_matrix",
    f"WITH {sql.HOURLY_LONG}, {sql.SCALED}, {_two_digests('val')} "
    f"SELECT *, window_id // 32 AS batch_id FROM dx JOIN dy USING ({_IDS})",
)
def windows_matrix(spark, folder):
    """All channels of a window in one row, taken apart again for the comparison."""
    made = prepare_matrix(hourly_wide(spark, folder), KEY, EVENT_TYPES, "val", SPEC, ts="date")
    names = F.array(*[F.lit(c) for c in EVENT_TYPES])
    rows = F.arrays_zip(names.alias("channel"), F.col("x"), F.col("y"))
    return made.select("series_id", "window_id", "batch_id", F.inline(rows)).select(*ID, *digest("x"), *digest("y"), "batch_id")


@query(
    "decoder_input",
    f"WITH {sql.USERS}, {sql.SCALED}, {sql.cells('test', 24, 12, 12, 12, 'sc', 'cd')} "
    f"SELECT {_IDS}, 24 AS d_n, d_sum, d_weighted FROM (SELECT {_IDS}, {digest_sql('d')} FROM cd GROUP BY ALL)",
)
def decoder_input(spark, folder):
    made = _prepared(spark, folder).withColumn("d", windows.decoder_input(F.col("y"), 12, 12))
    return made.select(*ID, *digest("d"))


@query(
    "target_slice",
    f"WITH {sql.HOURLY_LONG}, {sql.SCALED}, {sql.cells('test', 24, 12, 24, 12, 'sc', 'ct')} "
    f"SELECT {_IDS}, {digest_sql('t')} FROM ct WHERE channel='view' GROUP BY ALL",
)
def target_slice(spark, folder):
    channels = windows.output_channels(EVENT_TYPES, "MS")
    made = prepare_split(hourly_wide(spark, folder), KEY, channels, "test", SPEC)
    return made.select(*ID, windows.target_part(F.col("y"), 12).alias("t")).select(*ID, *digest("t"))


@query(
    "strided_windows",
    f"WITH {sql.USERS}, {sql.cells('train', 24, 12, 0, 24, 'plong', 'cx')} "
    f"SELECT series_id, window_id // 24 AS window_id, {digest_sql('x')} FROM cx WHERE window_id % 24 = 0 GROUP BY 1, 2",
)
def strided_windows(spark, folder):
    part = splits.rows(user_hourly(spark, folder), "train", 0)
    made = chunks.chunked(part, KEY, ["v"], 128, after=SPEC.halo, constant=["first"])
    cut = windows.starts(made, SPEC.length, 128, first="first", stride=24)
    return cut.select("series_id", "window_id", windows.piece("v", 0, 24).alias("x")).select(
        "series_id", "window_id", *digest("x")
    )


@query(
    "assign_batches",
    f"WITH {sql.USERS}, {sql.steps('val', 24, 12, 'plong')} "
    "SELECT series_id, window_id // 32 AS batch_id, count(*) AS windows, min(window_id) AS first_window "
    "FROM w WHERE step=1 GROUP BY 1, 2",
)
def assign_batches(spark, folder):
    spec = Spec(context=24, label=12, horizon=12, scale=False)
    made = split_windows(user_hourly(spark, folder), KEY, ["v"], "val", spec)
    return (
        made.withColumn("batch_id", windows.batch_id(32))
        .groupBy("series_id", "batch_id")
        .agg(F.count(F.lit(1)).alias("windows"), F.min("window_id").alias("first_window"))
    )


_STAGES, _PLACE = sql.stirred("x", "a", "b", "key")
_FIELDS = "series_id, window_id, epoch, cnt, a, b, key"


@query(
    "shuffle_windows",
    f"""WITH RECURSIVE {sql.USERS}, k AS (SELECT DISTINCT series_id, {sql.NT}-35 AS cnt FROM users WHERE {sql.NT} > 35),
        sides AS (SELECT *, ceil(sqrt(cnt::DOUBLE))::BIGINT AS a FROM k),
        start AS (SELECT series_id, unnest(range(0, cnt)) AS window_id, cnt, a, ceil(cnt / a)::BIGINT AS b FROM sides),
        keyed AS (SELECT *, '7/' || epoch || '/' || series_id AS key FROM start, (SELECT unnest([0, 1]) AS epoch)),
        walk AS (SELECT {_FIELDS}, {_PLACE} AS x, 1 AS times FROM {sql.nested(_STAGES, "(SELECT *, window_id AS x FROM keyed)")}
                 UNION ALL
                 SELECT {_FIELDS}, {_PLACE}, times + 1 FROM {sql.nested(_STAGES, "(SELECT * FROM walk WHERE x >= cnt)")})
        SELECT series_id, window_id, epoch::INT AS epoch, x AS place, x // 32 AS batch_id FROM walk WHERE x < cnt""",
)
def shuffle_windows(spark, folder):
    """Two epochs: place and batch of every training window in each."""
    spec = Spec(context=24, label=12, horizon=12, scale=False)
    made = split_windows(user_hourly(spark, folder), KEY, ["v"], "train", spec).select("series_id", "window_id", "n")
    epochs = made.withColumn("epoch", F.explode(F.array(F.lit(0), F.lit(1))))
    rows, _, _ = splits.part_sizes(F.col("n"))
    count = windows.count_windows(rows, spec.context, spec.horizon)
    return windows.shuffled(epochs, KEY, 7, count, F.col("epoch"), spec.batch).drop("n")


_EMB = "e AS (SELECT vec_id AS series_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding,1)-1 AS j FROM embeddings)"
_STAT = "s AS (SELECT series_id, avg(v) AS c, sqrt(var_pop(v)+1e-5) AS sd, max_by(v, j) AS last FROM e GROUP BY 1)"


@query(
    "instance_norm",
    f"""WITH {_EMB}, {_STAT} SELECT series_id, j::INT AS pos, round(center,6)+0.0 AS center, round(scale,6)+0.0 AS scale,
        round((v-center)/scale*1.5+0.25,6)+0.0 AS z FROM (SELECT *, c AS center, sd AS scale FROM e JOIN s USING (series_id))""",
)
def normalised(spark, folder):
    return _normed(spark, folder, last=False, weight=1.5, bias=0.25)


@query(
    "instance_norm_last",
    f"""WITH {_EMB}, {_STAT} SELECT series_id, j::INT AS pos, round(center,6)+0.0 AS center, round(scale,6)+0.0 AS scale,
        round((v-center)/scale,6)+0.0 AS z FROM (SELECT *, last AS center, sd AS scale FROM e JOIN s USING (series_id))""",
)
def normalised_last(spark, folder):
    return _normed(spark, folder, last=True)


def _normed(spark, folder, last, weight=1.0, bias=0.0):
    staged = vectors(spark, folder).withColumn("st", instance_norm.statistics(F.col("x"), last))
    z = staged.select("series_id", "st", F.posexplode(instance_norm.norm(F.col("x"), F.col("st"), weight, bias)).alias("pos", "z"))
    return z.select("series_id", "pos", r(F.col("st")["center"]).alias("center"), r(F.col("st")["scale"]).alias("scale"), r("z").alias("z"))


@query("instance_denorm", f"WITH {_EMB} SELECT series_id, j::INT AS pos, round(v,6)+0.0 AS v FROM e")
def denormalised(spark, folder):
    staged = vectors(spark, folder).withColumn("st", instance_norm.statistics(F.col("x")))
    z = instance_norm.norm(F.col("x"), F.col("st"), 1.5, 0.25)
    back = staged.select(
        "series_id", F.posexplode(instance_norm.denorm(z, F.col("st"), 1.5, 0.25)).alias("pos", "v")
    )
    return back.select("series_id", "pos", r("v").alias("v"))


@query(
    "patchify",
    f"""WITH {_EMB}, p AS (SELECT series_id, (unnest(generate_series(0, (64+8-16)//8)))::INT AS patch FROM (SELECT DISTINCT series_id FROM e))
        SELECT series_id, patch, 16 AS w_n, round(sum(v),5)+0.0 AS w_sum, round(sum((k+1)*v),4)+0.0 AS w_weighted
        FROM (SELECT series_id, patch, unnest(generate_series(0,15)) AS k FROM p) q
        JOIN e USING (series_id) WHERE e.j = least(patch*8+k, 63) GROUP BY 1, 2""",
)
def patchify(spark, folder):
    cut = vectors(spark, folder).select("series_id", F.posexplode(windows.patches(F.col("x"), 16, 8, 8)).alias("patch", "w"))
    return cut.select("series_id", "patch", *digest("w"))


@query(
    "plot_frames",
    f"""WITH {sql.HOURLY_LONG}, {sql.SCALED}, {sql.cells('test', 24, 12, 0, 36, 'sc', 'cp')},
        k AS (SELECT *, max(CASE WHEN pos=23 THEN v END) OVER (PARTITION BY {_IDS}) AS last FROM cp
              WHERE channel='view' AND window_id % 40 = 0)
        SELECT window_id, pos::INT AS pos, round(v,6)+0.0 AS truth,
               round(CASE WHEN pos<24 THEN v ELSE last END,6)+0.0 AS prediction FROM k""",
)
def plot_frames(spark, folder):
    made = split_windows(hourly_wide(spark, folder), KEY, ["view"], "test", SPEC).drop("n", "first")
    forecast = F.array_repeat(windows.at(24), 12)
    frames = windows.plot_frames(made, batch=2, every=20, context=24, horizon=12, prediction=forecast)
    return frames.select("window_id", "pos", r("truth").alias("truth"), r("prediction").alias("prediction"))


@query(
    "moving_frame",
    f"""WITH {sql.USERS} SELECT series_id, rn, round(avg(v) OVER (PARTITION BY series_id ORDER BY rn
        ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING),8)+0.0 AS trend FROM users""",
)
def moving_frame(spark, folder):
    return forecasts.trend(user_hourly(spark, folder), KEY, "v", 25, size=128).select("series_id", "rn", r("trend", 8).alias("trend"))
