"""Queries on forecasters and their evaluation."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from tsengine.operators import forecasts, gram, metrics, ridge
from tsengine.plans import evaluate, experiment
from tsengine.plans.catalog import fragments as sql
from tsengine.plans.catalog.registry import query, r
from tsengine.plans.catalog.scores import _ALL, FIVE, _H, _W, naive
from tsengine.plans.catalog.windowed import SPEC
from tsengine.plans.prepare import split_chunks
from tsengine.plans.tables import EVENT_TYPES, KEY, hourly_wide, user_hourly
from tsengine.session import scratch_path

_STEP = ["series_id", "channel", "window_id", "step"]


@query("evaluate_run", f"{_H} SELECT {_ALL} FROM w")
def evaluate_run(spark, folder):
    """The flagship: events to panel, split, scale, windows, last-value forecast, five metrics."""
    scored = evaluate.evaluate_last_value(hourly_wide(spark, folder), KEY, EVENT_TYPES, SPEC)
    return scored.select(*[r(m, 4).alias(m) for m in FIVE])


@query("evaluate_panel", f"{_W} SELECT {_ALL} FROM w")
def evaluate_panel(spark, folder):
    """The same over one series per user."""
    scored = evaluate.evaluate_last_value(user_hourly(spark, folder), KEY, ["v"], SPEC)
    return scored.select(*[r(m, 4).alias(m) for m in FIVE])


@query(
    "evaluate_long_horizon",
    f"WITH {sql.USERS}, {sql.SCALED}, {sql.steps('test', 336, 96)} SELECT {_ALL} FROM w",
)
def evaluate_long_horizon(spark, folder):
    """Context 336 and horizon 96, the settings of the experiments."""
    spec = evaluate.Spec(context=336, label=24, horizon=96)
    scored = evaluate.evaluate_last_value(user_hourly(spark, folder), KEY, ["v"], spec)
    return scored.select(*[r(m, 4).alias(m) for m in FIVE])


def _experiment(model, features):
    def run(spark, folder):
        path = scratch_path(spark, "wide")
        hourly_wide(spark, folder).select("date", *EVENT_TYPES).write.option("header", True).csv(path)
        config = experiment.Config(
            model_id="events", model=model, features=features, target="view", seq_len=24, label_len=12, pred_len=12
        )
        out = scratch_path(spark, "experiment")
        experiment.run(spark, path, config, out)
        again = experiment.run(spark, path, config, out)  # finds the results and runs nothing
        return again.select(*[r(m, 4).alias(m) for m in FIVE])

    return run


query("experiment_last_value", f"{_H} SELECT {_ALL} FROM w")(_experiment("last", "M"))
query("experiment_target_only", f"{_H} SELECT {_ALL} FROM w WHERE channel='view'")(_experiment("last", "MS"))
query("experiment_ridge")(_experiment("ridge", "M"))


@query(
    "align_forecasts",
    f"{_H} SELECT channel, window_id, step, round(pred,6)+0.0 AS pred, round(truth,6)+0.0 AS truth FROM w",
)
def align_forecasts(spark, folder):
    both = evaluate.last_value_forecasts(hourly_wide(spark, folder), KEY, EVENT_TYPES, "test", SPEC)
    aligned = evaluate.align(both.drop("true"), both.drop("pred"), _STEP)
    return aligned.select("channel", "window_id", "step", r("pred").alias("pred"), r("true").alias("truth"))


_PAIRS = sql.steps("train", 1, 1, name="pairs")
_AR = """ar AS (SELECT series_id, coalesce(regr_slope(truth, pred), 0) AS a,
        coalesce(regr_intercept(truth, pred), avg(truth)) AS b FROM pairs GROUP BY 1)"""
_BY_SERIES = "round(avg(abs(p-truth)),5)+0.0 AS mae, round(avg((p-truth)*(p-truth)),5)+0.0 AS mse"


def _score(df, digits=5):
    p, t = F.col("pred"), F.col("true")
    return df.groupBy("series_id", "step").agg(r(metrics.mae(p, t), digits).alias("mae"), r(metrics.mse(p, t), digits).alias("mse"))


@query(
    "forecast_recursive",
    f"""WITH {sql.USERS}, {sql.SCALED}, {_PAIRS}, {_AR}, {sql.steps('test', 24, 12)},
        f AS (SELECT series_id, step, truth, pow(a,step)*pred + b*CASE WHEN a=1 THEN step ELSE (1-pow(a,step))/(1-a) END AS p
              FROM w JOIN ar USING (series_id))
        SELECT series_id, step, {_BY_SERIES} FROM f GROUP BY 1, 2""",
)
def forecast_recursive(spark, folder):
    return _score(evaluate.ar1_forecasts(user_hourly(spark, folder), KEY, "v", "test", SPEC))


@query(
    "forecast_direct_one_lag",
    f"""WITH {sql.USERS}, {sql.SCALED}, {sql.steps('train', 1, 12, name='pairs')}, {sql.steps('test', 24, 12)},
        lag AS (SELECT series_id, step, coalesce(regr_slope(truth, pred),0) AS a, coalesce(regr_intercept(truth, pred), avg(truth)) AS b
                FROM pairs GROUP BY 1, 2),
        f AS (SELECT series_id, step, truth, a*pred+b AS p FROM w JOIN lag USING (series_id, step))
        SELECT series_id, step, {_BY_SERIES} FROM f GROUP BY 1, 2""",
)
def forecast_direct_one_lag(spark, folder):
    return _score(evaluate.lag_forecasts(user_hourly(spark, folder), KEY, "v", "test", SPEC))


@query("forecast_direct")
def forecast_direct(spark, folder):
    """Ridge on 24 normalised lags, pooled over all series; metrics per step."""
    users = user_hourly(spark, folder)
    model = ridge.fit(split_chunks(users, KEY, ["v"], "train", SPEC), 24, 12, penalty=1.0)
    test = split_chunks(users, KEY, ["v"], "test", SPEC)
    made = model.transform(test, KEY, first="first")
    return metrics.bundle(made, ["step"]).select("step", *[r(m, 4).alias(m) for m in FIVE])


@query("forecast_recursive_ridge")
def forecast_recursive_ridge(spark, folder):
    """One-step ridge on 24 normalised lags, rolled out over the horizon; metrics per step."""
    users = user_hourly(spark, folder)
    one_step = replace(SPEC, horizon=1)
    model = ridge.fit(split_chunks(users, KEY, ["v"], "train", one_step), 24, 1, penalty=1.0).rolled_out(12)
    made = model.transform(split_chunks(users, KEY, ["v"], "test", SPEC), KEY, first="first")
    return metrics.bundle(made, ["step"]).select("step", *[r(m, 4).alias(m) for m in FIVE])


@query(
    "score_windows",
    f"""WITH {sql.USERS}, {sql.SCALED}, {sql.steps('test', 24, 12)}, {sql.cells('test', 24, 12, 16, 8, 'sc', 'c8')},
        m AS (SELECT series_id, window_id, avg(v) AS p FROM c8 GROUP BY 1, 2),
        f AS (SELECT series_id, step, truth, p FROM w JOIN m USING (series_id, window_id))
        SELECT series_id, step, {_BY_SERIES} FROM f GROUP BY 1, 2""",
)
def score_windows(spark, folder):
    """A user's forecaster: the mean of the last eight values at every step."""

    def mean_of_eight(x: np.ndarray) -> np.ndarray:
        return np.repeat(x[:, -8:].mean(axis=1, keepdims=True), 12, axis=1)

    test = split_chunks(user_hourly(spark, folder), KEY, ["v"], "test", SPEC)
    return _score(ridge.unpack(ridge.score(test, mean_of_eight, 24, 12, KEY, first="first")))


@query(
    "forecast_sigma",
    f"""WITH {sql.USERS}, {sql.SCALED}, {sql.steps('train', 24, 12, name='tr')}, {sql.steps('test', 24, 12)},
        g AS (SELECT series_id, step, sqrt(avg(pow(truth-pred,2))) AS sigma FROM tr GROUP BY 1, 2)
        SELECT series_id, step, round(any_value(sigma),6)+0.0 AS sigma, count(*) AS n,
               round(avg(CASE WHEN sigma > 0 THEN ln(sigma)+0.5*pow((truth-pred)/sigma,2) END),5)+0.0 AS nll
        FROM w JOIN g USING (series_id, step) GROUP BY 1, 2""",
)
def forecast_sigma(spark, folder):
    made = evaluate.last_value_with_sigma(user_hourly(spark, folder), KEY, "v", "test", SPEC)
    return made.groupBy("series_id", "step").agg(
        r(F.max("sigma")).alias("sigma"),
        F.count(F.lit(1)).alias("n"),
        r(metrics.gaussian_nll(F.col("true"), F.col("mu"), F.col("sigma")), 5).alias("nll"),
    )


@query(
    "trend_season",
    f"""WITH {sql.USERS}, t AS (SELECT series_id, rn, n, v, avg(v) OVER (PARTITION BY series_id ORDER BY rn
              ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS trend FROM users),
        p AS (SELECT series_id, rn%24 AS phase, avg(v-trend) AS season FROM t WHERE rn < {sql.NT} GROUP BY 1, 2)
        SELECT series_id, rn, round(v,8)+0.0 AS v, round(trend,8)+0.0 AS trend, round(coalesce(season,0),8)+0.0 AS season,
               round(v-trend-coalesce(season,0),8)+0.0 AS rest
        FROM t LEFT JOIN p ON t.series_id=p.series_id AND t.rn%24=p.phase""".replace(
        "SELECT series_id, rn, round(v,8)", "SELECT t.series_id, rn, round(v,8)"
    ),
)
def trend_season(spark, folder):
    parts = forecasts.trend_season(user_hourly(spark, folder), KEY, "v", period=24, size=128)
    return parts.select("series_id", "rn", *[r(c, 8).alias(c) for c in ("v", "trend", "season", "rest")])


_SEASONS = f"""t AS (SELECT *, avg(v) OVER (PARTITION BY series_id ORDER BY rn
              ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS trend FROM sc),
        p AS (SELECT series_id, rn%24 AS phase, avg(v-trend) AS season FROM t WHERE rn < {sql.NT} GROUP BY 1, 2)"""


@query(
    "forecast_trend_season",
    f"""WITH {sql.USERS}, {sql.SCALED}, {_SEASONS}, {sql.cells('test', 24, 12, 11, 13, 'sc', 'c13')},
        l AS (SELECT series_id, window_id, avg(v) AS trend FROM c13 GROUP BY 1, 2), {sql.steps('test', 24, 12)},
        k AS (SELECT series_id, any_value(n) AS n FROM sc GROUP BY 1),
        f AS (SELECT w.series_id, w.step, w.truth, l.trend, coalesce(p.season,0) AS season, l.trend+coalesce(p.season,0) AS p
              FROM w JOIN l USING (series_id, window_id) JOIN k USING (series_id)
              LEFT JOIN p ON p.series_id=w.series_id AND p.phase=(w.window_id+{sql.bounds('test', 24, 'k.')[0]}+23+w.step)%24)
        SELECT series_id, step, round(avg(trend),5)+0.0 AS trend, round(avg(season),5)+0.0 AS season, {_BY_SERIES} FROM f GROUP BY 1, 2""",
)
def forecast_trend_season(spark, folder):
    made = evaluate.trend_season_forecasts(user_hourly(spark, folder), KEY, "v", "test", SPEC, period=24)
    p, t = F.col("pred"), F.col("true")
    return made.groupBy("series_id", "step").agg(
        r(F.avg("trend"), 5).alias("trend"),
        r(F.avg("season"), 5).alias("season"),
        r(metrics.mae(p, t), 5).alias("mae"),
        r(metrics.mse(p, t), 5).alias("mse"),
    )


_CANDIDATES = f"""
ctx AS (SELECT series_id, split, window_id, avg(v) AS mean FROM cc GROUP BY 1, 2, 3),
lagged AS (SELECT w.*, m.mean, s.v AS seasonal FROM w JOIN ctx m USING (series_id, split, window_id)
           JOIN sc s ON s.series_id=w.series_id AND s.rn=w.last_rn+w.step-24),
cand AS (SELECT split, window_id, series_id, 'last' AS candidate, pred, truth FROM lagged
         UNION ALL SELECT split, window_id, series_id, 'mean', mean, truth FROM lagged
         UNION ALL SELECT split, window_id, series_id, 'seasonal', seasonal, truth FROM lagged)"""


def _both(split: str) -> str:
    low, _ = sql.bounds(split, 24, "k.")
    w, c = f"w_{split}", f"c_{split}"
    return (
        f"{sql.steps(split, 24, 12, name=w)}, {sql.cells(split, 24, 12, 0, 24, 'sc', c)},"
        f"x_{split} AS (SELECT w.*, '{split}' AS split, w.window_id+{low}+23 AS last_rn FROM {w} w "
        f"JOIN (SELECT series_id, any_value(n) AS n FROM sc GROUP BY 1) k USING (series_id))"
    )


@query(
    "select_forecaster",
    f"""WITH {sql.USERS}, {sql.SCALED}, {_both('val')}, {_both('test')},
        w AS (SELECT * FROM x_val UNION ALL SELECT * FROM x_test),
        cc AS (SELECT *, 'val' AS split FROM c_val UNION ALL SELECT *, 'test' AS split FROM c_test), {_CANDIDATES},
        b AS (SELECT candidate, series_id, window_id//32 AS batch, avg(pow(pred-truth,2)) AS l FROM cand WHERE split='val' GROUP BY ALL),
        best AS (SELECT candidate, avg(l) AS val_loss FROM b GROUP BY 1 ORDER BY 2 LIMIT 1)
        SELECT candidate, round(any_value(val_loss),5)+0.0 AS val_loss, {_ALL} FROM cand JOIN best USING (candidate)
        WHERE split='test' GROUP BY 1""",
)
def select_forecaster(spark, folder):
    chosen = evaluate.select_forecaster(user_hourly(spark, folder), KEY, ["v"], SPEC, period=24)
    return chosen.select("candidate", r("val_loss", 5).alias("val_loss"), *[r(m, 4).alias(m) for m in FIVE])


def _uniform(salt: int) -> str:
    digits = f"substr(md5('11:{salt}:' || series_id || ':' || window_id || ':' || step || ':' || draw), 1, 15)"
    return f"((('0x' || {digits})::BIGINT::DOUBLE + 0.5) / pow(2, 60))"


@query(
    "sample_paths",
    f"""{_W}, d AS (SELECT series_id, window_id, step, unnest(range(1, 9)) AS draw FROM w),
        e AS (SELECT series_id, sqrt(-2.0*ln({_uniform(1)})) * cos({_uniform(2)}*2.0*pi()) AS error FROM d)
        SELECT series_id, count(*) AS draws, round(avg(error),6)+0.0 AS mean_error, round(stddev_pop(error),6)+0.0 AS spread FROM e GROUP BY 1""",
)
def sample_paths(spark, folder):
    """Eight draws around every last-value forecast; mean and spread per series."""
    made = naive(spark, folder).withColumns({"mu": F.col("pred"), "logvar": F.lit(0.0)})
    drawn = forecasts.sample_paths(made, ["series_id", "window_id", "step"], draws=8, seed=11)
    error = F.col("sample") - F.col("mu")
    return drawn.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("draws"), r(F.avg(error)).alias("mean_error"), r(F.stddev_pop(error)).alias("spread")
    )


_LAG = """lag AS (SELECT series_id, step, coalesce(regr_slope(truth, pred),0) AS a, coalesce(regr_intercept(truth, pred), avg(truth)) AS b
                FROM pairs GROUP BY 1, 2),
        spread AS (SELECT series_id, step, sqrt(avg(pow(truth-a*pred-b,2))) AS sd FROM pairs JOIN lag USING (series_id, step) GROUP BY 1, 2)"""


@query(
    "forecast_direct_per_series",
    f"""WITH {sql.USERS}, {sql.SCALED}, {sql.steps('train', 1, 12, name='pairs')}, {sql.steps('test', 24, 12)}, {_LAG},
        f AS (SELECT series_id, step, truth, a*pred+b AS p, sd FROM w JOIN lag USING (series_id, step) JOIN spread USING (series_id, step))
        SELECT series_id, step, round(any_value(sd),5)+0.0 AS sd, {_BY_SERIES} FROM f GROUP BY 1, 2""",
)
def forecast_direct_per_series(spark, folder):
    """A regression of each series' own, here on one lag, and the spread of each step from the same sums."""
    shape = gram.Shape(1, 12, normalised=False)
    made = evaluate.per_series_forecasts(user_hourly(spark, folder), KEY, "v", "test", SPEC, shape, penalty=0.0)
    p, t = F.col("pred"), F.col("true")
    return made.groupBy("series_id", "step").agg(
        r(F.max("sd"), 5).alias("sd"), r(metrics.mae(p, t), 5).alias("mae"), r(metrics.mse(p, t), 5).alias("mse")
    )


PENALTIES = (0.0, 100.0, 3_000.0, 100_000.0, 1_000_000.0)


@query(
    "select_ridge",
    f"""WITH {sql.USERS}, {sql.SCALED}, {sql.steps('train', 1, 12, name='tr')}, {sql.steps('val', 1, 12, name='va')}, {sql.steps('test', 1, 12)},
        sums AS (SELECT step, count(*) AS n, sum(pred) AS sx, sum(truth) AS sy, sum(pred*pred) AS sxx, sum(pred*truth) AS sxy FROM tr GROUP BY 1),
        m AS (SELECT penalty, step, (sxy-sx*sy/n)/(sxx-sx*sx/n+penalty) AS a, sx/n AS mx, sy/n AS my
              FROM sums, (SELECT unnest({list(PENALTIES)}) AS penalty)),
        loss AS (SELECT penalty, avg(pow(truth-my-a*(pred-mx),2)) AS val_loss FROM va JOIN m USING (step) GROUP BY 1),
        best AS (SELECT * FROM loss ORDER BY val_loss, penalty DESC LIMIT 1),
        w2 AS (SELECT b.penalty, b.val_loss, w.truth, my+a*(w.pred-mx) AS pred FROM w JOIN m USING (step) JOIN best b ON b.penalty=m.penalty)
        SELECT penalty::DOUBLE AS penalty, round(any_value(val_loss),6)+0.0 AS val_loss, {_ALL} FROM w2 GROUP BY 1""",
)
def select_ridge(spark, folder):
    """Pooled regressions of five penalties from one set of sums; the best on the validation sums is tested."""
    chosen = evaluate.select_ridge(user_hourly(spark, folder), KEY, ["v"], replace(SPEC, context=1, label=0), PENALTIES, normalised=False)
    return chosen.select("penalty", r("val_loss").alias("val_loss"), *[r(m, 4).alias(m) for m in FIVE])


_MEAN_LAST = "avg(pred) OVER (PARTITION BY series_id, window_id, step)"


@query(
    "score_multichannel",
    f"""WITH {sql.HOURLY_LONG}, {sql.SCALED}, {sql.steps('test', 24, 12)},
        placed AS (SELECT w.*, w.window_id+{sql.bounds('test', 24, 'k.')[0]}+23+w.step AS rn FROM w, (SELECT any_value(n) AS n FROM hourly) k),
        f AS (SELECT channel, step, window_id, truth, {_MEAN_LAST} + 0.5*(hour(h.date)/23.0-0.5) AS p FROM placed JOIN (SELECT rn, date FROM hourly) h USING (rn))
        SELECT channel, step, round(avg(p),5)+0.0 AS mean, round(avg(abs(p-truth)),5)+0.0 AS mae, round(avg((p-truth)*(p-truth)),5)+0.0 AS mse
        FROM f GROUP BY 1, 2""",
)
def score_multichannel(spark, folder):
    """A user's model: the channels' mean at the end of the decoder's label, plus half the hour of the step."""

    def model(x: np.ndarray, x_mark: np.ndarray, dec: np.ndarray, y_mark: np.ndarray) -> np.ndarray:
        level = dec[:, SPEC.label - 1].mean(axis=1)[:, None, None]
        hours = 0.5 * y_mark[:, SPEC.label :, :1]
        return np.broadcast_to(level + hours, (len(x), SPEC.horizon, x.shape[2]))

    made = evaluate.model_forecasts(hourly_wide(spark, folder), KEY, EVENT_TYPES, "test", SPEC, model, ts="date")
    p, t = F.col("pred"), F.col("true")
    return made.groupBy("channel", "step").agg(
        r(F.avg(p), 5).alias("mean"), r(metrics.mae(p, t), 5).alias("mae"), r(metrics.mse(p, t), 5).alias("mse")
    )


_HOUR = "(hour(date)/23.0-0.5)::DOUBLE"


@query(
    "forecast_with_marks",
    f"""WITH RECURSIVE {sql.USERS}, {sql.SCALED}, marked AS (SELECT series_id, rn, n, v, {_HOUR} AS m FROM sc),
        pairs AS (SELECT a.series_id, a.v AS x, b.m, b.v AS y FROM marked a JOIN marked b ON a.series_id=b.series_id AND b.rn=a.rn+1
                  WHERE b.rn < {sql.NT.replace('n*', 'a.n*')}),
        c AS (SELECT series_id, var_pop(x) AS xx, var_pop(m) AS mm, covar_pop(x,m) AS xm, covar_pop(x,y) AS xy, covar_pop(m,y) AS my,
              avg(x) AS ax, avg(m) AS am, avg(y) AS ay FROM pairs GROUP BY 1),
        ag AS (SELECT *, CASE WHEN xx*mm-xm*xm > 1e-12 THEN (xy*mm-my*xm)/(xx*mm-xm*xm) ELSE 0 END AS a,
               CASE WHEN xx*mm-xm*xm > 1e-12 THEN (my*xx-xy*xm)/(xx*mm-xm*xm) WHEN mm > 1e-12 THEN my/mm ELSE 0 END AS g FROM c),
        f AS (SELECT o.series_id, o.rn, 0 AS step, o.v AS pred FROM marked o
              WHERE o.rn-23 >= {sql.bounds('test', 24, 'o.')[0]} AND o.rn+12 < o.n
              UNION ALL
              SELECT f.series_id, f.rn, f.step+1, ag.a*f.pred + ag.g*t.m + ag.ay-ag.a*ag.ax-ag.g*ag.am
              FROM f JOIN ag USING (series_id) JOIN marked t ON t.series_id=f.series_id AND t.rn=f.rn+f.step+1 WHERE f.step < 12),
        w AS (SELECT f.series_id, f.step, f.pred AS p, t.v AS truth FROM f JOIN marked t ON t.series_id=f.series_id AND t.rn=f.rn+f.step WHERE f.step > 0)
        SELECT series_id, step, {_BY_SERIES} FROM w GROUP BY 1, 2""",
)
def forecast_with_marks(spark, folder):
    """AR(1) with the hour of the day, per series, rolled out over the true hours ahead."""
    return _score(evaluate.marked_forecasts(user_hourly(spark, folder), KEY, "v", "test", SPEC, "date"))
