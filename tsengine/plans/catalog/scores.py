"""Queries on metrics and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsengine.operators import metrics, training_log, windows
from tsengine.plans import evaluate
from tsengine.plans.catalog import fragments as sql
from tsengine.plans.catalog.registry import query, r
from tsengine.plans.catalog.windowed import SPEC
from tsengine.plans.tables import EVENT_TYPES, KEY, hourly_wide, loss_log, table, user_hourly, vectors

_W = f"WITH {sql.USERS}, {sql.SCALED}, {sql.steps('test', 24, 12)}"
_H = f"WITH {sql.HOURLY_LONG}, {sql.SCALED}, {sql.steps('test', 24, 12)}"
FIVE = ["mae", "mse", "rmse", "mape", "mspe"]
_REL = "CASE WHEN truth=0 THEN CASE WHEN pred=0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END ELSE abs((pred-truth)/truth) END"
_SQL = {
    "mae": "avg(abs(pred-truth))",
    "mse": "avg((pred-truth)*(pred-truth))",
    "rmse": "sqrt(avg((pred-truth)*(pred-truth)))",
    "mape": f"avg({_REL})",
    "mspe": f"avg(pow({_REL},2))",
    "rse": "sqrt(sum((pred-truth)*(pred-truth)))/sqrt(var_pop(truth)*count(*))",
}
_ALL = ", ".join(f"round({_SQL[m]},4)+0.0 AS {m}" for m in FIVE)


def naive(spark, folder, split="test"):
    return evaluate.last_value_forecasts(user_hourly(spark, folder), KEY, ["v"], split, SPEC)


def naive_wide(spark, folder, split="test"):
    return evaluate.last_value_forecasts(hourly_wide(spark, folder), KEY, EVENT_TYPES, split, SPEC)


def _metric(name):
    def run(spark, folder):
        value = getattr(metrics, name)(F.col("pred"), F.col("true"))
        return naive(spark, folder).groupBy("series_id").agg(r(value, 4).alias(name))

    return run


for _name in [*FIVE, "rse"]:
    query(f"metric_{_name}", f"{_W} SELECT series_id, round({_SQL[_name]},4)+0.0 AS {_name} FROM w GROUP BY 1")(_metric(_name))


@query(
    "metric_corr",
    f"""{_H}, m AS (SELECT *, avg(pred) OVER (PARTITION BY step, channel) AS mp, avg(truth) OVER (PARTITION BY step, channel) AS mt FROM w),
        c AS (SELECT step, channel, sum((truth-mt)*(pred-mp)) / sqrt(sum(pow(truth-mt,2)*pow(pred-mp,2))) AS u FROM m GROUP BY 1, 2)
        SELECT step, round(avg(u),5)+0.0 AS corr FROM c GROUP BY 1""",
)
def metric_corr(spark, folder):
    return metrics.corr_by_step(naive_wide(spark, folder)).select("step", r("corr", 5).alias("corr"))


@query("metric_bundle", f"{_H} SELECT channel, {_ALL} FROM w GROUP BY 1")
def metric_bundle(spark, folder):
    return metrics.bundle(naive_wide(spark, folder), ["channel"]).select("channel", *[r(m, 4).alias(m) for m in FIVE])


@query("metric_bundle_rollup", f"{_H} SELECT channel, step, {_ALL} FROM w GROUP BY ROLLUP (channel, step)")
def metric_bundle_rollup(spark, folder):
    rolled = metrics.bundle(naive_wide(spark, folder), ["channel", "step"], rollup=True)
    return rolled.select("channel", "step", *[r(m, 4).alias(m) for m in FIVE])


@query(
    "metric_zero_truth",
    f"""WITH {sql.USERS}, {sql.steps('test', 24, 12, 'plong')}
        SELECT series_id, round(avg(CASE WHEN truth<>0 THEN abs((pred-truth)/truth) END),4)+0.0 AS mape,
               round(avg(CASE WHEN truth<>0 THEN pow((pred-truth)/truth,2) END),4)+0.0 AS mspe FROM w GROUP BY 1""",
)
def metric_zero_truth(spark, folder):
    """Unscaled values have many zeros; here they are left out."""
    spec = evaluate.Spec(context=24, label=12, horizon=12, scale=False)
    raw = evaluate.last_value_forecasts(user_hourly(spark, folder), KEY, ["v"], "test", spec)
    return metrics.bundle(raw, ["series_id"], zero="skip").select("series_id", r("mape", 4).alias("mape"), r("mspe", 4).alias("mspe"))


@query(
    "batch_mean_loss",
    f"""WITH {sql.USERS}, {sql.SCALED}, {sql.steps('val', 24, 12)},
        b AS (SELECT series_id, window_id//32 AS batch, avg((pred-truth)*(pred-truth)) AS l FROM w GROUP BY 1, 2)
        SELECT series_id, round(avg(l),5)+0.0 AS loss FROM b GROUP BY 1""",
)
def batch_mean_loss(spark, folder):
    batched = naive(spark, folder, "val").withColumn("batch_id", windows.batch_id(SPEC.batch))
    return metrics.batch_mean_loss(batched, ["series_id"]).select("series_id", r("loss", 5).alias("loss"))


@query(
    "accuracy",
    "SELECT user_id AS series_id, round(avg(((value>10) = (event_type='error'))::INT),6)+0.0 AS accuracy FROM events GROUP BY 1",
)
def accuracy(spark, folder):
    events = table(spark, folder, "events")
    pred, truth = (F.col("event_type") == "error").cast("int"), (F.col("value") > 10).cast("int")
    return events.groupBy(F.col("user_id").alias("series_id")).agg(r(metrics.accuracy(pred, truth)).alias("accuracy"))


_NORMAL = "(SELECT user_id AS series_id, value AS y, event_id%7 AS mu, 1+event_id%3 AS sigma FROM events)"


@query(
    "gaussian_nll",
    f"SELECT series_id, round(avg(ln(sigma)+0.5*pow((y-mu)/sigma,2)),5)+0.0 AS nll, "
    f"round(-2*avg(ln(sigma)+0.5*pow((y-mu)/sigma,2)),5)+0.0 AS negated FROM {_NORMAL} GROUP BY 1",
)
def gaussian_nll(spark, folder):
    y, mu, sigma = F.col("value"), (F.col("event_id") % 7).cast("double"), (F.col("event_id") % 3 + 1).cast("double")
    return table(spark, folder, "events").groupBy(F.col("user_id").alias("series_id")).agg(
        r(metrics.gaussian_nll(y, mu, sigma), 5).alias("nll"),
        r(metrics.gaussian_nll(y, mu, sigma, alpha=2.0, reference_sign=True), 5).alias("negated"),
    )


@query("recon_sse", f"{_W} SELECT series_id, round(sum((pred-truth)*(pred-truth)),3)+0.0 AS sse FROM w GROUP BY 1")
def recon_sse(spark, folder):
    sse = metrics.recon_sse(F.col("pred"), F.col("true"))
    return naive(spark, folder).groupBy("series_id").agg(r(sse, 3).alias("sse"))


@query(
    "kl_gaussian",
    """WITH z AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS m, generate_subscripts(embedding,1) AS j FROM embeddings),
       p AS (SELECT a.label, a.m AS mu, b.m AS lv FROM z a JOIN z b ON a.vec_id=b.vec_id AND b.j=65-a.j)
       SELECT label, round(-0.5*sum(1+lv-mu*mu-exp(lv)),4)+0.0 AS kl FROM p GROUP BY 1""",
)
def kl_gaussian(spark, folder):
    return latents(spark, folder).groupBy("label").agg(r(metrics.kl_gaussian(F.col("z_mu"), F.col("z_logvar")), 4).alias("kl"))


def latents(spark, folder):
    """Embeddings as latent means; the reversed vector serves as log variances."""
    pairs = F.arrays_zip(F.col("x").alias("m"), F.reverse("x").alias("lv"))
    flat = vectors(spark, folder).select("label", F.explode(pairs).alias("z"))
    return flat.select("label", F.col("z")["m"].alias("z_mu"), F.col("z")["lv"].alias("z_logvar"))


@query(
    "combined_loss",
    f"""{_H}, z AS (SELECT vec_id, unnest(embedding)::DOUBLE AS m, generate_subscripts(embedding,1) AS j FROM embeddings),
        p AS (SELECT a.m AS mu, b.m AS lv FROM z a JOIN z b ON a.vec_id=b.vec_id AND b.j=65-a.j),
        k AS (SELECT 0.5*(-0.5)*sum(1+lv-mu*mu-exp(lv)) AS kl FROM p),
        f AS (SELECT avg(ln(1.5)+0.5*pow((truth-pred)/1.5,2)) AS nll, sum((pred-truth)*(pred-truth)) AS sse FROM w)
        SELECT round(nll,5)+0.0 AS nll, round(sse,3)+0.0 AS sse, round(kl,3)+0.0 AS kl, round(nll+sse+kl,3)+0.0 AS loss FROM f, k""",
)
def combined_loss(spark, folder):
    made = naive_wide(spark, folder).withColumns({"mu": F.col("pred"), "sigma": F.lit(1.5)})
    loss = metrics.combined_loss(made, latents(spark, folder), beta=0.5)
    return loss.select(r("nll", 5).alias("nll"), r("sse", 3).alias("sse"), r("kl", 3).alias("kl"), r("loss", 3).alias("loss"))


@query(
    "epoch_loss",
    """SELECT user_id AS run_id, day(ts)::INT AS epoch, round(avg(value),8)+0.0 AS loss FROM events GROUP BY 1, 2""",
)
def epoch_loss(spark, folder):
    return training_log.epoch_loss(loss_log(spark, folder)).select("run_id", "epoch", r("loss", 8).alias("loss"))
