"""Forecast metrics and losses: each one aggregation with map-side partials."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tsengine.functions.numeric import safe_div

# Task code travels with the job, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def mae(p: Column, t: Column) -> Column:
    return F.avg(F.abs(p - t))


def mse(p: Column, t: Column) -> Column:
    return F.avg((p - t) * (p - t))


def rmse(p: Column, t: Column) -> Column:
    return F.sqrt(mse(p, t))


def _relative(p: Column, t: Column, zero: str) -> Column:
    if zero == "inf":
        return safe_div(p - t, t)
    if zero == "skip":
        return F.when(t != 0, (p - t) / F.when(t != 0, t))
    raise ValueError("zero must be 'inf' or 'skip'")


def mape(p: Column, t: Column, zero: str = "inf") -> Column:
    """Mean |error / truth|. A zero truth gives inf (NaN for 0/0), or is left out with ``skip``."""
    return F.avg(F.abs(_relative(p, t, zero)))


def mspe(p: Column, t: Column, zero: str = "inf") -> Column:
    r = _relative(p, t, zero)
    return F.avg(r * r)


def rse(p: Column, t: Column) -> Column:
    """Root of the squared error relative to the spread of the truth over all elements."""
    return safe_div(F.sqrt(F.sum((p - t) * (p - t))), F.sqrt(F.var_pop(t) * F.count(t)))


def accuracy(p: Column, t: Column) -> Column:
    return F.avg(F.when(p == t, 1.0).otherwise(0.0))


def _grouped(df: DataFrame, by: Sequence[str], rollup: bool):
    return df.rollup(*by) if rollup and by else df.groupBy(*by)


def bundle(
    df: DataFrame,
    by: Sequence[str] = (),
    pred: str = "pred",
    true: str = "true",
    zero: str = "inf",
    rollup: bool = False,
) -> DataFrame:
    """MAE, MSE, RMSE, MAPE and MSPE in one pass, per group or overall."""
    p, t = F.col(pred), F.col(true)
    return _grouped(df, by, rollup).agg(
        mae(p, t).alias("mae"),
        mse(p, t).alias("mse"),
        rmse(p, t).alias("rmse"),
        mape(p, t, zero).alias("mape"),
        mspe(p, t, zero).alias("mspe"),
    )


# Central co-moments of (truth, prediction) up to order (2, 2); ``n`` rows and two means go with them.
MOMENTS = ("m20", "m11", "m02", "m21", "m12", "m22")
PARTIAL = ("n", "t", "p", *MOMENTS)


def _moved(m, t, p) -> dict:
    """Moments of a group about a point; its own means lie ``t`` and ``p`` above that. Columns or arrays."""
    n, m20, m11, m02, m21, m12, m22 = (m[c] for c in ("n", *MOMENTS))
    return {
        "m20": m20 + n * t * t,
        "m11": m11 + n * t * p,
        "m02": m02 + n * p * p,
        "m21": m21 + p * m20 + t * m11 * 2 + n * t * t * p,
        "m12": m12 + t * m02 + p * m11 * 2 + n * t * p * p,
        "m22": m22 + p * m21 * 2 + t * m12 * 2 + p * p * m20 + t * t * m02 + t * p * m11 * 4 + n * t * t * p * p,
    }


def merge_moments(a: Column, b: Column) -> Column:
    """Co-moments of two groups together, from those about each group's own means."""
    n = a["n"] + b["n"]
    dt, dp = (b["t"] - a["t"]) / n, (b["p"] - a["p"]) / n
    left, right = _moved(a, dt * b["n"] * -1, dp * b["n"] * -1), _moved(b, dt * a["n"], dp * a["n"])
    means = [(a["t"] + dt * b["n"]).alias("t"), (a["p"] + dp * b["n"]).alias("p")]
    return F.struct(n.alias("n"), *means, *[(left[m] + right[m]).alias(m) for m in MOMENTS])


def _merged(column: str) -> Column:
    held = F.collect_list(column)
    return F.aggregate(F.slice(held, F.lit(2), F.size(held)), F.get(held, F.lit(0)), merge_moments)


def _gathered(parts: pd.DataFrame, cell: list[str]) -> pd.DataFrame:
    """The same for any number of groups in a frame; a single row is a group whose moments are 0."""
    if not cell:
        parts = parts.assign(_all=0)
    group = parts.groupby(cell or ["_all"], sort=False, dropna=False).ngroup().to_numpy()
    add = lambda v: np.bincount(group, v)
    n = add(parts["n"])
    t, p = add(parts["n"] * parts["t"]) / n, add(parts["n"] * parts["p"]) / n
    moved = _moved(parts, parts["t"] - t[group], parts["p"] - p[group])
    first = np.unique(group, return_index=True)[1]
    made = parts.iloc[first][cell].reset_index(drop=True)
    return made.assign(n=n, t=t, p=p, **{m: add(v) for m, v in moved.items()})


def co_moments(
    df: DataFrame, cell: Sequence[str], pred: str = "pred", true: str = "true", held: int = 100_000, fan_in: int = 64
) -> DataFrame:
    """One struct ``m`` of co-moments per cell; rows are read once and not shuffled.

    A task takes the moments of each batch about the batch's own means and merges them, so
    nothing cancels however far from zero the values lie. Only those partials are shuffled:
    one row per task and cell (more where a task has over ``held`` cells), merged in groups
    of tasks first. Rows without a value are left out.
    """
    names = list(cell)
    rows = df.select(*names, F.col(true).cast("double").alias("t"), F.col(pred).cast("double").alias("p")).filter(
        "t is not null and p is not null"
    )
    fields = [*rows.select(*names).schema.fields, *[StructField(c, DoubleType()) for c in PARTIAL]]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, count = [], 0
        for batch in filter(len, batches):
            kept.append(_gathered(batch.assign(n=1.0, **dict.fromkeys(MOMENTS, 0.0)), names))
            count += len(kept[-1])
            if count > held:
                kept = [_gathered(pd.concat(kept, ignore_index=True), names)]
                count = len(kept[0])
                if 2 * count > held:
                    yield kept[0]
                    kept, count = [], 0
        if kept:
            yield _gathered(pd.concat(kept, ignore_index=True), names)

    parts = rows.mapInPandas(partial, StructType(fields))
    shares = parts.select(*names, F.expr(f"spark_partition_id() div {fan_in}").alias("_share"), F.struct(*PARTIAL).alias("m"))
    made = shares.groupBy(*names, "_share").agg(_merged("m").alias("m"))
    return made.groupBy(*names).agg(_merged("m").alias("m"))


def corr_by_step(
    df: DataFrame,
    step: str = "step",
    channel: str = "channel",
    pred: str = "pred",
    true: str = "true",
    by: Sequence[str] = (),
) -> DataFrame:
    """Per step: mean over channels of sum(dt*dp) / sqrt(sum(dt^2 * dp^2)) over windows.

    This is not Pearson's coefficient. Both sums are co-moments of a cell.
    """
    cell = [*by, step, channel]
    moments = co_moments(df, cell, pred, true)
    per_channel = moments.select(*cell, safe_div(F.col("m")["m11"], F.sqrt(F.col("m")["m22"])).alias("_r"))
    return per_channel.groupBy(*by, step).agg(F.avg("_r").alias("corr"))


def batch_mean_loss(
    df: DataFrame, by: Sequence[str] = (), batch: Sequence[str] = ("batch_id",), pred: str = "pred", true: str = "true"
) -> DataFrame:
    """Unweighted mean of the batches' MSE: a short last batch weighs as much as a full one."""
    per_batch = df.groupBy(*by, *batch).agg(mse(F.col(pred), F.col(true)).alias("_loss"))
    return per_batch.groupBy(*by).agg(F.avg("_loss").alias("loss"))


def nll_term(t: Column, mu: Column, sigma: Column) -> Column:
    """ln(sigma) + half the squared standardised error, without the constant.

    ``sigma`` must be positive; NULL results for others rather than an error.
    """
    positive = F.when(sigma > 0, sigma)
    z = (t - mu) / positive
    return F.ln(positive) + z * z * 0.5


def gaussian_nll(
    t: Column, mu: Column, sigma: Column, alpha: float = 1.0, reference_sign: bool = False
) -> Column:
    """Mean of ``nll_term`` times ``alpha``; ``reference_sign`` negates it."""
    return F.avg(nll_term(t, mu, sigma)) * (-alpha if reference_sign else alpha)


def recon_sse(p: Column, t: Column) -> Column:
    """Sum of squared errors over the horizon."""
    return F.sum((p - t) * (p - t))


def kl_gaussian(mu: Column, logvar: Column, beta: float = 1.0) -> Column:
    """KL divergence of N(mu, exp(logvar)) from N(0, 1), summed, times ``beta``."""
    return F.sum(logvar - mu * mu - F.exp(logvar) + 1.0) * (-0.5 * beta)


def combined_loss(
    forecasts: DataFrame,
    latents: DataFrame,
    by: Sequence[str] = (),
    alpha: float = 1.0,
    beta: float = 1.0,
    reference_sign: bool = False,
) -> DataFrame:
    """Likelihood term + squared error + divergence, in one aggregation.

    ``forecasts`` has pred, true, mu, sigma; ``latents`` has z_mu, z_logvar. The
    two are stacked, so no join is needed; NULLs drop out of each aggregate.
    """
    rows = forecasts.select(*by, "pred", "true", "mu", "sigma").unionByName(
        latents.select(*by, "z_mu", "z_logvar"), allowMissingColumns=True
    )
    c = F.col
    return (
        rows.groupBy(*by)
        .agg(
            F.coalesce(gaussian_nll(c("true"), c("mu"), c("sigma"), alpha, reference_sign), F.lit(0.0)).alias("nll"),
            F.coalesce(recon_sse(c("pred"), c("true")), F.lit(0.0)).alias("sse"),
            F.coalesce(kl_gaussian(c("z_mu"), c("z_logvar"), beta), F.lit(0.0)).alias("kl"),
        )
        .withColumn("loss", F.col("nll") + F.col("sse") + F.col("kl"))
    )
