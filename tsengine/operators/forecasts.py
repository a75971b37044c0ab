"""Simple forecasters over chunked windows.

Closed-form ones are plain expressions on the chunk arrays. Statistics per
series are one aggregation and travel back one row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from tsengine.functions.numeric import array_mean
from tsengine.functions.permutation import uniform
from tsengine.operators.chunks import SIZE, is_home, join_facts, with_halo
from tsengine.operators.splits import part_sizes
from tsengine.operators.windows import at, piece, steps


def last_value(windows: DataFrame, context: int, horizon: int, value: str = "v") -> DataFrame:
    """Repeat the last context value; one row per window and step with ``pred`` and ``true``."""
    return closed_form(windows, context, horizon, {"last": at(context, value)}, value).drop("candidate")


def seasonal_value(context: int, period: int, value: str = "v") -> Column:
    """The value one or more whole periods before the forecast step, inside the context."""
    back = F.col("step") - F.ceil(F.col("step") / period) * period
    return at(context, value, back)


def context_mean(context: int, value: str = "v") -> Column:
    """Mean of the context; evaluate it before exploding steps."""
    return array_mean(piece(value, 0, context))


def closed_form(
    windows: DataFrame,
    context: int,
    horizon: int,
    candidates: dict[str, Column],
    value: str = "v",
    before_steps: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per window, step and candidate expression.

    Expressions may use ``step``; those in ``before_steps`` are evaluated once
    per window. No array leaves the stage it was read in.
    """
    prepared = windows.withColumns(before_steps) if before_steps else windows
    stepped = steps(prepared, horizon)
    rest = [c for c in windows.columns if c not in (value, "base", "chunk", "start")]
    each = F.array(*[F.struct(F.lit(k).alias("candidate"), c.alias("pred")) for k, c in candidates.items()])
    return stepped.select(*rest, "step", at(context, value, F.col("step")).alias("true"), F.inline(each))


def ar1_fit(windows: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Per series least squares v[t+1] = slope * v[t] + intercept.

    ``windows`` are made with context 1 and horizon 1 and carry ``n``. A constant
    series gets slope 0 and its own level.
    """
    x, y = at(1, value, 0), at(1, value, 1)
    fitted = windows.select(*keys, "n", x.alias("x"), y.alias("y")).groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.avg("y").alias("level"),
    )
    return fitted.select(
        *keys,
        "n",
        F.coalesce("slope", F.lit(0.0)).alias("slope"),
        F.coalesce("intercept", "level").alias("intercept"),
    )


def roll_out(fitted: DataFrame, keys: Sequence[str], horizon: int) -> DataFrame:
    """Recursive AR(1): arrays ``slope`` and ``intercept`` for the steps 1..horizon.

    Predict, append, repeat is linear in the last value, so the recursion runs
    once per series and not once per window.
    """
    a, b = F.col("slope"), F.col("intercept")

    def extend(known: Column, _: Column) -> Column:
        last = F.element_at(known, -1)
        following = F.struct((last["a"] * a).alias("a"), (last["b"] * a + b).alias("b"))
        return F.concat(known, F.array(following))

    start = F.array(F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")))
    path = F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, extend), 2, horizon)
    return fitted.withColumn("_path", path).select(
        *keys, "n", F.col("_path")["a"].alias("slope"), F.col("_path")["b"].alias("intercept")
    )


def lag_fit(windows: DataFrame, keys: Sequence[str], horizon: int, value: str = "v") -> DataFrame:
    """Direct one-lag model: for every series and step h, v[t+h] on v[t].

    One aggregation over (series, step), combined before the shuffle.
    """
    pairs = steps(windows, horizon).select(
        *keys, "n", "step", at(1, value, 0).alias("x"), at(1, value, F.col("step")).alias("y")
    )
    fitted = pairs.groupBy(*keys, "step").agg(
        F.max("n").alias("n"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.avg("y").alias("level"),
    )
    return fitted.select(
        *keys,
        "n",
        "step",
        F.coalesce("slope", F.lit(0.0)).alias("slope"),
        F.coalesce("intercept", "level").alias("intercept"),
    )


def by_step(facts: DataFrame, keys: Sequence[str], columns: Sequence[str], horizon: int) -> DataFrame:
    """Gather per-step facts into arrays of ``horizon`` elements, one row per series."""
    gathered = F.sort_array(F.collect_list(F.struct("step", *columns)))
    return (
        facts.filter(F.col("step") <= horizon)
        .groupBy(*keys)
        .agg(F.max("n").alias("n"), gathered.alias("_facts"))
        .select(*keys, "n", *[F.col("_facts")[c].alias(c) for c in columns])
    )


def residual_sigma(forecasts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Root mean squared residual per series and step; positive unless the fit is exact."""
    e = F.col("true") - F.col("pred")
    return forecasts.groupBy(*keys, "step").agg(F.max("n").alias("n"), F.sqrt(F.avg(e * e)).alias("sigma"))


def trend(
    df: DataFrame, keys: Sequence[str], value: str, width: int = 25, size: int = SIZE, constant: Sequence[str] = ("n",)
) -> DataFrame:
    """Centred moving average, shortened at the ends of the series; keeps ``chunk``."""
    if width % 2 == 0:
        raise ValueError("width must be odd")
    half = width // 2
    haloed = with_halo(df.select(*keys, "rn", *constant, value), size, half, half)
    frame = Window.partitionBy(*keys, "chunk").orderBy("rn").rowsBetween(-half, half)
    return haloed.withColumn("trend", F.avg(value).over(frame)).filter(is_home(size))


def seasons(
    df: DataFrame, keys: Sequence[str], value: str, period: int, width: int = 25, train: float = 0.7, size: int = SIZE
) -> DataFrame:
    """Per series: array ``season`` of ``period`` mean detrended values, learnt on the training rows.

    A phase that never occurs there has 0.
    """
    trended = trend(df, keys, value, width, size)
    n_train, _, _ = part_sizes(F.col("n"), train)
    phases = (
        trended.filter(F.col("rn") < n_train)
        .groupBy(*keys, (F.col("rn") % period).alias("phase"))
        .agg(F.avg(F.col(value) - F.col("trend")).alias("mean"), F.max("n").alias("n"))
    )
    cells = [F.coalesce(F.max(F.when(F.col("phase") == i, F.col("mean"))), F.lit(0.0)) for i in range(period)]
    return phases.groupBy(*keys).agg(F.max("n").alias("n"), F.array(*cells).alias("season"))


def trend_season(
    df: DataFrame, keys: Sequence[str], value: str, period: int, width: int = 25, train: float = 0.7, size: int = SIZE
) -> DataFrame:
    """Additive parts of every row: trend, season of its phase, rest.

    The season goes to the rows as one array per chunk.
    """
    learnt = seasons(df, keys, value, period, width, train, size).withColumnRenamed("season", "_season")
    joined = join_facts(trend(df, keys, value, width, size), learnt, keys, size)
    season = F.element_at("_season", (F.col("rn") % period + 1).cast("int"))
    return joined.select(
        *keys,
        "rn",
        value,
        "trend",
        season.alias("season"),
        (F.col(value) - F.col("trend") - season).alias("rest"),
    )


def sample_paths(forecasts: DataFrame, keys: Sequence[str], draws: int, seed: int, mu: str = "mu", logvar: str = "logvar") -> DataFrame:
    """``draws`` samples of N(mu, exp(logvar)) per row.

    Each draw is an MD5 digest of seed, keys and draw number turned into a normal variate,
    so a recomputed task, and any other engine, gives the same sample; a seeded generator
    depends on how rows happen to be partitioned.
    """
    # Forecasts often come as slices of a few small partitions, and a draw costs far more than its row.
    tasks = int(forecasts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = reduce(or_, [F.col(k).isNotNull() for k in keys], F.lit(False))
    spread = forecasts.repartition(tasks, *keys).withColumn("_ids", F.when(known, F.concat_ws(":", *[F.col(k).cast("string") for k in keys])))
    drawn = spread.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    first, second = (uniform(F.lit(seed), F.lit(salt), F.col("_ids"), F.col("draw")) for salt in (1, 2))
    normal = F.sqrt(F.ln(first) * -2.0) * F.cos(second * F.lit(2.0) * F.pi())
    return drawn.withColumn("sample", F.col(mu) + normal * F.exp(F.col(logvar) / 2)).drop("_ids")
