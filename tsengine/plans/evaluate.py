"""Score forecasters on the standardised values of a split."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from tsengine.functions.numeric import array_mean
from tsengine.operators import chunks, forecasts, gram, metrics, model_calls, ridge, scaling, windows
from tsengine.plans.prepare import Spec, split_arrays, split_chunks, split_windows


def last_value_forecasts(
    panel: DataFrame, keys: Sequence[str], channels: Sequence[str], split: str, spec: Spec, stats: DataFrame | None = None
) -> DataFrame:
    """Long forecasts (keys, channel, window_id, step, pred, true) of the last-value rule."""
    indexed = split_windows(panel, keys, channels, split, spec, stats=stats).drop("n", "first")
    return forecasts.last_value(indexed, spec.context, spec.horizon)


def evaluate_last_value(
    panel: DataFrame,
    keys: Sequence[str],
    channels: Sequence[str],
    spec: Spec,
    split: str = "test",
    by: Sequence[str] = (),
    zero: str = "inf",
) -> DataFrame:
    """The five metrics of the last-value rule on one split."""
    return metrics.bundle(last_value_forecasts(panel, keys, channels, split, spec), by, zero=zero)


def align(pred: DataFrame, true: DataFrame, on: Sequence[str]) -> DataFrame:
    """Match forecasts with truths by their identity, never by position."""
    return pred.join(true, list(on))


def candidate_rules(context: int, period: int) -> tuple[dict[str, Column], dict[str, Column]]:
    """Closed-form rules to choose from, and what they need per window."""
    rules = {
        "last": windows.at(context),
        "mean": F.col("_mean"),
        "seasonal": forecasts.seasonal_value(context, period),
    }
    return rules, {"_mean": forecasts.context_mean(context)}


def select_forecaster(
    panel: DataFrame, keys: Sequence[str], channels: Sequence[str], spec: Spec, period: int
) -> DataFrame:
    """The rule with the lowest validation loss, with its test metrics; one row.

    All rules are scored in one pass over each split.
    """
    rules, per_window = candidate_rules(spec.context, period)
    stats = scaling.fit(panel, keys, channels, spec.train) if spec.scale else None

    def scored(split: str) -> DataFrame:
        indexed = split_windows(panel, keys, channels, split, spec, stats=stats).drop("n", "first")
        return forecasts.closed_form(indexed, spec.context, spec.horizon, rules, before_steps=per_window)

    batched = scored("val").withColumn("batch_id", windows.batch_id(spec.batch))
    losses = metrics.batch_mean_loss(batched, ["candidate"], [*keys, "batch_id"])
    best = losses.agg(F.min_by("candidate", F.struct("loss", "candidate")).alias("candidate"), F.min("loss").alias("val_loss"))
    tested = metrics.bundle(scored("test"), ["candidate"])
    return tested.join(F.broadcast(best), "candidate")  # best is one row by construction


def _with_facts(
    panel: DataFrame, keys: Sequence[str], channel: str, split: str, spec: Spec, stats: DataFrame | None, facts: DataFrame
) -> DataFrame:
    """Windows of a split with per-series facts attached chunk by chunk."""
    arrays = split_chunks(panel, keys, [channel], split, spec, stats=stats)
    joined = chunks.join_facts(arrays, facts, keys, spec.size)
    return windows.starts(joined, spec.length, spec.size, first="first")


def _linear(indexed: DataFrame, keys: Sequence[str], spec: Spec) -> DataFrame:
    """Forecast slope[h] * last value + intercept[h] for every step h."""
    pick = lambda c: F.element_at(c, F.col("step"))
    return windows.steps(indexed, spec.horizon).select(
        *keys, "channel", "window_id", "step",
        (pick("slope") * windows.at(spec.context) + pick("intercept")).alias("pred"),
        windows.at(spec.context, ahead=F.col("step")).alias("true"),
    )


def ar1_forecasts(panel: DataFrame, keys: Sequence[str], channel: str, split: str, spec: Spec) -> DataFrame:
    """AR(1) per series, fitted on its training rows, rolled out over each window of ``split``."""
    stats = scaling.fit(panel, keys, [channel], spec.train) if spec.scale else None
    pair = replace(spec, context=1, label=0, horizon=1)
    fitted = forecasts.ar1_fit(split_windows(panel, keys, [channel], "train", pair, stats=stats), keys)
    path = forecasts.roll_out(fitted, keys, spec.horizon)
    return _linear(_with_facts(panel, keys, channel, split, spec, stats, path), keys, spec)


def lag_forecasts(panel: DataFrame, keys: Sequence[str], channel: str, split: str, spec: Spec) -> DataFrame:
    """Direct one-lag forecasts: each step has its own coefficients per series."""
    stats = scaling.fit(panel, keys, [channel], spec.train) if spec.scale else None
    ahead = replace(spec, context=1, label=0)
    fitted = forecasts.lag_fit(split_windows(panel, keys, [channel], "train", ahead, stats=stats), keys, spec.horizon)
    arrays = forecasts.by_step(fitted, keys, ["slope", "intercept"], spec.horizon)
    return _linear(_with_facts(panel, keys, channel, split, spec, stats, arrays), keys, spec)


def last_value_with_sigma(panel: DataFrame, keys: Sequence[str], channel: str, split: str, spec: Spec) -> DataFrame:
    """Last-value forecasts with a standard deviation per series and step, learnt on train windows."""
    stats = scaling.fit(panel, keys, [channel], spec.train) if spec.scale else None
    seen = split_windows(panel, keys, [channel], "train", spec, stats=stats).drop("first")
    learnt = forecasts.residual_sigma(forecasts.last_value(seen, spec.context, spec.horizon), keys)
    arrays = forecasts.by_step(learnt, keys, ["sigma"], spec.horizon)
    indexed = _with_facts(panel, keys, channel, split, spec, stats, arrays)
    stepped = windows.steps(indexed, spec.horizon)
    return stepped.select(
        *keys, "channel", "window_id", "step",
        windows.at(spec.context).alias("mu"),
        F.element_at("sigma", F.col("step")).alias("sigma"),
        windows.at(spec.context, ahead=F.col("step")).alias("true"),
    )


def trend_season_forecasts(
    panel: DataFrame, keys: Sequence[str], channel: str, split: str, spec: Spec, period: int, width: int = 25
) -> DataFrame:
    """Forecast as trend + season: the level of the last ``width`` // 2 + 1 context values, and
    the learnt season of each future row's phase. The two parts are given as well.
    """
    stats = scaling.fit(panel, keys, [channel], spec.train) if spec.scale else None
    scaled = scaling.apply(panel, stats, keys, [channel], spec.size) if spec.scale else panel
    learnt = forecasts.seasons(scaled, keys, channel, period, width, spec.train, spec.size)
    indexed = _with_facts(panel, keys, channel, split, spec, stats, learnt)
    recent = width // 2 + 1
    level = indexed.withColumn("trend", array_mean(windows.piece("v", spec.context - recent, recent)))
    stepped = windows.steps(level, spec.horizon)
    phase = (F.col("start") + (spec.context - 1) + F.col("step")) % period
    season = F.element_at("season", (phase + 1).cast("int"))
    return stepped.select(
        *keys, "channel", "window_id", "step", "trend", season.alias("season"),
        (F.col("trend") + season).alias("pred"),
        windows.at(spec.context, ahead=F.col("step")).alias("true"),
    )


def per_series_forecasts(
    panel: DataFrame, keys: Sequence[str], channel: str, split: str, spec: Spec, shape: gram.Shape, penalty: float = 1.0
) -> DataFrame:
    """Direct forecasts by a regression of each series' own, with the spread of each step as ``sd``."""
    stats = scaling.fit(panel, keys, [channel], spec.train) if spec.scale else None
    own = replace(spec, context=shape.context, label=0, horizon=shape.horizon)
    train = split_chunks(panel, keys, [channel], "train", own, stats=stats)
    models = gram.fitted(gram.sums(train, shape, [*keys, "n"], size=spec.size), [*keys, "n"], shape, penalty)
    seen = split_chunks(panel, keys, [channel], split, spec, stats=stats)
    return gram.by_step(gram.forecast(seen, models, keys, shape, context=spec.context, keep=["channel"], size=spec.size))


def marked_forecasts(
    panel: DataFrame, keys: Sequence[str], channel: str, split: str, spec: Spec, ts: str, lags: int = 1, marks: int = 1, penalty: float = 0.0
) -> DataFrame:
    """A one-step model on ``lags`` values and the next row's first ``marks`` time marks, fitted per
    series and rolled out over each window with the true marks of the steps ahead.
    """
    stats = scaling.fit(panel, keys, [channel], spec.train) if spec.scale else None
    shape = gram.Shape(lags, 1, marks, normalised=False)
    train = split_chunks(panel, keys, [channel], "train", replace(spec, context=lags, label=0, horizon=1), ts, stats)
    models = gram.fitted(gram.sums(train, shape, [*keys, "n"], size=spec.size), [*keys, "n"], shape, penalty)
    seen = split_chunks(panel, keys, [channel], split, spec, ts, stats)
    made = gram.forecast(seen, models, keys, shape, spec.horizon, spec.context, ["channel"], size=spec.size)
    return gram.by_step(made)


def select_ridge(
    panel: DataFrame,
    keys: Sequence[str],
    channels: Sequence[str],
    spec: Spec,
    penalties: Sequence[float],
    normalised: bool = True,
) -> DataFrame:
    """The pooled regression whose penalty has the least mean squared validation error; one row.

    ``penalty``, ``val_loss`` and the test metrics. The training windows are read once and
    the validation windows once, whatever the number of penalties.
    """
    stats = scaling.fit(panel, keys, channels, spec.train) if spec.scale else None
    shape = gram.Shape(spec.context, spec.horizon, normalised=normalised)

    def learnt(split: str, original: bool) -> gram.Sums:
        parts = split_chunks(panel, keys, channels, split, spec, stats=stats)
        return gram.collected(gram.sums(parts, shape, original=original, size=spec.size), shape)

    best = gram.choose(learnt("train", False), learnt("val", True), penalties)
    model = ridge.Ridge(spec.context, spec.horizon, best.weights, best.intercept, normalised)
    test = split_chunks(panel, keys, channels, "test", spec, stats=stats)
    tested = metrics.bundle(model.transform(test, [*keys, "channel"], first="first", size=spec.size))
    return tested.select(F.lit(float(best.penalty)).alias("penalty"), F.lit(best.loss).alias("val_loss"), *tested.columns)


def model_forecasts(
    panel: DataFrame,
    keys: Sequence[str],
    channels: Sequence[str],
    split: str,
    spec: Spec,
    model: model_calls.Model,
    ts: str | None = None,
    outputs: Sequence[str] | None = None,
) -> DataFrame:
    """Long forecasts of a user's model that sees all channels, time marks and the decoder's input."""
    stats = scaling.fit(panel, keys, channels, spec.train) if spec.scale else None
    arrays = split_arrays(panel, keys, channels, split, spec, ts, stats)
    scored = model_calls.score_windows(
        arrays, model, channels, spec.context, spec.label, spec.horizon, keys, "marks" if ts else None, outputs, size=spec.size
    )
    return model_calls.unpack(scored, outputs or channels)
