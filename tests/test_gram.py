"""Forecasters from cross products against plain numpy, and a user's model on all channels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsengine.operators import chunks, gram, model_calls

KEYS = ["series_id"]


@pytest.fixture(scope="module")
def walks():
    rng = np.random.default_rng(1)
    made = {f"s{k}": np.cumsum(rng.normal(size=n)) for k, n in enumerate([400, 60, 90, 7])}
    return made | {"flat": np.full(50, 3.0)}


@pytest.fixture(scope="module")
def hours(walks):
    rng = np.random.default_rng(2)
    return {k: rng.normal(size=(len(v), 2)) for k, v in walks.items()}


@pytest.fixture(scope="module")
def data(spark, walks, hours):
    rows = [(k, i, len(v), 0, float(x), hours[k][i].tolist()) for k, v in walks.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "series_id string, rn long, n long, first long, v double, marks array<double>")


def chunked(data, size, length):
    return chunks.chunked(data, KEYS, ["v", "marks"], size, after=length - 1, constant=["n", "first"])


def windows(v, length):
    return np.lib.stride_tricks.sliding_window_view(v, length) if len(v) >= length else np.empty((0, length))


def refit(x, y, penalty):
    """Ridge with a free intercept."""
    mx, my = x.mean(0), y.mean(0)
    w = np.linalg.lstsq((x - mx).T @ (x - mx) + penalty * np.eye(x.shape[1]), (x - mx).T @ (y - my), rcond=1e-10)[0]
    return w, my - mx @ w


@pytest.mark.parametrize("size", [32, 4096])
@pytest.mark.parametrize("normalised, penalty", [(False, 0.5), (False, 0.0), (True, 2.0)])
def test_per_series(data, walks, size, normalised, penalty):
    shape = gram.Shape(24, 5, normalised=normalised)
    parts = chunked(data, size, 29)
    models = gram.fitted(gram.sums(parts, shape, ["series_id", "n"], size=size), ["series_id", "n"], shape, penalty)
    got = {r["series_id"]: r for r in models.collect()}
    assert set(got) == {k for k, v in walks.items() if len(v) >= 29}
    forecasts = gram.forecast(parts, models, KEYS, shape, size=size)
    scored = {}
    for r in forecasts.collect():
        scored.setdefault(r["series_id"], {})[r["window_id"]] = (r["pred"], r["true"], r["sd"])
    for name, row in got.items():
        w = windows(walks[name], 29)
        x, y = w[:, :24], w[:, 24:]
        mean, scale = np.zeros((len(x), 1)), np.ones((len(x), 1))
        if normalised:
            mean, scale = x.mean(1, keepdims=True), np.sqrt(x.var(1, keepdims=True) + 1e-5)
        xs, ys = (x - mean) / scale, (y - mean) / scale
        weights, intercept = refit(xs, ys, penalty)
        fitted = xs @ weights + intercept
        assert row["windows"] == len(w) and len(scored[name]) == len(w)
        np.testing.assert_allclose(row["sigma"], np.sqrt(((ys - fitted) ** 2).mean(0)), atol=2e-5)
        np.testing.assert_allclose([scored[name][i][0] for i in range(len(w))], fitted * scale + mean, atol=1e-5)
        np.testing.assert_allclose([scored[name][i][1] for i in range(len(w))], y)
        np.testing.assert_allclose([scored[name][i][2] for i in range(len(w))], scale * np.array(row["sigma"]), atol=1e-9)


@pytest.mark.parametrize("normalised", [False, True])
def test_penalties_from_one_decomposition(data, walks, normalised):
    shape, penalties = gram.Shape(12, 4, normalised=normalised), [0.01, 1.0, 50.0, 4000.0]
    parts = chunked(data, 64, 16)
    train, validation = parts.filter("series_id != 's2'"), parts.filter("series_id = 's2'")
    sums = gram.collected(gram.sums(train, shape, size=64), shape)
    seen = gram.collected(gram.sums(validation, shape, original=True, size=64), shape)
    best = gram.choose(sums, seen, penalties)

    def scaled(w):
        x, y = w[:, :12], w[:, 12:]
        if not normalised:
            return x, y, 1.0
        mean, scale = x.mean(1, keepdims=True), np.sqrt(x.var(1, keepdims=True) + 1e-5)
        return (x - mean) / scale, (y - mean) / scale, scale

    x, y, _ = scaled(np.vstack([windows(v, 16) for k, v in walks.items() if k != "s2"]))
    vx, vy, scale = scaled(windows(walks["s2"], 16))
    losses = []
    for p, penalty in enumerate(penalties):
        w, b = refit(x, y, penalty)
        losses.append((((vy - vx @ w - b) * scale) ** 2).mean())
        solved = gram.solve(sums, penalty)
        np.testing.assert_allclose(x @ solved[0][0] + solved[1][0], x @ w + b, atol=1e-6)
    np.testing.assert_allclose(best.losses, losses, rtol=1e-6)
    assert best.penalty == penalties[int(np.argmin(losses))] and best.loss == min(best.losses)


def test_ties_go_to_the_larger_penalty():
    shape = gram.Shape(1, 1, normalised=False)
    nothing = gram.Sums.of(np.array([[4.0, 0.0, 0.0, 4.0, 0.0, 4.0, 4.0]]), shape)
    assert gram.choose(nothing, nothing, [1.0, 9.0, 3.0]).penalty == 9.0


def test_pooled_sums_are_the_series_sums(data):
    shape = gram.Shape(6, 2, normalised=False)
    parts = chunked(data, 32, 8).repartition(40)
    pooled = np.array(gram.sums(parts, shape, size=32).first()["sums"])
    each = np.array([r["sums"] for r in gram.sums(parts, shape, KEYS, size=32).collect()])
    np.testing.assert_allclose(each.sum(0), pooled, rtol=1e-9)
    assert gram.sums(parts.filter("false"), shape, KEYS).count() == 0
    with pytest.raises(ValueError, match="no window"):
        gram.collected(gram.sums(parts.filter("false"), shape), shape)


@pytest.mark.parametrize("lags, marks", [(1, 1), (3, 2)])
def test_marks_ahead(data, walks, hours, lags, marks):
    shape, size = gram.Shape(lags, 1, marks, normalised=False), 64
    models = gram.fitted(gram.sums(chunked(data, size, lags + 1), shape, ["series_id", "n"], size=size), ["series_id", "n"], shape, 0.3)
    fitted = {r["series_id"]: r for r in models.collect()}
    made = gram.forecast(chunked(data, size, 16), models, KEYS, shape, horizon=6, context=10, size=size)
    seen = 0
    for r in made.collect():
        v, m, model = walks[r["series_id"]], hours[r["series_id"]], fitted[r["series_id"]]
        w, start = np.array(model["weights"]), r["window_id"]
        known = list(v[start : start + 10])
        for h in range(6):
            known.append(np.array(known[-lags:]) @ w[:lags] + m[start + 10 + h, :marks] @ w[lags:] + model["intercept"][0])
        np.testing.assert_allclose(r["pred"], known[10:], atol=1e-8)
        np.testing.assert_allclose(r["true"], v[start + 10 : start + 16])
        seen += 1
    assert seen == sum(max(len(v) - 15, 0) for k, v in walks.items() if k in fitted)
    x = np.hstack([windows(walks["s0"], lags + 1)[:, :lags], hours["s0"][lags:, :marks]])
    w, b = refit(x, walks["s0"][lags:, None], 0.3)
    np.testing.assert_allclose(np.append(fitted["s0"]["weights"], fitted["s0"]["intercept"]), np.append(w, b), atol=1e-6)


def test_shapes_that_cannot_be():
    with pytest.raises(ValueError):
        gram.Shape(3, 2, marks=1, normalised=False)
    with pytest.raises(ValueError):
        gram.Shape(3, 1, marks=1)


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(5)
    values = {"a": rng.normal(size=(150, 3)), "b": rng.normal(size=(9, 3))}
    rows = [(k, i, len(v), 2, *map(float, x), [float(i), float(-i)]) for k, v in values.items() for i, x in enumerate(v) if i >= 2]
    df = spark.createDataFrame(rows, "series_id string, rn long, n long, first long, x double, y double, z double, marks array<double>")
    return values, df


@pytest.mark.parametrize("size", [16, 4096])
@pytest.mark.parametrize("outputs", [None, ["z"]])
def test_model_sees_all_channels_and_marks(matrix, size, outputs):
    values, df = matrix
    arrays = chunks.chunked(df, KEYS, ["x", "y", "z", "marks"], size, after=6, constant=["n", "first"])

    def model(x, x_mark, dec, y_mark):
        assert x.shape[1:] == (4, 3) and x_mark.shape[1:] == (4, 2) and dec.shape[1:] == (5, 3) and y_mark.shape[1:] == (5, 2)
        assert (dec[:, 2:] == 0).all() and (dec[:, :2] == x[:, 2:]).all() and (x_mark[:, 2:] == y_mark[:, :2]).all()
        width = 3 if outputs is None else 1
        return np.broadcast_to(x.sum(axis=(1, 2))[:, None, None] + y_mark[:, 2:, :1], (len(x), 3, width))

    scored = model_calls.score_windows(arrays, model, ["x", "y", "z"], 4, 2, 3, KEYS, "marks", outputs, size=size, block=7)
    got = {(r["series_id"], r["window_id"], r["step"], r["channel"]): (r["pred"], r["true"]) for r in model_calls.unpack(scored, outputs or ["x", "y", "z"]).collect()}
    want = {}
    for k, v in values.items():
        for s in range(2, len(v) - 6):
            for h in range(1, 4):
                for c, name in enumerate("xyz"):
                    if outputs is None or name in outputs:
                        want[k, s - 2, h, name] = (v[s : s + 4].sum() + s + 3 + h, v[s + 3 + h, c])
    assert got.keys() == want.keys()
    for key, pair in want.items():
        np.testing.assert_allclose(got[key], pair)


def test_model_without_marks_and_wrong_shapes(matrix):
    _, df = matrix
    arrays = chunks.chunked(df, KEYS, ["x", "y", "z"], 64, after=6, constant=["n", "first"])
    none = model_calls.score_windows(arrays, lambda x, m, d, n: d[:, 2:] if m is None and n is None else x, ["x", "y", "z"], 4, 2, 3, KEYS, size=64)
    assert none.select(F.sum(F.aggregate("pred", F.lit(0.0), lambda a, b: a + b))).first()[0] == 0
    with pytest.raises(Exception, match="shape"):
        model_calls.score_windows(arrays, lambda x, m, d, n: x, ["x", "y", "z"], 4, 2, 3, KEYS, size=64).collect()
