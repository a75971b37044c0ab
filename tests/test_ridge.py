"""The regression against plain numpy."""

import numpy as np
import pytest

from tsengine.operators import chunks, ridge

KEYS = ["series_id"]


@pytest.fixture(scope="module")
def walks():
    rng = np.random.default_rng(1)
    return {f"s{k}": np.cumsum(rng.normal(size=n)) for k, n in enumerate([300, 12, 40, 7])}


@pytest.fixture(scope="module")
def data(spark, walks):
    rows = [(k, i, len(v), float(x)) for k, v in walks.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "series_id string, rn long, n long, v double")


def windows(walks, length):
    return np.vstack([np.lib.stride_tricks.sliding_window_view(v, length) for v in walks.values() if len(v) >= length])


@pytest.mark.parametrize("size", [16, 4096])
@pytest.mark.parametrize("normalised", [False, True])
def test_fit(data, walks, size, normalised):
    made = chunks.chunked(data, KEYS, ["v"], size, after=8)
    model = ridge.fit(made, 6, 3, penalty=0.5, normalised=normalised, size=size)
    w = windows(walks, 9)
    x, y = w[:, :6], w[:, 6:]
    if normalised:
        mean, scale = x.mean(1, keepdims=True), np.sqrt(x.var(1, keepdims=True) + 1e-5)
        x, y = (x - mean) / scale, (y - mean) / scale
    design = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([0.5] * 6 + [0.0])
    if normalised:  # normalised lags add up to zero: compare fitted values
        want = design @ np.linalg.lstsq(design.T @ design + penalty, design.T @ y, rcond=None)[0]
        np.testing.assert_allclose(x @ model.weights + model.intercept, want, atol=1e-6)
    else:
        want = np.linalg.solve(design.T @ design + penalty, design.T @ y)
        np.testing.assert_allclose(np.vstack([model.weights, model.intercept]), want, atol=1e-6)


def test_rolled_out_is_recursion(walks):
    rng = np.random.default_rng(2)
    model = ridge.Ridge(4, 1, rng.normal(size=(4, 1)) / 3, np.array([0.2]), normalised=False)
    x = windows(walks, 4)
    known = x
    for _ in range(5):
        known = np.hstack([known, model.predict(known[:, -4:])])
    np.testing.assert_allclose(model.rolled_out(5).predict(x), known[:, 4:], atol=1e-9)
    with pytest.raises(ValueError):
        model.rolled_out(5).rolled_out(2)


@pytest.mark.parametrize("size", [8, 4096])
def test_score_sees_every_window_once(data, walks, size):
    made = chunks.chunked(data, KEYS, ["v"], size, after=6)
    scored = ridge.score(made, lambda x: x[:, -2:] * 2, 5, 2, KEYS, size=size)
    got = {(r["series_id"], r["window_id"]): (r["pred"], r["true"]) for r in scored.collect()}
    want = {
        (k, s): ([2 * v[s + 3], 2 * v[s + 4]], [v[s + 5], v[s + 6]]) for k, v in walks.items() for s in range(len(v) - 6)
    }
    assert got.keys() == want.keys()
    for key, (p, t) in want.items():
        np.testing.assert_allclose(got[key], (p, t))
    flat = ridge.unpack(scored).filter("series_id = 's3'").orderBy("step").collect()
    assert [(r["step"], r["true"]) for r in flat] == [(1, walks["s3"][5]), (2, walks["s3"][6])]


def test_score_checks_shapes(data):
    made = chunks.chunked(data, KEYS, ["v"], after=6)
    with pytest.raises(Exception, match="shape"):
        ridge.score(made, lambda x: x, 5, 2, KEYS).collect()
