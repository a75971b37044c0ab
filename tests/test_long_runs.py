"""Early stopping of very long runs: records followed along pointers, against the loop."""

import numpy as np
import pytest

from tsengine.operators import training_log


def accepted(losses, delta):
    best, kept = None, []
    for i, v in enumerate(losses):
        if best is None or v <= best - delta:
            best = v
            kept.append(i)
    return kept


def loop(losses, delta, patience):
    best, count, at = None, 0, None
    for i, v in enumerate(losses):
        if best is None or not v > best - delta:
            best, count, at = v, 0, i
        else:
            count += 1
            if count >= patience:
                return i, at
    return None, at


CASES = {
    "falling": lambda rng: 100 - 0.01 * np.arange(9_000),
    "steps": lambda rng: np.repeat(100.0 - np.arange(90), 100) - np.tile(0.001 * np.arange(100), 90),
    "cliff": lambda rng: np.concatenate([1 - 1e-6 * np.arange(6_000), -10 - 1e-6 * np.arange(3_000)]),
    "walk": lambda rng: np.cumsum(rng.normal(size=9_000)).round(2),
    "flat": lambda rng: np.zeros(50),
    "one": lambda rng: np.array([3.5]),
}


@pytest.fixture(scope="module")
def runs():
    rng = np.random.default_rng(4)
    return {name: make(rng) for name, make in CASES.items()}


@pytest.fixture(scope="module")
def history(spark, runs):
    rows = [(name, i, float(v)) for name, losses in runs.items() for i, v in enumerate(losses)]
    return spark.createDataFrame(rows, "run_id string, epoch int, loss double").repartition(4).cache()


@pytest.mark.parametrize("delta", [0.005, 0.5, 11.0])
@pytest.mark.parametrize("size", [64, 4096])
def test_path_of_improvements(history, runs, delta, size):
    rows = history.selectExpr("run_id", "cast(epoch as bigint) AS rn", "loss")
    made = training_log._improvements(rows, ["run_id"], "loss", delta, size).collect()
    got = {}
    for r in made:
        got.setdefault(r["run_id"], []).append(r["rn"])
    assert {k: sorted(v) for k, v in got.items()} == {k: accepted(v, delta) for k, v in runs.items()}


@pytest.mark.parametrize("patience, delta", [(7, 0.5), (120, 0.05)])
def test_stops(history, runs, patience, delta):
    made = training_log.early_stop(history, patience=patience, delta=delta, size=256)
    assert {r["run_id"]: (r["stop_epoch"], r["best_epoch"]) for r in made.collect()} == {k: loop(v, delta, patience) for k, v in runs.items()}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan


def test_no_chunk_is_met_by_all(history, runs):
    """Records meet the chunks of their span only: about two of them each, whatever the run."""
    rows = training_log.with_chunk(history.selectExpr("run_id", "cast(epoch as bigint) AS rn", "loss"), 64)
    falling = rows.filter("run_id in ('falling', 'cliff')").select("run_id", "rn", "loss")
    for delta in (0.005, 0.5):
        pointers = training_log.next_lower(falling, ["run_id"], "loss", delta, 64)
        wanted = {}
        for name in ("falling", "cliff"):
            v = runs[name]
            low = np.searchsorted(-v, -(v - delta))
            wanted |= {(name, i): int(j) for i, j in enumerate(low) if j < len(v)}
        assert {(r["run_id"], r["rn"]): r["next"] for r in pointers.collect()} == wanted
