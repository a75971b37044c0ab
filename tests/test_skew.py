"""Ordered operators against plain pandas, with one series holding most rows and tiny chunks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tsengine.operators import anomaly, chunks, forecasts, panel, training_log
from tsengine.plans import evaluate
from tsengine.plans.prepare import Spec

KEYS = ["series_id"]


@pytest.fixture(scope="module")
def frame():
    """Eleven series; the first has two thirds of the rows."""
    rng = np.random.default_rng(3)
    lengths = [600, *rng.integers(20, 40, 10)]
    parts = []
    for k, n in enumerate(lengths):
        gaps = rng.integers(1, 900, n)
        parts.append(
            pd.DataFrame(
                {
                    "series_id": f"s{k}",
                    "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(gaps), unit="min"),
                    "v": rng.normal(size=n).round(3),
                    "gt": (rng.random(n) < 0.7).astype("int32"),
                    "pred": (rng.random(n) < 0.15).astype("int32"),
                }
            )
        )
    return pd.concat(parts).sample(frac=1, random_state=1)


@pytest.fixture(scope="module")
def indexed(spark, frame):
    return chunks.row_index(spark.createDataFrame(frame), KEYS, "ts").cache()


@pytest.fixture(scope="module")
def expected(frame):
    df = frame.sort_values(["series_id", "ts"]).reset_index(drop=True)
    df["rn"] = df.groupby("series_id").cumcount()
    df["n"] = df.groupby("series_id")["rn"].transform("size")
    return df


def by_place(df, *columns):
    return df.select("series_id", "rn", *columns).toPandas().sort_values(["series_id", "rn"]).reset_index(drop=True)


def test_row_index(indexed, expected):
    got = by_place(indexed, "n", "v")
    pd.testing.assert_frame_equal(got, expected[["series_id", "rn", "n", "v"]], check_dtype=False)


@pytest.mark.parametrize("block", ["hour", "month", ("month", "day"), ("month", "day", "hour"), ("day", "minute")])
def test_row_index_of_one_long_series(spark, frame, block):
    one = panel.as_panel(spark.createDataFrame(frame[["ts", "v"]].drop_duplicates("ts")))
    got = chunks.row_index(one, KEYS, "ts", block).select("ts", "rn").toPandas().sort_values("ts")
    assert got["rn"].tolist() == list(range(len(got)))


@pytest.mark.parametrize("how", ["max", "min", "sum"])
@pytest.mark.parametrize("exclusive", [False, True])
def test_running(indexed, expected, how, exclusive):
    got = by_place(chunks.running(indexed, KEYS, F.col("v"), how, "r", exclusive, size=7), "r")
    g = expected.groupby("series_id")["v"]
    want = {"max": g.cummax, "min": g.cummin, "sum": g.cumsum}[how]()
    if exclusive:
        want = want.groupby(expected["series_id"]).shift()
    np.testing.assert_allclose(got["r"].astype(float), want, atol=1e-9)


def adjust(gt, pred):
    """Run by run: fill a run that has a hit, but never position 0."""
    out, i = list(pred), 0
    while i < len(gt):
        j = i
        while j < len(gt) and gt[j] == 1:
            j += 1
        if any(pred[i:j]):
            out[max(i, 1) : j] = [1] * (j - max(i, 1))
        i = max(j, i + 1)
    return out


@pytest.mark.parametrize("size", [3, 16, 4096])
def test_point_adjust(indexed, expected, size):
    got = by_place(anomaly.point_adjust(indexed.select("series_id", "rn", "gt", "pred"), KEYS, size=size), "adjusted")
    want = [x for _, g in expected.groupby("series_id") for x in adjust(g["gt"].tolist(), g["pred"].tolist())]
    assert got["adjusted"].tolist() == want


def test_point_adjust_of_one_endless_run(spark):
    df = spark.range(500).select(F.lit("a").alias("series_id"), F.col("id").alias("rn"), F.lit(1).alias("gt"), (F.col("id") == 450).cast("int").alias("pred"))
    got = anomaly.point_adjust(df, KEYS, size=10).orderBy("rn").toPandas()
    assert got["adjusted"].tolist() == [0] + [1] * 499
    again = anomaly.point_adjust(
        spark.createDataFrame(got[["series_id", "rn", "gt", "adjusted"]]).withColumnRenamed("adjusted", "pred"), KEYS, size=10
    )
    assert again.orderBy("rn").toPandas()["adjusted"].tolist() == got["adjusted"].tolist()


@pytest.mark.parametrize("size", [12, 64])
def test_trend(indexed, expected, size):
    got = by_place(forecasts.trend(indexed, KEYS, "v", 25, size), "trend")
    want = expected.groupby("series_id")["v"].transform(lambda v: v.rolling(25, center=True, min_periods=1).mean())
    np.testing.assert_allclose(got["trend"], want, atol=1e-9)


def test_trend_and_season_add_up(indexed):
    parts = forecasts.trend_season(indexed, KEYS, "v", period=6, width=5, size=16).toPandas()
    np.testing.assert_allclose(parts["v"], parts["trend"] + parts["season"] + parts["rest"], atol=1e-9)


def plain_forecasts(expected, context, horizon):
    rows = []
    for key, g in expected.groupby("series_id"):
        v, n = g["v"].to_numpy(), len(g)
        n_train, n_test = int(n * 0.7), int(n * 0.2)
        train = v[:n_train]
        z = (v - train.mean()) / (train.std() or 1.0)
        low = n - n_test - context
        for s in range(low, n - context - horizon + 1):
            last = z[s + context - 1]
            rows += [(key, s - low, h, last, z[s + context - 1 + h]) for h in range(1, horizon + 1)]
    return pd.DataFrame(rows, columns=["series_id", "window_id", "step", "pred", "true"])


@pytest.mark.parametrize("size", [8, 4096])
def test_evaluation(indexed, expected, size):
    spec = Spec(context=5, label=2, horizon=3, size=size)
    order = ["series_id", "window_id", "step"]
    got = evaluate.last_value_forecasts(indexed, KEYS, ["v"], "test", spec).toPandas().sort_values(order)
    want = plain_forecasts(expected, 5, 3).sort_values(order)
    assert len(got) == len(want)
    np.testing.assert_allclose(got[["pred", "true"]].to_numpy(), want[["pred", "true"]].to_numpy(), atol=1e-9)


def stop(losses, patience, delta):
    best, count, best_at = None, 0, None
    for i, x in enumerate(losses):
        if best is None or not x > best - delta:
            best, count, best_at = x, 0, i
        else:
            count += 1
            if count >= patience:
                return i, best_at
    return None, best_at


@pytest.mark.parametrize("delta", [0.0, 0.3])
@pytest.mark.parametrize("size", [4, 4096])
def test_early_stop(spark, delta, size):
    rng = np.random.default_rng(5)
    rows = []
    for k, n in enumerate([400, *rng.integers(3, 30, 8)]):
        losses = (5 * np.exp(-np.arange(n) / (n / 3)) + rng.normal(scale=0.4, size=n)).round(1)
        rows += [(f"r{k}", i, float(x)) for i, x in enumerate(losses)]
    df = spark.createDataFrame(rows, "run_id string, epoch int, loss double").repartition(5)
    got = training_log.early_stop(df, patience=5, delta=delta, size=size).toPandas().set_index("run_id")
    for run, g in pd.DataFrame(rows, columns=["run", "epoch", "loss"]).groupby("run"):
        at, best = stop(g["loss"].tolist(), 5, delta)
        row = got.loc[run]
        assert (None if pd.isna(row["stop_epoch"]) else row["stop_epoch"], row["best_epoch"]) == (at, best), run


def test_regular_panel_fills_gaps_of_each_series(spark, frame):
    df = spark.createDataFrame(frame)
    got = panel.regular_panel(df, KEYS, "ts", "hour", {"v": F.sum("v")}).toPandas()
    step = frame.assign(date=frame["ts"].dt.floor("h")).groupby(["series_id", "date"])["v"].sum()
    for key, g in got.groupby("series_id"):
        g, seen = g.sort_values("rn"), step[key]
        hours = pd.date_range(seen.index.min(), seen.index.max(), freq="h")
        assert g["rn"].tolist() == list(range(len(hours))) and set(g["n"]) == {len(hours)}
        assert (g["date"].to_numpy() == hours.to_numpy()).all()
        np.testing.assert_allclose(g["v"], seen.reindex(hours).fillna(0.0), atol=1e-9)


def test_regular_panel_shuffles_observed_steps_only(spark, monkeypatch):
    """Gaps of many blocks, also before 1970 and in a series without key; no shuffle above the rows of the grid."""
    monkeypatch.setattr(panel, "FAN_OUT", 7)
    seen = [("a", "1969-12-31 05:10:00", 1.0), ("a", "1969-12-31 05:20:00", 2.0), ("a", "1970-01-03 00:00:00", 4.0), ("a", None, 9.0)]
    seen += [(None, "2024-01-01 00:00:00", 5.0), (None, "2024-01-01 02:59:00", 5.0), ("b", "2024-01-01 00:30:00", None), ("c", None, 1.0)]
    df = spark.createDataFrame(seen, "series_id string, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    made = panel.regular_panel(df, KEYS, "ts", "hour", {"v": F.sum("v")}, fill=-1.0)
    got = [tuple(r) for r in made.selectExpr("series_id", "cast(date AS string)", "rn", "n", "v").collect()]
    hours = pd.date_range("1969-12-31 05:00", "1970-01-03 00:00", freq="h")
    want = [("a", str(h), i, 68, {0: 3.0, 67: 4.0}.get(i, -1.0)) for i, h in enumerate(hours)] + [("b", "2024-01-01 00:00:00", 0, 1, -1.0)]
    want += [(None, f"2024-01-01 0{i}:00:00", i, 3, -1.0) for i in range(3)]  # NULL matches nothing
    assert sorted(got, key=str) == sorted(want, key=str)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join") and "Exchange" not in plan[: plan.index("Join")]
    weeks = panel.regular_panel(df.filter("series_id = 'a'"), KEYS, "ts", "week", {"v": F.sum("v")}).collect()
    assert [(r["rn"], r["n"], r["v"]) for r in weeks] == [(0, 1, 7.0)]


def test_explode_range_has_every_number(spark, monkeypatch):
    monkeypatch.setattr(chunks, "FAN_OUT", 4)
    df = spark.createDataFrame([(0, 10), (5, 5), (3, 2), (7, 40)], "a long, b long")
    for step in (1, 3):
        for spread in (None, ["a"]):
            made = chunks.explode_range(df, F.col("a"), F.col("b"), "x", step, spread).toPandas()
            want = [(a, b, x) for a, b in [(0, 10), (5, 5), (7, 40)] for x in range(a, b + 1, step)]
            assert sorted(made.itertuples(index=False, name=None)) == want
