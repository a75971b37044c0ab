"""Hand-computed values for single operators."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tsengine.functions import calendar, encodings, numeric, text
from tsengine.operators import (
    anomaly, chunks, forecasts, instance_norm, metrics, panel, runs, scaling, series_sets, splits, training_log, windows,
)
from tsengine.plans.prepare import Spec, prepare_split


def one(df):
    return df.first()[0]


def value(spark, column):
    return one(spark.range(1).select(column))


def doubles(*items):
    return F.array(*[F.lit(float(i)) for i in items])


def near(a, b, tol=1e-6):
    return len(a) == len(b) and all(math.isclose(x, y, abs_tol=tol) for x, y in zip(a, b))


@pytest.mark.parametrize("n,parts", [(10, (7, 1, 2)), (90, (62, 10, 18)), (531, (371, 54, 106)), (720, (503, 73, 144)), (17420, (12194, 1742, 3484))])
def test_split_sizes_use_truncated_double_products(spark, n, parts):
    row = spark.range(1).select(*splits.part_sizes(F.lit(n).cast("bigint"))).first()
    assert tuple(row) == parts


def test_split_bounds_have_lookback_and_raise_when_too_short(spark):
    n = F.lit(720).cast("bigint")
    got = [tuple(spark.range(1).select(*splits.bounds(n, s, 24)).first()) for s in splits.SPLITS]
    assert got == [(0, 503), (479, 576), (552, 720)]
    with pytest.raises(Exception, match="too short"):
        spark.range(1).select(*splits.bounds(F.lit(10).cast("bigint"), "val", 24)).collect()


def series(spark, values, key="a"):
    return spark.createDataFrame([(key, i, len(values), float(v)) for i, v in enumerate(values)], "series_id string, rn long, n long, v double")


def test_window_contents(spark):
    made = chunks.chunked(series(spark, range(10)), ["series_id"], ["v"], after=6)
    cut = windows.contexts(windows.starts(made, 7), 4, 2, 3).orderBy("window_id").collect()
    assert [r["window_id"] for r in cut] == [0, 1, 2, 3]
    assert cut[0]["x"] == [0, 1, 2, 3] and cut[0]["y"] == [2, 3, 4, 5, 6]
    assert cut[3]["x"] == [3, 4, 5, 6] and cut[3]["y"] == [5, 6, 7, 8, 9]
    assert value(spark, windows.decoder_input(doubles(2, 3, 4, 5, 6), 2, 3)) == [2, 3, 0, 0, 0]
    assert value(spark, windows.target_part(doubles(2, 3, 4, 5, 6), 3)) == [4, 5, 6]
    assert value(spark, windows.count_windows(F.lit(10).cast("bigint"), 4, 3)) == 4
    assert value(spark, windows.count_windows(F.lit(5).cast("bigint"), 4, 3)) == 0


def test_windows_do_not_depend_on_chunk_size(spark):
    data = series(spark, range(100))
    for size, stride in [(7, 1), (16, 1), (4096, 1), (7, 5), (16, 3)]:
        made = chunks.chunked(data, ["series_id"], ["v"], size, after=6)
        cut = windows.starts(made, 7, size, stride=stride).select("window_id", windows.piece("v", 0, 7).alias("w"))
        got = {r["window_id"]: r["w"] for r in cut.collect()}
        assert got == {i // stride: [float(k) for k in range(i, i + 7)] for i in range(0, 94, stride)}


def test_too_small_chunks_are_refused(spark):
    with pytest.raises(ValueError, match="halo"):
        chunks.chunked(series(spark, range(5)), ["series_id"], ["v"], 4, after=6)


# columns: second, minute, hour, weekday, day of month, day of year, month, week
FEATURES = {
    "2024-01-01 00:00:00": [-0.5] * 8,
    "2020-12-31 23:59:59": [0.5, 0.5, 0.5, 0.0, 0.5, 0.5, 0.5, 0.5],
    "2021-01-03 12:30:15": [-0.245763, 0.008475, 0.021739, 0.5, -0.433333, -0.494521, -0.5, 0.5],
    "2024-02-29 06:15:00": [-0.5, -0.245763, -0.23913, 0.0, 0.433333, -0.338356, -0.409091, -0.346154],
}


@pytest.mark.parametrize("ts", FEATURES)
def test_time_features(spark, ts):
    columns = calendar.feature_columns(F.lit(ts).cast("timestamp_ntz"), names=list(calendar.FEATURES))
    assert near(list(spark.range(1).select(*columns).first()), FEATURES[ts])


def test_frequencies():
    units = {"t": "minute", "min": "minute", "15min": "minute", "h": "hour", "H": "hour", "3h": "hour", "w": "week",
             "W-MON": "week", "m": "month", "M": "month", "ME": "month", "Q": "quarter", "QE": "quarter", "A": "year",
             "YE": "year", "b": "business day", "D": "day", "S": "second"}
    assert {f: calendar.resolve(f) for f in units} == units
    # number of features of each frequency
    counts = {"h": 4, "t": 5, "s": 6, "m": 1, "a": 0, "w": 2, "d": 3, "b": 3}
    assert {f: len(calendar.feature_names(f)) for f in counts} == counts
    for bad in ("MS", "QS", "x", "", "h-MON"):
        with pytest.raises(ValueError):
            calendar.resolve(bad)


def test_marks_and_yearly_features(spark):
    ts = F.lit("2024-02-29 06:15:00").cast("timestamp_ntz")
    assert list(spark.range(1).select(*calendar.calendar_marks(ts)).first()) == [2, 29, 3, 6]
    assert value(spark, calendar.mark_array(ts, None)) == [2.0, 29.0, 3.0, 6.0]
    assert value(spark, calendar.feature_array(ts, "y")) == []


FORECASTS = [
    (w, s + 1, c, float(p), float(t))
    for w, (ps, ts) in enumerate(
        zip(
            [[[1, 2], [3, 4]], [[2, 2], [5, 3]], [[0, 1], [4, 6]]],
            [[[1, 1], [2, 4]], [[3, 2], [4, 5]], [[2, 4], [6, 8]]],
        )
    )
    for s, (pr, tr) in enumerate(zip(ps, ts))
    for c, (p, t) in enumerate(zip(pr, tr))
]


def test_metrics(spark):
    df = spark.createDataFrame(FORECASTS, "window_id long, step int, channel int, pred double, true double")
    assert near(list(metrics.bundle(df).first()), [1.25, 2.416667, 1.554563, 0.401389, 0.276644])
    assert math.isclose(one(df.agg(metrics.rse(F.col("pred"), F.col("true")))), 0.769309, abs_tol=1e-6)
    corr = [r["corr"] for r in metrics.corr_by_step(df).orderBy("step").collect()]
    assert near(corr, [-0.193375, 1.162085])


def test_zero_truth(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0)], "pred double, true double")
    assert one(metrics.bundle(df).select("mape")) == math.inf
    assert math.isclose(one(metrics.bundle(df, zero="skip").select("mape")), 0.5)
    both = spark.createDataFrame([(0.0, 0.0)], "pred double, true double")
    assert math.isnan(one(metrics.bundle(both).select("mape")))
    constant = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0)], "pred double, true double")
    assert one(constant.agg(metrics.rse(F.col("pred"), F.col("true")))) == math.inf


def test_batch_mean_loss_weighs_batches_equally(spark):
    df = spark.createDataFrame([(i, 0.0, e) for i, e in enumerate([1.0, 1.0, 1.0, 1.0, 2.0])], "window_id long, pred double, true double")
    batched = df.withColumn("batch_id", windows.batch_id(2))
    assert one(metrics.batch_mean_loss(batched)) == 2.0


def test_losses(spark):
    nll = spark.range(1).agg(metrics.gaussian_nll(F.lit(3.0), F.lit(1.0), F.lit(2.0)))
    assert math.isclose(one(nll), 1.193147, abs_tol=1e-6)
    flipped = spark.range(1).agg(metrics.gaussian_nll(F.lit(3.0), F.lit(1.0), F.lit(2.0), 2.0, True))
    assert math.isclose(one(flipped), -2.386294, abs_tol=1e-6)
    z = spark.createDataFrame([(0.5, 0.0), (-1.0, 0.2)], "z_mu double, z_logvar double")
    assert math.isclose(one(z.agg(metrics.kl_gaussian(F.col("z_mu"), F.col("z_logvar")))), 0.635701, abs_tol=1e-6)
    f = spark.createDataFrame([(1.0, 3.0, 1.0, 2.0)], "pred double, true double, mu double, sigma double")
    assert math.isclose(one(metrics.combined_loss(f, z).select("loss")), 1.193147 + 4.0 + 0.635701, abs_tol=1e-5)
    got = [value(spark, numeric.softplus(F.lit(x))) for x in (-2.0, 0.0, 3.0, 800.0)]
    assert near(got, [0.126928, 0.693147, 3.048587, 800.0])


def test_instance_norm(spark):
    x = doubles(1, 2, 3, 4)
    stats = instance_norm.statistics(x)
    assert math.isclose(value(spark, stats)["scale"], 1.118038, abs_tol=1e-6)
    z = instance_norm.norm(x, stats)
    assert near(value(spark, z), [-1.341635, -0.447212, 0.447212, 1.341635])
    last = instance_norm.statistics(x, last=True)
    zl = instance_norm.norm(x, last)
    assert near(value(spark, zl), [-2.683271, -1.788848, -0.894424, 0])
    assert near(value(spark, instance_norm.denorm(z, stats)), [1, 2, 3, 4], 1e-8)
    assert near(value(spark, instance_norm.denorm(zl, last)), [1, 2, 3, 4], 1e-8)
    affine = instance_norm.norm(x, stats, 2.0, 0.5)
    assert near(value(spark, instance_norm.denorm(affine, stats, 2.0, 0.5)), [1, 2, 3, 4], 1e-8)


def test_patches(spark):
    assert value(spark, windows.patches(doubles(1, 2, 3, 4, 5), 3, 2, 2)) == [[1, 2, 3], [3, 4, 5], [5, 5, 5]]
    assert value(spark, windows.patches(doubles(1), 3, 2, 1)) == []


@pytest.mark.parametrize("size", [2, 3, 100])
def test_point_adjust(spark, size):
    gt, pred = [1, 1, 1, 0, 0, 1, 1, 1, 0, 1, 1], [0, 1, 0, 1, 0, 0, 0, 1, 0, 0, 0]
    df = spark.createDataFrame([("a", i, g, p) for i, (g, p) in enumerate(zip(gt, pred))], "series_id string, rn long, gt int, pred int")
    got = anomaly.point_adjust(df, ["series_id"], size=size).orderBy("rn").collect()
    assert [r["adjusted"] for r in got] == [0, 1, 1, 1, 0, 1, 1, 1, 0, 0, 0]


def history(spark, losses, run="a"):
    return spark.createDataFrame([(run, i + 1, float(x)) for i, x in enumerate(losses)], "run_id string, epoch int, loss double")


@pytest.mark.parametrize("size", [2, 4096])
def test_early_stop(spark, size):
    row = training_log.early_stop(history(spark, [5, 4, 4, 4.5, 4.6, 3]), patience=2, size=size).first()
    assert (row["stop_epoch"], row["best_epoch"]) == (5, 3)
    row = training_log.early_stop(history(spark, [5, 4, 3]), patience=2, size=size).first()
    assert (row["stop_epoch"], row["best_epoch"]) == (None, 3)
    row = training_log.early_stop(history(spark, [5, 4.5, 4.2, 3.9, 3.8]), patience=2, delta=1.0, size=size).first()
    assert (row["stop_epoch"], row["best_epoch"]) == (3, 1)
    row = training_log.early_stop(history(spark, [5, 4.5, 3.9, 3.8, 3.7]), patience=2, delta=1.0, size=size).first()
    assert (row["stop_epoch"], row["best_epoch"]) == (5, 3)


def test_best_candidate_keeps_the_later_tie(spark):
    row = training_log.best_candidate(history(spark, [5, 4, 4, 6])).first()
    assert (row["best_epoch"], row["best_loss"]) == (3, 4.0)


def test_holdout(spark):
    v, h = doubles(*range(1, 8)), F.lit(2)
    assert value(spark, series_sets.train_part(v, h)) == [1, 2, 3, 4, 5]
    assert value(spark, series_sets.test_part(v, h)) == [6, 7]
    assert value(spark, series_sets.train_part(v, h, 2)) == [1, 2, 3]
    assert value(spark, series_sets.train_part(v, F.lit(8))) == []
    df = spark.range(1).select(v.alias("values"))
    assert series_sets.longer_than(df, "values", 7).count() == 0
    assert series_sets.longer_than(df, "values", 6).count() == 1
    with pytest.raises(Exception, match="at least 1"):
        value(spark, series_sets.train_part(v, F.lit(0)))


def test_coercion(spark):
    cells = F.array(*[F.lit(c) for c in ["1", "x", "", "3.5", None, "nan", "7", " 8 ", "1d", "-2e3", "inf"]])
    assert value(spark, series_sets.coerce_values(cells)) == [1, 3.5, 7, 8, -2000, math.inf]


def test_sinusoid(spark):
    assert near(value(spark, encodings.sinusoid(F.lit(3), 4)), [0.14112, -0.989992, 0.029996, 0.99955], 1e-5)
    with pytest.raises(ValueError):
        encodings.sinusoid(F.lit(3), 5)
    with pytest.raises(Exception, match="below"):
        value(spark, encodings.sinusoid(F.lit(5000), 4))
    code = value(spark, encodings.calendar_code(F.lit("2024-02-29 06:15:00").cast("timestamp_ntz"), 4))
    expected = sum(math.sin(p) for p in (6, 3, 29, 2))
    assert math.isclose(code[0], expected, abs_tol=1e-9)


def test_info_join_order(spark):
    info = spark.createDataFrame([("A", "g", 1), ("B", "g", 2), ("C", "g", 3)], "series_id string, grp string, info_ord int")
    rows = [("B", [1.0], 0, 0), ("D", [2.0], 0, 1), ("B", [3.0], 1, 0)]
    df = spark.createDataFrame(rows, "series_id string, values array<double>, file_ord int, row_ord int")
    got = series_sets.attach_info(df, info).orderBy("ord").collect()
    assert [(r["series_id"], r["values"]) for r in got] == [("A", []), ("B", [3.0]), ("C", []), ("D", [2.0])]


def test_url_file_name(spark):
    for url, name in [("http://a/b.csv", "b.csv"), ("", ""), ("http://a/", ""), ("plain", "plain")]:
        assert value(spark, text.url_file_name(F.lit(url))) == name


def test_run_names_agree(spark):
    config = {"task_name": "t", "model_id": "m", "model": "x", "data": "d", "features": "M", "seq_len": 1, "label_len": 2,
              "pred_len": 3, "d_model": 4, "n_heads": 5, "e_layers": 6, "d_layers": 7, "d_ff": 8, "embed": "timeF",
              "inter_dim": 9, "latent_dim": 10, "revin": True, "des": "Exp", "itr": 0}
    name = "t_m_x_d_ftM_sl1_ll2_pl3_dm4_nh5_el6_dl7_df8_ebtimeF_id9_ld10_revinTrue_Exp_0"
    assert text.run_name(config) == name
    assert value(spark, text.run_key(config)) == name
    with pytest.raises(ValueError, match="factor"):
        text.run_key(config, variational=False)


def test_scaling_guards_constant_channels_and_missing_values(spark):
    rows = [("a", i, 10, 5.1, v) for i, v in enumerate([1.0, 2.0, None, float("nan"), 3.0, 4.0, 5.0, 100.0, 100.0, 100.0])]
    df = spark.createDataFrame(rows, "series_id string, rn long, n long, c double, v double")
    stats = scaling.fit(df, ["series_id"], ["c", "v"]).first()
    assert stats["c_std"] == 1.0 and math.isclose(stats["c_mean"], 5.1)
    assert stats["v_mean"] == 3.0 and math.isclose(stats["v_std"], math.sqrt(2))
    out = scaling.apply(df, scaling.fit(df, ["series_id"], ["c", "v"]), ["series_id"], ["c", "v"]).orderBy("rn").collect()
    assert all(abs(r["c"]) < 1e-12 for r in out) and out[2]["v"] is None and math.isnan(out[3]["v"])


def test_columns_and_modes(spark):
    df = spark.createDataFrame([(1.0, "2024-01-01", 2.0)], "OT double, date string, a double")
    assert panel.canonical_columns(df).columns == ["date", "a", "OT"]
    assert panel.feature_mode(df, "S").columns == ["date", "OT"]
    assert windows.output_channels(["a", "OT"], "MS") == ["OT"]
    for call in (lambda: panel.canonical_columns(df, "b"), lambda: panel.feature_mode(df, "X")):
        with pytest.raises(ValueError):
            call()


def test_validate(spark):
    good = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0)], "k string, ts int, v double")
    assert panel.validate(good, ["k"], "ts", ["v"]) is good
    with pytest.raises(ValueError, match="repeated"):
        panel.validate(good.union(good), ["k"], "ts", ["v"])
    with pytest.raises(ValueError, match="null"):
        panel.validate(good.union(spark.createDataFrame([("a", None, 1.0)], good.schema)), ["k"], "ts", ["v"])
    with pytest.raises(ValueError, match="not a number"):
        panel.validate(good, ["k"], "ts", ["k"])


def test_experiment_grid(spark):
    datasets = spark.createDataFrame(runs.DATASETS, "dataset string, channels int, freq string, batch int")
    grid = runs.experiment_grid(datasets)
    assert grid.count() == 64 and grid.distinct().count() == 64
    named = grid.withColumn("run_id", F.concat_ws("_", "dataset", "features", "pred_len"))
    done = named.filter("pred_len = 96")
    assert runs.pending(named, done.union(done)).count() == 48


def test_sampling_is_reproducible_and_normal(spark):
    base = spark.range(20000).select("id", F.lit(3.0).alias("mu"), F.lit(2 * math.log(2)).alias("logvar"))
    a = forecasts.sample_paths(base, ["id"], 2, seed=5)
    b = forecasts.sample_paths(base.repartition(7), ["id"], 2, seed=5)
    both = a.join(b.withColumnRenamed("sample", "other"), ["id", "draw"])
    assert both.filter("sample <> other").count() == 0
    mean, std = a.agg(F.avg("sample"), F.stddev_pop("sample")).first()
    assert abs(mean - 3) < 0.05 and abs(std - 2) < 0.05


def test_draws_of_one_partition_are_spread_and_those_of_the_digests(spark):
    rows = [(k, w, 1.0, 0.5) for k in ("a", "", None) for w in [None, *range(40)]]
    base = spark.createDataFrame(rows, "k string, w long, mu double, logvar double").coalesce(1)
    made = forecasts.sample_paths(base, ["k", "w"], 3, seed=5)
    assert made.columns == [*base.columns, "draw", "sample"]
    assert made.select(F.spark_partition_id()).distinct().count() > 1

    def uniform(salt, *parts):
        text = ":".join(str(p) for p in (5, salt, *parts) if p is not None)
        return (int(hashlib.md5(text.encode()).hexdigest()[:15], 16) + 0.5) / 2**60

    found = made.collect()
    assert len(found) == 3 * len(rows)
    for r in found:
        first, second = (uniform(salt, r["k"], r["w"], r["draw"]) for salt in (1, 2))
        assert r["sample"] == pytest.approx(1 + math.sqrt(-2 * math.log(first)) * math.cos(2 * math.pi * second) * math.exp(0.25))


def test_prepare_split_shapes(spark):
    rows = [("a", i, 60, float(i), f"2024-01-01 {i % 24:02d}:00:00") for i in range(60)]
    df = spark.createDataFrame(rows, "series_id string, rn long, n long, v double, d string")
    df = df.withColumn("date", F.col("d").cast("timestamp_ntz")).drop("d")
    spec = Spec(context=6, label=3, horizon=2, batch=4, size=8)
    made = prepare_split(df, ["series_id"], ["v"], "test", spec, ts="date").collect()
    assert len(made) == 12 - 2 + 1
    for r in made:
        assert (len(r["x"]), len(r["y"]), len(r["x_mark"]), len(r["y_mark"])) == (6, 5, 6, 5)
        assert len(r["x_mark"][0]) == 4 and r["batch_id"] == r["window_id"] // 4
        assert r["x"][3:] == r["y"][:3]


@pytest.mark.parametrize("count", [1, 2, 3, 5, 97, 100, 2503])
def test_shuffle_is_a_permutation_of_each_epoch(spark, count):
    df = spark.range(count).select(F.lit("a").alias("series_id"), F.col("id").alias("window_id"))
    orders = {}
    for seed, epoch in ((1, 0), (1, 1), (2, 0)):
        made = windows.shuffled(df.repartition(3), ["series_id"], seed, F.lit(count).cast("bigint"), epoch, batch=32)
        rows = sorted(tuple(r)[1:] for r in made.select("series_id", "window_id", "place", "batch_id").collect())
        orders[seed, epoch] = [p for _, p, _ in rows]
        assert sorted(orders[seed, epoch]) == list(range(count)) and all(b == p // 32 for _, p, b in rows)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and "Sort" not in plan
    if count > 90:
        assert len({tuple(o) for o in orders.values()}) == 3
        for order in orders.values():
            steps = {(b - a) % count for a, b in zip(order, order[1:])}
            assert len(steps) > count / 3  # nothing like an arithmetic order
