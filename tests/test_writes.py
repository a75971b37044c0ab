"""Jobs that are broken off and run again, folders of several files, and sums far from zero."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsengine.operators import metrics, series_sets
from tsengine.plans import competition, experiment
from tsengine.sources import readers, writers


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def test_run_broken_off_between_its_writes(spark, tmp_path, monkeypatch):
    lines = [f"2016-07-{1 + i // 24:02d} {i % 24:02d}:00:00,{(i * 7) % 11},{i % 24 + (i % 5) * 0.1}" for i in range(300)]
    path = write(tmp_path / "e.csv", "date,a,OT", *lines)
    runs = [experiment.Config(model=m, seq_len=24, label_len=12, pred_len=6, size=64) for m in ("last", "mean")]
    clean, broken = str(tmp_path / "clean"), str(tmp_path / "broken")
    for config in runs:
        experiment.run(spark, path, config, clean)
    experiment.run(spark, path, runs[0], broken)

    def fail(*_):
        raise RuntimeError("lost")

    for _ in range(2):
        with monkeypatch.context() as patch:
            patch.setattr(writers, "append_results", fail)
            with pytest.raises(RuntimeError):
                experiment.run(spark, path, runs[1], broken)
        assert [r["run_id"] for r in writers.load_results(spark, f"{broken}/results").collect()] == [runs[0].run_id]
    experiment.run(spark, path, runs[1], broken)
    for table in ("forecasts", "results"):
        left, right = (spark.read.parquet(f"{out}/{table}") for out in (clean, broken))
        assert rows(left) == rows(right) and left.count()


def test_half_a_cache_is_built_again(spark, tmp_path):
    path = str(tmp_path / "c")
    df = spark.createDataFrame([("a", [1.0, 2.0, 3.0], 1), ("b", [4.0, 5.0], 1)], "series_id string, values array<double>, horizon int")
    held = series_sets.holdout(df)
    # What a job leaves that was lost while writing: one of two parts, no mark.
    held.filter("series_id = 'a'").select("series_id", "horizon", F.col("train").alias("values"), F.lit("train").alias("part")).write.partitionBy("part").parquet(path)
    assert writers.table_exists(spark, path) and not writers.committed(spark, path)
    made = writers.cached_series(spark, path, lambda: held)
    assert rows(made.select("series_id", "values")) == [("a", [1.0, 2.0]), ("b", [4.0])]
    assert writers.committed(spark, path) and rows(writers.load_series_cache(spark, path, False).select("values")) == [([3.0],), ([5.0],)]

    def never():
        raise AssertionError("built twice")

    assert writers.cached_series(spark, path, never).count() == 2
    # Building it anew takes the mark away before it writes.
    with pytest.raises(Exception, match="lost"):
        writers.write_table(held.withColumn("x", F.raise_error(F.lit("lost")).cast("int")), path)
    assert not writers.committed(spark, path)


def test_indexed_collection_after_a_crash(spark, tmp_path, monkeypatch):
    info = write(tmp_path / "info.csv", "M4id,category,Frequency,Horizon,SP", "A,x,1,1,Yearly")
    train = write(tmp_path / "t.csv", "V1,V2,V3", "A,1,2", "Z,5,")
    out = str(tmp_path / "m")
    with monkeypatch.context() as patch:
        patch.setattr(writers, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            competition.build_indexed(spark, info, [train], [train], out)
    cache = competition.build_indexed(spark, info, [train], [train], out)
    assert spark.read.parquet(cache).count() == 4


def test_folder_of_files_in_order(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    write(folder / "1.csv", "V1,V2,V3", "B,1,2", "A,3,4", 'C,"9,5",6')
    write(folder / "2.csv", "V1,V2,V3", "A,5", "D,7,8")
    write(folder / "3.csv", "V1,V2,V3", "B,,9")
    series = readers.series_rows(spark, str(folder))
    won = {r["series_id"]: r["values"] for r in series_sets.last_wins(series).collect()}
    assert won == {"A": [5.0], "B": [9.0], "C": [6.0], "D": [7.0, 8.0]}
    info = write(tmp_path / "info.csv", "M4id,category,Frequency,Horizon,SP", "D,x,1,1,Yearly", "E,x,1,1,Yearly")
    ordered = series_sets.output_order(series_sets.attach_info(series, readers.info(spark, info)))
    assert [r["series_id"] for r in ordered.orderBy("position").collect()] == ["D", "E", "B", "A", "C"]
    assert sorted(r["position"] for r in ordered.collect()) == list(range(5))


def test_longer_line_raises(spark, tmp_path):
    path = write(tmp_path / "l.csv", "V1,V2,V3", "A,1,2", "B,1,2,3")
    with pytest.raises(Exception, match="more than 3 cells"):
        readers.series_rows(spark, path).collect()
    wide = readers.series_rows(spark, path, columns=["V1", "V2", "V3", "V4"])
    assert {r["series_id"]: r["values"] for r in wide.collect()} == {"A": [1.0, 2.0], "B": [1.0, 2.0, 3.0]}


@pytest.mark.parametrize("level", [0.0, 1e6])
def test_co_moments(spark, level):
    """Against numpy, with values far from zero and cells of one and of many rows."""
    rng = np.random.default_rng(8)
    sizes = {(1, "a"): 4000, (1, "b"): 1, (2, "a"): 37}
    data = {cell: (level + rng.normal(size=n), level * 2 + rng.normal(size=n)) for cell, n in sizes.items()}
    flat = [(*cell, float(p), float(t)) for cell, (ts, ps) in data.items() for t, p in zip(ts, ps)] + [(1, "a", None, 5.0)]
    df = spark.createDataFrame(flat, "step int, channel string, pred double, true double").repartition(9)
    made = {(r["step"], r["channel"]): r["m"] for r in metrics.co_moments(df, ["step", "channel"], held=2, fan_in=2).collect()}
    assert made.keys() == data.keys()
    for cell, (t, p) in data.items():
        d, e = t - t.mean(), p - p.mean()
        want = {"n": len(t), "m20": (d**2).sum(), "m11": (d * e).sum(), "m02": (e**2).sum(), "m21": (d**2 * e).sum(), "m12": (d * e**2).sum(), "m22": (d**2 * e**2).sum()}
        for name, value in want.items():
            assert abs(made[cell][name] - value) <= 1e-7 * max(1.0, abs(value)) * (1 if level == 0 else 10), (cell, name)
        np.testing.assert_allclose([made[cell]["t"], made[cell]["p"]], [t.mean(), p.mean()], rtol=1e-12)
    every = metrics.co_moments(df, []).first()["m"]
    assert every["n"] == 4038


def test_corr_is_one_shuffle_of_partials(spark):
    df = spark.range(1000).selectExpr("cast(id % 3 as int) AS step", "'c' AS channel", "rand(1) AS pred", "rand(2) AS true")
    text = metrics.corr_by_step(df)._jdf.queryExecution().executedPlan().toString()
    below = text[: text.index("MapInPandas")]
    assert "Join" not in text and text[text.index("MapInPandas") :].count("Exchange") == 0 and "collect_list" in below


def test_results_of_many_runs_need_few_folders(spark, tmp_path):
    path, five = str(tmp_path / "r"), ["mae", "mse", "rmse", "mape", "mspe"]
    runs = spark.range(300).select(F.col("id").alias("run_id"), *[F.col("id").cast("double").alias(m) for m in five])
    writers.append_results(runs, path)
    writers.append_results(runs.filter("run_id >= 290").withColumn("mae", F.lit(-1.0)).withColumn("run_id", F.nullif("run_id", F.lit(299))), path)
    assert len([p for p in (tmp_path / "r").iterdir() if p.is_dir()]) == 2
    # A NULL run id is a run too; a run written again has its last row only.
    found = {r["run_id"]: r["mae"] for r in writers.load_results(spark, path).collect()}
    assert found == {**{str(i): float(i) for i in range(290)}, **{str(i): -1.0 for i in range(290, 299)}, "299": 299.0, None: -1.0}
    writers.append_results(runs.limit(0), path)
    assert writers.load_results(spark, path).count() == 301


def test_a_task_writes_a_bounded_share_of_forecasts(spark, tmp_path, monkeypatch):
    advisory = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(advisory)
    df = spark.range(400000).select(F.lit("r").alias("run_id"), F.rand(3).alias("pred"), F.rand(4).alias("true")).repartition(16)
    monkeypatch.setattr(writers, "SHARE", "1m")
    writers.save_forecasts(df, str(tmp_path / "f"))
    assert len(list((tmp_path / "f" / "run_id=r").glob("*.parquet"))) >= 4  # some 6 MB; one file at the session's 64 MB
    assert writers.load_forecasts(spark, str(tmp_path / "f")).count() == 400000
    assert spark.conf.get(advisory) == before
