"""Files in and out."""

import pytest
from pyspark.sql import functions as F

from tsengine.functions import calendar
from tsengine.operators import chunks, panel, scaling, series_sets
from tsengine.plans import competition, experiment
from tsengine.sources import readers, writers
from tsengine.streaming.files import transform_stream


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_wide_series(spark, tmp_path):
    path = write(tmp_path / "w.csv", "date,a,OT", "2016-07-01 00:00:00,1.5,2", "2016-07-01 01:00:00,,x", "2016-07-01 02:00:00,3,4")
    df = readers.wide_series(spark, path)
    assert dict(df.dtypes) == {"date": "timestamp_ntz", "a": "double", "OT": "double"}
    rows = df.orderBy("date").collect()
    assert str(rows[1]["date"]) == "2016-07-01 01:00:00" and (rows[1]["a"], rows[1]["OT"]) == (None, None)
    assert (rows[2]["a"], rows[2]["OT"]) == (3.0, 4.0)
    with pytest.raises(ValueError, match="HUFL"):
        readers.wide_series(spark, path, target="HUFL")


def test_scan_reads_only_the_wanted_columns(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(10).select(F.col("id").alias("date"), F.lit(1.0).alias("a"), F.lit(2.0).alias("OT")).write.parquet(path)
    df = panel.feature_mode(readers.wide_series(spark, path, format="parquet"), "S").filter("date > 3")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<date:bigint,OT:double>" in plan and "GreaterThan(date,3)" in plan


def test_series_rows_keep_line_order_and_last_wins(spark, tmp_path):
    one = write(tmp_path / "1.csv", '"V1","V2","V3","V4"', '"B","1","2",', '"A","3",,"5"', '"B","7","x","nan"')
    two = write(tmp_path / "2.csv", "V1,V2", "D,9", "A,8")
    df = readers.series_files(spark, [one, two])
    assert df.count() == 5
    won = {r["series_id"]: r["values"] for r in series_sets.last_wins(df).collect()}
    assert won == {"B": [7.0], "A": [8.0], "D": [9.0]}


def test_competition_flows(spark, tmp_path):
    info = write(tmp_path / "info.csv", "M4id,category,Frequency,Horizon,SP", "A,x,1,6,Yearly", "B,x,12,18,Monthly")
    train = write(tmp_path / "t.csv", "V1,V2,V3", "B,1,2", "Z,5,")
    test = write(tmp_path / "s.csv", "V1,V2", "A,4")
    cache = competition.build_indexed(spark, info, [train], [test], str(tmp_path / "m"))
    got = spark.read.parquet(cache).orderBy("part", "ord").collect()
    assert [(r["part"], r["series_id"], r["values"], r["horizon"]) for r in got] == [
        ("test", "A", [4.0], 6), ("test", "B", [], 18),
        ("train", "A", [], 6), ("train", "B", [1.0, 2.0], 18), ("train", "Z", [5.0], None),
    ]
    assert competition.build_indexed(spark, info, [], [], str(tmp_path / "m")) == cache
    competition.export_combined(spark, [train, test], str(tmp_path / "all"))
    assert spark.read.option("header", True).csv(str(tmp_path / "all")).columns == ["V1", "V2", "V3"]

    head = "Series,N,NF,Category,Starting Year,Starting Month,1,2,3,4,5,6,7,8"
    year = write(tmp_path / "y.csv", head, " N1 ,8,6,MICRO,1990,1,1,2,3,4,5,6,7,8", "N2,6,6,MICRO,1990,1,1,2,3,4,5,6,,")
    other = write(tmp_path / "o.csv", head + ",9", "N3,9,4,MICRO,1990,1,1,2,3,4,5,6,7,8,9")
    cache = competition.build_grouped(spark, [("M3Year", year), ("M3Other", other)], str(tmp_path / "g"))
    got = {r["series_id"]: (r["values"], r["horizon"]) for r in writers.load_series_cache(spark, cache).collect()}
    assert got == {"N1": ([1.0, 2.0], 6), "N3": ([1.0], 4)}  # cut by the group's horizon, stated one kept
    tests = {r["series_id"]: r["values"] for r in writers.load_series_cache(spark, cache, training=False).collect()}
    assert tests["N3"] == [2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0]
    exported = spark.read.option("header", True).csv(str(tmp_path / "g/train-csv"))
    assert exported.columns == ["0", "1"] and exported.count() == 2


def test_cache_is_built_once(spark, tmp_path):
    path, calls = str(tmp_path / "c"), []

    def build():
        calls.append(1)
        df = spark.createDataFrame([("a", [1.0, 2.0, 3.0], 1)], "series_id string, values array<double>, horizon int")
        return series_sets.holdout(df)

    for training, values in [(True, [1.0, 2.0]), (False, [3.0]), (True, [1.0, 2.0])]:
        assert writers.cached_series(spark, path, build, training).first()["values"] == values
    assert len(calls) == 1
    plan = writers.load_series_cache(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan


def test_forecasts_and_results(spark, tmp_path):
    df = spark.createDataFrame([("r1", 1.0, 2.0), ("r2", 1.0, 3.0)], "run_id string, pred double, true double")
    writers.save_forecasts(df, str(tmp_path / "f"))
    assert writers.load_forecasts(spark, str(tmp_path / "f"), "r2").first()["true"] == 3.0
    from tsengine.operators import metrics

    for _ in range(2):
        writers.append_results(metrics.bundle(df, ["run_id"]), str(tmp_path / "r"))
    assert sorted(r["run_id"] for r in writers.load_results(spark, str(tmp_path / "r")).collect()) == ["r1", "r2"]


@pytest.mark.parametrize("model", experiment.MODELS)
def test_experiment_runs_once(spark, tmp_path, model):
    lines = [f"2016-07-{1 + i // 24:02d} {i % 24:02d}:00:00,{(i * 7) % 11},{i % 24 + (i % 5) * 0.1}" for i in range(400)]
    path = write(tmp_path / "e.csv", "date,a,OT", *lines)
    config = experiment.Config(model=model, features="MS", seq_len=48, label_len=24, pred_len=12, size=64)
    first = experiment.run(spark, path, config, str(tmp_path / "out")).collect()
    again = experiment.run(spark, "/nowhere", config, str(tmp_path / "out")).collect()
    assert len(first) == 1 and first == again
    saved = writers.load_forecasts(spark, str(tmp_path / "out/forecasts"))
    assert saved.select("channel").distinct().collect()[0][0] == "OT"
    assert saved.count() == (80 - 12 + 1) * 12


def test_experiment_refuses_repeated_dates(spark, tmp_path):
    path = write(tmp_path / "d.csv", "date,OT", "2016-07-01 00:00:00,1", "2016-07-01 00:00:00,2")
    with pytest.raises(ValueError, match="repeated"):
        experiment.run(spark, path, experiment.Config(), str(tmp_path / "o"))


def test_text_dates_in_parquet(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("2016-07-01 01:00:00", 1.0), ("soon", 2.0)], "date string, OT double").write.parquet(path)
    rows = readers.wide_series(spark, path, format="parquet").orderBy("OT").collect()
    assert [str(r["date"]) for r in rows] == ["2016-07-01 01:00:00", "None"]


def test_stream_equals_batch(spark, tiny, tmp_path):
    events = spark.read.parquet(f"{tiny}/events.parquet")
    stats = scaling.fit(
        chunks.row_index(panel.as_panel(events.select("ts", "value")), ["series_id"], "ts"), ["series_id"], ["value"]
    )
    mean, std = stats.select("value_mean", "value_std").first()

    def features(df):
        long = df.select("event_id", *calendar.feature_columns(F.col("ts"), "s"), *calendar.calendar_marks(F.col("ts")),
                         scaling.scaled(F.col("value"), F.lit(mean), F.lit(std)).alias("z"))
        return long.withColumn("back", scaling.unscaled(F.col("z"), F.lit(mean), F.lit(std)))

    sink = str(tmp_path / "sink")
    transform_stream(spark, tiny, events.schema, features, sink, str(tmp_path / "state"), "events.parquet")
    batch, stream = features(events), spark.read.parquet(sink)
    assert stream.count() == 1000 and stream.exceptAll(batch).count() == 0
    transform_stream(spark, tiny, events.schema, features, sink, str(tmp_path / "state"), "events.parquet")
    assert spark.read.parquet(sink).count() == 1000  # nothing is read twice
