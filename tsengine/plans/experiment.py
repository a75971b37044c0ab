"""One experiment from a wide file to its results table."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tsengine.functions.calendar import resolve
from tsengine.functions.text import run_name
from tsengine.operators import chunks, forecasts, metrics, panel, ridge, scaling, windows
from tsengine.plans.evaluate import candidate_rules
from tsengine.plans.prepare import Spec, split_chunks, split_windows
from tsengine.sources import readers, writers

KEY = ["series_id"]

# Nested blocks whose rows are numbered together, by the frequency of the data.
BLOCKS = {"second": ("day", "minute"), "minute": ("month", "hour"), "hour": ("year", "day"), "day": ("year", "month")}


@dataclass(frozen=True)
class Config:
    """Settings of a run. The names of the first block make up the run name."""

    # Defaults of the experiments.
    task_name: str = "long_term_forecast"
    model_id: str = "test"
    model: str = "last"
    data: str = "custom"
    features: str = "M"
    seq_len: int = 96
    label_len: int = 48
    pred_len: int = 96
    d_model: int = 512
    n_heads: int = 8
    e_layers: int = 2
    d_layers: int = 1
    d_ff: int = 2048
    factor: int = 1
    embed: str = "timeF"
    distil: bool = True
    des: str = "test"
    itr: int = 0

    target: str = "OT"
    freq: str = "h"
    batch_size: int = 32
    period: int = 24  # season length of the seasonal rule
    penalty: float = 1.0
    size: int = chunks.SIZE

    @property
    def run_id(self) -> str:
        return run_name(asdict(self), variational=False)

    @property
    def spec(self) -> Spec:
        freq = self.freq if self.embed == "timeF" else None
        return Spec(self.seq_len, self.label_len, self.pred_len, freq=freq, batch=self.batch_size, size=self.size)


MODELS = ("last", "mean", "seasonal", "ridge")


def forecast(df: DataFrame, channels: list[str], config: Config, scored: list[str]) -> DataFrame:
    """Long test forecasts of the configured model for the ``scored`` channels."""
    spec = config.spec
    stats = scaling.fit(df, KEY, channels, spec.train)
    if config.model == "ridge":
        train = split_chunks(df, KEY, channels, "train", spec, stats=stats)
        model = ridge.fit(train, spec.context, spec.horizon, config.penalty, size=spec.size)
        test = split_chunks(df, KEY, scored, "test", spec, stats=stats)
        return model.transform(test, [*KEY, "channel"], first="first", size=spec.size)
    rules, per_window = candidate_rules(spec.context, config.period)
    if config.model not in rules:
        raise ValueError(f"model must be one of {MODELS}, not {config.model!r}")
    needed = per_window if config.model == "mean" else None
    indexed = split_windows(df, KEY, scored, "test", spec, stats=stats).drop("n", "first")
    made = forecasts.closed_form(
        indexed, spec.context, spec.horizon, {config.model: rules[config.model]}, before_steps=needed
    )
    return made.drop("candidate")


def run(spark: SparkSession, path: str, config: Config, out: str, format: str = "csv") -> DataFrame:
    """Run one experiment unless its results exist; returns its row of the results table.

    Rows without a date and repeated dates are refused. Forecasts are written
    once, and the metrics are read from that table. The results are written last and
    both replace what an earlier try of the run has left, so a run that was broken off
    anywhere can simply be run again.
    """
    results = f"{out}/results"
    mine = F.col("run_id") == config.run_id
    if writers.table_exists(spark, results):
        done = writers.load_results(spark, results).filter(mine)
        if not done.isEmpty():
            return done
    wide = panel.feature_mode(readers.wide_series(spark, path, target=config.target, format=format), config.features, config.target)
    channels = panel.channels_of(wide)
    scored = windows.output_channels(channels, config.features)
    block = BLOCKS.get(resolve(config.freq), ("year", "month"))
    checked = panel.validate(panel.as_panel(wide), KEY, "date", channels)
    indexed = chunks.row_index(checked, KEY, "date", block)
    made = forecast(indexed, channels, config, scored).withColumn("run_id", F.lit(config.run_id))
    writers.save_forecasts(made, f"{out}/forecasts")
    saved = writers.load_forecasts(spark, f"{out}/forecasts", config.run_id)
    writers.append_results(metrics.bundle(saved, ["run_id"]), results)
    return writers.load_results(spark, results).filter(mine)
