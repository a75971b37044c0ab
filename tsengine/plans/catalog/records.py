"""Queries on anomaly labels, training logs and run bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsengine.functions import text
from tsengine.operators import metrics, runs, training_log
from tsengine.operators.anomaly import point_adjust as adjust
from tsengine.plans.catalog import fragments as sql
from tsengine.plans.catalog.registry import query, r
from tsengine.plans.catalog.scores import FIVE, _ALL, _W, naive
from tsengine.plans.tables import KEY, anomaly_labels, loss_log, table
from tsengine.session import scratch_path, settled
from tsengine.sources import writers

_LABELS = """l AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts)-1 AS rn,
       (value>10)::INT AS gt, (event_type='error')::INT AS pred FROM events)"""


@query(
    "point_adjust",
    f"""WITH {_LABELS}, g AS (SELECT *, sum(1-gt) OVER (PARTITION BY series_id ORDER BY rn) AS seg FROM l),
        h AS (SELECT *, max(CASE WHEN gt=1 THEN pred ELSE 0 END) OVER (PARTITION BY series_id, seg) AS hit FROM g)
        SELECT series_id, rn, gt, pred, CASE WHEN gt=1 AND hit=1 AND rn>0 THEN 1 ELSE pred END AS adjusted FROM h""",
)
def point_adjust(spark, folder):
    """Small chunks, so that runs of anomalies cross chunk edges."""
    return adjust(anomaly_labels(spark, folder), KEY, size=16)


_HISTORY = "h AS (SELECT user_id AS run_id, day(ts)::INT AS epoch, avg(value) AS loss FROM events GROUP BY 1, 2)"


@query(
    "early_stop_epoch",
    f"""WITH {_HISTORY}, k AS (SELECT *, row_number() OVER w AS i, min(loss) OVER (PARTITION BY run_id ORDER BY epoch
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM h WINDOW w AS (PARTITION BY run_id ORDER BY epoch)),
        m AS (SELECT *, max(CASE WHEN best IS NULL OR loss<=best THEN i END) OVER (PARTITION BY run_id ORDER BY i) AS since,
              max(CASE WHEN best IS NULL OR loss<=best THEN epoch END) OVER (PARTITION BY run_id ORDER BY i) AS since_epoch FROM k),
        s AS (SELECT run_id, min(epoch) AS stop_epoch FROM m WHERE i-since>=3 GROUP BY 1)
        SELECT m.run_id, any_value(s.stop_epoch) AS stop_epoch,
               max(CASE WHEN s.stop_epoch IS NULL OR m.epoch<=s.stop_epoch THEN since_epoch END) AS best_epoch
        FROM m LEFT JOIN s ON m.run_id=s.run_id GROUP BY 1""",
)
def early_stop_epoch(spark, folder):
    history = training_log.epoch_loss(loss_log(spark, folder))
    return training_log.early_stop(history, patience=3)


_FOLD = """f AS (
  SELECT run_id, i, epoch, loss AS best, 0 AS cnt, epoch AS best_epoch FROM k WHERE i=1
  UNION ALL
  SELECT k.run_id, k.i, k.epoch, CASE WHEN k.loss > f.best-2.0 THEN f.best ELSE k.loss END,
         CASE WHEN k.loss > f.best-2.0 THEN f.cnt+1 ELSE 0 END, CASE WHEN k.loss > f.best-2.0 THEN f.best_epoch ELSE k.epoch END
  FROM f JOIN k ON k.run_id=f.run_id AND k.i=f.i+1)"""


@query(
    "early_stop_epoch_delta",
    f"""WITH RECURSIVE {_HISTORY}, k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS i FROM h), {_FOLD},
        s AS (SELECT run_id, min(epoch) AS stop_epoch FROM f WHERE cnt>=3 GROUP BY 1)
        SELECT f.run_id, any_value(s.stop_epoch) AS stop_epoch,
               max(CASE WHEN s.stop_epoch IS NULL OR f.epoch<=s.stop_epoch THEN best_epoch END) AS best_epoch
        FROM f LEFT JOIN s ON f.run_id=s.run_id GROUP BY 1""",
)
def early_stop_epoch_delta(spark, folder):
    history = training_log.epoch_loss(loss_log(spark, folder))
    return training_log.early_stop(history, patience=3, delta=2.0)


@query(
    "best_candidate",
    f"""WITH {_HISTORY}, o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY loss, epoch DESC) AS k FROM h)
        SELECT run_id, epoch AS best_epoch, round(loss,8)+0.0 AS best_loss, 'epoch-' || epoch AS params FROM o WHERE k=1""",
)
def best_candidate(spark, folder):
    history = training_log.epoch_loss(loss_log(spark, folder)).withColumn("params", F.concat(F.lit("epoch-"), "epoch"))
    best = training_log.best_candidate(history, keep=["params"])
    return best.select("run_id", "best_epoch", r("best_loss", 8).alias("best_loss"), "params")


def _datasets(spark, folder):
    """One dataset per user, with the number of events as its length."""
    events = table(spark, folder, "events")
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("user"), "user_id").alias("dataset"), "n"
    )


def _grid(spark, folder):
    made = runs.experiment_grid(_datasets(spark, folder))
    return made.withColumn("run_id", F.concat_ws("_", "dataset", "features", "pred_len"))


_GRID = """grid AS (SELECT dataset, n, features, pred_len, dataset || '_' || features || '_' || pred_len AS run_id
        FROM (SELECT 'user' || user_id AS dataset, count(*) AS n FROM events GROUP BY user_id),
             (SELECT unnest(['M','S']) AS features), (SELECT unnest([96,192,336,720])::INT AS pred_len))"""


@query("experiment_grid", f"WITH {_GRID} SELECT * FROM grid")
def experiment_grid(spark, folder):
    return _grid(spark, folder)


@query(
    "run_key",
    f"""WITH {_GRID} SELECT 'long_term_forecast_' || dataset || '_336_' || pred_len || '_base_custom_ft' || features
        || '_sl336_ll24_pl' || pred_len || '_dm16_nh4_el2_dl2_df64_ebtimeF_id256_ld256_revinTrue_Exp_0' AS variational,
        'long_term_forecast_' || dataset || '_336_' || pred_len || '_base_custom_ft' || features
        || '_sl336_ll24_pl' || pred_len || '_dm16_nh4_el2_dl2_df64_fc1_ebtimeF_dtTrue_Exp_0' AS plain FROM grid""",
)
def run_key(spark, folder):
    config = {
        "task_name": "long_term_forecast", "model_id": F.concat_ws("_336_", "dataset", "pred_len"), "model": "base",
        "data": "custom", "features": F.col("features"), "seq_len": 336, "label_len": 24, "pred_len": F.col("pred_len"),
        "d_model": 16, "n_heads": 4, "e_layers": 2, "d_layers": 2, "d_ff": 64, "embed": "timeF", "inter_dim": 256,
        "latent_dim": 256, "revin": True, "factor": 1, "distil": True, "des": "Exp", "itr": 0,
    }
    return _grid(spark, folder).select(
        text.run_key(config).alias("variational"), text.run_key(config, variational=False).alias("plain")
    )


@query(
    "pending_runs",
    f"""WITH {_GRID} SELECT run_id FROM grid WHERE run_id NOT IN
        (SELECT 'user' || user_id || '_M_96' FROM events WHERE event_type='error')""",
)
def pending_runs(spark, folder):
    done = table(spark, folder, "events").filter("event_type = 'error'").select(
        F.concat(F.lit("user"), "user_id", F.lit("_M_96")).alias("run_id")
    )
    return runs.pending(_grid(spark, folder), done).select("run_id")


@query(
    "save_forecasts",
    f"WITH {sql.USERS}, {sql.SCALED}, {sql.leads('test', 24, 12, list(range(1, 13)))} SELECT 'user' || series_id AS run_id, "
    "window_id, step, round(pred,6)+0.0 AS pred, round(truth,6)+0.0 AS truth FROM w",
)
def save_forecasts(spark, folder):
    """All steps, written per run group and read back; the run id is the user, in 16 folders by hash.

    Half of the groups are written twice, as by a rerun after a crash.
    """
    path = scratch_path(spark, "forecasts")
    named = naive(spark, folder).withColumn("member", F.concat(F.lit("user"), "series_id"))
    grouped = named.withColumn("run_id", F.pmod(F.xxhash64("series_id"), F.lit(16)))
    writers.save_forecasts(grouped.filter("run_id < 8"), path)
    writers.save_forecasts(grouped, path)
    back = writers.load_forecasts(spark, path)
    return back.select(F.col("member").alias("run_id"), "window_id", "step", r("pred").alias("pred"), r("true").alias("truth"))


@query("append_results", f"{_W} SELECT 'user' || series_id || '_' || half AS run_id, {_ALL} FROM w, (SELECT unnest([1,2]) AS half) GROUP BY series_id, half")
def append_results(spark, folder):
    """Two batches of runs written to one results table, the second one twice."""
    path = scratch_path(spark, "results")
    scored = settled(metrics.bundle(naive(spark, folder), ["series_id"]), "scored")
    for half in (1, 2, 2):
        writers.append_results(scored.withColumn("run_id", F.concat(F.lit("user"), "series_id", F.lit(f"_{half}"))), path)
    return writers.load_results(spark, path).select("run_id", *[r(m, 4).alias(m) for m in FIVE])
