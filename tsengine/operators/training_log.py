"""Queries over the loss logs of many training runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tsengine.operators.chunks import SIZE, row_index, running, with_chunk
from tsengine.session import settled


def epoch_loss(log: DataFrame, by: Sequence[str] = ("run_id", "epoch"), loss: str = "loss") -> DataFrame:
    """Mean loss of the steps of each epoch."""
    return log.groupBy(*by).agg(F.avg(loss).alias("loss"))


def _records(history: DataFrame, keys: Sequence[str], loss: str, size: int) -> DataFrame:
    """Epochs strictly better than all before them."""
    best = running(history, keys, F.col(loss), "min", "_best", exclusive=True, size=size)
    return best.filter(F.col("_best").isNull() | (F.col(loss) < F.col("_best"))).drop("_best")


def next_lower(records: DataFrame, keys: Sequence[str], loss: str, delta: float, size: int = SIZE) -> DataFrame:
    """For every record the first later one at least ``delta`` lower: keys, ``rn``, ``next``.

    Records fall along a run, so a chunk's last one is its least, and the records that
    those of one chunk may be followed by lie in a span of chunks. Spans are found on one
    row per chunk; all spans together are at most twice the chunks. Records then meet
    only the chunks of their span.
    """
    rows = with_chunk(records, size).select(*keys, "rn", "chunk", loss)
    order = Window.partitionBy(*keys).orderBy("chunk")
    ends = (
        rows.groupBy(*keys, "chunk")
        .agg(F.max(loss).alias("_high"), F.min(loss).alias("_low"))
        .withColumns({"_no": F.row_number().over(order), "_last": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    )
    wanted = [(0, F.col("_low")), (1, F.col("_high") - delta), (2, F.col("_low") - delta)]
    events = ends.select(
        *keys, "_no", "_last", F.inline(F.array(*[F.struct(F.lit(k).alias("_kind"), v.alias("_value")) for k, v in wanted]))
    )
    # In rising order the last chunk before a wanted value is the first chunk of the run that goes so low.
    rising = Window.partitionBy(*keys).orderBy("_value", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = events.withColumn("_at", F.last(F.when(F.col("_kind") == 0, F.col("_no")), ignorenulls=True).over(rising))
    spans = (
        found.groupBy(*keys, "_no", "_last")
        .agg(F.max(F.when(F.col("_kind") == 1, F.col("_at"))).alias("_from"), F.max(F.when(F.col("_kind") == 2, F.col("_at"))).alias("_to"))
        .filter("_from is not null")
        .select(*keys, "_no", F.explode(F.sequence("_from", F.coalesce("_to", F.col("_last").cast("int")))).alias("_target"))
    )
    placed = rows.join(ends.select(*keys, "chunk", "_no"), [*keys, "chunk"])
    targets = placed.withColumnRenamed("_no", "_target").join(spans, [*keys, "_target"])
    askers = placed.join(spans, [*keys, "_no"])
    pair = [*keys, "_no", "_target"]
    met = targets.select(*pair, "rn", F.lit(0).alias("_kind"), F.col(loss).alias("_value")).unionByName(
        askers.select(*pair, "rn", F.lit(1).alias("_kind"), (F.col(loss) - delta).alias("_value"))
    )
    inside = Window.partitionBy(*pair).orderBy("_value", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    asked = met.withColumn("_next", F.last(F.when(F.col("_kind") == 0, F.col("rn")), ignorenulls=True).over(inside))
    return asked.filter("_kind = 1 and _next is not null").groupBy(*keys, "rn").agg(F.min("_next").alias("next"))


def reached(pointers: DataFrame, starts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, rn) of all rows on the paths from ``starts`` along ``pointers`` (keys, rn, next).

    Pointer doubling: after k rounds the rows up to 2^k steps away are known and a
    pointer skips 2^k rows, so a path of a million steps takes twenty rounds. Joins are
    on (keys, rn), never on a run alone.
    """
    known, jumps = settled(starts.select(*keys, "rn"), "path"), settled(pointers.select(*keys, "rn", "next"), "jumps")
    while not jumps.isEmpty():
        ahead = known.join(jumps, [*keys, "rn"]).select(*keys, F.col("next").alias("rn"))
        known = settled(known.unionByName(ahead), "path")
        onward = jumps.select(*keys, F.col("rn").alias("next"), F.col("next").alias("_far"))
        jumps = settled(jumps.join(onward, [*keys, "next"]).select(*keys, "rn", F.col("_far").alias("next")), "jumps")
    return known


def _improvements(history: DataFrame, keys: Sequence[str], loss: str, delta: float, size: int) -> DataFrame:
    """(keys, rn) of the epochs that beat the last accepted one by at least ``delta``.

    Whether an epoch counts depends on the ones accepted before it. Only strict records
    can count; each record's successor doesn't depend on the others, and the accepted
    epochs are those on the path of successors from the first one.
    """
    records = settled(_records(history, keys, loss, size).select(*keys, "rn", loss), "records")
    first = records.filter("rn = 0")
    return reached(next_lower(records, keys, loss, delta, size), first, keys)


def early_stop(
    history: DataFrame,
    run: str = "run_id",
    epoch: str = "epoch",
    loss: str = "loss",
    patience: int = 7,
    delta: float = 0.0,
    size: int = SIZE,
) -> DataFrame:
    """Per run: ``stop_epoch`` (NULL if it never stops) and ``best_epoch`` up to there.

    An epoch worse than the best one minus ``delta`` counts; any other one, ties
    included when delta is 0, is the new best and resets the count. The run
    stops when the count reaches ``patience``.
    """
    if delta < 0 or patience < 1:
        raise ValueError("delta must not be negative and patience must be at least 1")
    keys = [run]
    block = F.expr(f"cast(floor(`{epoch}` / {size}) as bigint)")
    ranked = with_chunk(row_index(history.select(run, epoch, loss), keys, epoch, block), size)
    if delta == 0:
        marked = running(ranked, keys, F.col(loss), "min", "_best", exclusive=True, size=size).withColumn(
            "_improved", F.col("_best").isNull() | (F.col(loss) <= F.col("_best"))
        )
    else:
        accepted = _improvements(ranked, keys, loss, delta, size).withColumn("_improved", F.lit(True))
        marked = ranked.join(accepted, [*keys, "rn"], "left").fillna(False, ["_improved"])
    place = F.when(F.col("_improved"), F.struct(F.col("rn"), F.col(epoch).alias("epoch")))
    followed = running(marked, keys, place, "max", "_since", size=size)
    stops = F.when(F.col("rn") - F.col("_since")["rn"] >= patience, F.struct("rn", F.col(epoch).alias("epoch"), "_since"))
    return (
        followed.groupBy(run)
        .agg(F.min(stops).alias("_stop"), F.max(place).alias("_best"))
        .select(
            run,
            F.col("_stop")["epoch"].alias("stop_epoch"),
            F.coalesce(F.col("_stop")["_since"]["epoch"], F.col("_best")["epoch"]).alias("best_epoch"),
        )
    )


def best_candidate(
    history: DataFrame, run: str = "run_id", epoch: str = "epoch", loss: str = "loss", keep: Sequence[str] = ()
) -> DataFrame:
    """Per run: the epoch of lowest loss and its ``keep`` columns; a tie keeps the later epoch."""
    order = F.struct(F.col(loss), -F.col(epoch))
    return history.groupBy(run).agg(
        F.min_by(epoch, order).alias("best_epoch"),
        F.min(loss).alias("best_loss"),
        *[F.min_by(c, order).alias(c) for c in keep],
    )
