"""Point adjustment of anomaly predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tsengine.operators.chunks import SIZE, running, with_chunk


def point_adjust(
    df: DataFrame, keys: Sequence[str], gt: str = "gt", pred: str = "pred", size: int = SIZE, rn: str = "rn"
) -> DataFrame:
    """Add ``adjusted``: a run of gt = 1 with any hit counts as wholly predicted.

    Position 0 is never filled in from a later hit. Predictions outside runs
    stay. A run is named by the last normal position before it. Hits are found
    inside each chunk; a run that crosses chunk edges is settled on a summary
    with two rows per chunk (the run it begins in and the run it ends in), so
    neither a hot series nor an endless run gathers in one task.
    """
    chunks = with_chunk(df, size, rn)
    normal_at = F.when(F.col(gt) != 1, F.col(rn))
    named = running(chunks, keys, normal_at, "max", "_run", size=size, rn=rn).withColumn(
        "_run", F.coalesce("_run", F.lit(-1).cast("bigint"))
    )
    hit = F.when((F.col(gt) == 1) & (F.col(pred) == 1), 1).otherwise(0)
    local = named.withColumn("_hit", hit).withColumn(
        "_inside", F.max("_hit").over(Window.partitionBy(*keys, "chunk", "_run"))
    )
    edges = (
        local.groupBy(*keys, "chunk")
        .agg(
            F.min(F.struct(F.col(rn), "_run", "_inside")).alias("_first"),
            F.max(F.struct(F.col(rn), "_run", "_inside")).alias("_last"),
        )
        .select(
            *keys,
            "chunk",
            F.inline(
                F.array(*[F.struct(F.lit(side).alias("_side"), F.col(f"_{side}")["_run"].alias("_run"),
                                   F.col(f"_{side}")["_inside"].alias("_inside")) for side in ("first", "last")])
            ),
        )
        .withColumn("_whole", F.max("_inside").over(Window.partitionBy(*keys, "_run")))
        .groupBy(*keys, "chunk")
        .agg(
            F.max(F.when(F.col("_side") == "first", F.struct("_run", "_whole"))).alias("_head"),
            F.max(F.when(F.col("_side") == "last", F.struct("_run", "_whole"))).alias("_tail"),
        )
    )
    settled = local.join(edges.hint("shuffle_hash"), [*keys, "chunk"])
    found = F.greatest(
        F.col("_inside"),
        F.when(F.col("_run") == F.col("_head")["_run"], F.col("_head")["_whole"]).otherwise(0),
        F.when(F.col("_run") == F.col("_tail")["_run"], F.col("_tail")["_whole"]).otherwise(0),
    )
    filled = F.when((F.col(gt) == 1) & (found == 1) & (F.col(rn) > 0), 1).otherwise(F.col(pred))
    return settled.withColumn("adjusted", filled).drop("chunk", "_run", "_hit", "_inside", "_head", "_tail")
