"""Skew-safe "previous value in group" (the lag behind GRF5).

A plain ``lag().over(Window.partitionBy(group).orderBy(seq))`` puts every row
of a group into one task; a single hot source holding a third of all logs
would then land on one executor.  Here the window is partitioned by
``(group, seq block)`` instead, so a hot group is spread over as many tasks as
it has blocks.  The first row of each block takes its predecessor from a small
per-block summary (last value of the previous non-empty block of the same
group), computed with a partial ``max_by`` aggregate and a window over blocks
-- a table with at most one row per (group, block).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK_ROWS = 1 << 20
CONF_KEY = "vigil.window.blockRows"


def block_rows(df: DataFrame) -> int:
    value = df.sparkSession.conf.get(CONF_KEY, None)
    return int(value) if value else DEFAULT_BLOCK_ROWS


def previous_in_group(df: DataFrame, group: str, order: str, value: str, out: str,
                      block: int | None = None) -> DataFrame:
    """Add ``out`` = ``value`` of the previous row (by ``order``) in ``group``; NULL for the first.

    ``order`` must be a unique, roughly dense ordinal (the input ``seq``);
    ``value`` must be non-null.
    """
    size = block if block is not None else block_rows(df)
    blk = "_blk"
    # dealt by (group, block) explicitly: an input that is already partitioned by the group alone would
    # satisfy the window and keep a hot group in one task
    with_blk = df.withColumn(blk, F.floor(F.col(order) / F.lit(size)).cast("bigint")).repartition(group, blk)
    in_block = Window.partitionBy(group, blk).orderBy(order)
    lagged = with_blk.withColumn("_prev_in", F.lag(value).over(in_block))
    last_per_block = (with_blk.groupBy(group, blk)
                      .agg(F.max_by(F.col(value), F.col(order)).alias("_last")))
    prev_block = (last_per_block
                  .withColumn("_prev_blk", F.lag("_last").over(Window.partitionBy(group).orderBy(blk)))
                  .select(group, blk, "_prev_blk"))
    joined = lagged.join(prev_block, [group, blk], "left")
    return (joined.withColumn(out, F.coalesce(F.col("_prev_in"), F.col("_prev_blk")))
            .drop(blk, "_prev_in", "_prev_blk"))
