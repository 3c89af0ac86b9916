"""Consecutive 0-based index over the sorted distinct values of a column.

Range-partition the values, number rows inside each partition, and add the
running total of the partition sizes (one number per partition, summed on
the driver and joined back as a tiny table).
The range-partitioned frame is checkpointed to the shared checkpoint folder
first, so the per-partition counts and the row numbers are computed from the
same materialized partitions even if an executor is lost in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.session import ensure_checkpoint_dir

def dense_index(values: DataFrame, col: str, partitions: int | None = None) -> DataFrame:
    """(col, idx) for the distinct values of ``col``; idx follows ascending order."""
    spark = values.sparkSession
    ensure_checkpoint_dir(spark)
    parts = partitions or max(1, spark.sparkContext.defaultParallelism)
    ranged = (values.select(col).distinct().repartitionByRange(parts, col)
              .withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True))
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_pid").orderBy(col)) - 1)
    # per-partition row counts are metadata (one number per partition): their
    # running sum is computed on the driver and joined back as a tiny table
    sizes = sorted((r["_pid"], r["_n"]) for r in ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")).collect())
    running, rows = 0, []
    for pid, n in sizes:
        rows.append(f"({int(pid)}, CAST({running} AS BIGINT))")
        running += n
    offsets = (spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(_pid, _offset)") if rows
               else spark.sql("SELECT CAST(0 AS INT) AS _pid, CAST(0 AS BIGINT) AS _offset WHERE false"))
    index = (local.join(F.broadcast(offsets), "_pid")
             .select(col, (F.col("_offset") + F.col("_local")).cast("bigint").alias("idx")))
    # dimension-sized: materialize so every consumer reads a small leaf
    return index.checkpoint(eager=True)
