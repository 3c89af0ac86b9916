"""Materialized dimensions and scan spreading.

No join is forced: Spark broadcasts a side whose size in bytes it knows to be
below ``spark.sql.autoBroadcastJoinThreshold``, and AQE decides again on
measured sizes.  A dimension that is materialized is a parquet table, so its
size is known when the join is planned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.session import scratch_path


#: Rows of a scan that one task of the CPU-heavy normalization is given.
TASK_ROWS = 250_000


def spread(df: DataFrame, by: list[str], min_partitions: int | None = None) -> DataFrame:
    """Rows dealt by the hash of ``by`` when the scan leaves too many of them to one task.

    A parquet row group is read by one task, however many splits its file has,
    so the rows of each scan task are counted (from the footers, no column is
    read).  A large input in many row groups is left alone (no shuffle); a table
    of few row groups, whatever its size, would otherwise run the normalization
    in as few tasks.
    """
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()]
    want = max(min_partitions or df.sparkSession.sparkContext.defaultParallelism, -(-sum(sizes) // TASK_ROWS))
    if max(sizes, default=0) <= 2 * -(-sum(sizes) // want):
        return df
    # true of every row, and no condition is moved across it: what a later filter computes is computed by the many tasks
    return df.repartition(want, *by).where(F.spark_partition_id() >= 0)


def materialize_dimension(df: DataFrame, tag: str) -> DataFrame:
    """Write a dimension-derived frame under ``spark.checkpoint.dir`` and read it back.

    For small derived lookups (deduplicated registry, version table): the plan
    that uses them reads a leaf of known size.  Written anew on every call, so
    a changed source is seen; never for log-sized frames.
    """
    return written_table(df, f"dimensions/{tag}")


def written_table(df: DataFrame, tag: str) -> DataFrame:
    """Write a frame of any size under ``spark.checkpoint.dir`` and read it back: computed once, a leaf for later plans."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
