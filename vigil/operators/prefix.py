"""Places and running values over an order of all rows, without a task that sees them all.

Rows are dealt by ranges of the order, sorted inside each range and written
with the number of their range (``_part``) and their place in it (``_local``).
What earlier ranges leave to a range is one row per range: it is folded on the
driver and comes back as a table of that many rows.  The number of ranges is
the session's number of shuffle partitions unless given, whatever the input.

Rows that are equal in the whole order share a range, so an order with hot
values needs a last column that tells rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.sizing import written_table

_PLACE = (1 << 33) - 1  # the bits of monotonically_increasing_id below the partition


def in_ranges(df: DataFrame, order: list[Column | str], tag: str, partitions: int | None = None) -> DataFrame:
    """``df`` written in order, with ``_part`` (range, ascending) and ``_local`` (place in the range, from 0)."""
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return written_table(dealt.withColumn("_part", F.spark_partition_id())
                         .withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))), tag)


def running_totals(ranged: DataFrame, total: Column, out: str) -> DataFrame:
    """(_part, ``out``): the sum of ``total`` (an aggregate, bigint) over the ranges before each range."""
    rows, running = [], 0
    for part, n in sorted(ranged.groupBy("_part").agg(total.cast("long").alias("n")).collect()):
        rows.append((part, running))
        running += n or 0
    return ranged.sparkSession.createDataFrame(rows, f"_part int, {out} long")


def carried(ranged: DataFrame, last: Column, out: str) -> DataFrame:
    """(_part, ``out``): the last non-null ``last`` (an aggregate) over the ranges before each range, null in front."""
    per_range = ranged.groupBy("_part").agg(last.alias(out))
    rows, held = [], None
    for part, value in sorted(per_range.collect(), key=lambda r: r[0]):
        rows.append((part, held))
        held = held if value is None else value
    return ranged.sparkSession.createDataFrame(rows, per_range.schema)


def with_ordinal(df: DataFrame, order: list[Column | str], out: str, tag: str, partitions: int | None = None) -> DataFrame:
    """``df`` with ``out``: the 0-based place of each row in ``order``."""
    ranged = in_ranges(df, order, tag, partitions)
    before = running_totals(ranged, F.count(F.lit(1)), "_before")
    return (ranged.join(before, "_part").withColumn(out, F.col("_before") + F.col("_local"))
            .drop("_part", "_local", "_before"))


def chunked(df: DataFrame, by: list[str], value: str, size: int, tag: str) -> DataFrame:
    """(*by, chunk, members): the distinct non-null ``value`` of each group, sorted, in arrays of at most ``size``.

    Chunk numbers start at 0 in each group; members of a chunk come before those of the next.
    """
    placed = with_ordinal(df.select(*by, value).where(F.col(value).isNotNull()).distinct(), [*by, value], "_at", tag)
    if by:
        first = placed.groupBy(*by).agg(F.min("_at").alias("_first"))
        for c in by:
            first = first.withColumnRenamed(c, f"_by_{c}")
        same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
        placed = placed.join(first, same).withColumn("_at", F.col("_at") - F.col("_first"))
    return (placed.groupBy(*by, F.floor(F.col("_at") / size).cast("long").alias("chunk"))
            .agg(F.sort_array(F.collect_list(value)).alias("members")))


def running_in_order(df: DataFrame, order: list[Column | str], n: str, out: str, tag: str, partitions: int | None = None) -> DataFrame:
    """``df`` (rows distinct in ``order``) with ``out``: the sum of ``n`` over the rows before, written."""
    ranged = in_ranges(df, order, tag, partitions)
    before = running_totals(ranged, F.sum(n), "_before")
    inside = Window.partitionBy("_part").orderBy("_local").rowsBetween(Window.unboundedPreceding, -1)
    out_col = F.col("_before") + F.coalesce(F.sum(n).over(inside), F.lit(0))
    return written_table(ranged.join(before, "_part").withColumn(out, out_col).drop("_part", "_local", "_before"), f"{tag}-sums")
