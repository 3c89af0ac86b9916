"""As-of lookup of a boundary table (ING2).

Each input row gets the value of the boundary with the greatest
``start <= key``; rows below every start (and rows without a key) get the first boundary's value; an
empty boundary table yields ``default``.  Boundaries with equal starts keep
the last one in (start, seq) order.

A few boundaries (at most ``few``, counted) become a balanced CASE expression:
no shuffle, generated code.  More are looked up by a prefix scan: the distinct
keys and the boundaries are dealt by ranges of the key, the last boundary is
carried forward inside a range, and each range is told the last boundary of
the ranges before it (one row per range).  Only keys go through the scan, each
once, so a key that a third of all rows hold is one row of it; the rows then
take their value by a join on the key, which AQE splits where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.prefix import carried, in_ranges

FEW = 64


def _case(key: Column, steps: list[tuple[int, Column]], below: Column) -> Column:
    """The value of the last step at or before ``key``, by halving."""
    if not steps:
        return below
    mid = len(steps) // 2
    start, value = steps[mid]
    return F.when(key >= start, _case(key, steps[mid + 1:], value)).otherwise(_case(key, steps[:mid], below))


def asof_lookup(df: DataFrame, key: str, boundaries: DataFrame, start: str, value: str, out: str,
                default=1, order: str = "seq", few: int = FEW, partitions: int | None = None) -> DataFrame:
    """``df`` with ``out``: the value of the boundary that holds at ``key`` (a null key: the first one's)."""
    # equal starts: the later one (by order) wins
    b = (boundaries.select(F.col(start).cast("bigint").alias("_k"), F.col(value).alias("_v"), F.col(order).alias("_o"))
         .where(F.col("_k").isNotNull()).groupBy("_k").agg(F.max_by("_v", "_o").alias("_v")))
    own = F.col(key).cast("bigint")
    found = b.where("_v is not null").limit(few + 1).collect()
    if len(found) <= few:
        first = b.agg(F.min_by("_v", "_k")).first()[0]
        kind = b.schema["_v"].dataType
        below = F.coalesce(F.lit(first).cast(kind), F.lit(default))
        steps = [(r["_k"], F.lit(r["_v"]).cast(kind)) for r in sorted(found)]
        return df.withColumn(out, F.when(own.isNull(), below).otherwise(_case(own, steps, below)))
    first = b.agg(F.min_by("_v", "_k")).scalar()
    keys = df.select(own.alias("_k")).where("_k is not null").distinct()
    both = keys.withColumn("_row", F.lit(1)).unionByName(b.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    ranged = in_ranges(both, ["_k", "_row"], "asof", partitions)
    boundary = F.when(F.col("_row") == 0, F.col("_v"))
    before = carried(ranged, F.max_by("_v", F.when(boundary.isNotNull(), F.col("_local"))), "_carry")
    inside = Window.partitionBy("_part").orderBy("_local").rowsBetween(Window.unboundedPreceding, 0)
    held = ranged.withColumn("_held", F.last(boundary, ignorenulls=True).over(inside)).where("_row = 1")
    held = held.join(before, "_part", "left").select(F.col("_k"), F.coalesce("_held", "_carry").alias("_found"))
    return (df.withColumn("_key", own).join(held, F.col("_key") == F.col("_k"), "left")
            .withColumn(out, F.coalesce("_found", first, F.lit(default))).drop("_key", "_k", "_found"))
