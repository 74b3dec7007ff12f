"""Running totals over a global order, without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def slots_for(rows: int, per_slot: int = 2_000) -> int:
    return max(1, -(-rows // per_slot))


def running(df: DataFrame, group: list[str], draw: Column, order: list[Column], value: Column, slots: int, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows of the group up to and including this one.

    ``draw`` is a number in [0, 1) that comes first in the order.  Its range is cut into
    ``slots`` so that a hot group spreads over as many tasks; only the slots' totals are
    summed in a row per group.  Group columns must not be null.
    """
    cut = df.withColumn("_draw", draw).withColumn("_slot", F.least(F.floor(F.col("_draw") * slots), F.lit(slots - 1)).cast("int")).withColumn("_value", value)
    inside = W.partitionBy(*group, "_slot").orderBy("_draw", *order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*group).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    totals = cut.groupBy(*group, "_slot").agg(F.sum("_value").alias("_total")).withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    joined = cut.withColumn("_inside", F.sum("_value").over(inside)).join(totals, [*group, "_slot"])
    return joined.withColumn(name, F.col("_inside") + F.col("_before")).drop("_draw", "_slot", "_value", "_inside", "_before")
