"""The panel contract: one row per (series_id, ts), value ``y``, NaN held as NULL.

Two shapes of series exist:

* **grained** panels come out of ``to_panel``: one row per calendar step, so a
  series is never longer than the calendar and a plain series window is safe
  whatever the number of source rows;
* **long** series (raw events) have no such bound.  ``number_rows`` positions
  their rows without sorting a series in one task, and ``split_series`` cuts
  them into parts of fixed length with overlap, so that every bounded window
  runs per (series, part) instead of per series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BY = ("series_id",)
PART = "part_id"
HALO = "is_halo"


def exact_mean(value: Column, scale: int | None = None) -> Column:
    """Mean of the values as they are, or, for values known to have ``scale`` decimals, through
    a decimal sum, whose result does not depend on row order."""
    if scale is None:
        return F.avg(value)
    return F.sum(value.cast(f"decimal(18,{scale})")).cast("double") / F.nullif(F.count(value), F.lit(0))


def null_nan(value: Column) -> Column:
    """Spark aggregates skip NULL but not NaN."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def to_panel(df: DataFrame, key: Column, ts: Column, value: Column, grain: str, scale: int | None = None) -> DataFrame:
    """Mean per series and calendar step; partial sums are combined map-side."""
    v = null_nan(value)
    means = df.groupBy(key.alias("_key"), F.date_trunc(grain, ts).alias("ts")).agg(exact_mean(v, scale).alias("y"))
    return means.select(F.col("_key").cast("string").alias("series_id"), "ts", "y")


def over(by: Sequence[str] = BY, order: Sequence[str] = ("ts",)) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def with_position(df: DataFrame, by: Sequence[str] = BY, order: Sequence[str] = ("ts",), count: bool = False) -> DataFrame:
    """Row position ``t`` from 0 (and series length ``n``) of a grained panel."""
    out = df.withColumn("t", F.row_number().over(over(by, order)) - 1)
    if count:
        out = out.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    return out


def number_rows(
    df: DataFrame,
    by: Sequence[str] = BY,
    ts: str = "ts",
    tie: Sequence[str] = (),
    slot: str = "hour",
) -> DataFrame:
    """Position ``t`` and length ``n`` for long series.

    Rows are counted per calendar slot (combined map-side), the slot counts are
    summed up in time order, and rows are only sorted inside their own slot.
    The series-wide window sees one row per slot, never the rows themselves.
    """
    slotted = df.withColumn("_slot", F.date_trunc(slot, F.col(ts)))
    counts = slotted.groupBy(*by, "_slot").agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy(*by).orderBy("_slot")
    offsets = counts.select(
        *by,
        "_slot",
        (F.sum("_c").over(run) - F.col("_c")).alias("_before"),
        F.sum("_c").over(Window.partitionBy(*by)).alias("n"),
    )
    inner = Window.partitionBy(*by, "_slot").orderBy(ts, *tie)
    return (
        slotted.join(offsets, [*by, "_slot"])
        .withColumn("t", F.col("_before") + F.row_number().over(inner) - 1)
        .drop("_slot", "_before")
    )


def split_series(df: DataFrame, part_rows: int, before: int = 0, after: int = 0) -> DataFrame:
    """Parts of ``part_rows`` positions, each with copies of its neighbours' edge rows.

    ``before``/``after`` is the reach of the widest window that will run; it
    must not exceed ``part_rows``.  Needs ``t`` (see ``number_rows``).
    """
    if max(before, after) > part_rows:
        raise ValueError("window reach must not exceed the part length")
    home = F.floor(F.col("t") / part_rows)
    place = F.col("t") % part_rows
    homes = [F.struct(home.alias(PART), F.lit(False).alias(HALO))]
    if before:
        homes.append(F.when(place >= part_rows - before, F.struct((home + 1).alias(PART), F.lit(True).alias(HALO))))
    if after:
        homes.append(F.when((place < after) & (home > 0), F.struct((home - 1).alias(PART), F.lit(True).alias(HALO))))
    return (
        df.withColumn("_p", F.explode(F.array_compact(F.array(*homes))))
        .withColumn(PART, F.col(f"_p.{PART}"))
        .withColumn(HALO, F.col(f"_p.{HALO}"))
        .drop("_p")
    )


def join_parts(df: DataFrame) -> DataFrame:
    """Drop the overlap again."""
    return df.where(~F.col(HALO)).drop(PART, HALO)
