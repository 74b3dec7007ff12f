"""Outliers, gap weights and degree days of a weather-like panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.numbers import safe_ratio
from tidewell.operators import quantiles as qt
from tidewell.panel import BY


def modified_z(df: DataFrame, value: str = "y", by: Sequence[str] = BY, limit: float = 3.5) -> DataFrame:
    """Rows with modified_z = 0.6745 (x - median) / MAD per group, and outlier = its size is above ``limit``.

    Both medians are exact; a group whose MAD is 0 has no score and no outlier.
    """
    middle = qt.attach(df, qt.quantile_columns(df, value, {"_m": 0.5}, by), by).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    both = qt.attach(middle, qt.quantile_columns(middle, "_d", {"_mad": 0.5}, by), by)
    z = safe_ratio(0.6745 * (F.col(value) - F.col("_m")), F.col("_mad"), None)
    return both.withColumn("modified_z", z).withColumn("outlier", F.coalesce(F.abs("modified_z") > limit, F.lit(False))).drop("_m", "_d", "_mad")


def quartile_scaled(df: DataFrame, value: str = "y", by: Sequence[str] = BY, out: str = "scaled") -> DataFrame:
    """(x - Q1) / (Q3 - Q1) per group; NULL where the quartiles are equal."""
    both = qt.attach(df, qt.quantile_columns(df, value, {"_a": 0.25, "_b": 0.75}, by), by)
    return both.withColumn(out, safe_ratio(F.col(value) - F.col("_a"), F.col("_b") - F.col("_a"), None)).drop("_a", "_b")


def quartile_outliers(df: DataFrame, value: str = "y", by: Sequence[str] = BY, reach: float = 1.5) -> DataFrame:
    """Rows with outlier = beyond ``reach`` interquartile ranges from the quartiles."""
    both = qt.attach(df, qt.quantile_columns(df, value, {"_a": 0.25, "_b": 0.75}, by), by)
    slack = reach * (F.col("_b") - F.col("_a"))
    beyond = (F.col(value) < F.col("_a") - slack) | (F.col(value) > F.col("_b") + slack)
    return both.withColumn("outlier", F.coalesce(beyond, F.lit(False))).drop("_a", "_b")


def weighted_fill(value: str = "y", alpha: float = 0.5, by: Sequence[str] = BY, order: Sequence[str] = ("ts",)) -> Column:
    """A missing value is alpha times the last one before it plus 1 - alpha times the next one; at an end, the one there is."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return F.coalesce(F.col(value), alpha * before + (1 - alpha) * after, before, after)


def degree_days(df: DataFrame, value: str = "y", heat: float = 18.0, cool: float = 18.0, grow: float = 10.0, by: Sequence[str] = BY) -> DataFrame:
    """(by..., heating, cooling, growing): sums of degrees below and above the bases, one row per step."""
    x = F.col(value)
    above = lambda base: F.sum(F.greatest(x - base, F.lit(0.0)))
    return df.where(x.isNotNull()).groupBy(*by).agg(F.sum(F.greatest(heat - x, F.lit(0.0))).alias("heating"), above(cool).alias("cooling"), above(grow).alias("growing"))
