"""Metric snapshots, threshold alerts and history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.numbers import correlation
from tidewell.operators import longseries
from tidewell.operators import summary as sm
from tidewell.panel import BY

# Limits above which a metric raises an alert.
THRESHOLDS = {"mae": 10.0, "missing_rate": 0.05}


def snapshot(df: DataFrame, y="y", yhat: str | None = None, by: Sequence[str] = BY, tie: Sequence[str] = (), extra: Mapping[str, float] | None = None) -> DataFrame:
    """(by..., metrics MAP): data statistics, errors when predictions are given, and own entries.

    Works on series of any length: the lag for the autocorrelation is taken
    part by part.
    """
    part = ("series_id", "part_id")
    prev = F.lag(y, 1).over(Window.partitionBy(*part).orderBy("t"))
    rows = longseries.windowed(df, {"_prev": prev}, reach=1, tie=tie)
    stats = rows.groupBy(*by).agg(
        F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"), F.min(y).alias("min"), F.max(y).alias("max"),
        F.avg(F.col(y).isNull().cast("double")).alias("missing_rate"), correlation(y, "_prev").alias("autocorrelation"), F.regr_slope(y, "t").alias("trend"),
    )
    names = ["mean", "std", "min", "max", "missing_rate", "autocorrelation", "trend"]
    if yhat:
        errors = sm.regression_metrics(rows, by, y, yhat).select(*by, "mae", "mse", "rmse", "mape", "max_error", "r2")
        stats = stats.join(errors, list(by))
        names += ["mae", "mse", "rmse", "mape", "max_error", "r2"]
    pairs = [x for n in names for x in (F.lit(n), F.col(n).cast("double"))]
    for k, v in (extra or {}).items():
        pairs += [F.lit(k), F.lit(float(v))]
    return stats.select(*by, F.create_map(*pairs).alias("metrics"))


def long_metrics(snapshots: DataFrame, keys: Sequence[str]) -> DataFrame:
    return snapshots.select(*keys, F.explode("metrics").alias("metric", "value"))


def alerts(metrics: DataFrame, thresholds: Mapping[str, float] = THRESHOLDS) -> DataFrame:
    """Rows of (…, metric, value) above their limit, with the limit."""
    limit = F.coalesce(*[F.when(F.col("metric") == k, F.lit(float(v))) for k, v in thresholds.items()])
    return metrics.withColumn("threshold", limit).where(F.col("value") > F.col("threshold"))


def history(log: DataFrame, metric: str | None = None, last: int | None = None, order: str = "ts", ties: Sequence[str] = ()) -> DataFrame:
    """The log, or one metric of it, or its last entries per metric."""
    out = log if metric is None else log.where(F.col("metric") == metric)
    if last is None:
        return out
    w = Window.partitionBy("metric").orderBy(F.desc(order), *ties)
    return out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last).drop("_r")
