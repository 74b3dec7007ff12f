"""Lag, rolling, expanding and exponential features as window expressions.

Every function adds columns over the same partition and order, so a chain of
them costs one shuffle and one sort.  For long series pass ``by`` with the part
column of ``panel.split_series`` and the reach given by ``reach``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.distribution import bias_corrected_kurtosis, bias_corrected_skew
from tidewell.functions.numbers import correlation, finite_or, safe_ratio
from tidewell.panel import BY, over

START = Window.unboundedPreceding
END = Window.unboundedFollowing
LAGS = (1, 2, 3, 12)
LAGS_DENSE = tuple(range(1, 13))
LAGS_LONG = (1, 2, 3, 6, 9, 12, 24, 36)
LAGS_HOURLY = (1, 24, 168)
ROLLS = (3, 6, 12)


def add(df: DataFrame, columns: dict[str, Column], keep_existing: bool = True) -> DataFrame:
    """Add columns, leaving those that already exist alone."""
    new = {k: v for k, v in columns.items() if not (keep_existing and k in df.columns)}
    return df.withColumns(new) if new else df


def lags(y="y", ks: Sequence[int] = LAGS, by=BY, order=("ts",), prefix="lag_") -> dict[str, Column]:
    w = over(by, order)
    return {f"{prefix}{k}": F.lag(y, k).over(w) for k in ks}


def diffs(y="y", ks=(1, 12), by=BY, order=("ts",), prefix="diff_") -> dict[str, Column]:
    w = over(by, order)
    return {f"{prefix}{k}": F.col(y) - F.lag(y, k).over(w) for k in ks}


def past_frame(w: int, by=BY, order=("ts",)):
    """The ``w`` rows before the current one."""
    return over(by, order).rowsBetween(-w, -1)


def roll_mean(y="y", windows=ROLLS, by=BY, order=("ts",)) -> dict[str, Column]:
    return {f"roll_mean_{w}": F.avg(y).over(past_frame(w, by, order)) for w in windows}


def roll_std(y="y", windows=ROLLS, by=BY, order=("ts",)) -> dict[str, Column]:
    return {f"roll_std_{w}": F.coalesce(F.stddev_samp(y).over(past_frame(w, by, order)), F.lit(0.0)) for w in windows}


def roll_extremes(y="y", windows=ROLLS, by=BY, order=("ts",)) -> dict[str, Column]:
    out = {}
    for w in windows:
        out[f"roll_min_{w}"] = F.min(y).over(past_frame(w, by, order))
        out[f"roll_max_{w}"] = F.max(y).over(past_frame(w, by, order))
    return out


def current_roll(y="y", windows=(3, 12), by=BY, order=("ts",)) -> dict[str, Column]:
    """Rolling mean and deviation that include the current row."""
    out = {}
    for w in windows:
        frame = over(by, order).rowsBetween(-(w - 1), 0)
        out[f"cur_mean_{w}"] = F.avg(y).over(frame)
        out[f"cur_std_{w}"] = F.coalesce(F.stddev_samp(y).over(frame), F.lit(0.0))
    return out


def current_quantile(y="y", windows=(3, 12), p=0.9, by=BY, order=("ts",)) -> dict[str, Column]:
    """Rolling linear quantile; the frame holds at most ``w`` values."""
    name = f"roll_q{int(round(p * 100))}_"
    return {f"{name}{w}": F.percentile(y, F.lit(p)).over(over(by, order).rowsBetween(-(w - 1), 0)) for w in windows}


def back_filled(df: DataFrame, columns: Sequence[str], by=BY, order=("ts",)) -> DataFrame:
    w = over(by, order).rowsBetween(0, END)
    return df.withColumns({c: F.first(c, ignorenulls=True).over(w) for c in columns})


def full_window(y="y", w=10, by=BY, order=("ts",)) -> dict[str, Column]:
    """Mean and deviation only once ``w`` rows are there, 0 before."""
    frame = over(by, order).rowsBetween(-(w - 1), 0)
    ready = F.count(y).over(frame) >= w
    return {
        f"full_mean_{w}": F.when(ready, F.avg(y).over(frame)).otherwise(0.0),
        f"full_std_{w}": F.when(ready, F.stddev_samp(y).over(frame)).otherwise(0.0),
    }


def z_score(y="y", windows=ROLLS, by=BY, order=("ts",)) -> dict[str, Column]:
    """Current value against the previous window.  Uses ``y`` itself: descriptive, not a model input."""
    out = {}
    for w in windows:
        frame = past_frame(w, by, order)
        out[f"roll_zscore_{w}"] = safe_ratio(F.col(y) - F.avg(y).over(frame), F.stddev_samp(y).over(frame))
    return out


def extreme_flag(z: Column, limit: float = 2.0) -> Column:
    return (F.abs(z) > limit).cast("int")


def roll_moments(y="y", windows=(6, 12), by=BY, order=("ts",)) -> dict[str, Column]:
    """Bias-corrected skewness and excess kurtosis of the past window, 0 where undefined."""
    out = {}
    for w in windows:
        frame = past_frame(w, by, order)
        n = F.count(y).over(frame)
        out[f"roll_skew_{w}"] = finite_or(bias_corrected_skew(F.skewness(y).over(frame), n), 0.0)
        out[f"roll_kurt_{w}"] = finite_or(bias_corrected_kurtosis(F.kurtosis(y).over(frame), n), 0.0)
    return out


def expanding(y="y", by=BY, order=("ts",)) -> dict[str, Column]:
    frame = over(by, order).rowsBetween(START, -1)
    return {"cum_mean_past": F.avg(y).over(frame), "cum_std_past": F.coalesce(F.stddev_samp(y).over(frame), F.lit(0.0))}


def with_trend(df: DataFrame, y="y", windows=(12, 24), by=BY, order=("ts",), t="t") -> DataFrame:
    """Rolling least-squares slope of the series shifted by one, leading gap as 0."""
    w = over(by, order)
    shifted = df.withColumn("_z", F.coalesce(F.last(y, ignorenulls=True).over(w.rowsBetween(START, -1)), F.lit(0.0)))
    slopes = {
        f"roll_trend_{k}": F.coalesce(F.regr_slope("_z", t).over(w.rowsBetween(-(k - 1), 0)), F.lit(0.0)) for k in windows
    }
    return shifted.withColumns(slopes).drop("_z")


def with_autocorrelation(df: DataFrame, y="y", ks=(1, 12, 24), window=36, by=BY, order=("ts",)) -> DataFrame:
    """Autocorrelation inside a rolling window of the series shifted by one."""
    w = over(by, order)
    cols = {"_a": F.lag(y, 1).over(w)} | {f"_b{k}": F.lag(y, 1 + k).over(w) for k in ks}
    out = df.withColumns(cols).withColumns(
        {
            f"autocorr_lag_{k}": finite_or(correlation("_a", f"_b{k}", w.rowsBetween(-(window - 1 - k), 0)), 0.0)
            for k in ks
        }
    )
    return out.drop(*cols)


def ewm_depth(span: float) -> int:
    """Rows after which the weight of the oldest value is below double precision."""
    return math.ceil(-40.0 / math.log(1 - 2 / (span + 1)))


def ewm(y="y", span: int = 12, by=BY, order=("ts",)) -> dict[str, Column]:
    """Recursive exponential mean of the past rows (``adjust=False``).

    Over missing values the weight of what came before goes on falling, row by row.  The frame stops where older weights no longer change a double, so the cost
    per row is constant however long the series is.
    """
    a = 2.0 / (span + 1)
    past = F.collect_list(F.struct(F.col(y).cast("double").alias("x"))).over(over(by, order).rowsBetween(-ewm_depth(span), -1))
    start = F.struct(F.lit(None).cast("double").alias("v"), F.lit(1.0).alias("w"))

    def step(s: Column, r: Column) -> Column:
        x, w = r["x"], s["w"] * (1 - a)
        mean = F.when(s["v"].isNull(), x).otherwise((w * s["v"] + a * x) / (w + a))
        return F.when(x.isNull(), F.struct(s["v"].alias("v"), F.when(s["v"].isNull(), F.lit(1.0)).otherwise(w).alias("w"))).otherwise(F.struct(mean.alias("v"), F.lit(1.0).alias("w")))

    return {f"ewm_{span}": F.aggregate(past, start, step, lambda s: s["v"])}


def residual_window(n: int) -> int:
    return max(3, min(24, n // 10))


def residual_rolls(residual="residual", window=None, by=BY, order=("ts",)) -> dict[str, Column]:
    frame = over(by, order).rowsBetween(-(window - 1), 0)
    return {"roll_mae": F.avg(F.abs(residual)).over(frame), "roll_bias": F.avg(residual).over(frame)}


def tail_rows(df: DataFrame, n: int, by=BY, order=("ts",)) -> DataFrame:
    """Last ``n`` rows per series in time order."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def head_rows(df: DataFrame, n: int, by=BY, order=("ts",)) -> DataFrame:
    w = over(by, order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def naive_forecast(df: DataFrame, y="y", n: int = 12, by=BY, order=("ts",)) -> DataFrame:
    """Mean and sample variance of the last ``n`` rows per series."""
    return tail_rows(df, n, by, order).groupBy(*by).agg(
        F.avg(y).alias("mu"), F.coalesce(F.var_samp(y), F.lit(0.0)).alias("var"), F.lit("naive").alias("mode")
    )


# Least-squares quadratic over five points, for the middle point
# and for the first and second point of the end window.
SMOOTH_MID = (-3.0, 12.0, 17.0, 12.0, -3.0)
SMOOTH_EDGE = ((31.0, 9.0, -3.0, -5.0, 3.0), (9.0, 13.0, 12.0, 6.0, -5.0))


def smooth5(df: DataFrame, y="y", out="smooth", by=BY, order=("ts",)) -> DataFrame:
    """Five-point quadratic smoothing; the ends use the fitted end polynomial.

    Series shorter than five rows are returned unchanged.
    """
    w = over(by, order)
    shift = {f"_s{k}": (F.lag(y, -k) if k < 0 else F.lead(y, k)).over(w) for k in range(-4, 5) if k}
    sh = df.withColumns({k.replace("-", "m"): v for k, v in shift.items()}).withColumn("_s0", F.col(y))

    def at(k: int) -> Column:
        return F.col(f"_s{k}".replace("-", "m"))

    def dot(weights, offsets) -> Column:
        total = at(offsets[0]) * (weights[0] / 35.0)
        for c, k in zip(weights[1:], offsets[1:]):
            total = total + at(k) * (c / 35.0)
        return total

    first, second = SMOOTH_EDGE
    value = F.coalesce(
        dot(SMOOTH_MID, (-2, -1, 0, 1, 2)),
        F.when(at(-1).isNull(), dot(first, (0, 1, 2, 3, 4))),
        F.when(at(-2).isNull(), dot(second, (-1, 0, 1, 2, 3))),
        F.when(at(1).isNull(), dot(first, (0, -1, -2, -3, -4))),
        F.when(at(2).isNull(), dot(second, (1, 0, -1, -2, -3))),
        F.col(y),
    )
    return sh.withColumn(out, value).drop(*[f"_s{k}".replace("-", "m") for k in range(-4, 5)])
