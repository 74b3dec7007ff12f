"""Feature bundles: named compositions of calendar and window features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import arrays, calendar
from tidewell.operators import windows as win
from tidewell.panel import BY, over, with_position

# Columns that use the target of the same row: description only, never model input.
LEAKY = ("diff_1", "diff_12", "roll_zscore_", "zscore_12", "is_extreme_12", "stl_", "month_mean_all", "month_std_all", "year_mean", "year_std")


def leak_free(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if not c.startswith(LEAKY)]


def lag_matrix(df: DataFrame, n_lags: int = 12, windows=(3, 6, 12), dummies: bool = False, by=BY, order=("ts",)) -> DataFrame:
    """Lags 1..n, leak-free rolling means and the month cycle; incomplete rows dropped."""
    month = F.month("ts")
    s, c = calendar.cycle(month)
    cols = win.lags(ks=range(1, n_lags + 1), by=by, order=order) | win.roll_mean(windows=windows, by=by, order=order)
    cols |= {"month_num": month, "month_sin": s, "month_cos": c}
    if dummies:
        cols |= calendar.month_dummies(month)
    return win.add(df, cols).na.drop("any")


def aggregate_features(df: DataFrame, by=BY, order=("ts",)) -> DataFrame:
    """Month and year statistics joined to the rows, past windows and lags."""
    month, year = F.month("ts"), F.year("ts")
    out = df.withColumns({"year": year, "month_num": month})
    out = group_stats(out, ("month_num",), "month_mean_all", "month_std_all", by=by)
    cols = win.roll_mean(by=by, order=order) | win.roll_std(by=by, order=order)
    past = win.expanding(by=by, order=order)
    cols |= {"expanding_mean_prev": past["cum_mean_past"], "expanding_std_prev": past["cum_std_past"]}
    cols |= win.lags(by=by, order=order)
    s, c = calendar.cycle(F.col("month_num"))
    cols |= {"month_sin": s, "month_cos": c}
    out = win.add(out, cols)
    return group_stats(out, ("year",), "year_mean", "year_std", by=by).na.drop("any")


def group_stats(df: DataFrame, group: Sequence[str], mean: str, std: str, y="y", by=BY) -> DataFrame:
    """Group mean and sample deviation on every row, without a join."""
    w = Window.partitionBy(*by, *group)
    return df.withColumns({mean: F.avg(y).over(w), std: F.stddev_samp(y).over(w)})


def drop_warmup(df: DataFrame, rows: int, by=BY, t="t") -> DataFrame:
    """Drop the first ``rows`` rows of a series that has more than that."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return df.withColumn("_n", n).where((F.col(t) >= rows) | (F.col("_n") <= rows)).drop("_n")


def extended_features(
    df: DataFrame, lags=win.LAGS_LONG, windows=(3, 6, 12, 24), harmonics=(1, 2, 3), drop_initial=True, by=BY, order=("ts",)
) -> DataFrame:
    """The wide descriptive bundle: calendar, lags, rolls, trend, autocorrelation, interactions."""
    out = with_position(df, by, order)
    month = F.month("ts")
    s, c = calendar.cycle(month, phase=1)
    cols = {"year": F.year("ts"), "month_num": month, "quarter": calendar.quarter_of(month), "season": calendar.season_of(month)}
    cols |= {"month_sin": s, "month_cos": c} | calendar.fourier_terms(F.col("t"), harmonics)
    for part in (win.lags(ks=lags, by=by, order=order, prefix="y_lag_"), win.diffs(by=by, order=order)):
        cols |= part
    for fn in (win.roll_mean, win.roll_std, win.roll_extremes, win.z_score):
        cols |= fn(windows=windows, by=by, order=order)
    cols |= win.roll_moments(by=by, order=order)
    cols["cum_mean_past"] = win.expanding(by=by, order=order)["cum_mean_past"]
    out = win.add(out, cols)
    out = win.with_trend(out, by=by, order=order)
    out = win.with_autocorrelation(out, by=by, order=order)
    out = with_interactions(out)
    return drop_warmup(out, max(*lags, *windows) + 1, by) if drop_initial else out


def with_interactions(df: DataFrame, lag_prefix="y_lag_") -> DataFrame:
    """Lag x month cycle, rolling mean x year, and the extreme flag."""
    cols = {}
    for k in (1, 12):
        for trig in ("sin", "cos"):
            cols[f"{lag_prefix}{k}_x_month_{trig}"] = F.col(f"{lag_prefix}{k}") * F.col(f"month_{trig}")
    for w in (3, 12):
        cols[f"roll_mean_{w}_x_year"] = F.col(f"roll_mean_{w}") * F.col("year")
    out = win.add(df, cols)
    out = win.add(out, {"zscore_12": F.col("roll_zscore_12")})
    return win.add(out, {"is_extreme_12": win.extreme_flag(F.col("zscore_12"))})


def simple_extended(df: DataFrame, lags=win.LAGS, windows=win.ROLLS, drop_initial=True, by=BY, order=("ts",), target="y") -> DataFrame:
    """Smaller bundle in which every lag appears under three names."""
    out = with_position(df, by, order)
    month = F.month("ts")
    s, c = calendar.cycle(month, phase=1)
    cols = {"month_num": month, "month_sin": s, "month_cos": c}
    for prefix in (f"{target}_lag_", "lag_", "y_lag_"):
        cols |= win.lags(ks=lags, by=by, order=order, prefix=prefix)
    cols |= win.diffs(by=by, order=order)
    rolled = win.roll_mean(windows=windows, by=by, order=order) | win.roll_std(windows=windows, by=by, order=order)
    cols |= rolled | {f"y_{k}": v for k, v in rolled.items()}
    out = win.add(out, cols)
    return drop_warmup(out, max(*lags, *windows) + 1, by) if drop_initial else out


def builder_features(df: DataFrame, lags=win.LAGS, windows=win.ROLLS, by=BY, order=("ts",)) -> DataFrame:
    """Calendar parts, lags and rolls; columns that exist already are kept."""
    parts = calendar.calendar_parts(F.col("ts"))
    s, c = calendar.cycle(F.month("ts"))
    cols = parts | {"month_sin": s, "month_cos": c}
    cols |= win.lags(ks=lags, by=by, order=order) | win.roll_mean(windows=windows, by=by, order=order)
    return win.add(df, cols | win.roll_std(windows=windows, by=by, order=order))


def model_features(df: DataFrame, exogenous: Sequence[str] = (), by=BY, order=("ts",)) -> DataFrame:
    """The modelling bundle: lags, rolls, exponential mean, diffs, calendar, Fourier, exogenous columns."""
    out = with_position(df, by, order)
    cols = win.lags(by=by, order=order)
    for fn in (win.roll_mean, win.roll_std, win.roll_extremes):
        cols |= fn(by=by, order=order)
    cols |= win.ewm(by=by, order=order) | win.diffs(by=by, order=order, prefix="trend_diff_")
    month = F.month("ts")
    s, c = calendar.cycle(month)
    cols |= {"month": month, "day": F.dayofmonth("ts"), "year": F.year("ts"), "month_sin": s, "month_cos": c}
    cols |= calendar.fourier_terms(F.col("t"))
    cols |= {f"exog_{x}": F.col(x).cast("double") for x in exogenous}
    return win.add(out, cols)


def safe_lag_features(df: DataFrame, by=BY, order=("ts",)) -> DataFrame:
    """Lags, one rolling mean, the exponential mean and the month cycle: no leakage."""
    s, c = calendar.cycle(F.month("ts"))
    cols = win.lags(by=by, order=order) | win.roll_mean(windows=(3,), by=by, order=order) | win.ewm(by=by, order=order)
    return win.add(df, cols | {"month_sin": s, "month_cos": c})


def candidate_features(df: DataFrame, lags=(1, 2, 3, 12), windows=(3, 12), by=BY, order=("ts",)) -> DataFrame:
    """Candidates for feature selection: windows here include the current row."""
    s, c = calendar.cycle(F.month("ts"))
    quant = win.current_quantile(windows=windows, by=by, order=order)
    cols = win.lags(ks=lags, by=by, order=order) | win.current_roll(windows=windows, by=by, order=order) | quant
    return win.back_filled(win.add(df, cols | {"month_sin": s, "month_cos": c}), list(quant), by, order)


def harmonic_features(df: DataFrame, frequencies: DataFrame, k: int, by=BY, t="t") -> DataFrame:
    """sin/cos(omega_j t) for the fitted frequencies (series_id, rank, omega), one column pair per rank."""
    wide = frequencies.groupBy(*by).agg(*[F.max(F.when(F.col("rank") == j, F.col("omega"))).alias(f"_w{j}") for j in range(1, k + 1)])
    out = df.join(wide, list(by), "left")
    for j in range(1, k + 1):
        out = out.withColumns({f"harm_sin_{j}": F.sin(F.col(f"_w{j}") * F.col(t)), f"harm_cos_{j}": F.cos(F.col(f"_w{j}") * F.col(t))})
    return out.drop(*[f"_w{j}" for j in range(1, k + 1)])


def row_mean_std(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and sample deviation across numeric columns of a row, missing values skipped."""
    values = F.array_compact(F.array(*[F.col(c).cast("double") for c in columns]))
    return df.withColumns(
        {"row_mean": arrays.mean(values), "row_std": F.coalesce(arrays.std(values, 1), F.lit(0.0))}
    )


def cumulative_abs(residual="residual", by=BY, order=("ts",)):
    return F.sum(F.abs(residual)).over(over(by, order).rowsBetween(Window.unboundedPreceding, 0))
