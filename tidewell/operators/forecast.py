"""Forecasters: closed forms and grouped least squares, one job for all series."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators import gram
from tidewell.operators import windows as win
from tidewell.panel import BY, over, with_position


def ahead(df: DataFrame, horizon: int, by=BY) -> DataFrame:
    """(by..., step, ts, n, last_y): the months after each series' last row."""
    last = df.groupBy(*by).agg(F.max("ts").alias("_a"), F.max_by("y", "ts").alias("last_y"), F.count(F.lit(1)).alias("n"))
    steps = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.withColumn("ts", F.col("_a") + F.make_ym_interval(F.lit(0), F.col("step"))).drop("_a")


def persistence(df: DataFrame, horizon: int, by=BY) -> DataFrame:
    return ahead(df, horizon, by).withColumn("yhat", F.col("last_y"))


def ar1_models(df: DataFrame, by=BY, order=("ts",)) -> DataFrame:
    """(by..., c, phi, sigma2, last_y, n) by conditional least squares."""
    lagged = df.withColumn("_x", F.lag("y").over(over(by, order)))
    both = F.col("_x").isNotNull() & F.col("y").isNotNull()
    x, z = F.when(both, F.col("_x")), F.when(both, F.col("y"))
    m = lagged.groupBy(*by).agg(
        F.regr_slope("y", "_x").alias("phi"), F.regr_intercept("y", "_x").alias("c"), F.covar_pop(z, x).alias("_xy"),
        F.var_pop(z).alias("_yy"), F.max_by("y", F.struct(*order)).alias("last_y"), F.count(F.lit(1)).alias("n"),
    )
    return m.withColumn("sigma2", F.greatest(F.col("_yy") - F.col("phi") * F.col("_xy"), F.lit(0.0))).drop("_xy", "_yy")


def ar1_forecast(df: DataFrame, horizon: int, z: float = 1.96, by=BY, order=("ts",)) -> DataFrame:
    """h-step mean and variance in closed form, with the normal interval."""
    f = ar1_models(df, by, order).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    phi, h = F.col("phi"), F.col("step")
    unit = F.abs(1 - phi) < 1e-12
    power = F.pow(phi, h)
    mean = F.when(unit, F.col("last_y") + h * F.col("c")).otherwise(F.col("c") * (1 - power) / (1 - phi) + power * F.col("last_y"))
    var = F.when(F.abs(1 - phi * phi) < 1e-12, F.col("sigma2") * h).otherwise(F.col("sigma2") * (1 - power * power) / (1 - phi * phi))
    f = f.withColumns({"yhat": mean, "var": var})
    half = z * F.sqrt("var")
    return f.select(*by, "n", "step", "yhat", "var", (F.col("yhat") - half).alias("lo"), (F.col("yhat") + half).alias("hi"))


def _season(t: Column, orders: Sequence[int], period: float) -> list[Column]:
    out = [F.lit(1.0), t.cast("double")]
    for k in orders:
        angle = F.lit(2 * math.pi * k / period) * t
        out += [F.sin(angle), F.cos(angle)]
    return out


def trend_season_models(df: DataFrame, orders=(1, 2, 3), period: float = 12.0, multiplicative: bool = False, by=BY, order=("ts",)) -> DataFrame:
    """(by..., n, beta): least squares on trend and yearly waves; the multiplicative form works on log y."""
    pos = with_position(df.where(F.col("y").isNotNull()), by, order)
    target = F.log("y") if multiplicative else F.col("y")
    return gram.solve(gram.gram_sums(pos, by, _season(F.col("t"), orders, period), target)).select(*by, "n", "beta")


def trend_season_forecast(df: DataFrame, horizon: int, orders=(1, 2, 3), period: float = 12.0, multiplicative: bool = False, by=BY, order=("ts",)) -> DataFrame:
    m = trend_season_models(df, orders, period, multiplicative, by, order)
    f = m.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    value = gram.dot(F.col("beta"), _season(F.col("n") + F.col("step") - 1, orders, period))
    return f.select(*by, "n", "step", (F.exp(value) if multiplicative else value).alias("yhat"))


def _recent(df: DataFrame, reach: int, by, order) -> DataFrame:
    """(by..., _path): the last ``reach`` values of each series; a shorter one repeats its first value in front."""
    last = win.tail_rows(df.select(*by, *order, "y"), reach, by, order)
    rows = last.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, "y"))).alias("_r"))
    values = F.transform("_r", lambda r: r["y"])
    return rows.select(*by, F.concat(F.array_repeat(F.get(values, F.lit(0)), F.lit(reach) - F.size("_r")), values).alias("_path"))


def _lag_set(lags: int | Sequence[int]) -> list[int]:
    return list(range(1, lags + 1)) if isinstance(lags, int) else sorted(lags)


def recursive_forecast(df: DataFrame, model, horizon: int, lags: int | Sequence[int], by=BY, order=("ts",)) -> DataFrame:
    """Many steps with a fitted one-step lag model: predictions become the next lags.

    ``lags`` are those of the model's feature vector, in rising order (a number n means 1..n).
    One row per series carries its last values as an array; every step adds a prediction to
    it, so the rows never grow.
    """
    ks = _lag_set(lags)
    reach = max(ks)
    state = _recent(df, reach, by, order)
    feature, out = model.getFeaturesCol(), model.getPredictionCol()
    for _ in range(horizon):
        seen = F.array(*[F.element_at("_path", -k) for k in ks])
        scored = model.transform(state.withColumn(feature, array_to_vector(seen)))
        state = scored.select(*by, F.concat("_path", F.array(F.col(out))).alias("_path"))
    steps = state.select(*by, F.posexplode(F.slice("_path", reach + 1, horizon)).alias("_i", "yhat"))
    return steps.select(*by, (F.col("_i") + 1).alias("step"), "yhat")


def linear_recursive_forecast(df: DataFrame, horizon: int, lags: int | Sequence[int], l2: float = 0.0, train_share: float = 1.0, by=BY, order=("ts",)) -> DataFrame:
    """The same with one ridge model per series, stepped inside an array expression.

    ``train_share`` is the part of each series, from its start, that the model is fitted on.
    """
    ks = _lag_set(lags)
    reach = max(ks)
    names = [f"lag_{k}" for k in ks]
    lagged = with_position(df, by, order, count=True).withColumns(win.lags(ks=ks, by=by, order=order)).na.drop(subset=names)
    models = gram.fit_linear(lagged.where(F.col("t") < F.floor(F.col("n") * train_share)), by, names, "y", l2)
    paths = _recent(df, reach, by, order)

    def step(path: Column, _: Column) -> Column:
        value = F.element_at("beta", 1)
        for i, k in enumerate(ks):
            value = value + F.element_at("beta", i + 2) * F.element_at(path, -k)
        return F.concat(path, F.array(value))

    # a series too short for a model repeats its last value
    flat = F.concat(F.array(F.lit(0.0)), F.array(*[F.lit(float(k == ks[0])) for k in ks]))
    full = paths.join(models, list(by), "left").withColumn("beta", F.coalesce("beta", flat))
    full = full.withColumn("_path", F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("_path"), step))
    out = full.select(*by, F.posexplode(F.slice("_path", reach + 1, horizon)).alias("_i", "yhat"))
    return out.select(*by, (F.col("_i") + 1).alias("step"), "yhat")


def forecast_chain(df: DataFrame, horizon: int, least_rows=(36, 12), by=BY, order=("ts",)) -> DataFrame:
    """First method that has enough rows and a finite result: trend and season, AR(1), mean of the last 12.

    Returns (by..., step, yhat, method).
    """
    season = trend_season_forecast(df, horizon, by=by, order=order).where(F.col("n") >= least_rows[0]).select(*by, "step", F.col("yhat").alias("_a"))
    ar = ar1_forecast(df, horizon, by=by, order=order).where(F.col("n") >= least_rows[1]).select(*by, "step", F.col("yhat").alias("_b"))
    naive = win.naive_forecast(df, by=by, order=order).select(*by, F.col("mu").alias("_c"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    joined = naive.join(ar, [*by, "step"], "left").join(season, [*by, "step"], "left")
    good = {m: F.when(~F.isnan(c), F.col(c)) for m, c in (("trend_season", "_a"), ("ar1", "_b"), ("naive", "_c"))}
    method = F.coalesce(*[F.when(v.isNotNull(), F.lit(m)) for m, v in good.items()])
    return joined.select(*by, "step", F.coalesce(*good.values()).alias("yhat"), method.alias("method"))


def hour_profile_forecast(df: DataFrame, horizon: int, days: int = 7, by=BY) -> DataFrame:
    """(by..., step, yhat): the mean of the same hour over the last days, else the last value; steps are hours."""
    end = df.groupBy(*by).agg(F.max("ts").alias("_end"), F.max_by("y", "ts").alias("_last"))
    recent = df.join(end, list(by)).where(F.col("ts") > F.col("_end") - F.expr(f"INTERVAL {days} DAYS"))
    profile = recent.groupBy(*by, F.hour("ts").alias("_hour")).agg(F.avg("y").alias("_mean"))
    steps = end.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    steps = steps.withColumn("_hour", ((F.hour("_end") + F.col("step")) % 24).cast("int"))
    return steps.join(profile, [*by, "_hour"], "left").select(*by, "step", F.coalesce("_mean", "_last").alias("yhat"))


#: Methods in order of preference, and what a series must have: rows, and seconds between them.
ROUTES = (
    ("lagged", 198, 0.0, 2 * 3600.0),  # hourly, with 30 rows beyond the longest lag
    ("trend_season", 36, 20 * 86400.0, 45 * 86400.0),  # monthly
    ("ar1", 12, 2 * 3600.0, math.inf),
    ("hour_profile", 24, 0.0, 2 * 3600.0),
    ("naive", 1, 0.0, math.inf),
)


def routed(df: DataFrame, routes=ROUTES, by=BY) -> DataFrame:
    """(by..., n, gap, method): the first method whose needs a series meets; one pass."""
    sizes = df.where("y IS NOT NULL").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    span = F.unix_timestamp(F.col("_b").cast("timestamp")) - F.unix_timestamp(F.col("_a").cast("timestamp"))
    sizes = sizes.withColumn("gap", F.coalesce(span / F.nullif(F.col("n") - 1, F.lit(0)), F.lit(0.0)))
    method = F.coalesce(*[F.when((F.col("n") >= rows) & (F.col("gap") >= low) & (F.col("gap") <= high), F.lit(m)) for m, rows, low, high in routes])
    return sizes.select(*by, "n", "gap", method.alias("method"))


def routed_forecast(df: DataFrame, horizon: int, routes=ROUTES, lags: Sequence[int] = (1, 24, 168), by=BY, order=("ts",)) -> DataFrame:
    """(by..., step, yhat, method): every series goes to the first method that can run on it.

    A method is fitted on its own series only.  Where it ends without a finite value, the last
    value is repeated and the method is called naive.
    """
    route = routed(df, routes, by)
    rows = df.where("y IS NOT NULL").join(route.select(*by, "method"), list(by))

    def own(method: str) -> DataFrame:
        return rows.where(F.col("method") == method).drop("method")

    made = {
        "lagged": lambda d: linear_recursive_forecast(d, horizon, lags, 1e-6, 0.9, by, order),
        "trend_season": lambda d: trend_season_forecast(d, horizon, by=by, order=order),
        "ar1": lambda d: ar1_forecast(d, horizon, by=by, order=order),
        "hour_profile": lambda d: hour_profile_forecast(d, horizon, by=by),
        "naive": lambda d: persistence(d, horizon, by),
    }
    out = None
    for method, *_ in routes:
        part = made[method](own(method)).select(*by, F.col("step").cast("int").alias("step"), F.col("yhat").alias("_v"), F.lit(method).alias("method"))
        out = part if out is None else out.unionByName(part)
    last = persistence(df.where("y IS NOT NULL"), horizon, by).select(*by, F.col("step").cast("int").alias("step"), "last_y")
    good = F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < math.inf)
    both = last.join(out, [*by, "step"], "left")
    return both.select(*by, "step", F.when(good, F.col("_v")).otherwise(F.col("last_y")).alias("yhat"), F.when(good, F.col("method")).otherwise("naive").alias("method"))


def with_fallback(df: DataFrame, prediction: str, feature: str, y="y", by=BY, order=("ts",)) -> DataFrame:
    """mu, var, mode: the prediction, else a feature column, else mean and variance of the last 12 rows."""
    naive = win.naive_forecast(df, y, 12, by, order).select(*by, F.col("mu").alias("_m"), F.col("var").alias("_v"))
    out = df.join(naive, list(by), "left")
    mode = F.when(F.col(prediction).isNotNull(), "predict").when(F.col(feature).isNotNull(), "feature").otherwise("naive")
    return out.withColumns({"mu": F.coalesce(prediction, feature, "_m"), "var": F.col("_v"), "mode": mode}).drop("_m", "_v")


# --- fusion -----------------------------------------------------------------------

# Names under which predictions and variances of two models are known.
MEAN_ALIASES = (("mu_arima", "arima_mean", "model1_temp", "mu_a", "pred_a"), ("mu_ml", "ml_mean", "model2_temp", "mu_m", "pred_b"))
VARIANCE_ALIASES = (("var_arima", "arima_var", "model1_var", "var_a"), ("var_ml", "ml_var", "model2_var", "var_m"))


def fusion_columns(columns: Sequence[str]) -> tuple[list[str | None], list[str | None]]:
    """Prediction and variance column of each model, None where there is none."""
    from tidewell.operators.clean import find_column

    return [find_column(columns, a) for a in MEAN_ALIASES], [find_column(columns, a) for a in VARIANCE_ALIASES]


def fuse(df: DataFrame, models: Sequence[tuple[str, str]], floor: float = 1e-10) -> DataFrame:
    """Precision-weighted mean and variance of several (mean, variance) column pairs of a row."""
    weights = [1 / F.greatest(F.col(v), F.lit(floor)) for _, v in models]
    total = sum(weights[1:], weights[0])
    mean = sum((w * F.col(m) for w, (m, _) in zip(weights[1:], models[1:])), weights[0] * F.col(models[0][0])) / total
    return df.withColumns({"fused_mean": mean, "fused_variance": 1 / total, "fused_std": F.sqrt(1 / total)})


def fuse_long(df: DataFrame, keys: Sequence[str], mean="yhat", var="var", floor: float = 1e-10) -> DataFrame:
    """The same over any number of models held as rows."""
    w = 1 / F.greatest(F.col(var), F.lit(floor))
    return df.groupBy(*keys).agg((F.sum(w * F.col(mean)) / F.sum(w)).alias("fused_mean"), (1 / F.sum(w)).alias("fused_variance"))


def ensemble_mean(df: DataFrame, keys: Sequence[str], yhat="yhat") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(yhat).alias("ensemble"), F.count(yhat).alias("members"))


def rolling_variance(w: int = 12, residual="residual", by=BY, order=("ts",)) -> Column:
    """Variance of the last residuals, for use as a model's predictive variance."""
    return F.var_pop(residual).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-w, -1))
