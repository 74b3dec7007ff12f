"""Prediction intervals and their calibration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import distribution as dist
from tidewell.functions.arrays import constant
from tidewell.functions.draws import Draw, poisson_one, uniform
from tidewell.operators import gram
from tidewell.operators import quantiles as qt
from tidewell.operators import summary as sm


def absolute_residual(y="y", yhat="yhat") -> Column:
    return F.abs(F.col(y) - F.col(yhat))


def with_limits(df: DataFrame, limits: DataFrame, by: Sequence[str]) -> DataFrame:
    """Fitted limits, one row per group, on every row."""
    return qt.attach(df, limits, by)


def band(df: DataFrame, q: str = "q", yhat="yhat") -> DataFrame:
    return df.withColumns({"lo": F.col(yhat) - F.col(q), "hi": F.col(yhat) + F.col(q)})


def split_conformal(calibration: DataFrame, alpha: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """(by..., q): the 1 - alpha quantile of the absolute residuals."""
    return qt.quantile_columns(calibration.withColumn("_s", absolute_residual()), "_s", {"q": 1 - alpha}, by)


def finite_sample_conformal(calibration: DataFrame, alpha: str = "0.1", by: Sequence[str] = ()) -> DataFrame:
    """(by..., q): the ceil((n+1)(1-alpha))-th smallest score; the level is a decimal, so no index is lost to rounding."""
    level = F.lit(Decimal(1) - Decimal(alpha))

    def rank(n: Column) -> Column:
        return F.least(F.ceil((n + 1) * level).cast("bigint"), n) - 1

    scores = calibration.withColumn("_s", absolute_residual())
    return qt.order_stats(scores, "_s", {"q": rank}, by).select(*by, F.col("value").alias("q"))


def widen_by_conformal(calibration: DataFrame, alpha: float = 0.1, lo="lo", hi="hi", y="y") -> DataFrame:
    """One row (delta): how far quantile intervals must be widened on calibration data."""
    score = F.greatest(F.col(lo) - F.col(y), F.col(y) - F.col(hi), F.lit(0.0))
    return qt.quantile_columns(calibration.withColumn("_s", score), "_s", {"delta": 1 - alpha})


def scale_grid() -> list[float]:
    """Multipliers tried for the interval width: fine around 1, coarse above."""
    # 0.60, 0.62 .. 1.40 and 1.5, 1.6 .. 3.0
    return [round(0.6 + 0.02 * i, 2) for i in range(41)] + [round(1.5 + 0.1 * i, 1) for i in range(16)]


def scale_search(calibration: DataFrame, q: float, grid: Sequence[float] | None = None, nominal: float = 0.9, lo="yhat", hi="yhat", y="y") -> DataFrame:
    """(s, coverage, gap), nearest to nominal first.  One pass: one average per multiplier, no row copies."""
    grid = list(grid or scale_grid())
    inside = [F.avg((F.col(y).between(F.col(lo) - s * q, F.col(hi) + s * q)).cast("double")).alias(f"_{i}") for i, s in enumerate(grid)]
    one = calibration.agg(*inside)
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(s).alias("s"), F.col(f"_{i}").alias("coverage")) for i, s in enumerate(grid)])))
    return rows.withColumn("gap", F.abs(F.col("coverage") - nominal)).orderBy(F.round("gap", 12), "s")


def robust_scale(calibration: DataFrame, score: str, by: Sequence[str] = (), nominal: float = 0.9, low: float = 1e-6, high: float = 10.0) -> DataFrame:
    """(by..., q): nominal quantile; degenerate ones fall back to median + 2.5 MAD, then to the 0.95 quantile."""
    first = qt.quantile_columns(calibration, score, {"q_nominal": nominal, "q_95": 0.95, "centre": 0.5}, by)
    spread = with_limits(calibration, first.select(*by, "centre"), by).withColumn("_d", F.abs(F.col(score) - F.col("centre")))
    mad = qt.quantile_columns(spread, "_d", {"mad": 0.5}, by)
    both = qt.attach(first, mad, by)
    robust = F.col("centre") + 2.5 * F.col("mad")
    good = F.col("q_nominal").between(low, high)
    return both.withColumn("q", F.when(good, F.col("q_nominal")).when(robust > low, robust).otherwise(F.col("q_95")))


def winsorised_quantile(calibration: DataFrame, score: str, nominal: float = 0.9, low: float = 0.01, high: float = 0.95) -> DataFrame:
    """One row (q): quantile of the scores clipped to their own 1st and 95th percentile."""
    limits = qt.quantile_columns(calibration, score, {"a": low, "b": high})
    clipped = with_limits(calibration, limits, ()).withColumn("_c", F.least(F.greatest(F.col(score), F.col("a")), F.col("b")))
    return qt.quantile_columns(clipped, "_c", {"q": nominal})


def clip_sigma(df: DataFrame, calibration: DataFrame, sigma="sigma", low: float = 0.2, high: float = 5.0) -> DataFrame:
    """Clip predicted deviations to 0.2 x the 1st and 5 x the 99th percentile seen in calibration."""
    limits = qt.quantile_columns(calibration, sigma, {"_a": 0.01, "_b": 0.99})
    out = with_limits(df, limits, ())
    return out.withColumn(sigma, F.least(F.greatest(F.col(sigma), low * F.col("_a")), high * F.col("_b"))).drop("_a", "_b")


def ranked_intervals(df: DataFrame, by: Sequence[str] = ("model",), nominal: float = 0.9) -> DataFrame:
    """Coverage, width and gap per model, nearest to nominal first (one row per model)."""
    from pyspark.sql import Window

    s = sm.interval_summary(df, by, nominal=nominal)
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.round("coverage_gap", 12), "mean_width", *by)))


# --- sample tables ------------------------------------------------------------


def level_flags(draws: DataFrame, point: Sequence[str], levels: Sequence[float], y="y") -> DataFrame:
    """(point..., level, inside): is the truth within the central interval of the draws?"""
    probs = {f"_{i}_{side}": (1 - a) / 2 if side == "lo" else (1 + a) / 2 for i, a in enumerate(levels) for side in ("lo", "hi")}
    wide = sm.sample_percentiles(draws, probs, [*point, y])
    cells = [
        F.struct(F.lit(float(a)).alias("level"), F.col(y).between(F.col(f"_{i}_lo"), F.col(f"_{i}_hi")).cast("int").alias("inside"))
        for i, a in enumerate(levels)
    ]
    return wide.select(*point, F.inline(F.array(*cells)))


def calibration_curve(draws: DataFrame, point: Sequence[str], levels: Sequence[float], y="y") -> DataFrame:
    return level_flags(draws, point, levels, y).groupBy("level").agg(F.avg("inside").alias("coverage"))


def calibration_band(draws: DataFrame, point: Sequence[str], levels: Sequence[float], n_boot: int = 200, seed: int = 42, y="y", draw: Draw = uniform) -> DataFrame:
    """Bootstrap 95 % band of the calibration curve: Poisson weights per point and draw.

    A point carries its weights as an array; a batch passes on one line per level and draw.
    """
    flags = level_flags(draws, point, levels, y).where("inside IS NOT NULL").select("level", "inside", draw_weights(n_boot, seed, point, draw).cast("array<double>").alias("w"))

    def add(batches):
        for pdf in batches:
            for level, part in pdf.groupby("level"):
                w = np.vstack(part["w"].to_numpy())
                yield pd.DataFrame({"level": level, "b": np.arange(1, n_boot + 1, dtype=np.int32), "hit": w.T @ part["inside"].to_numpy(float), "all": w.sum(0)})

    curves = flags.mapInPandas(add, "level double, b int, hit double, all double").groupBy("level", "b").agg((F.sum("hit") / F.nullif(F.sum("all"), F.lit(0.0))).alias("coverage"))
    return curves.groupBy("level").agg(F.percentile("coverage", F.lit(0.025)).alias("lower"), F.percentile("coverage", F.lit(0.975)).alias("upper"))


def gaussian_scores(df: DataFrame, by: Sequence[str] = (), y="y", mu="mu", var="var") -> DataFrame:
    """Sharpness, coverage of +-1.645 sigma, mean negative log-likelihood, mean CRPS.

    Rows without truth, mean or a positive variance have no score; ``n_left_out`` counts them.
    """
    ok = F.coalesce(F.col(y).isNotNull() & F.col(mu).isNotNull() & (F.col(var) > 0), F.lit(False))
    v = F.when(ok, F.col(var))
    sd = F.sqrt(v)
    inside = F.abs(F.col(y) - F.col(mu)) <= 1.645 * sd
    return df.groupBy(*by).agg(
        F.avg(sd).alias("sharpness"), F.avg(inside.cast("double")).alias("coverage_90"),
        F.avg(dist.gaussian_nll(F.col(y), F.col(mu), v)).alias("nll"), F.avg(dist.gaussian_crps(F.col(y), F.col(mu), sd)).alias("crps"),
        F.count(v).alias("n"), (F.count(F.lit(1)) - F.count(v)).alias("n_left_out"),
    )


def sample_crps(draws: DataFrame, point: Sequence[str], y="y", yhat="yhat") -> DataFrame:
    """(point..., y, crps, n): CRPS of each point's draws against its truth.

    With the n draws in order, it is the mean of |x - y| less the sum of (2i - n - 1) x_i over
    n^2.  Equal draws count at once, and the ranks are carried from bin to bin of the value, so
    a point with millions of draws spreads over tasks.  A point without a truth gives NULL;
    NULL draws do not count.
    """
    truth = F.coalesce(F.col(y).cast("double"), F.lit(float("nan")))  # NaN is a key like others, NULL is not
    ranked = qt.cumulative_counts(draws.withColumn("_y", truth), yhat, {"c": F.lit(1)}, [*point, "_y"])
    v, c = F.col(yhat), F.col("c")
    off, spread = F.sum(c * F.abs(v - F.col("_y"))), F.sum(v * c * (2 * F.col("c_cum") - c - F.col("c_total")))
    n = F.max("c_total")
    out = ranked.groupBy(*point, "_y").agg(((off - spread / n) / n).alias("crps"), n.alias("n"))
    return out.select(*point, *[F.when(~F.isnan("_y"), F.col(c)).alias(a) for c, a in (("_y", y), ("crps", "crps"))], "n")


def heteroscedastic(train: DataFrame, calibration: DataFrame, test: DataFrame, mean, spread, features: Sequence[str], spread_features: Sequence[str] | None = None, y="y") -> DataFrame:
    """Test rows with yhat, sigma, q, lo and hi: one model for the mean, a second one for the
    absolute residuals of the first, and a scale from the standardised residuals of calibration."""
    from tidewell.operators.models import on_features

    first = on_features(mean, features, y, "yhat").fit(train)
    seen = first.transform(train).withColumn("_abs_r", absolute_residual(y))
    second = on_features(spread, list(spread_features or features), "_abs_r", "_sigma").fit(seen)

    def scored(df: DataFrame) -> DataFrame:
        return second.transform(first.transform(df)).withColumn("sigma", F.greatest("_sigma", F.lit(1e-6))).drop("_sigma")

    cal = scored(calibration)
    limit = robust_scale(cal.withColumn("_z", absolute_residual(y) / F.col("sigma")), "_z")
    out = with_limits(clip_sigma(scored(test), cal), limit.select("q"), ())
    return out.withColumns({"lo": F.col("yhat") - F.col("q") * F.col("sigma"), "hi": F.col("yhat") + F.col("q") * F.col("sigma")})


# --- linear models refitted on bootstrap draws ---------------------------------


def bootstrap_models(train: DataFrame, features: Sequence[str], n_boot: int = 100, seed: int = 42, keys: Sequence[str] = ("series_id", "ts"), y="y", draw: Draw = uniform) -> DataFrame:
    """(b, beta): one least-squares fit per draw, all from one pass in which a row carries its draws as an array."""
    xs = [F.lit(1.0)] + [F.col(f) for f in features]
    sums = gram.weighted_sums(train.na.drop(subset=[*features, y]), draw_weights(n_boot, seed, keys, draw), xs, F.col(y))
    return gram.solve(sums).select("b", "beta")


def draw_weights(n_boot: int, seed: int, keys: Sequence[str], draw: Draw = uniform) -> Column:
    """Poisson counts of a row in draws 1..n_boot, by its keys."""
    return F.transform(F.sequence(F.lit(1), F.lit(n_boot)), lambda b: poisson_one(seed, [*keys, b], draw))


def bootstrap_draws(models: DataFrame, df: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys..., b, yhat): every row under every refitted model, held as one array per row."""
    betas = [r["beta"] for r in models.orderBy("b").collect()]
    xs = [F.lit(1.0)] + [F.col(f) for f in features]
    rows = constant([[float(v) for v in beta] for beta in betas], "array<array<double>>")
    vec = F.array(*xs)

    def one(beta: Column) -> Column:
        return F.aggregate(F.zip_with(beta, vec, lambda a, x: a * x), F.lit(0.0), lambda s, v: s + v)

    return df.withColumn("draws", F.transform(rows, one)).select(*keys, "draws")


def draw_summary(drawn: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, population deviation, normal 95 % and 99 % bands and the 2.5/50/97.5 percentiles of each row's draws."""
    from tidewell.functions import arrays

    ordered = drawn.withColumns({"mean": arrays.mean(F.col("draws")), "std": arrays.std(F.col("draws")), "_s": F.array_sort("draws")})

    def percentile(p: float) -> Column:
        r = F.lit(p) * (F.size("_s") - 1)
        low = F.floor(r).cast("int")
        a, b = F.get("_s", low), F.get("_s", F.least(low + 1, F.size("_s") - 1))
        return a + (b - a) * (r - low)

    cols = {"p025": percentile(0.025), "p500": percentile(0.5), "p975": percentile(0.975)}
    for name, z in (("ci", 1.96), ("pi", 2.576)):
        cols[f"{name}_lo"] = F.col("mean") - z * F.col("std")
        cols[f"{name}_hi"] = F.col("mean") + z * F.col("std")
    return ordered.withColumns(cols).select(*keys, "mean", "std", *cols)


def posterior_models(train: DataFrame, features: Sequence[str], n_draws: int = 200, seed: int = 42, by: Sequence[str] = (), y="y") -> DataFrame:
    """(by..., b, beta, sigma2): draws of a conjugate linear model, from grouped sums."""
    xs = [F.lit(1.0)] + [F.col(f) for f in features]
    p = len(xs)
    keys = list(by) or ["every"]
    base = train if by else train.withColumn("every", F.lit("all"))
    sums = gram.gram_sums(base.na.drop(subset=[*features, y]), keys, xs, F.col(y))

    def sample(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                a = np.asarray(r.xtx, float).reshape(p, p)
                scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
                inv = np.linalg.pinv(a / scale[:, None] / scale[None, :], hermitian=True) / scale[:, None] / scale[None, :]
                b = np.asarray(r.xty, float)
                mean = inv @ b
                rss = max(float(r.yy - mean @ b), 1e-12)
                key = [getattr(r, k) for k in keys]
                rng = np.random.default_rng([seed, *[int.from_bytes(str(k).encode()[-6:], "big") for k in key]])
                sigma2 = 1.0 / rng.gamma(max(r.n - p, 1) / 2, 2.0 / rss, size=n_draws)
                w, v = np.linalg.eigh((inv + inv.T) / 2)
                root = v * np.sqrt(np.maximum(w, 0))
                beta = mean + np.sqrt(sigma2)[:, None] * (rng.standard_normal((n_draws, p)) @ root.T)
                yield pd.DataFrame({**{k: [x] * n_draws for k, x in zip(keys, key)}, "b": np.arange(1, n_draws + 1), "beta": list(beta), "sigma2": sigma2})

    keyed = ", ".join(f"{k} string" for k in keys)
    out = sums.mapInPandas(sample, f"{keyed}, b int, beta array<double>, sigma2 double")
    return out if by else out.drop("every")


# --- quantile regression ---------------------------------------------------------


def quantile_regression(df: DataFrame, features: Sequence[str], taus: Mapping[str, float], y="y", passes: int = 2000, tol: float = 1e-3) -> dict[str, list[float]]:
    """Linear quantile models by reweighted least squares; intercept first.

    Each pass is one aggregation of weighted sums for all levels together; the
    driver solves p x p systems, p being the number of features plus one.  Passes go on
    until no coefficient, in units of deviations, moves by ``tol``; if ``passes`` do not
    suffice, it fails.
    """
    scaled = df.na.drop(subset=[*features, y]).agg(
        *[f(c).alias(f"{n}_{i}") for i, c in enumerate([*features, y]) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    ).first()
    k = len(features)
    stat = [(scaled[f"m_{i}"], scaled[f"s_{i}"] or 1.0) for i in range(k + 1)]
    rows = df.na.drop(subset=[*features, y]).select(
        F.lit(1.0).alias("_x0"), *[((F.col(c) - stat[i][0]) / stat[i][1]).alias(f"_x{i + 1}") for i, c in enumerate(features)], ((F.col(y) - stat[k][0]) / stat[k][1]).alias("_y")
    ).persist()
    p = k + 1
    beta = {t: np.zeros(p) for t in taus}
    for step in range(passes):
        aggs = []
        for t, tau in taus.items():
            r = F.col("_y") - sum((float(b) * F.col(f"_x{i}") for i, b in enumerate(beta[t])), F.lit(0.0))
            w = F.lit(1.0) if step == 0 else F.when(r >= 0, tau).otherwise(1 - tau) / F.greatest(F.abs(r), F.lit(1e-4))
            for i in range(p):
                aggs += [F.sum(w * F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"{t}_g{i}_{j}") for j in range(i, p)]
                aggs.append(F.sum(w * F.col(f"_x{i}") * F.col("_y")).alias(f"{t}_r{i}"))
        got = rows.agg(*aggs).first()
        change = 0.0
        for t in taus:
            a = np.array([[got[f"{t}_g{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
            new = np.linalg.pinv(a, hermitian=True) @ np.array([got[f"{t}_r{i}"] for i in range(p)])
            change = max(change, float(np.max(np.abs(new - beta[t]))))
            beta[t] = new
        if step and change < tol:
            break
    else:
        raise RuntimeError(f"quantile regression did not settle within {passes} passes")
    rows.unpersist()
    out = {}
    for t in taus:
        slopes = [float(beta[t][i + 1] * stat[k][1] / stat[i][1]) for i in range(k)]
        level = stat[k][0] + stat[k][1] * float(beta[t][0]) - sum(s * stat[i][0] for i, s in enumerate(slopes))
        out[t] = [float(level), *slopes]
    return out


def linear_prediction(coefficients: Sequence[float], features: Sequence[str]) -> Column:
    total = F.lit(float(coefficients[0]))
    for c, f in zip(coefficients[1:], features):
        total = total + F.lit(float(c)) * F.col(f)
    return total
