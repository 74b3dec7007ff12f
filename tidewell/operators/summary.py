"""Group statistics, metrics, correlations and distribution summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.distribution import normal_quantile
from tidewell.functions.numbers import correlation, safe_ratio
from tidewell.operators import quantiles as qt
from tidewell.panel import BY, null_nan, over, with_position

FIVE = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def value_stats(y: str = "y") -> list[Column]:
    return [
        F.count(y).alias("count"), F.avg(y).alias("mean"), F.median(y).alias("median"),
        F.coalesce(F.stddev_samp(y), F.lit(0.0)).alias("std"), F.min(y).alias("min"), F.max(y).alias("max"),
    ]


def annual(df: DataFrame, by=BY) -> DataFrame:
    """Statistics per series and year; a group is at most one year of a grained panel."""
    return df.groupBy(*by, F.year("ts").alias("year")).agg(*value_stats())


def climatology(df: DataFrame, by=BY) -> DataFrame:
    """Statistics per series and month of year, with the month's short name."""
    named = df.withColumns({"month_num": F.month("ts"), "month_name": F.date_format("ts", "MMM")})
    return named.groupBy(*by, "month_num", "month_name").agg(*value_stats())


LABELS = {"Low": 0, "Medium": 1, "High": 2}


def tercile_labels(df: DataFrame, y="y", by=BY, out="category") -> DataFrame:
    """Low / Medium / High by the series' own terciles, right-closed."""
    cuts = F.percentile(y, F.array(F.lit(1 / 3), F.lit(2 / 3))).over(Window.partitionBy(*by))
    labelled = df.withColumn("_c", cuts)
    label = F.when(F.col(y) <= F.col("_c")[0], "Low").when(F.col(y) <= F.col("_c")[1], "Medium").otherwise("High")
    return labelled.withColumn(out, label).drop("_c")


def label_code(label: Column) -> Column:
    out = F
    for name, code in LABELS.items():
        out = out.when(label == name, code)
    return out


def category_stats(df: DataFrame, y="y", by=BY) -> DataFrame:
    return tercile_labels(df, y, by).groupBy(*by, "category").agg(*value_stats(y))


def missing_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, missing_count, missing_pct)."""
    from tidewell.operators.clean import null_profile

    return null_profile(df, columns).select("column", F.col("nulls").alias("missing_count"), (100 * F.col("null_frac")).alias("missing_pct"))


def trend(df: DataFrame, by=BY) -> DataFrame:
    """Least-squares slope of the annual means on the year."""
    means = df.groupBy(*by, F.year("ts").alias("year")).agg(F.avg("y").alias("mean"))
    slope = F.regr_slope("mean", "year")
    return means.groupBy(*by).agg(slope.alias("per_year"), (10 * slope).alias("per_decade"))


def describe(df: DataFrame, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, min, exact quartiles, max, for groups of any size."""
    base = df.groupBy(*by).agg(F.count(y).alias("count"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.min(y).alias("min"), F.max(y).alias("max"))
    quart = qt.quantile_columns(df, y, FIVE, by)
    return qt.attach(base, quart, by)


def data_stats(df: DataFrame, y="y", by=BY) -> DataFrame:
    """Mean, population deviation, range, missing share, lag-1 autocorrelation and linear trend."""
    w = over(by)
    pos = with_position(df, by).withColumn("_prev", F.lag(y).over(w))
    return pos.groupBy(*by).agg(
        F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"), F.min(y).alias("min"), F.max(y).alias("max"),
        F.avg(F.col(y).isNull().cast("int")).alias("missing_rate"),
        correlation(y, "_prev").alias("autocorrelation"), F.regr_slope(y, "t").alias("trend"),
    )


def regression_metrics(df: DataFrame, by: Sequence[str], y="y", yhat="yhat") -> DataFrame:
    """MAE, MSE, RMSE, MAPE over non-zero targets, largest error and R2 in one pass."""
    e = F.col(y) - F.col(yhat)
    ok = F.col(y).isNotNull() & F.col(yhat).isNotNull()
    share = F.when(F.col(y) != 0, F.abs(e / F.col(y)))
    agg = df.where(ok).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.avg(share).alias("_mape"),
        F.max(F.abs(e)).alias("max_error"), F.var_pop(y).alias("_v"), F.stddev_pop(y).alias("_sd"),
    )
    return agg.withColumns(
        {"rmse": F.sqrt("mse"), "mape": 100 * F.col("_mape"), "r2": 1 - F.col("mse") / F.nullif(F.col("_v"), F.lit(0.0)), "rmse_over_sd": F.sqrt("mse") / F.nullif(F.col("_sd"), F.lit(0.0))}
    ).drop("_mape", "_v", "_sd")


def skill(metrics: DataFrame, reference: str, by: Sequence[str] = ()) -> DataFrame:
    """Skill 1 - RMSE / RMSE_ref and improvement in percent of MAE, against one model."""
    ref = metrics.where(F.col("model") == reference).select(*by, F.col("rmse").alias("_r"), F.col("mae").alias("_m"))
    joined = qt.attach(metrics, ref, by)
    return joined.withColumns(
        {"skill": 1 - safe_ratio(F.col("rmse"), F.col("_r"), None), "improvement_pct": 100 * safe_ratio(F.col("_m") - F.col("mae"), F.col("_m"), None)}
    ).drop("_r", "_m")


def box_summary(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Quartiles and whiskers (last values within 1.5 IQR), for groups of any size."""
    quart = qt.quantile_columns(df, value, FIVE, by)
    # one row per group: months, seasons, categories
    rows = qt.attach(df, quart, by)
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = F.col(value).between(F.col("q25") - reach, F.col("q75") + reach)
    return rows.groupBy(*by, *FIVE).agg(
        F.count(value).alias("n"), F.min(F.when(inside, F.col(value))).alias("low_whisker"), F.max(F.when(inside, F.col(value))).alias("high_whisker")
    )


def quantile_bin(df: DataFrame, value: str, bins: int, out: str = "bin", by: Sequence[str] = ()) -> DataFrame:
    """Equal-count bins 1..bins of a whole column, or of each group, right-closed, from exact cut points."""
    cuts = {f"_c{i}": i / bins for i in range(1, bins)}
    found = qt.attach(df, qt.quantile_columns(df, value, cuts, by), by)
    return found.withColumn(out, F.lit(1) + sum(((F.col(value) > F.col(c)).cast("int") for c in cuts), F.lit(0))).drop(*cuts)


def error_by_bin(df: DataFrame, bins: int = 5, y="y", yhat="yhat", by: Sequence[str] = ()) -> DataFrame:
    e = F.abs(F.col(y) - F.col(yhat))
    return quantile_bin(df, y, bins, by=by).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(e).alias("mae"))


def error_by_season(df: DataFrame, t="t", period: int = 12, y="y", yhat="yhat", by: Sequence[str] = ()) -> DataFrame:
    place = (F.col(t) % period + 1).alias("place")
    return df.groupBy(*by, place).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(y) - F.col(yhat))).alias("mae"))


def mutual_information(df: DataFrame, features: Sequence[str], y="y", bins: int = 16) -> DataFrame:
    """(feature, information, n) in nats, strongest first.

    Every feature and the target fall into ``bins`` bins of equal width; all joint histograms
    come from one aggregate, combined map-side to features x bins x bins rows.  Rows without
    the feature or the target do not count for that feature; a constant tells nothing.
    """
    names = [*features, y]
    ends = df.agg(*[f(null_nan(F.col(c))).alias(f"{n}_{i}") for i, c in enumerate(names) for n, f in (("a", F.min), ("b", F.max))]).first()

    def place(i: int) -> Column:
        a, b = ends[f"a_{i}"], ends[f"b_{i}"]
        if a is None or a == b:
            return F.when(null_nan(F.col(names[i])).isNotNull(), F.lit(0))
        x = null_nan(F.col(names[i]))
        nth = F.least(F.floor((x - F.lit(float(a))) / F.lit(float(b) - float(a)) * bins), F.lit(bins - 1))
        return F.when(x.isNotNull(), nth.cast("int"))  # least() passes over NULL

    cells = F.array(*[F.struct(F.lit(f).alias("feature"), place(i).alias("x")) for i, f in enumerate(features)])
    joint = df.select(F.inline(cells), place(len(features)).alias("z")).where("x IS NOT NULL AND z IS NOT NULL")
    joint = joint.groupBy("feature", "x", "z").agg(F.count(F.lit(1)).cast("double").alias("c"))

    def total(*keys: str) -> Column:
        return F.sum("c").over(Window.partitionBy("feature", *keys))

    n = joint.withColumns({"n": total(), "cx": total("x"), "cz": total("z")})
    told = F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("cx") * F.col("cz"))))
    out = n.groupBy("feature").agg(F.greatest(told, F.lit(0.0)).alias("information"), F.max("n").cast("long").alias("n"))
    return out.orderBy(F.desc("information"), "feature")


def most_informative(df: DataFrame, features: Sequence[str], k: int, y="y", bins: int = 16) -> list[str]:
    """The k features that tell most about the target."""
    return [r["feature"] for r in mutual_information(df, features, y, bins).limit(k).collect()]


def target_correlation(df: DataFrame, features: Sequence[str], y="y", by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, r) strongest first, one pass."""
    one = df.groupBy(*by).agg(*[correlation(c, y).alias(c) for c in features])
    return one.unpivot(list(by), list(features), "feature", "r").orderBy(F.desc(F.abs("r")), "feature")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for every column pair, one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[correlation(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    rows = []
    for i, (a, b) in enumerate(pairs):
        rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r")))
        if a != b:
            rows.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"_{i}").alias("r")))
    return one.select(F.inline(F.array(*rows)))


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mean, std, min, max), one pass."""
    one = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))])
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"{n}_{c}").cast("double").alias(n) for n in ("mean", "std", "min", "max")]) for c in columns]
    return one.select(F.inline(F.array(*rows)))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts and density per equal-width bin 1..bins; the last bin holds its right edge."""
    width = (high - low) / bins
    v = F.col(value)
    place = F.when((v >= low) & (v <= high), F.least(F.floor((v - low) / width) + 1, F.lit(bins)))
    counts = df.select(*by, place.alias("bin")).where("bin IS NOT NULL").groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    return counts.withColumn("density", F.col("n") / (total * width))


def normal_plot(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Quantile-quantile points: Filliben order medians against the sorted values.

    Ranks come from binned running counts, so a group is never sorted whole.
    Equal values are one row with their first and last rank and quantile.
    """
    ranked = qt.cumulative_counts(df, value, {"c": F.lit(1)}, by)

    def theoretical(i: Column) -> Column:
        n = F.col("c_total")
        last = F.pow(F.lit(0.5), 1.0 / n)
        return normal_quantile(F.when(i == n, last).when(i == 1, 1 - last).otherwise((i - 0.3175) / (n + 0.365)))

    first, last = F.col("c_cum") - F.col("c") + 1, F.col("c_cum")
    return ranked.select(*by, value, first.alias("first_rank"), last.alias("last_rank"), theoretical(first).alias("low"), theoretical(last).alias("high"))


def interval_summary(df: DataFrame, by: Sequence[str], y="y", lo="lo", hi="hi", yhat: str | None = "yhat", nominal: float = 0.9) -> DataFrame:
    """Coverage, width statistics, distance from nominal, efficiency."""
    width = F.col(hi) - F.col(lo)
    inside = F.col(y).between(F.col(lo), F.col(hi)).cast("double")
    out = df.where(F.col(y).isNotNull() & F.col(lo).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(inside).cast("bigint").alias("covered"), F.avg(inside).alias("coverage"), F.avg(width).alias("mean_width"),
        F.min(width).alias("min_width"), F.max(width).alias("max_width"), F.stddev_pop(width).alias("std_width"),
    )
    return out.withColumns(
        {"coverage_gap": F.abs(F.col("coverage") - nominal), "efficiency": 1 / F.nullif(F.col("mean_width"), F.lit(0.0))}
    )


def median_abs_error(df: DataFrame, by: Sequence[str], y="y", yhat="yhat") -> DataFrame:
    e = df.withColumn("_e", F.abs(F.col(y) - F.col(yhat)))
    return qt.quantile_columns(e, "_e", {"median_abs_error": 0.5}, by)


# --- sample tables: (point_id, sample_id, grp, yhat) with the truth per point -------


def sample_percentiles(df: DataFrame, probs: Mapping[str, float], point: Sequence[str], yhat="yhat") -> DataFrame:
    """Exact percentiles per point; a point holds as many values as there are draws."""
    cols = F.percentile(yhat, F.array(*[F.lit(float(p)) for p in probs.values()]))
    out = df.groupBy(*point).agg(cols.alias("_q"))
    return out.select(*point, *[F.col("_q")[i].alias(k) for i, k in enumerate(probs)])


def pit(df: DataFrame, point: Sequence[str], y="y", yhat="yhat") -> DataFrame:
    return df.groupBy(*point).agg(F.avg((F.col(yhat) <= F.col(y)).cast("double")).alias("pit"))


def variance_split(df: DataFrame, point: Sequence[str], group="grp", yhat="yhat") -> DataFrame:
    """Epistemic = variance of group means, aleatoric = mean variance inside groups (sample forms)."""
    inner = df.groupBy(*point, group).agg(F.avg(yhat).alias("_m"), F.var_samp(yhat).alias("_v"))
    return inner.groupBy(*point).agg(F.var_samp("_m").alias("epistemic"), F.avg("_v").alias("aleatoric"))


def sample_group(seed: int, keys: Sequence[str], groups: int = 10) -> Column:
    """Stable random group of a draw."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(groups)).cast("int")
