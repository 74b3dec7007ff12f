"""Aggregation queries (AGG*) and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import quantiles as qt
from tidewell.operators import splits
from tidewell.operators import summary as sm
from tidewell.operators import windows as win
from tidewell.plans import panels as P
from tidewell.plans.registry import day, normal_quantile_sql, q, query, sday, sq, table
from tidewell.plans.window_queries import WSQL

STATS = ("mean", "median", "std", "min", "max")
STATS_SQL = (
    f"count(y) AS count, {sq('avg(y)', 3)} AS mean, {sq('median(y)', 3)} AS median, {sq('coalesce(stddev_samp(y), 0)', 3)} AS std, "
    f"{sq('min(y)', 3)} AS min, {sq('max(y)', 3)} AS max"
)


def stats_out(df, *keys):
    return df.select(*keys, "count", *[q(c, 3).alias(c) for c in STATS])


@query("agg1_annual_stats", f"{P.ctes('wide')} SELECT series_id, year(ts) AS year, {STATS_SQL} FROM wide GROUP BY 1, 2")
def _(spark, sf):
    return stats_out(sm.annual(P.wide(spark, sf)), "series_id", F.col("year").cast("bigint").alias("year"))


@query(
    "agg2_climatology",
    f"{P.ctes('wide')} SELECT series_id, month(ts) AS month_num, strftime(ts, '%b') AS month_name, {STATS_SQL} FROM wide GROUP BY 1, 2, 3",
)
def _(spark, sf):
    return stats_out(sm.climatology(P.wide(spark, sf)), "series_id", F.col("month_num").cast("bigint").alias("month_num"), "month_name")


CATS = (
    "c AS (SELECT *, CASE WHEN y <= quantile_cont(y, 1.0/3) OVER (PARTITION BY series_id) THEN 'Low' "
    "WHEN y <= quantile_cont(y, 2.0/3) OVER (PARTITION BY series_id) THEN 'Medium' ELSE 'High' END AS category FROM monthly)"
)


@query("agg3_category_stats", f"{P.ctes('monthly')}, {CATS} SELECT series_id, category, {STATS_SQL} FROM c GROUP BY 1, 2")
def _(spark, sf):
    return stats_out(sm.category_stats(P.monthly(spark, sf)), "series_id", "category")


@query(
    "agg4_label_codes",
    f"{P.ctes('monthly')}, {CATS} SELECT series_id, {sday('ts')} AS d, category, CAST(CASE category WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END AS BIGINT) AS code FROM c",
)
def _(spark, sf):
    df = sm.tercile_labels(P.monthly(spark, sf))
    return df.select("series_id", day("ts").alias("d"), "category", sm.label_code(F.col("category")).cast("bigint").alias("code"))


@query(
    "agg5_missing_summary",
    f"{P.ctes('wide')}, l AS (SELECT *, lag(y, 12) OVER w AS lag_12 FROM wide {WSQL}) SELECT 'y' AS name, count(*) - count(y) AS missing_count, "
    f"{sq('100.0 * (count(*) - count(y)) / count(*)')} AS missing_pct FROM l UNION ALL SELECT 'lag_12', count(*) - count(lag_12), {sq('100.0 * (count(*) - count(lag_12)) / count(*)')} FROM l",
)
def _(spark, sf):
    df = P.wide(spark, sf).withColumns(win.lags(ks=(12,)))
    return sm.missing_summary(df, ["y", "lag_12"]).select(F.col("column").alias("name"), "missing_count", q("missing_pct").alias("missing_pct"))


@query(
    "agg6_trend",
    f"{P.ctes('monthly')}, a AS (SELECT series_id, year(ts) AS yr, avg(y) AS mean FROM monthly GROUP BY 1, 2) "
    f"SELECT series_id, {sq('regr_slope(mean, yr)', 4)} AS per_year, {sq('10 * regr_slope(mean, yr)', 3)} AS per_decade FROM a GROUP BY 1",
)
def _(spark, sf):
    t = sm.trend(P.monthly(spark, sf))
    return t.select("series_id", q("per_year", 4).alias("per_year"), q("per_decade", 3).alias("per_decade"))


@query(
    "agg7_group_features",
    f"{P.ctes('monthly')} SELECT series_id, {sday('ts')} AS d, {sq('avg(y) OVER (PARTITION BY series_id, month(ts))', 3)} AS month_mean, "
    f"{sq('stddev_samp(y) OVER (PARTITION BY series_id, year(ts))', 3)} AS year_std FROM monthly",
)
def _(spark, sf):
    from tidewell.operators.features import group_stats

    df = P.monthly(spark, sf).withColumns({"m": F.month("ts"), "yr": F.year("ts")})
    df = group_stats(group_stats(df, ["m"], "month_mean", "month_std"), ["yr"], "year_mean", "year_std")
    return df.select("series_id", day("ts").alias("d"), q("month_mean", 3).alias("month_mean"), q("year_std", 3).alias("year_std"))


DESC = f"count(v) AS count, {sq('avg(v)', 4)} AS mean, {sq('stddev_samp(v)', 4)} AS std, {sq('min(v)', 4)} AS min, {sq('quantile_cont(v, 0.25)', 4)} AS q25, {sq('median(v)', 4)} AS median, {sq('quantile_cont(v, 0.75)', 4)} AS q75, {sq('max(v)', 4)} AS max"
DESC_COLS = ("mean", "std", "min", "q25", "median", "q75", "max")


@query("agg8_describe", f"WITH e AS (SELECT event_type AS series_id, value AS v FROM events) SELECT series_id, {DESC} FROM e GROUP BY 1")
def _(spark, sf):
    d = sm.describe(P.raw(spark, sf), "y", ["series_id"])
    return d.select("series_id", "count", *[q(c, 4).alias(c) for c in DESC_COLS])


@query("agg8_describe_table", f"WITH e AS (SELECT l_extendedprice AS v FROM lineitem) SELECT {DESC} FROM e")
def _(spark, sf):
    d = sm.describe(table(spark, sf, "lineitem").select("l_extendedprice"), "l_extendedprice")
    return d.select("count", *[q(c, 4).alias(c) for c in DESC_COLS])


@query(
    "agg8_quantiles_by_bins",
    f"SELECT l_returnflag AS flag, {sq('quantile_cont(l_extendedprice, 0.25)', 4)} AS q25, {sq('median(l_extendedprice)', 4)} AS median, {sq('quantile_cont(l_extendedprice, 0.999)', 4)} AS q999 FROM lineitem GROUP BY 1",
)
def _(spark, sf):
    # the way taken for groups too large to sort as one array
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    d = qt.quantile_columns(rows, "l_extendedprice", {"q25": 0.25, "median": 0.5, "q999": 0.999}, ["flag"])
    return d.select("flag", *[q(c, 4).alias(c) for c in ("q25", "median", "q999")])


STAT9 = ("mean", "std", "min", "max", "missing_rate", "autocorrelation", "trend")
STAT9_SQL = ", ".join(
    f"{sq(e, 4)} AS {n}"
    for n, e in zip(STAT9, ("avg(y)", "stddev_pop(y)", "min(y)", "max(y)", "1 - count(y) / count(*)", "corr(y, p)", "regr_slope(y, t)"))
)


@query(
    "agg9_data_stats",
    f"{P.ctes('monthly')}, s AS (SELECT *, lag(y) OVER w AS p, row_number() OVER w - 1 AS t FROM monthly {WSQL}) SELECT series_id, {STAT9_SQL} FROM s GROUP BY 1",
)
def _(spark, sf):
    return sm.data_stats(P.monthly(spark, sf)).select("series_id", *[q(c, 4).alias(c) for c in STAT9])


METRIC_SQL = (
    "met AS (SELECT model, count(*) AS n, avg(abs(y - yhat)) AS mae, avg((y - yhat) * (y - yhat)) AS mse, sqrt(avg((y - yhat) * (y - yhat))) AS rmse, "
    "100 * avg(CASE WHEN y <> 0 THEN abs((y - yhat) / y) END) AS mape, max(abs(y - yhat)) AS max_error, "
    "1 - avg((y - yhat) * (y - yhat)) / var_pop(y) AS r2, sqrt(avg((y - yhat) * (y - yhat))) / stddev_pop(y) AS rmse_over_sd FROM ml GROUP BY 1)"
)
METRICS = {"mae": 3, "mse": 0, "rmse": 3, "mape": 4, "max_error": 3, "r2": 6}


@query(
    "agg10_regression_metrics",
    f"{P.ctes('wide')}, {P.forecasts_sql('wide')}, {METRIC_SQL} SELECT model, n, {', '.join(f'{sq(c, d)} AS {c}' for c, d in METRICS.items())} FROM met",
)
def _(spark, sf):
    m = sm.regression_metrics(P.forecasts(P.wide(spark, sf)), ["model"])
    return m.select("model", "n", *[q(c, d).alias(c) for c, d in METRICS.items()])


@query(
    "agg11_skill",
    f"{P.ctes('wide')}, {P.forecasts_sql('wide')}, {METRIC_SQL} SELECT m.model, {sq('1 - m.rmse / r.rmse')} AS skill, {sq('m.rmse_over_sd')} AS rmse_over_sd FROM met m, met r WHERE r.model = 'persistence'",
)
def _(spark, sf):
    s = sm.skill(sm.regression_metrics(P.forecasts(P.wide(spark, sf)), ["model"]), "persistence")
    return s.select("model", q("skill").alias("skill"), q("rmse_over_sd").alias("rmse_over_sd"))


@query(
    "agg12_improvement",
    f"{P.ctes('wide')}, {P.forecasts_sql('wide')}, {METRIC_SQL} SELECT m.model, {sq('100 * (r.mae - m.mae) / r.mae')} AS improvement_pct FROM met m, met r WHERE r.model = 'persistence'",
)
def _(spark, sf):
    s = sm.skill(sm.regression_metrics(P.forecasts(P.wide(spark, sf)), ["model"]), "persistence")
    return s.select("model", q("improvement_pct").alias("improvement_pct"))


@query(
    "agg13_box_by_month",
    f"{P.ctes('wide')}, {P.forecasts_sql('wide')}, r AS (SELECT model, month(ts) AS m, y - yhat AS e FROM ml), "
    "b AS (SELECT model, m, quantile_cont(e, 0.25) AS q25, median(e) AS median, quantile_cont(e, 0.75) AS q75 FROM r GROUP BY 1, 2) "
    f"SELECT b.model, b.m, count(*) AS n, {sq('any_value(q25)', 3)} AS q25, {sq('any_value(median)', 3)} AS median, {sq('any_value(q75)', 3)} AS q75, "
    f"{sq('min(CASE WHEN e >= q25 - 1.5 * (q75 - q25) THEN e END)', 3)} AS low_whisker, {sq('max(CASE WHEN e <= q75 + 1.5 * (q75 - q25) THEN e END)', 3)} AS high_whisker FROM r JOIN b USING (model, m) GROUP BY b.model, b.m",
)
def _(spark, sf):
    r = P.forecasts(P.wide(spark, sf)).select("model", F.month("ts").cast("bigint").alias("m"), (F.col("y") - F.col("yhat")).alias("e"))
    b = sm.box_summary(r, "e", ["model", "m"])
    return b.select("model", "m", "n", *[q(c, 3).alias(c) for c in ("q25", "median", "q75", "low_whisker", "high_whisker")])


@query(
    "agg14_error_by_quintile",
    f"{P.ctes('wide')}, {P.forecasts_sql('wide')}, "
    "c AS (SELECT model, quantile_cont(y, 0.2) a, quantile_cont(y, 0.4) b, quantile_cont(y, 0.6) c, quantile_cont(y, 0.8) d FROM ml GROUP BY 1) "
    f"SELECT model, CAST(1 + (y > a)::INT + (y > b)::INT + (y > c)::INT + (y > d)::INT AS BIGINT) AS bin, count(*) AS n, {sq('avg(abs(y - yhat))', 3)} AS mae FROM ml JOIN c USING (model) GROUP BY 1, 2",
)
def _(spark, sf):
    b = sm.error_by_bin(P.forecasts(P.wide(spark, sf)), by=["model"])
    return b.select("model", F.col("bin").cast("bigint").alias("bin"), "n", q("mae", 3).alias("mae"))


@query(
    "agg14_error_by_season",
    f"{P.ctes('wide')}, {P.forecasts_sql('wide')} SELECT model, t % 12 + 1 AS place, count(*) AS n, {sq('avg(abs(y - yhat))', 3)} AS mae FROM ml GROUP BY 1, 2",
)
def _(spark, sf):
    b = sm.error_by_season(P.forecasts(P.wide(spark, sf)), by=["model"])
    return b.select("model", F.col("place").cast("bigint").alias("place"), "n", q("mae", 3).alias("mae"))


NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "agg15_target_correlation",
    f"{P.ctes('wide')}, f AS (SELECT series_id, y, lag(y, 1) OVER w AS lag_1, lag(y, 2) OVER w AS lag_2, avg(y) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS roll_mean_6 FROM wide {WSQL}), "
    "c AS (SELECT corr(lag_1, y) AS lag_1, corr(lag_2, y) AS lag_2, corr(roll_mean_6, y) AS roll_mean_6 FROM f) "
    f"SELECT k AS feature, {sq('v')} AS r FROM (UNPIVOT c ON lag_1, lag_2, roll_mean_6 INTO NAME k VALUE v)",
)
def _(spark, sf):
    df = P.wide(spark, sf).withColumns(win.lags(ks=(1, 2)) | win.roll_mean(windows=(6,)))
    return sm.target_correlation(df, ["lag_1", "lag_2", "roll_mean_6"]).select("feature", q("r").alias("r"))


@query(
    "agg16_correlation_matrix",
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {sq(f'corr({a}, {b})')} AS r FROM lineitem" for a in NUM for b in NUM),
)
def _(spark, sf):
    return sm.correlation_matrix(table(spark, sf, "lineitem"), NUM).select("a", "b", q("r").alias("r"))


@query(
    "agg17_column_stats",
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, {sq(f'avg({c})', 4)} AS mean, {sq(f'stddev_pop({c})', 4)} AS std, {sq(f'min({c})', 4)} AS min, {sq(f'max({c})', 4)} AS max FROM lineitem" for c in NUM
    ),
)
def _(spark, sf):
    s = sm.column_stats(table(spark, sf, "lineitem"), NUM)
    return s.select(F.col("column").alias("name"), *[q(c, 4).alias(c) for c in ("mean", "std", "min", "max")])


PROBS = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
DRAWS = f"{P.ctes('monthly')}, {P.draws_sql('monthly')}"


@query("agg18_sample_percentiles", f"{DRAWS} SELECT series_id, {sday('ts')} AS d, {', '.join(f'{sq(f'quantile_cont(yhat, {p})', 3)} AS {k}' for k, p in PROBS.items())} FROM dr GROUP BY series_id, ts")
def _(spark, sf):
    s = sm.sample_percentiles(P.draws(P.monthly(spark, sf)), PROBS, ["series_id", "ts"])
    return s.select("series_id", day("ts").alias("d"), *[q(k, 3).alias(k) for k in PROBS])


@query("agg19_pit", f"{DRAWS} SELECT series_id, {sday('ts')} AS d, {sq('avg(CASE WHEN yhat <= y THEN 1.0 ELSE 0 END)')} AS pit FROM dr GROUP BY series_id, ts")
def _(spark, sf):
    s = sm.pit(P.draws(P.monthly(spark, sf)), ["series_id", "ts"])
    return s.select("series_id", day("ts").alias("d"), q("pit").alias("pit"))


@query(
    "agg20_variance_split",
    f"{DRAWS}, g AS (SELECT series_id, ts, grp, avg(yhat) AS m, var_samp(yhat) AS v FROM dr GROUP BY 1, 2, 3) "
    f"SELECT series_id, {sday('ts')} AS d, {sq('var_samp(m)', 0)} AS epistemic, {sq('avg(v)', 0)} AS aleatoric FROM g GROUP BY series_id, ts",
)
def _(spark, sf):
    s = sm.variance_split(P.draws(P.monthly(spark, sf)), ["series_id", "ts"])
    return s.select("series_id", day("ts").alias("d"), q("epistemic", 0).alias("epistemic"), q("aleatoric", 0).alias("aleatoric"))


@query(
    "agg21_histogram",
    "WITH b AS (SELECT event_type AS series_id, least(CAST(floor(value / 12.5) AS BIGINT) + 1, 40) AS bin FROM events WHERE value BETWEEN 0 AND 500) "
    f"SELECT series_id, bin, count(*) AS n, {sq('count(*) / (sum(count(*)) OVER (PARTITION BY series_id) * 12.5)', 8)} AS density FROM b GROUP BY 1, 2",
)
def _(spark, sf):
    h = sm.histogram(P.raw(spark, sf), "y", 0.0, 500.0, 40, ["series_id"])
    return h.select("series_id", "bin", "n", q("density", 8).alias("density"))


PLOT_SQL = (
    "WITH v AS (SELECT event_type AS series_id, value AS y, count(*) AS c FROM events GROUP BY 1, 2), "
    "k AS (SELECT series_id, y, CAST(sum(c) OVER w - c + 1 AS BIGINT) AS first_rank, CAST(sum(c) OVER w AS BIGINT) AS last_rank, CAST(sum(c) OVER (PARTITION BY series_id) AS DOUBLE) AS n FROM v "
    "WINDOW w AS (PARTITION BY series_id ORDER BY y ROWS UNBOUNDED PRECEDING)), "
    "m AS (SELECT *, "
    + ", ".join(f"CASE WHEN {r} = n THEN pow(0.5, 1.0 / n) WHEN {r} = 1 THEN 1 - pow(0.5, 1.0 / n) ELSE ({r} - 0.3175) / (n + 0.365) END AS {o}" for r, o in (("first_rank", "pa"), ("last_rank", "pb")))
    + f" FROM k) SELECT series_id, y, first_rank, last_rank, {sq(normal_quantile_sql('pa'))} AS low, {sq(normal_quantile_sql('pb'))} AS high FROM m"
)


@query("agg22_normal_plot", PLOT_SQL)
def _(spark, sf):
    p = sm.normal_plot(P.raw(spark, sf), "y", ["series_id"])
    return p.select("series_id", "y", "first_rank", "last_rank", q("low").alias("low"), q("high").alias("high"))


IV = ("coverage", "mean_width", "min_width", "max_width", "std_width", "coverage_gap")


def intervals(df):
    half = 1.645 * F.lit(25000.0)
    return df.withColumns({"lo": F.col("yhat") - half - F.col("t") * 10, "hi": F.col("yhat") + half + F.col("t") * 10})


IV_SQL = "iv AS (SELECT *, yhat - 1.645 * 25000.0 - t * 10 AS lo, yhat + 1.645 * 25000.0 + t * 10 AS hi FROM ml)"


@query(
    "agg23_coverage_count",
    f"{P.ctes('wide')}, {P.forecasts_sql('wide')}, {IV_SQL} SELECT model, count(*) AS n, CAST(sum((y BETWEEN lo AND hi)::INT) AS BIGINT) AS covered, {sq('avg((y BETWEEN lo AND hi)::INT)')} AS coverage FROM iv GROUP BY 1",
)
def _(spark, sf):
    s = sm.interval_summary(intervals(P.forecasts(P.wide(spark, sf))), ["model"])
    return s.select("model", "n", "covered", q("coverage").alias("coverage"))


@query(
    "agg24_width_and_median_error",
    f"{P.ctes('wide')}, {P.forecasts_sql('wide')}, {IV_SQL} SELECT model, {sq('min(hi - lo)', 4)} AS min_width, {sq('max(hi - lo)', 4)} AS max_width, {sq('stddev_pop(hi - lo)', 4)} AS std_width, {sq('median(abs(y - yhat))', 3)} AS median_abs_error FROM iv GROUP BY 1",
)
def _(spark, sf):
    iv = intervals(P.forecasts(P.wide(spark, sf)))
    s = sm.interval_summary(iv, ["model"]).join(sm.median_abs_error(iv, ["model"]), "model")
    return s.select("model", *[q(c, 4).alias(c) for c in ("min_width", "max_width", "std_width")], q("median_abs_error", 3).alias("median_abs_error"))


@query(
    "top3_leaderboard",
    f"{P.ctes('wide')}, {P.forecasts_sql('wide')}, {METRIC_SQL} SELECT row_number() OVER (ORDER BY rmse, model) AS rank, model, {sq('rmse', 3)} AS rmse FROM met",
)
def _(spark, sf):
    m = splits.leaderboard(sm.regression_metrics(P.forecasts(P.wide(spark, sf)), ["model"]), "rmse")
    return m.select(F.col("rank").cast("bigint").alias("rank"), "model", q("rmse", 3).alias("rmse"))
