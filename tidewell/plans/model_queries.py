"""Model, stacking and forecasting queries (MLP*, REG3)."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions.draws import portable_uniform
from tidewell.operators import agents, callables, forecast, gram, models, regimes, relate, splits
from tidewell.operators import summary as sm
from tidewell.operators import windows as win
from tidewell.panel import with_position
from tidewell.plans import panels as P
from tidewell.plans.clean_queries import SEASONAL_SQL
from tidewell.plans.registry import day, q, query, sday, sq, table, uniform_sql
from tidewell.plans.uncertainty_queries import LAG_FEATURES, fold_sql, lag_frame
from tidewell.plans.window_queries import WSQL
from tidewell.session import scratch_path, spread

TRAIN_END = "2000-01-01"


def parts(spark, sf, panel=P.monthly):
    # fits and scores go over the rows many times; trees hold a row in every task's memory
    df = spread(lag_frame(panel(spark, sf)).persist()).persist()
    return df.where(F.col("ts") < TRAIN_END), df.where(F.col("ts") >= TRAIN_END)


#: Every seventh quantity and every fifth flag is taken away, to be filled again.
GAPS_SQL = "WITH g AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 > 0 THEN l_quantity END AS q0, l_extendedprice, CASE WHEN l_orderkey % 5 > 0 THEN l_returnflag END AS f0 FROM lineitem)"
PREP_SQL = (
    f"{GAPS_SQL}, rk AS (SELECT f0 AS f, row_number() OVER (ORDER BY count(*) DESC, f0) - 1 AS i FROM g WHERE f0 IS NOT NULL GROUP BY 1), "
    "li AS (SELECT l_orderkey, l_linenumber, coalesce(q0, (SELECT quantile_disc(q0, 0.5) FROM g)) AS l_quantity, l_extendedprice, coalesce(f0, (SELECT f FROM rk WHERE i = 0)) AS l_returnflag FROM g), "
    "st AS (SELECT avg(l_quantity) qa, stddev_samp(l_quantity) qs, avg(l_extendedprice) pa, stddev_samp(l_extendedprice) ps FROM li) "
    f"SELECT l_orderkey, l_linenumber, {sq('(l_quantity - qa) / qs')} AS quantity, {sq('(l_extendedprice - pa) / ps')} AS price, "
    + ", ".join(f"(i = {k})::INT::DOUBLE AS flag_{k}" for k in range(3))
    + " FROM li JOIN rk ON l_returnflag = f, st"
)


@query("mlp1_preprocessing", PREP_SQL)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 7 > 0, F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice", F.when(F.col("l_orderkey") % 5 > 0, F.col("l_returnflag")).alias("l_returnflag"),
    )
    out = models.preprocessing(["l_quantity", "l_extendedprice"], ["l_returnflag"]).fit(li).transform(li)
    names = ["quantity", "price", "flag_0", "flag_1", "flag_2"]
    named = models.vector_column(out, "features", names)
    return named.select("l_orderkey", "l_linenumber", q("quantity").alias("quantity"), q("price").alias("price"), *names[2:])


NUM = ("l_quantity", "l_extendedprice")


def _scaler_sql(offset, width):
    cols = ", ".join(f"{sq(f'({c} - (SELECT {offset.format(c)} FROM tr)) / (SELECT {width.format(c)} FROM tr)')} AS {c}_scaled, {sq(c, 4)} AS {c}_back" for c in NUM)
    return f"WITH tr AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{TRAIN_END}') SELECT l_orderkey, l_linenumber, {cols} FROM lineitem"


def _scaled(spark, sf, kind):
    li = table(spark, sf, "lineitem")
    fitted = models.fit_scaler(li.where(F.col("l_shipdate") < TRAIN_END), NUM, kind)
    out = models.scale(li, fitted)
    cols = [x for c in NUM for x in (q(f"{c}_scaled").alias(f"{c}_scaled"), q(models.unscale(F.col(f"{c}_scaled"), fitted[c]), 4).alias(f"{c}_back"))]
    return out.select("l_orderkey", "l_linenumber", *cols)


@query("mlp2_standard_scaling", _scaler_sql("avg({})", "stddev_pop({})"))
def _(spark, sf):
    return _scaled(spark, sf, "standard")


@query("mlp2_minmax_scaling", _scaler_sql("min({})", "max({0}) - min({0})"))
def _(spark, sf):
    return _scaled(spark, sf, "minmax")


OLS_SQL = f"f AS (SELECT series_id, ts, y, lag(y) OVER w AS x FROM monthly {WSQL}), k AS (SELECT * FROM f WHERE x IS NOT NULL)"


@query("mlp3_linear_model", f"{P.ctes('monthly')}, {OLS_SQL} SELECT {sq('regr_slope(y, x)')} AS slope, {sq('regr_intercept(y, x)', 3)} AS intercept FROM k WHERE ts < TIMESTAMP '{TRAIN_END}'")
def _(spark, sf):
    df = P.monthly(spark, sf).withColumns(win.lags(ks=(1,))).where("lag_1 IS NOT NULL")
    train = df.where(F.col("ts") < TRAIN_END)
    m = models.inner(models.on_features(models.linear(), ["lag_1"]).fit(train))
    got = train.agg(F.lit(float(m.coefficients[0])).alias("slope"), F.lit(float(m.intercept)).alias("intercept"))
    return got.select(q("slope").alias("slope"), q("intercept", 3).alias("intercept"))


@query("mlp3_linear_per_series", f"{P.ctes('wide')}, {OLS_SQL.replace('monthly', 'wide')} SELECT series_id, {sq('regr_slope(y, x)', 5)} AS slope, {sq('regr_intercept(y, x)', 2)} AS intercept, count(*) AS n FROM k GROUP BY 1")
def _(spark, sf):
    df = P.wide(spark, sf).withColumns(win.lags(ks=(1,))).where("lag_1 IS NOT NULL")
    # a line needs two points
    m = gram.fit_linear(df, ["series_id"], ["lag_1"]).withColumn("beta", F.when(F.col("n") > 1, F.col("beta")))
    return m.select("series_id", q(F.col("beta")[1], 5).alias("slope"), q(F.col("beta")[0], 2).alias("intercept"), "n")


@query("mlp3_ridge_and_lasso")
def _(spark, sf):
    train, test = parts(spark, sf, P.wide)
    row = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("y").alias("sd")).first()
    fits = {"ridge": models.ridge(1.0, row["n"], row["sd"]), "lasso": models.lasso(100.0)}
    return models.evaluate_models({n: models.on_features(e, LAG_FEATURES).fit(train) for n, e in fits.items()}, test, LAG_FEATURES)


RIDGE = 1e10


@query(
    "mlp3_ridge_closed_form",
    f"{P.ctes('monthly')}, {OLS_SQL}, s AS (SELECT regr_sxy(y, x) / (regr_sxx(y, x) + {RIDGE}) AS b, avg(y) AS my, avg(x) AS mx FROM k) SELECT {sq('b')} AS slope, {sq('my - b * mx', 2)} AS intercept FROM s",
)
def _(spark, sf):
    df = P.monthly(spark, sf).withColumns(win.lags(ks=(1,))).where("lag_1 IS NOT NULL").withColumn("g", F.lit(1))
    centre = df.agg(F.avg("lag_1")).first()[0]
    m = gram.fit_linear(df.withColumn("x", F.col("lag_1") - centre), ["g"], ["x"], l2=RIDGE)
    slope = F.col("beta")[1]
    return m.select(q(slope).alias("slope"), q(F.col("beta")[0] - slope * centre, 2).alias("intercept"))


@query("mlp4_tree_models")
def _(spark, sf):
    train, test = parts(spark, sf, P.wide)
    fits = {"forest": models.forest(20, 4), "boosted": models.boosted(10, 3)}
    return models.evaluate_models({n: models.on_features(e, LAG_FEATURES).fit(train) for n, e in fits.items()}, test, LAG_FEATURES)


ONE_SPLIT_SQL = "SELECT o_orderkey, {0} AS forest, {0} AS boosted FROM (SELECT o_orderkey, avg(o_totalprice) OVER (PARTITION BY o_orderpriority = '1-URGENT') AS m FROM orders)".format(sq("m", 4))


@query("mlp4_one_split", ONE_SPLIT_SQL)
def _(spark, sf):
    """Trees of one split on a two-valued feature predict the mean of each side."""
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderpriority") == "1-URGENT").cast("double").alias("urgent"), F.col("o_totalprice").alias("y"))
    out = o
    for name, est in (("forest", models.forest(1, 1, bootstrap=False)), ("boosted", models.boosted(1, 1, 1.0))):
        fitted = models.on_features(est, ["urgent"]).fit(o)
        out = fitted.transform(out).withColumnRenamed("prediction", name)
    return out.select("o_orderkey", q("forest", 4).alias("forest"), q("boosted", 4).alias("boosted"))


@query("mlp5_grid_search")
def _(spark, sf):
    df = lag_frame(P.monthly(spark, sf))
    return models.search(df, LAG_FEATURES, "forest", models.grid({"trees": (5, 10), "depth": (2, 4)}), k=5)


@query("mlp6_random_search")
def _(spark, sf):
    df = lag_frame(P.monthly(spark, sf))
    return models.search(df, LAG_FEATURES, "boosted", models.random_grid({"rounds": (3, 5), "depth": (2, 3), "step": (0.05, 0.1)}, 3), k=5)


FOLD_SQL = fold_sql()


def linear_folds(spark, sf):
    df = P.monthly(spark, sf).withColumns(win.lags(ks=(1,)))
    return models.linear_fold_predictions(df, ["lag_1"], {"linear": 0.0})


@query(
    "mlp7_cv_metrics",
    f"{FOLD_SQL}, m AS (SELECT fold, avg((y - yhat) * (y - yhat)) AS mse, sqrt(avg((y - yhat) * (y - yhat))) AS rmse, 1 - avg((y - yhat) * (y - yhat)) / var_pop(y) AS r2 FROM pr GROUP BY 1) "
    f"SELECT count(*) AS folds, {sq('avg(mse) / 1e6', 3)} AS mse, {sq('avg(rmse)', 2)} AS rmse, {sq('avg(r2)', 5)} AS r2 FROM m",
)
def _(spark, sf):
    m = models.cv_metrics(linear_folds(spark, sf))
    return m.select("folds", q(F.col("mse") / 1e6, 3).alias("mse"), q("rmse", 2).alias("rmse"), q("r2", 5).alias("r2"))


@query("mlp8_oof_predictions", f"{FOLD_SQL} SELECT series_id, {sday('ts')} AS d, fold, {sq('y', 3)} AS y, {sq('yhat', 3)} AS yhat FROM pr")
def _(spark, sf):
    p = linear_folds(spark, sf)
    return p.select("series_id", day("ts").alias("d"), F.col("fold").cast("bigint").alias("fold"), q("y", 3).alias("y"), q("yhat", 3).alias("yhat"))


BASES = {"linear": lambda: models.linear(), "forest": lambda: models.forest(10, 3), "boosted": lambda: models.boosted(5, 3)}


def stacked(spark, sf, k=5):
    df = lag_frame(P.monthly(spark, sf))
    preds = models.fold_predictions(df, LAG_FEATURES, {n: f() for n, f in BASES.items()}, k)
    return models.repair_oof(models.oof_matrix(preds, [*BASES, "absent"]), [*BASES, "absent"])


@query(
    "mlp9_repaired_oof",
    f"{P.ctes('wide')}, fc AS (SELECT series_id, ts, y, lag(y, 1) OVER w AS a, lag(y, 12) OVER w AS b FROM wide {WSQL}), "
    "m AS (SELECT median(a) AS ma, median(b) AS mb FROM fc WHERE a IS NOT NULL OR b IS NOT NULL) "
    f"SELECT series_id, {sday('ts')} AS d, {sq('coalesce(a, ma)', 3)} AS one, {sq('coalesce(b, mb)', 3)} AS twelve FROM fc, m WHERE a IS NOT NULL OR b IS NOT NULL",
)
def _(spark, sf):
    cols = win.lags(ks=(1, 12, 500))
    base = P.wide(spark, sf).withColumns({"one": cols["lag_1"], "twelve": cols["lag_12"], "never": cols["lag_500"]})
    fixed, _kept = models.repair_oof(base, ["one", "twelve", "never"])
    return fixed.select("series_id", day("ts").alias("d"), q("one", 3).alias("one"), q("twelve", 3).alias("twelve"))


@query("mlp10_stacked_model")
def _(spark, sf):
    oof, kept = stacked(spark, sf)
    oof = oof.persist()
    stack = models.fit_stack(oof, kept)
    scored = models.predict_stack(oof, stack).select("series_id", "ts", "y", F.col("stacked").alias("yhat"), F.lit("stack").alias("model"))
    return sm.regression_metrics(scored, ["model"])


@query(
    "mlp10_stack_of_one",
    f"{P.ctes('wide')}, {OLS_SQL.replace('monthly', 'wide')}, z AS (SELECT series_id, ts, y, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS z FROM k), s AS (SELECT avg(y) AS a, regr_sxy(y, z) / (regr_sxx(y, z) + 50.0) AS b FROM z) "
    f"SELECT series_id, {sday('ts')} AS d, {sq('a + b * z', 2)} AS stacked FROM z, s",
)
def _(spark, sf):
    oof = P.wide(spark, sf).withColumns({"one": win.lags(ks=(1,))["lag_1"]}).where("one IS NOT NULL")
    out = models.predict_stack(oof, models.fit_stack(oof, ["one"], alpha=50.0))
    return out.select("series_id", day("ts").alias("d"), q("stacked", 2).alias("stacked"))


@query("mlp11_best_candidate")
def _(spark, sf):
    train, test = parts(spark, sf, P.wide)
    path = scratch_path(spark, "best-model")
    board, name, _ = models.best_on_holdout(train, test, LAG_FEATURES, {"linear": models.linear(), "forest": models.forest(10, 3)}, path=path)
    saved = models.evaluate_models({name: PipelineModel.load(path)}, test, LAG_FEATURES).first()["rmse"]
    return splits.leaderboard(board, "rmse").withColumns({"best": F.lit(name), "saved_rmse": F.lit(saved)})


@query("mlp12_feature_selection")
def _(spark, sf):
    df = lag_frame(P.monthly(spark, sf)).persist()
    by_r = models.top_correlated(df, LAG_FEATURES, 2)
    strong = models.strong_coefficients(models.on_features(models.lasso(100.0), LAG_FEATURES).fit(df), LAG_FEATURES)
    hits = models.shadow_selection(df, LAG_FEATURES, ["series_id", "ts"], rounds=2, trees=10)
    rows = [F.struct(F.lit(f).alias("feature"), F.lit(int(f in by_r)).alias("by_correlation"), F.lit(int(f in strong)).alias("by_lasso"), F.lit(hits[f]).alias("shadow_hits")) for f in LAG_FEATURES]
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.inline(F.array(*rows)), "n_rows")


@query("mlp12_permutation_importance")
def _(spark, sf):
    df = lag_frame(P.monthly(spark, sf))
    model = models.on_features(models.linear(), LAG_FEATURES).fit(df)
    return models.permutation_importance(model, df, LAG_FEATURES, ["series_id", "ts"])


SHUFFLE_SQL = (
    f"{P.ctes('monthly')}, {OLS_SQL}, c AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM k), "
    f"ra AS (SELECT y, x, row_number() OVER (ORDER BY {uniform_sql(42, 'series_id', 'ts')}) AS r FROM k), rb AS (SELECT x, row_number() OVER (ORDER BY {uniform_sql(43, 'series_id', 'ts')}) AS r FROM k), "
    "e AS (SELECT sqrt(avg(pow(ra.y - a - b * rb.x, 2))) AS rmse, sqrt(avg(pow(ra.y - a - b * ra.x, 2))) AS base FROM ra JOIN rb USING (r), c) "
    f"SELECT 'lag_1' AS feature, {sq('rmse', 2)} AS rmse, {sq('rmse - base', 2)} AS increase FROM e"
)


@query("mlp12_shuffled_lag", SHUFFLE_SQL)
def _(spark, sf):
    df = P.monthly(spark, sf).withColumns(win.lags(ks=(1,))).where("lag_1 IS NOT NULL")
    model = models.on_features(models.linear(), ["lag_1"]).fit(df)
    out = models.permutation_importance(model, df, ["lag_1"], ["series_id", "ts"], draw=portable_uniform)
    return out.select("feature", q("rmse", 2).alias("rmse"), q("increase", 2).alias("increase"))


@query("mlp13_importance_table")
def _(spark, sf):
    df = spread(lag_frame(P.wide(spark, sf)).persist()).persist()
    return models.importance_table(models.on_features(models.forest(20, 4), LAG_FEATURES).fit(df), LAG_FEATURES, df, 3)


BETA = (0.4, -0.2, 0.7)


@query(
    "mlp14_linear_attribution",
    f"{P.ctes('wide')}, f AS (SELECT y, lag(y, 1) OVER w AS lag_1, lag(y, 2) OVER w AS lag_2, avg(y) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS roll_mean_6 FROM wide {WSQL}), "
    "k AS (SELECT * FROM f WHERE lag_2 IS NOT NULL), m AS (SELECT avg(lag_1) a, avg(lag_2) b, avg(roll_mean_6) c FROM k), "
    "s AS (SELECT avg(abs(0.4 * (lag_1 - a))) AS lag_1, avg(abs(-0.2 * (lag_2 - b))) AS lag_2, avg(abs(0.7 * (roll_mean_6 - c))) AS roll_mean_6 FROM k, m) "
    f"SELECT n AS feature, {sq('v', 3)} AS mean_abs FROM (UNPIVOT s ON lag_1, lag_2, roll_mean_6 INTO NAME n VALUE v)",
)
def _(spark, sf):
    a = models.linear_attribution(lag_frame(P.wide(spark, sf)), BETA, LAG_FEATURES)
    return a.select("feature", q("mean_abs", 3).alias("mean_abs"))


@query("mlp15_partial_dependence")
def _(spark, sf):
    df = lag_frame(P.monthly(spark, sf))
    model = models.on_features(models.forest(10, 4), LAG_FEATURES).fit(df)
    lo, hi = df.agg(F.min("lag_1"), F.max("lag_1")).first()
    return models.partial_dependence(model, df, "lag_1", [lo + (hi - lo) * i / 9 for i in range(10)])


@query(
    "mlp16_persistence",
    f"{P.ctes('wide')}, l AS (SELECT series_id, max(ts) AS a, max_by(y, ts) AS yhat FROM wide GROUP BY 1) SELECT series_id, CAST(k AS BIGINT) AS step, {sday('a + to_months(CAST(k AS INT))')} AS d, {sq('yhat', 4)} AS yhat FROM l, range(1, 7) r(k)",
)
def _(spark, sf):
    f = forecast.persistence(P.wide(spark, sf), 6)
    return f.select("series_id", F.col("step").cast("bigint").alias("step"), day("ts").alias("d"), q("yhat", 4).alias("yhat"))


@query(
    "mlp16_seasonal_profile",
    f"{P.ctes('hourly')}, {SEASONAL_SQL} SELECT series_id, CAST(hr AS BIGINT) AS hour, {sq('profile')} AS profile FROM p",
)
def _(spark, sf):
    p = relate.hour_profile(P.hourly(spark, sf))
    return p.select("series_id", F.col("hour").cast("bigint").alias("hour"), q("profile").alias("profile"))


@query(
    "mlp15_dependence_of_linear_model",
    f"{P.ctes('monthly')}, {OLS_SQL}, b AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS c FROM k), g AS (SELECT unnest([100000, 200000, 300000])::DOUBLE AS value) SELECT value, {sq('c + b * value', 2)} AS mean_prediction FROM b, g",
)
def _(spark, sf):
    df = P.monthly(spark, sf).withColumns(win.lags(ks=(1,))).where("lag_1 IS NOT NULL")
    model = models.on_features(models.linear(), ["lag_1"]).fit(df)
    p = models.partial_dependence(model, df, "lag_1", [100000.0, 200000.0, 300000.0])
    return p.select("value", q("mean_prediction", 2).alias("mean_prediction"))


@query("mlp17_recursive_forest")
def _(spark, sf):
    names = [f"lag_{k}" for k in range(1, 4)]
    m = P.monthly(spark, sf)
    train = m.withColumns(win.lags(ks=(1, 2, 3))).na.drop(subset=names)
    model = models.inner(models.on_features(models.forest(200, 4), names).fit(train))
    return forecast.recursive_forecast(m, model, 6, 3)


@query(
    "mlp17_recursive_linear",
    f"{P.ctes('monthly').replace('WITH', 'WITH RECURSIVE')}, {OLS_SQL}, co AS (SELECT series_id, regr_slope(y, x) AS b, regr_intercept(y, x) AS c, max_by(y, ts) AS l FROM k GROUP BY 1), "
    "s AS (SELECT series_id, b, c, CAST(1 AS BIGINT) AS step, c + b * l AS yhat FROM co UNION ALL SELECT series_id, b, c, step + 1, c + b * yhat FROM s WHERE step < 12) "
    f"SELECT series_id, step, {sq('yhat', 3)} AS yhat FROM s",
)
def _(spark, sf):
    f = forecast.linear_recursive_forecast(P.monthly(spark, sf), 12, 1)
    return f.select("series_id", F.col("step").cast("bigint").alias("step"), q("yhat", 3).alias("yhat"))


@query(
    "mlp18_ar1_forecast",
    f"{P.ctes('monthly')}, {OLS_SQL}, co AS (SELECT series_id, regr_slope(y, x) AS phi, regr_intercept(y, x) AS c, var_pop(y) - regr_slope(y, x) * covar_pop(y, x) AS s2, max_by(y, ts) AS l FROM k GROUP BY 1), "
    "s AS (SELECT series_id, CAST(h AS BIGINT) AS step, c * (1 - pow(phi, h)) / (1 - phi) + pow(phi, h) * l AS yhat, s2 * (1 - pow(phi, 2 * h)) / (1 - phi * phi) AS var FROM co, range(1, 13) r(h)) "
    f"SELECT series_id, step, {sq('yhat', 3)} AS yhat, {sq('yhat - 1.96 * sqrt(var)', 2)} AS lo, {sq('yhat + 1.96 * sqrt(var)', 2)} AS hi FROM s",
)
def _(spark, sf):
    f = forecast.ar1_forecast(P.monthly(spark, sf), 12)
    return f.select("series_id", F.col("step").cast("bigint").alias("step"), q("yhat", 3).alias("yhat"), q("lo", 2).alias("lo"), q("hi", 2).alias("hi"))


@query("mlp19_trend_season_forecast")
def _(spark, sf):
    m = P.monthly(spark, sf)
    both = forecast.trend_season_forecast(m, 12).withColumn("mode", F.lit("additive"))
    return both.unionByName(forecast.trend_season_forecast(m, 12, multiplicative=True).withColumn("mode", F.lit("multiplicative")))


@query(
    "mlp19_trend_only",
    f"{P.ctes('wide')}, p AS (SELECT *, row_number() OVER w - 1 AS t FROM wide {WSQL}), m AS (SELECT series_id, regr_slope(y, t) AS b, regr_intercept(y, t) AS c, count(*) AS n FROM p GROUP BY 1) "
    f"SELECT series_id, CAST(k AS BIGINT) AS step, {sq('c + b * (n + k - 1)', 2)} AS yhat FROM m, range(1, 7) r(k)",
)
def _(spark, sf):
    f = forecast.trend_season_forecast(P.wide(spark, sf), 6, orders=()).withColumn("yhat", F.when(F.col("n") > 1, F.col("yhat")))
    return f.select("series_id", F.col("step").cast("bigint").alias("step"), q("yhat", 2).alias("yhat"))


DATED_SQL = (
    f"{P.ctes('wide')}, f AS (SELECT series_id, ts, y, lag(y) OVER w AS x FROM wide {WSQL}), k AS (SELECT * FROM f WHERE x IS NOT NULL), "
    "d AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM k)), "
    "fo AS (SELECT k.*, CAST(r.k AS BIGINT) AS fold, i, n // 6 AS s, n - (6 - r.k) * (n // 6) AS a FROM k JOIN d USING (ts), range(1, 6) r(k)), "
    "co AS (SELECT fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS c FROM fo WHERE i < a GROUP BY 1) "
)


@query("mlp8_dated_folds", f"{DATED_SQL} SELECT series_id, {sday('ts')} AS d, fo.fold, {sq('c + b * x', 3)} AS yhat FROM fo JOIN co ON fo.fold = co.fold WHERE i >= a AND i < a + s")
def _(spark, sf):
    df = P.wide(spark, sf).withColumns(win.lags(ks=(1,))).where("lag_1 IS NOT NULL")
    out = models.linear_fold_predictions(df, ["lag_1"], {"linear": 0.0}, folds=splits.dated_folds)
    return out.select("series_id", day("ts").alias("d"), F.col("fold").cast("bigint").alias("fold"), q("yhat", 3).alias("yhat"))


GIVEN_SQL = fold_sql().replace("regr_slope(y, x) AS b, regr_intercept(y, x) AS c", "avg(y) AS mean, sum(x * y) / sum(x * x) AS b").replace("y, c + b * x AS yhat", "y, mean, b * x AS through")


@query(
    "mlp8_given_functions",
    f"{GIVEN_SQL} SELECT series_id, {sday('ts')} AS d, fold, model, {sq('yhat', 3)} AS yhat FROM (SELECT *, 'mean' AS model, mean AS yhat FROM pr UNION ALL SELECT *, 'origin', through FROM pr)",
)
def _(spark, sf):
    df = P.monthly(spark, sf).withColumns(win.lags(ks=(1,))).where("lag_1 IS NOT NULL")
    out = callables.fold_predictions(df, ["lag_1"], [("mean", callables.mean_model), ("origin", callables.origin_model)])
    return out.select("series_id", day("ts").alias("d"), F.col("fold").cast("bigint").alias("fold"), "model", q("yhat", 3).alias("yhat"))


@query("mlp20_forecast_chain")
def _(spark, sf):
    return forecast.forecast_chain(P.wide(spark, sf), 6)


@query(
    "mlp20_chain_without_season",
    f"{P.ctes('wide')}, {OLS_SQL.replace('monthly', 'wide')}, co AS (SELECT series_id, regr_slope(y, x) AS phi, regr_intercept(y, x) AS c, max_by(y, ts) AS l, count(*) + 1 AS n FROM k GROUP BY 1), "
    "nv AS (SELECT series_id, avg(y) AS m FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS i FROM wide) WHERE i <= 12 GROUP BY 1) "
    f"SELECT nv.series_id, CAST(h AS BIGINT) AS step, {sq('CASE WHEN n >= 25 THEN c * (1 - pow(phi, h)) / (1 - phi) + pow(phi, h) * l ELSE m END', 2)} AS yhat, CASE WHEN n >= 25 THEN 'ar1' ELSE 'naive' END AS method FROM nv LEFT JOIN co ON nv.series_id = co.series_id, range(1, 5) r(h)",
)
def _(spark, sf):
    f = forecast.forecast_chain(P.wide(spark, sf), 4, least_rows=(10**9, 25))
    return f.select("series_id", F.col("step").cast("bigint").alias("step"), q("yhat", 2).alias("yhat"), "method")


MIXED = (("h:", "hourly", None), ("s:", "hourly", 5), ("d:", "daily", None), ("n:", "daily", 8), ("m:", "monthly", None))


def mixed_panel(spark, sf):
    """Hourly, daily and monthly series, some cut to their last days."""
    out = None
    for mark, name, days in MIXED:
        df = getattr(P, name)(spark, sf)
        if days:
            end = df.groupBy("series_id").agg(F.max("ts").alias("end"))
            df = df.join(end, "series_id").where(F.col("ts") > F.col("end") - F.expr(f"INTERVAL {days} DAYS")).drop("end")
        df = df.select(F.concat(F.lit(mark), "series_id").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), "y")
        out = df if out is None else out.unionByName(df)
    return out


MIXED_SQL = (
    P.ctes("hourly", "daily", "monthly") + ", mx AS ("
    + " UNION ALL ".join(
        f"SELECT '{m}' || series_id AS series_id, CAST(ts AS TIMESTAMP) AS ts, y FROM {n}" + (f" QUALIFY ts > max(ts) OVER (PARTITION BY series_id) - INTERVAL {d} DAY" if d else "") for m, n, d in MIXED
    )
    + "), z AS (SELECT series_id, count(*) AS n, max(ts) AS b, max_by(y, ts) AS l, coalesce((epoch(max(ts)) - epoch(min(ts))) / nullif(count(*) - 1, 0), 0) AS gap FROM mx WHERE y IS NOT NULL GROUP BY 1), "
    "ro AS (SELECT *, CASE WHEN n >= 198 AND gap <= 7200 THEN 'lagged' WHEN n >= 36 AND gap BETWEEN 20 * 86400 AND 45 * 86400 THEN 'trend_season' WHEN n >= 12 AND gap >= 7200 THEN 'ar1' WHEN n >= 24 AND gap <= 7200 THEN 'hour_profile' ELSE 'naive' END AS method FROM z), "
    "lg AS (SELECT series_id, y, lag(y) OVER (PARTITION BY series_id ORDER BY ts) AS x FROM mx), "
    "co AS (SELECT series_id, regr_slope(y, x) AS phi, regr_intercept(y, x) AS c FROM lg WHERE x IS NOT NULL GROUP BY 1), "
    "hp AS (SELECT mx.series_id, hour(ts) AS h, avg(y) AS m FROM mx JOIN z USING (series_id) WHERE ts > b - INTERVAL 7 DAY GROUP BY 1, 2) "
)


@query(
    "mlp20_routed_forecast",
    f"{MIXED_SQL} SELECT ro.series_id, CAST(k AS BIGINT) AS step, method, {sq('CASE method WHEN ' + chr(39) + 'naive' + chr(39) + ' THEN l WHEN ' + chr(39) + 'ar1' + chr(39) + ' THEN c * (1 - pow(phi, k)) / (1 - phi) + pow(phi, k) * l WHEN ' + chr(39) + 'hour_profile' + chr(39) + ' THEN coalesce(m, l) END', 3)} AS yhat "
    "FROM ro JOIN co USING (series_id) JOIN range(1, 13) r(k) ON true LEFT JOIN hp ON ro.series_id = hp.series_id AND hp.h = (hour(b) + k) % 24",
)
def _(spark, sf):
    f = forecast.routed_forecast(mixed_panel(spark, sf), 12)
    plain = F.when(F.col("method").isin("naive", "ar1", "hour_profile"), F.col("yhat"))  # the others have closed forms of their own queries
    return f.select("series_id", F.col("step").cast("bigint").alias("step"), "method", q(plain, 3).alias("yhat"))


@query("mlp21_ensemble_mean", f"{P.ctes('wide')}, {P.forecasts_sql('wide')} SELECT series_id, {sday('ts')} AS d, {sq('avg(yhat)', 3)} AS ensemble, count(*) AS members FROM ml GROUP BY series_id, ts")
def _(spark, sf):
    e = forecast.ensemble_mean(P.forecasts(P.wide(spark, sf)), ["series_id", "ts"])
    return e.select("series_id", day("ts").alias("d"), q("ensemble", 3).alias("ensemble"), "members")


@query(
    "mlp22_predict_with_fallback",
    f"{P.ctes('wide')}, f AS (SELECT *, lag(y, 12) OVER w AS a, lag(y, 1) OVER w AS b, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS i FROM wide {WSQL}), "
    "n AS (SELECT series_id, avg(y) AS m FROM f WHERE i <= 12 GROUP BY 1) "
    f"SELECT series_id, {sday('ts')} AS d, {sq('coalesce(a, b, m)', 3)} AS mu, CASE WHEN a IS NOT NULL THEN 'predict' WHEN b IS NOT NULL THEN 'feature' ELSE 'naive' END AS mode FROM f JOIN n USING (series_id)",
)
def _(spark, sf):
    df = P.wide(spark, sf).withColumns(win.lags(ks=(1, 12)))
    return forecast.with_fallback(df, "lag_12", "lag_1").select("series_id", day("ts").alias("d"), q("mu", 3).alias("mu"), "mode")


FUSE_W = "OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"


@query(
    "mlp23_fusion",
    f"{P.ctes('wide')}, f AS (SELECT series_id, ts, lag(y) OVER (PARTITION BY series_id ORDER BY ts) AS a, avg(y) {FUSE_W} AS b, coalesce(var_pop(y) {FUSE_W}, 0) + 1e6 AS va, coalesce(var_pop(y) {FUSE_W}, 0) / 2 AS vb FROM wide), "
    "g AS (SELECT *, 1 / greatest(va, 1e-10) AS wa, 1 / greatest(vb, 1e-10) AS wb FROM f WHERE a IS NOT NULL) "
    f"SELECT series_id, {sday('ts')} AS d, {sq('(wa * a + wb * b) / (wa + wb)', 3)} AS fused_mean, {sq('sqrt(1 / (wa + wb))', 3)} AS fused_std FROM g",
)
def _(spark, sf):
    w = win.past_frame(12)
    var = F.coalesce(F.var_pop("y").over(w), F.lit(0.0))
    df = P.wide(spark, sf).withColumns({"mu_arima": win.lags(ks=(1,))["lag_1"], "mu_ml": F.avg("y").over(w), "var_arima": var + 1e6, "var_ml": var / 2})
    means, variances = forecast.fusion_columns(df.columns)
    f = forecast.fuse(df.where("mu_arima IS NOT NULL"), list(zip(means, variances)))
    return f.select("series_id", day("ts").alias("d"), q("fused_mean", 3).alias("fused_mean"), q("fused_std", 3).alias("fused_std"))


@query(
    "mlp24_fusion_columns",
    f"WITH g AS (SELECT event_id, value AS a, event_id % 7 + 1 AS va, value / 2 AS b, event_id % 3 + 1 AS vb FROM events) SELECT event_id, {sq('(a / va + b / vb) / (1.0 / va + 1.0 / vb)')} AS fused_mean, {sq('1 / (1.0 / va + 1.0 / vb)')} AS fused_variance FROM g",
)
def _(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", F.col("value").alias("ARIMA_mean"), (F.col("event_id") % 7 + 1).cast("double").alias("arima_var"),
        (F.col("value") / 2).alias("ML_Mean"), (F.col("event_id") % 3 + 1).cast("double").alias("ml_var"),
    )
    means, variances = forecast.fusion_columns(e.columns)
    f = forecast.fuse(e, list(zip(means, variances)))
    return f.select("event_id", q("fused_mean").alias("fused_mean"), q("fused_variance").alias("fused_variance"))


@query("mlp25_registered_component", f"{P.ctes('monthly')}, {OLS_SQL}, co AS (SELECT series_id, regr_slope(y, x) AS phi, regr_intercept(y, x) AS c, max_by(y, ts) AS l FROM k GROUP BY 1) SELECT series_id, {sq('c + phi * l', 3)} AS mu, 'predict' AS mode FROM co")
def _(spark, sf):
    m = P.monthly(spark, sf)
    path = scratch_path(spark, "ar1")
    agents.get_agent("ar1").fit(m).save(path)
    return agents.PanelModel.load(path).predict(m).select("series_id", q("mu", 3).alias("mu"), "mode")


@query(
    "mlp25_pipeline_of_components",
    f"{P.ctes('monthly')}, {OLS_SQL}, co AS (SELECT series_id, regr_slope(y, x) AS phi, regr_intercept(y, x) AS c FROM k GROUP BY 1), "
    "pr AS (SELECT series_id, month(ts) AS m, avg(y) AS profile FROM monthly GROUP BY 1, 2) "
    f"SELECT f.series_id, {sday('ts')} AS d, {sq('profile', 3)} AS profile, {sq('c + phi * x', 3)} AS fitted FROM f JOIN co USING (series_id) JOIN pr ON f.series_id = pr.series_id AND month(ts) = m",
)
def _(spark, sf):
    m = P.monthly(spark, sf)
    path = scratch_path(spark, "components")
    Pipeline(stages=[agents.get_agent("profile"), agents.get_agent("ar1")]).fit(m).save(path)
    out = PipelineModel.load(path).transform(m)
    return out.select("series_id", day("ts").alias("d"), q("profile", 3).alias("profile"), q("fitted", 3).alias("fitted"))


TWO_SQL = (
    f"{P.ctes('monthly')}, f AS (SELECT series_id, ts, y, lag(y, 1) OVER w AS a, lag(y, 2) OVER w AS b FROM monthly {WSQL}), k AS (SELECT * FROM f WHERE b IS NOT NULL), "
    f"c AS (SELECT regr_slope(y, a) AS sa, regr_intercept(y, a) AS ia, regr_slope(y, b) AS sb, regr_intercept(y, b) AS ib FROM k WHERE ts < TIMESTAMP '{TRAIN_END}'), "
    "pr AS (SELECT 'one' AS model, y, ia + sa * a AS yhat FROM k, c WHERE ts >= TIMESTAMP '" + TRAIN_END + "' UNION ALL SELECT 'two', y, ib + sb * {two} FROM k, c WHERE ts >= TIMESTAMP '" + TRAIN_END + "'), "
    "e AS (SELECT model, count(*) AS n, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) * (y - yhat))) AS rmse FROM pr GROUP BY 1)"
)


def two_fits(train):
    return {n: models.on_features(models.linear(), [f]).fit(train) for n, f in (("one", "lag_1"), ("two", "lag_2"))}


def two_parts(spark, sf):
    df = P.monthly(spark, sf).withColumns(win.lags(ks=(1, 2))).na.drop(subset=["lag_1", "lag_2"])
    return df.where(F.col("ts") < TRAIN_END), df.where(F.col("ts") >= TRAIN_END)


@query("mlp26_evaluate_models", TWO_SQL.replace("{two}", "b") + f" SELECT model, n, {sq('mae', 2)} AS mae, {sq('rmse', 2)} AS rmse FROM e")
def _(spark, sf):
    train, test = two_parts(spark, sf)
    m = models.evaluate_models(two_fits(train), test, ["lag_1", "lag_2"])
    return m.select("model", "n", q("mae", 2).alias("mae"), q("rmse", 2).alias("rmse"))


@query("mlp26_missing_column", TWO_SQL.replace("{two}", "0") + f" SELECT model, n, {sq('mae', 2)} AS mae, {sq('rmse', 2)} AS rmse FROM e")
def _(spark, sf):
    train, test = two_parts(spark, sf)
    m = models.evaluate_models(two_fits(train), test.drop("lag_2"), ["lag_1", "lag_2"])
    return m.select("model", "n", q("mae", 2).alias("mae"), q("rmse", 2).alias("rmse"))


@query(
    "mlp26_one_job_per_model",
    TWO_SQL.replace("{two}", "0") + f" SELECT model, n, {sq('mae', 2)} AS mae, {sq('rmse', 2)} AS rmse, CASE model WHEN 'two' THEN 'lag_2' ELSE '' END AS filled, false AS not_loaded, false AS failed FROM e "
    "UNION ALL VALUES ('gone', NULL, NULL, NULL, '', true, false), ('text', NULL, NULL, NULL, '', false, true)",
)
def _(spark, sf):
    train, test = two_parts(spark, sf)
    fits = two_fits(train) | {"gone": scratch_path(spark, "no-such-model"), "text": models.on_features(models.linear(), ["code"]).fit(train.withColumn("code", F.col("lag_1")))}
    m = models.evaluate_each(fits, test.drop("lag_2").withColumn("code", F.lit("x")))
    return m.select("model", "n", q("mae", 2).alias("mae"), q("rmse", 2).alias("rmse"), F.array_join("filled", ",").alias("filled"), F.col("load_error").isNotNull().alias("not_loaded"), F.col("eval_error").isNotNull().alias("failed"))


@query("reg3_smoothed_boosting")
def _(spark, sf):
    names = ["lag_1", "lag_2", "lag_3"]
    m = P.monthly(spark, sf).withColumns(win.lags(ks=(1, 2, 3)))
    # the first rows take the first lag that follows
    later = Window.partitionBy("series_id").orderBy("ts").rowsBetween(0, Window.unboundedFollowing)
    m = m.withColumns({c: F.first(c, ignorenulls=True).over(later) for c in names})
    model = models.on_features(models.boosted(rounds=200, depth=3, step=0.05), names).fit(m)
    raw = model.transform(m).select("series_id", "ts", F.col("prediction").alias("raw"))
    return regimes.smoothed_prediction(raw).select("series_id", day("ts").alias("d"), "mu", "var")
