"""Models, clusters and decompositions on inputs whose answer SQL can state."""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tidewell.operators import clustering, drift, forecast, intervals, models, regimes, spectral
from tidewell.operators import windows as win
from tidewell.panel import with_position
from tidewell.plans import panels as P
from tidewell.plans.model_queries import OLS_SQL, TRAIN_END
from tidewell.plans.registry import day, q, query, sday, sq, table
from tidewell.plans.shape_queries import WIN_SQL, W, windows_of
from tidewell.plans.uncertainty_queries import fold_sql, is_ref
from tidewell.plans.window_queries import WSQL
from tidewell.session import scratch_path, spread

# --- clusters --------------------------------------------------------------------------


@query(
    "clu1_all_components",
    f"{P.ctes('wide')}, {WIN_SQL.format('wide')}, s AS (SELECT series_id, start, (v - avg(v) OVER (PARTITION BY pos)) / stddev_samp(v) OVER (PARTITION BY pos) AS z FROM win) "
    f"SELECT series_id, start, {sq('sum(z * z)', 3)} AS length2 FROM s GROUP BY 1, 2",
)
def _(spark, sf):
    """All components only turn the standardised windows, so lengths stay."""
    _, z = clustering.reduce_windows(windows_of(P.wide(spark, sf)), components=W)
    total = F.aggregate(vector_to_array("z"), F.lit(0.0), lambda s, v: s + v * v)
    return z.select("series_id", F.col("start").cast("bigint").alias("start"), q(total, 3).alias("length2"))


@query("clu4_parted_segments", "SELECT count(*) AS n, count(DISTINCT c_mktsegment) AS best_silhouette FROM customer")
def _(spark, sf):
    """Groups that gaps of a thousand widths part have the best silhouette at their own number."""
    c = table(spark, sf, "customer").withColumn("z", array_to_vector(F.array(F.ascii("c_mktsegment") * 1e7 + F.col("c_acctbal"))))
    c = spread(c.select("c_custkey", "z")).persist()
    chosen = clustering.choose_k(c, (3, 4, 5, 6), keys=["c_custkey"])
    out = c.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(chosen["silhouette"]).cast("bigint").alias("best_silhouette"))
    return out


SHAPES = ((1, 2, 3, 4, 5, 6), (6, 5, 4, 3, 2, 1), (1, 6, 1, 6, 1, 6))


@query(
    "clu5_three_shapes",
    "WITH s(k, pos, v) AS (VALUES " + ", ".join(f"({k}, {i}, {v}::DOUBLE)" for k, s in enumerate(SHAPES) for i, v in enumerate(s)) + "), "
    "c AS (SELECT c_custkey, pos, v FROM customer JOIN s ON c_custkey % 3 = k), d AS (SELECT pos, stddev_samp(v) AS sd FROM c GROUP BY 1), "
    "e AS (SELECT a.k, b.k AS h, sqrt(sum(pow((a.v - b.v) / sd, 2))) AS dist FROM s a JOIN s b ON a.pos = b.pos JOIN d ON d.pos = a.pos GROUP BY 1, 2) "
    f"SELECT c_custkey, 3::BIGINT AS centroids, {sq('sum(dist)', 4)} AS distances, 0.0::DOUBLE AS least_distance, 0.0::DOUBLE AS least_dtw FROM customer JOIN e ON c_custkey % 3 = e.k GROUP BY 1",
)
def _(spark, sf):
    """Three shapes: each is a centroid, and a window is its own shape's distance of zero away."""
    shape = F.coalesce(*[F.when(F.col("c_custkey") % 3 == k, F.array(*[F.lit(float(v)) for v in s])) for k, s in enumerate(SHAPES)])
    w = table(spark, sf, "customer").select("c_custkey", shape.alias("window"))
    out = clustering.cluster_windows(w, ["c_custkey"], 3, radius=3, restarts=10, keep=1.0)
    return out.groupBy("c_custkey").agg(
        F.count(F.lit(1)).alias("centroids"), q(F.sum("distance"), 4).alias("distances"), q(F.min("distance"), 4).alias("least_distance"), q(F.min("dtw"), 4).alias("least_dtw")
    )


# --- decompositions ------------------------------------------------------------------------

WAVES = ((3.0, 0.3), (1.5, -0.7))


@query(
    "spc6_known_waves",
    f"{P.ctes('monthly')}, p AS (SELECT series_id, row_number() OVER w - 1 AS t FROM monthly {WSQL}), k AS (SELECT DISTINCT series_id FROM p), "
    f"m(m, amplitude, phase) AS (VALUES (0, 3.0::DOUBLE, 0.3::DOUBLE), (1, 1.5::DOUBLE, -0.7::DOUBLE)) SELECT series_id, m::BIGINT AS m, {sq('amplitude', 4)} AS amplitude, 0.0::DOUBLE AS decay, {sq('phase', 4)} AS phase, 10.0::DOUBLE AS mean FROM k, m",
)
def _(spark, sf):
    """Six years of two undamped waves around 10: the fit finds them."""
    t = F.col("t")
    wave = sum((a * F.cos(2 * math.pi * (m + 1) / 12 * t + ph) for m, (a, ph) in enumerate(WAVES)), F.lit(10.0))
    known = with_position(P.monthly(spark, sf)).where("t < 72").withColumn("y", wave).drop("t")
    f = spectral.fit_damped(known).select("series_id", "mean", F.posexplode("params").alias("m", "p"))
    return f.select("series_id", F.col("m").cast("bigint").alias("m"), q("p.amplitude", 4).alias("amplitude"), q("p.decay", 4).alias("decay"), q("p.phase", 4).alias("phase"), q("mean", 4).alias("mean"))


@query("spc7_constant_series", f"{P.ctes('monthly')} SELECT series_id, 13::BIGINT AS modes, 1.0::DOUBLE AS first, 1.0::DOUBLE AS total FROM monthly GROUP BY 1")
def _(spark, sf):
    """A constant series has one mode that stays and twelve that vanish."""
    m = spectral.koopman_modes(P.monthly(spark, sf).withColumn("y", F.lit(5.0)))
    return m.groupBy("series_id").agg(F.count(F.lit(1)).alias("modes"), q(F.max(F.when(F.col("mode") == 1, F.col("re"))), 5).alias("first"), q(F.sum("modulus"), 5).alias("total"))


@query("reg3_constant_target", f"{P.ctes('monthly')} SELECT series_id, {sday('ts')} AS d, 5.0::DOUBLE AS mu, {sq('1e-6', 8)} AS var FROM monthly")
def _(spark, sf):
    m = P.monthly(spark, sf).withColumns({"lag_1": F.coalesce(win.lags(ks=(1,))["lag_1"], F.lit(0.0)), "y": F.lit(5.0)})
    raw = models.on_features(models.boosted(rounds=5), ["lag_1"], out="raw").fit(m).transform(m)
    out = regimes.smoothed_prediction(raw.select("series_id", "ts", "raw"))
    return out.select("series_id", day("ts").alias("d"), q("mu", 6).alias("mu"), q("var", 8).alias("var"))


# --- searches and choices of models -------------------------------------------------------

_CV = fold_sql().replace("regr_slope(y, x) AS b, regr_intercept(y, x) AS c", "regr_slope(y, x) AS b, regr_intercept(y, x) AS c, sum(x * y) / sum(x * x) AS o").replace("y, c + b * x AS yhat", "y, c + b * x AS line, o * x AS origin")
SEARCH_SQL = (
    f"{_CV}, e AS (SELECT fold, avg(abs(y - line)) AS a, avg(abs(y - origin)) AS b FROM pr GROUP BY 1), m AS (SELECT count(*) AS folds, avg(a) AS a, avg(b) AS b FROM e), "
    "r AS (SELECT 'regParam=0.0, fitIntercept=True' AS model, folds, a AS mae FROM m UNION ALL SELECT 'regParam=0.0, fitIntercept=False', folds, b FROM m) "
    f"SELECT model, folds, {sq('mae', 2)} AS mae, (row_number() OVER (ORDER BY mae, model))::BIGINT AS rank FROM r"
)
LINES = {"regParam": (0.0,), "fitIntercept": (True, False)}


def searched(spark, sf, settings):
    df = P.monthly(spark, sf).withColumns(win.lags(ks=(1,))).where("lag_1 IS NOT NULL")
    return models.search(df, ["lag_1"], "linear", settings, k=5).select("model", "folds", q("mae", 2).alias("mae"), F.col("rank").cast("bigint").alias("rank"))


@query("mlp5_line_search", SEARCH_SQL)
def _(spark, sf):
    return searched(spark, sf, models.grid(LINES))


@query("mlp6_random_line_search", SEARCH_SQL)
def _(spark, sf):
    return searched(spark, sf, models.random_grid(LINES, 2))


@query(
    "mlp11_best_line",
    f"{P.ctes('wide')}, {OLS_SQL.replace('monthly', 'wide')}, c AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS c, sum(x * y) / sum(x * x) AS o FROM k WHERE ts < TIMESTAMP '{TRAIN_END}'), "
    f"e AS (SELECT sqrt(avg(pow(y - c - b * x, 2))) AS line, sqrt(avg(pow(y - o * x, 2))) AS origin FROM k, c WHERE ts >= TIMESTAMP '{TRAIN_END}'), r AS (SELECT 'line' AS model, line AS rmse FROM e UNION ALL SELECT 'origin', origin FROM e) "
    f"SELECT model, {sq('rmse', 2)} AS rmse, (SELECT min_by(model, rmse) FROM r) AS best, {sq('(SELECT min(rmse) FROM r)', 2)} AS saved_rmse FROM r",
)
def _(spark, sf):
    # fits and scores go over the rows many times
    df = spread(P.wide(spark, sf).withColumns(win.lags(ks=(1,))).where("lag_1 IS NOT NULL").persist()).persist()
    train, test = df.where(F.col("ts") < TRAIN_END), df.where(F.col("ts") >= TRAIN_END)
    path = scratch_path(spark, "best-line")
    board, name, _ = models.best_on_holdout(train, test, ["lag_1"], {"line": models.linear(), "origin": models.linear(fitIntercept=False)}, path=path)
    saved = models.evaluate_models({name: PipelineModel.load(path)}, test, ["lag_1"]).first()["rmse"]
    return board.select("model", q("rmse", 2).alias("rmse"), F.lit(name).alias("best"), q(F.lit(saved), 2).alias("saved_rmse"))


@query("mlp13_only_feature", f"{P.ctes('monthly')}, {OLS_SQL} SELECT feature, importance, (SELECT count(*) FROM k) AS n_rows FROM (VALUES ('flat', 0.0::DOUBLE), ('lag_1', 1.0::DOUBLE)) v(feature, importance)")
def _(spark, sf):
    df = P.monthly(spark, sf).withColumns({"lag_1": win.lags(ks=(1,))["lag_1"], "flat": F.lit(1.0)}).where("lag_1 IS NOT NULL")
    # every tree is offered both features, and only one can part the rows
    fitted = models.on_features(models.forest(10, 4, featureSubsetStrategy="all"), ["flat", "lag_1"]).fit(df)
    return models.importance_table(fitted, ["flat", "lag_1"], df).select("feature", q("importance").alias("importance"), "n_rows")


STACK_SQL = (
    f"{P.ctes('monthly')}, f AS (SELECT series_id, ts, y, lag(y) OVER w AS x1, lag(y, 2) OVER w AS x2 FROM monthly {WSQL}), "
    "p AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS t, count(*) OVER (PARTITION BY series_id) AS n FROM f WHERE x2 IS NOT NULL), "
    "fo AS (SELECT p.*, k AS fold, n // 6 AS s, n - (6 - k) * (n // 6) AS a FROM p, range(1, 6) r(k)), "
    "co AS (SELECT fold, regr_slope(y, x1) AS b1, regr_intercept(y, x1) AS c1, regr_slope(y, x2) AS b2, regr_intercept(y, x2) AS c2 FROM fo WHERE t < a GROUP BY 1), "
    "o AS (SELECT y, c1 + b1 * x1 AS u, c2 + b2 * x2 AS v FROM fo JOIN co ON fo.fold = co.fold WHERE t >= a AND t < a + s), "
    "m AS (SELECT count(*)::DOUBLE AS n, avg(y) AS my, avg(u) AS mu, stddev_pop(u) AS su, avg(v) AS mv, stddev_pop(v) AS sv, corr(u, v) AS r, covar_pop(u, y) / stddev_pop(u) AS gu, covar_pop(v, y) / stddev_pop(v) AS gv FROM o), "
    "w AS (SELECT *, ((n + 2.0) * n * gu - n * r * n * gv) / (pow(n + 2.0, 2) - pow(n * r, 2)) AS wu, ((n + 2.0) * n * gv - n * r * n * gu) / (pow(n + 2.0, 2) - pow(n * r, 2)) AS wv FROM m), "
    "al AS (SELECT regr_slope(y, x1) AS b1, regr_intercept(y, x1) AS c1, regr_slope(y, x2) AS b2, regr_intercept(y, x2) AS c2 FROM p) "
    f"SELECT series_id, {sday('ts')} AS d, {sq('my + wu * (c1 + b1 * x1 - mu) / su + wv * (c2 + b2 * x2 - mv) / sv', 2)} AS stacked FROM p, w, al"
)


@query("mlp10_full_stack", STACK_SQL)
def _(spark, sf):
    df = P.monthly(spark, sf).withColumns(win.lags(ks=(1, 2))).where("lag_2 IS NOT NULL")
    full = models.fit_full_stack(df, {"one": (models.linear(), ["lag_1"]), "two": (models.linear(), ["lag_2"])}, alpha=2.0)
    return models.predict_full_stack(df, full).select("series_id", day("ts").alias("d"), q("stacked", 2).alias("stacked"))


# --- uncertainty and drift ----------------------------------------------------------------


@query(
    "unc9_mean_of_two_variance_lines",
    f"{P.ctes('monthly')}, f AS (SELECT series_id, ts, y, lag(y) OVER w AS x1, lag(y, 2) OVER w AS x2 FROM monthly {WSQL}), k AS (SELECT *, abs(y - x1) AS e FROM f WHERE x2 IS NOT NULL), "
    "c AS (SELECT regr_slope(e, x1) AS b1, regr_intercept(e, x1) AS c1, regr_slope(e, x2) AS b2, regr_intercept(e, x2) AS c2 FROM k) "
    f"SELECT series_id, {sday('ts')} AS d, {sq('greatest((c1 + b1 * x1 + c2 + b2 * x2) / 2, 1e-6)', 2)} AS sigma, 2::BIGINT AS members FROM k, c",
)
def _(spark, sf):
    df = P.monthly(spark, sf).withColumns(win.lags(ks=(1, 2))).where("lag_2 IS NOT NULL").withColumn("abs_r", F.abs(F.col("y") - F.col("lag_1")))
    members = None
    for f in ("lag_1", "lag_2"):
        part = models.on_features(models.linear(), [f], "abs_r", "yhat").fit(df).transform(df).select("series_id", "ts", F.lit(f).alias("member"), "yhat")
        members = part if members is None else members.unionByName(part)
    out = forecast.ensemble_mean(members, ["series_id", "ts"])
    return out.select("series_id", day("ts").alias("d"), q(F.greatest("ensemble", F.lit(1e-6)), 2).alias("sigma"), "members")


@query("unc16_exact_line", f"{P.ctes('monthly')}, {OLS_SQL} SELECT series_id, {sday('ts')} AS d, {sq('2 + 3 * x / 1e5', 3)} AS mean, 0.0::DOUBLE AS std FROM k")
def _(spark, sf):
    """Where the data lie on a line, every posterior draw is that line."""
    df = P.monthly(spark, sf).withColumn("x", win.lags(ks=(1,))["lag_1"] / 1e5).where("x IS NOT NULL").withColumn("y", 2 + 3 * F.col("x"))
    post = intervals.posterior_models(df, ["x"], 50)
    out = intervals.draw_summary(intervals.bootstrap_draws(post.select("b", "beta"), df, ["x"], ["series_id", "ts"]), ["series_id", "ts"])
    return out.select("series_id", day("ts").alias("d"), q("mean", 3).alias("mean"), q("std", 3).alias("std"))


@query("drf4_constant_feature", "SELECT 0.5::DOUBLE AS reference_score, 0.5::DOUBLE AS new_score, 0.0::DOUBLE AS drift_score FROM events LIMIT 1")
def _(spark, sf):
    """Rows that no cut can part lie at the average depth: a score of one half on both sides."""
    e = table(spark, sf, "events").select("event_id", "ts", F.lit(1.0).alias("value"))
    d = drift.isolation_drift(e, ["value"], is_ref(), ["event_id"])
    return d.select(*[q(c, 3).alias(c) for c in ("reference_score", "new_score", "drift_score")])
