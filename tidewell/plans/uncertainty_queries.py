"""Interval, drift, monitoring and augmentation queries (UNC*, DRF*, MON*, AUG*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions.draws import portable_uniform
from tidewell.operators import augment, callables, drift, gram, intervals, models, monitor, quantile_trees, quantiles, splits
from tidewell.operators import features as feat
from tidewell.operators import summary as sm
from tidewell.operators import windows as win
from tidewell.panel import with_position
from tidewell.plans import panels as P
from tidewell.plans.registry import day, normal_cdf_sql, normal_quantile_sql, poisson_sql, q, query, sday, sq, table, uniform_sql
from tidewell.plans.window_queries import WSQL
from tidewell.session import spread

CUT = "2000-06-01"


def calibrated(spark, sf):
    """Forecasts of the wide panel, split by time into calibration and test."""
    f = P.forecasts(P.wide(spark, sf))
    return f.where(F.col("ts") < CUT), f.where(F.col("ts") >= CUT)


CAL_SQL = f"{P.ctes('wide')}, {P.forecasts_sql('wide')}, cal AS (SELECT * FROM ml WHERE ts < TIMESTAMP '{CUT}'), tst AS (SELECT * FROM ml WHERE ts >= TIMESTAMP '{CUT}')"
BAND_SQL = f"SELECT tst.model, series_id, {sday('ts')} AS d, {sq('yhat - q', 3)} AS lo, {sq('yhat + q', 3)} AS hi FROM tst JOIN qq ON tst.model = qq.model"


def band_out(df):
    return intervals.band(df).select("model", "series_id", day("ts").alias("d"), q("lo", 3).alias("lo"), q("hi", 3).alias("hi"))


@query("unc1_split_conformal", f"{CAL_SQL}, qq AS (SELECT model, quantile_cont(abs(y - yhat), 0.9) AS q FROM cal GROUP BY 1) {BAND_SQL}")
def _(spark, sf):
    cal, test = calibrated(spark, sf)
    return band_out(intervals.with_limits(test, intervals.split_conformal(cal, 0.1, ["model"]), ["model"]))


@query(
    "unc2_finite_sample_conformal",
    f"{CAL_SQL}, sc AS (SELECT model, abs(y - yhat) AS s, row_number() OVER (PARTITION BY model ORDER BY abs(y - yhat)) AS i, count(*) OVER (PARTITION BY model) AS n FROM cal), "
    f"qq AS (SELECT model, s AS q FROM sc WHERE i = least(CAST(ceil((n + 1) * CAST(0.9 AS DECIMAL(3,1))) AS BIGINT), n)) {BAND_SQL}",
)
def _(spark, sf):
    cal, test = calibrated(spark, sf)
    return band_out(intervals.with_limits(test, intervals.finite_sample_conformal(cal, "0.1", ["model"]), ["model"]))


LAG_FEATURES = ("lag_1", "lag_2", "roll_mean_6")


def lag_frame(panel):
    cols = win.lags(ks=(1, 2)) | win.roll_mean(windows=(6,))
    return panel.withColumns(cols).na.drop(subset=["y", *LAG_FEATURES])


def fold_sql(panel: str = "monthly") -> str:
    """Expanding folds of the one-lag linear model: predictions ``pr``."""
    return (
        f"{P.ctes(panel)}, f AS (SELECT series_id, ts, y, lag(y) OVER w AS x FROM {panel} {WSQL}), "
        "p AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS t, count(*) OVER (PARTITION BY series_id) AS n FROM f WHERE x IS NOT NULL), "
        "fo AS (SELECT p.*, CAST(k AS BIGINT) AS fold, n // 6 AS s, n - (6 - k) * (n // 6) AS a FROM p, range(1, 6) r(k)), "
        "co AS (SELECT fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS c FROM fo WHERE t < a GROUP BY 1), "
        "pr AS (SELECT series_id, ts, fo.fold, y, c + b * x AS yhat FROM fo JOIN co ON fo.fold = co.fold WHERE t >= a AND t < a + s)"
    )


@query(
    "unc3_cross_validated_interval",
    f"{fold_sql()}, qq AS (SELECT quantile_cont(abs(y - yhat), 0.9) AS q FROM pr), fin AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS c FROM p) "
    f"SELECT series_id, {sday('ts')} AS d, {sq('c + b * x - q', 2)} AS lo, {sq('c + b * x + q', 2)} AS hi FROM p, fin, qq",
)
def _(spark, sf):
    df = P.monthly(spark, sf).withColumns(win.lags(ks=(1,))).where("lag_1 IS NOT NULL").withColumn("g", F.lit(1))
    limit = intervals.split_conformal(models.linear_fold_predictions(df, ["lag_1"], {"linear": 0.0}), 0.1)
    scored = gram.predict_linear(df, gram.fit_linear(df, ["g"], ["lag_1"]), ["g"], ["lag_1"])
    out = intervals.band(intervals.with_limits(scored, limit, ()))
    return out.select("series_id", day("ts").alias("d"), q("lo", 2).alias("lo"), q("hi", 2).alias("hi"))


@query("unc4_quantile_regression")
def _(spark, sf):
    df = lag_frame(P.wide(spark, sf))
    train, rest = df.where(F.col("ts") < "1999-06-01"), df.where(F.col("ts") >= "1999-06-01")
    beta = intervals.quantile_regression(train, LAG_FEATURES, {"lo": 0.05, "hi": 0.95})
    scored = rest.withColumns({k: intervals.linear_prediction(b, LAG_FEATURES) for k, b in beta.items()})
    cal, test = scored.where(F.col("ts") < CUT), scored.where(F.col("ts") >= CUT)
    delta = intervals.widen_by_conformal(cal).first()["delta"]
    wide = test.withColumns({"lo": F.col("lo") - delta, "hi": F.col("hi") + delta})
    return sm.interval_summary(wide.withColumn("yhat", (F.col("lo") + F.col("hi")) / 2), [])


@query("unc4_boosted_quantiles")
def _(spark, sf):
    df = lag_frame(P.wide(spark, sf)).persist()  # read for bins, start, trees, limits and test
    train, rest = df.where(F.col("ts") < "1999-06-01"), df.where(F.col("ts") >= "1999-06-01")
    trees = quantile_trees.fit_quantile_trees(train, LAG_FEATURES, {"lo": 0.05, "hi": 0.95}, keys=["series_id", "ts"])
    scored = trees.predict(rest)
    cal, test = scored.where(F.col("ts") < CUT), scored.where(F.col("ts") >= CUT)
    delta = intervals.widen_by_conformal(cal).first()["delta"]
    wide = test.withColumns({"lo": F.col("lo") - delta, "hi": F.col("hi") + delta})
    return sm.interval_summary(wide.withColumn("yhat", (F.col("lo") + F.col("hi")) / 2), [])


@query(
    "unc4_conformal_widening",
    f"{CAL_SQL} SELECT {sq('quantile_cont(greatest(yhat - 20000 - y, y - yhat - 20000, 0), 0.9)', 3)} AS delta FROM cal",
)
def _(spark, sf):
    cal, _test = calibrated(spark, sf)
    c = cal.withColumns({"lo": F.col("yhat") - 20000, "hi": F.col("yhat") + 20000})
    return intervals.widen_by_conformal(c).select(q("delta", 3).alias("delta"))


@query(
    "unc5_scale_search",
    f"{CAL_SQL}, g AS (SELECT unnest([{', '.join(str(s) for s in intervals.scale_grid())}])::DOUBLE AS s) "
    f"SELECT s, {sq('avg((y BETWEEN yhat - s * 30000 AND yhat + s * 30000)::INT)')} AS coverage FROM cal, g GROUP BY 1",
)
def _(spark, sf):
    cal, _test = calibrated(spark, sf)
    s = intervals.scale_search(cal, 30000.0)
    return s.select("s", q("coverage").alias("coverage"))


@query("unc6_heteroscedastic_interval")
def _(spark, sf):
    df = spread(lag_frame(P.wide(spark, sf)).persist()).persist()
    train, cal, test = (df.where(c) for c in ("ts < '1999-06-01'", f"ts >= '1999-06-01' AND ts < '{CUT}'", f"ts >= '{CUT}'"))
    out = intervals.heteroscedastic(train, cal, test, models.linear(), models.BoostedOnCells(), LAG_FEATURES)
    return sm.interval_summary(out, [])


HETERO_SQL = (
    f"{P.ctes('wide')}, f AS (SELECT ts, y, lag(y) OVER w AS x, lag(y, 2) OVER w AS x2 FROM wide {WSQL}), "
    "k AS (SELECT *, CASE WHEN ts < TIMESTAMP '1999-06-01' THEN 'train' WHEN ts < TIMESTAMP '{cut}' THEN 'cal' ELSE 'test' END AS part FROM f WHERE x2 IS NOT NULL), "
    "m AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS c FROM k WHERE part = 'train'), "
    "r AS (SELECT k.*, c + b * x AS yhat, abs(y - c - b * x) AS e FROM k, m), "
    "v AS (SELECT regr_slope(e, x2) AS b, regr_intercept(e, x2) AS c FROM r WHERE part = 'train'), "
    "s AS (SELECT r.*, greatest(c + b * x2, 1e-6) AS sd FROM r, v), "
    "l AS (SELECT 0.2 * quantile_cont(sd, 0.01) AS a, 5 * quantile_cont(sd, 0.99) AS b, quantile_cont(e / sd, 0.9) AS q FROM s WHERE part = 'cal'), "
    "o AS (SELECT y, yhat - q * least(greatest(sd, a), b) AS lo, yhat + q * least(greatest(sd, a), b) AS hi FROM s, l WHERE part = 'test') "
).replace("{cut}", CUT)


@query("unc6_two_linear_models", f"{HETERO_SQL} SELECT count(*) AS n, {sq('avg((y BETWEEN lo AND hi)::INT)')} AS coverage, {sq('avg(hi - lo)', 1)} AS mean_width FROM o")
def _(spark, sf):
    df = spread(P.wide(spark, sf).withColumns(win.lags(ks=(1, 2))).where("lag_2 IS NOT NULL").persist()).persist()
    train, cal, test = (df.where(c) for c in ("ts < '1999-06-01'", f"ts >= '1999-06-01' AND ts < '{CUT}'", f"ts >= '{CUT}'"))
    out = intervals.heteroscedastic(train, cal, test, models.linear(), models.linear(), ["lag_1"], ["lag_2"])
    return out.agg(F.count(F.lit(1)).alias("n"), q(F.avg(F.col("y").between(F.col("lo"), F.col("hi")).cast("double"))).alias("coverage"), q(F.avg(F.col("hi") - F.col("lo")), 1).alias("mean_width"))


Z_SQL = f"{CAL_SQL}, st AS (SELECT series_id, stddev_pop(y) AS sd FROM cal GROUP BY 1), z AS (SELECT cal.*, abs(y - yhat) / (sd + 1e-9) AS z FROM cal JOIN st USING (series_id))"


def standard_scores(spark, sf):
    cal, _test = calibrated(spark, sf)
    sd = F.stddev_pop("y").over(Window.partitionBy("series_id"))
    return cal.withColumn("sd", sd).withColumn("z", F.abs(F.col("y") - F.col("yhat")) / (F.col("sd") + 1e-9))


@query(
    "unc7_robust_scale",
    f"{Z_SQL}, m AS (SELECT median(z) AS centre, quantile_cont(z, 0.9) AS q_nominal, quantile_cont(z, 0.95) AS q_95 FROM z), d AS (SELECT median(abs(z - centre)) AS mad FROM z, m) "
    f"SELECT {sq('centre')} AS centre, {sq('mad')} AS mad, {sq('CASE WHEN q_nominal BETWEEN 1e-6 AND 0.5 THEN q_nominal WHEN centre + 2.5 * mad > 1e-6 THEN centre + 2.5 * mad ELSE q_95 END')} AS q FROM m, d",
)
def _(spark, sf):
    r = intervals.robust_scale(standard_scores(spark, sf), "z", high=0.5)
    return r.select(*[q(c).alias(c) for c in ("centre", "mad", "q")])


@query(
    "unc8_winsorised_quantile",
    f"{Z_SQL}, m AS (SELECT quantile_cont(z, 0.01) AS a, quantile_cont(z, 0.95) AS b FROM z) SELECT {sq('quantile_cont(least(greatest(z, a), b), 0.9)')} AS q FROM z, m",
)
def _(spark, sf):
    return intervals.winsorised_quantile(standard_scores(spark, sf), "z").select(q("q").alias("q"))


@query("unc9_averaged_variance_models")
def _(spark, sf):
    df = lag_frame(P.monthly(spark, sf)).withColumn("abs_r", F.abs(F.col("y") - F.col("roll_mean_6")))
    fits = [models.on_features(models.boosted(rounds=5, depth=3, seed=s, subsamplingRate=0.8), LAG_FEATURES, "abs_r").fit(df) for s in (1, 2, 3)]
    members = None
    for i, m in enumerate(fits):
        part = m.transform(df).select("series_id", "ts", F.lit(i).alias("member"), F.col("prediction").alias("yhat"))
        members = part if members is None else members.unionByName(part)
    from tidewell.operators.forecast import ensemble_mean

    return ensemble_mean(members, ["series_id", "ts"]).select("series_id", day("ts").alias("d"), F.greatest("ensemble", F.lit(1e-6)).alias("sigma"), "members")


def boot_frame(spark, sf, n=100):
    df = P.monthly(spark, sf).withColumns(win.lags(ks=(1,))).where("lag_1 IS NOT NULL")
    fitted = intervals.bootstrap_models(df, ["lag_1"], n, draw=portable_uniform)
    return intervals.draw_summary(intervals.bootstrap_draws(fitted, df, ["lag_1"], ["series_id", "ts"]), ["series_id", "ts"])


BOOT_SQL = (
    f"{P.ctes('monthly')}, f AS (SELECT series_id, ts, y, lag(y) OVER w AS x FROM monthly {WSQL}), k AS (SELECT * FROM f WHERE x IS NOT NULL), "
    f"u AS (SELECT k.*, b, {uniform_sql(42, 'series_id', 'ts', 'b')} AS u FROM k, range(1, 101) r(b)), w AS (SELECT *, {poisson_sql('u')}::DOUBLE AS w FROM u), "
    "m AS (SELECT b, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM w GROUP BY 1), "
    "s AS (SELECT w.b, any_value(mx) AS mx, any_value(my) AS my, sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) AS slope FROM w JOIN m ON w.b = m.b GROUP BY 1), "
    "p AS (SELECT series_id, ts, my + slope * (x - mx) AS yhat FROM k, s), "
    "g AS (SELECT series_id, ts, avg(yhat) AS mean, stddev_pop(yhat) AS std, quantile_cont(yhat, 0.025) AS p025, quantile_cont(yhat, 0.5) AS p500, quantile_cont(yhat, 0.975) AS p975 FROM p GROUP BY 1, 2)"
)


@query("unc10_bootstrap_percentiles", f"{BOOT_SQL} SELECT series_id, {sday('ts')} AS d, {sq('p025', 1)} AS p025, {sq('p500', 1)} AS p500, {sq('p975', 1)} AS p975 FROM g")
def _(spark, sf):
    return boot_frame(spark, sf).select("series_id", day("ts").alias("d"), *[q(c, 1).alias(c) for c in ("p025", "p500", "p975")])


@query(
    "unc10_given_function",
    f"{P.ctes('monthly')}, f AS (SELECT series_id, ts, y, lag(y) OVER w AS x FROM monthly {WSQL}), k AS (SELECT * FROM f WHERE x IS NOT NULL), "
    f"u AS (SELECT k.*, b, {uniform_sql(42, 'series_id', 'ts', 'b')} AS u FROM k, range(1, 61) r(b)), m AS (SELECT b, sum({poisson_sql('u')} * y) / sum({poisson_sql('u')}) AS m FROM u GROUP BY 1) "
    f"SELECT series_id, {sday('ts')} AS d, {sq('quantile_cont(m, 0.025)', 2)} AS lower, {sq('quantile_cont(m, 0.5)', 2)} AS median, {sq('quantile_cont(m, 0.975)', 2)} AS upper, count(*) AS fits FROM k, m GROUP BY series_id, ts",
)
def _(spark, sf):
    df = P.monthly(spark, sf).withColumns(win.lags(ks=(1,))).where("lag_1 IS NOT NULL")
    out = callables.bootstrap_intervals(df, df, ["lag_1"], callables.mean_model, 60, draw=portable_uniform)
    return out.select("series_id", day("ts").alias("d"), *[q(c, 2).alias(c) for c in ("lower", "median", "upper")], "fits")


@query(
    "unc11_bootstrap_normal_bands",
    f"{BOOT_SQL} SELECT series_id, {sday('ts')} AS d, {sq('mean', 1)} AS mean, {sq('std', 1)} AS std, {sq('mean - 1.96 * std', 1)} AS ci_lo, {sq('mean + 1.96 * std', 1)} AS ci_hi, {sq('mean - 2.576 * std', 1)} AS pi_lo, {sq('mean + 2.576 * std', 1)} AS pi_hi FROM g",
)
def _(spark, sf):
    return boot_frame(spark, sf).select("series_id", day("ts").alias("d"), *[q(c, 1).alias(c) for c in ("mean", "std", "ci_lo", "ci_hi", "pi_lo", "pi_hi")])


@query(
    "unc12_rank_intervals",
    f"{CAL_SQL}, qq AS (SELECT model, quantile_cont(abs(y - yhat), 0.9) AS q FROM cal GROUP BY 1), "
    "s AS (SELECT model, avg((y BETWEEN yhat - q AND yhat + q)::INT) AS coverage, avg(2 * q) AS w FROM tst JOIN qq USING (model) GROUP BY 1) "
    f"SELECT model, {sq('coverage')} AS coverage, {sq('w', 2)} AS mean_width, {sq('abs(coverage - 0.9)')} AS coverage_gap, {sq('1e6 / w', 4)} AS efficiency, row_number() OVER (ORDER BY round(abs(coverage - 0.9), 12), w) AS rank FROM s",
)
def _(spark, sf):
    cal, test = calibrated(spark, sf)
    iv = intervals.band(intervals.with_limits(test, intervals.split_conformal(cal, 0.1, ["model"]), ["model"]))
    r = intervals.ranked_intervals(iv)
    return r.select(
        "model", q("coverage").alias("coverage"), q("mean_width", 2).alias("mean_width"), q("coverage_gap").alias("coverage_gap"),
        q(F.col("efficiency") * 1e6, 4).alias("efficiency"), F.col("rank").cast("bigint").alias("rank"),
    )


LEVELS = (0.5, 0.8, 0.9, 0.95)


@query(
    "unc13_calibration_curve",
    f"{P.ctes('monthly')}, {P.draws_sql('monthly')}, "
    + ", ".join(f"c{i} AS (SELECT {a}::DOUBLE AS level, series_id, ts, y, quantile_cont(yhat, {(1 - a) / 2!r}) AS lo, quantile_cont(yhat, {(1 + a) / 2!r}) AS hi FROM dr GROUP BY series_id, ts, y)" for i, a in enumerate(LEVELS))
    + " SELECT level, " + sq("avg((y BETWEEN lo AND hi)::INT)") + " AS coverage FROM (" + " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(len(LEVELS))) + ") GROUP BY 1",
)
def _(spark, sf):
    c = intervals.calibration_curve(P.draws(P.monthly(spark, sf)), ["series_id", "ts"], LEVELS)
    return c.select("level", q("coverage").alias("coverage"))


BAND_CURVE_SQL = (
    f"{P.ctes('monthly')}, {P.draws_sql('monthly')}, "
    + ", ".join(f"c{i} AS (SELECT {a}::DOUBLE AS level, series_id, ts, (y BETWEEN quantile_cont(yhat, {(1 - a) / 2!r}) AND quantile_cont(yhat, {(1 + a) / 2!r}))::INT AS inside FROM dr GROUP BY series_id, ts, y)" for i, a in enumerate(LEVELS))
    + ", fl AS (" + " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(len(LEVELS))) + f"), u AS (SELECT fl.*, b, {uniform_sql(42, 'series_id', 'ts', 'b')} AS u FROM fl, range(1, 101) r(b)), "
    f"w AS (SELECT *, {poisson_sql('u')} AS w FROM u), cv AS (SELECT level, b, CAST(sum(w * inside) AS DOUBLE) / sum(w) AS coverage FROM w GROUP BY 1, 2) "
    f"SELECT level, {sq('quantile_cont(coverage, 0.025)')} AS lower, {sq('quantile_cont(coverage, 0.975)')} AS upper FROM cv GROUP BY 1"
)


@query("unc14_calibration_band", BAND_CURVE_SQL)
def _(spark, sf):
    b = intervals.calibration_band(P.draws(P.monthly(spark, sf)), ["series_id", "ts"], LEVELS, n_boot=100, draw=portable_uniform)
    return b.select("level", q("lower").alias("lower"), q("upper").alias("upper"))


@query(
    "unc15_gaussian_scores",
    f"{P.ctes('wide')}, g AS (SELECT y, avg(y) OVER w AS mu, var_samp(y) OVER w AS var FROM wide WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)), "
    "k AS (SELECT *, CASE WHEN y IS NOT NULL AND mu IS NOT NULL AND var > 0 THEN 1 END AS ok FROM g) "
    f"SELECT {sq('avg(sqrt(var)) FILTER (ok = 1)', 3)} AS sharpness, {sq('avg((abs(y - mu) <= 1.645 * sqrt(var))::INT) FILTER (ok = 1)')} AS coverage_90, "
    f"{sq('avg(0.5 * (ln(2 * pi() * (var + 1e-9)) + (y - mu) * (y - mu) / (var + 1e-9))) FILTER (ok = 1)', 4)} AS nll, count(ok) AS n, count(*) - count(ok) AS n_left_out FROM k",
)
def _(spark, sf):
    w = Window.partitionBy("series_id").orderBy("ts").rowsBetween(-12, -1)
    df = P.wide(spark, sf).withColumns({"mu": F.avg("y").over(w), "var": F.var_samp("y").over(w)})
    s = intervals.gaussian_scores(df)
    return s.select(q("sharpness", 3).alias("sharpness"), q("coverage_90").alias("coverage_90"), q("nll", 4).alias("nll"), "n", "n_left_out")


@query(
    "unc15_gaussian_crps",
    f"{P.ctes('wide')}, g AS (SELECT ts, y, avg(y) OVER w AS mu, var_samp(y) OVER w AS var FROM wide WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)), "
    "z AS (SELECT year(ts) AS yr, sqrt(var) AS sd, (y - mu) / sqrt(var) AS z FROM g WHERE mu IS NOT NULL AND var > 0) "
    f"SELECT yr, {sq('avg(sd * (z * (2 * ' + normal_cdf_sql('z') + ' - 1) + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi())))', 2)} AS crps FROM z GROUP BY 1",
)
def _(spark, sf):
    w = Window.partitionBy("series_id").orderBy("ts").rowsBetween(-12, -1)
    df = P.wide(spark, sf).withColumns({"mu": F.avg("y").over(w), "var": F.var_samp("y").over(w)})
    s = intervals.gaussian_scores(df.withColumn("yr", F.year("ts").cast("bigint")), ["yr"])
    return s.select("yr", q("crps", 2).alias("crps"))


@query("unc16_posterior_draws")
def _(spark, sf):
    df = lag_frame(P.monthly(spark, sf))
    post = intervals.posterior_models(df, LAG_FEATURES, 100)
    drawn = intervals.bootstrap_draws(post.select("b", "beta"), df, LAG_FEATURES, ["series_id", "ts"])
    return intervals.draw_summary(drawn, ["series_id", "ts"]).select("series_id", day("ts").alias("d"), "mean", "std", "p025", "p975")


# --- drift -----------------------------------------------------------------------

HALF = "2024-01-16"
RAW_PARTS = f"p AS (SELECT event_type AS series_id, value AS y, ts < TIMESTAMP '{HALF}' AS ref FROM events)"
KS_SQL = (
    f"WITH {RAW_PARTS}, v AS (SELECT series_id, y, sum(ref::INT) AS a, sum((NOT ref)::INT) AS b FROM p GROUP BY 1, 2), "
    "c AS (SELECT series_id, sum(a) OVER w / sum(a) OVER t - sum(b) OVER w / sum(b) OVER t AS g, sum(a) OVER t AS na, sum(b) OVER t AS nb FROM v "
    "WINDOW w AS (PARTITION BY series_id ORDER BY y ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY series_id)), "
    "ks AS (SELECT series_id, max(abs(g)) AS ks, CAST(max(na) AS BIGINT) AS n_ref, CAST(max(nb) AS BIGINT) AS n_new FROM c GROUP BY 1)"
)


def is_ref():
    return F.col("ts") < F.lit(HALF).cast("timestamp_ntz")


@query("drf1_ks_statistic", f"{KS_SQL} SELECT series_id, {sq('ks')} AS ks, n_ref, n_new FROM ks")
def _(spark, sf):
    k = drift.ks_statistic(P.raw(spark, sf), "y", is_ref(), ["series_id"])
    return k.select("series_id", q("ks").alias("ks"), "n_ref", "n_new")


T_SQL = (
    f"{KS_SQL}, mo AS (SELECT series_id, count(*) FILTER (ref) AS na, count(*) FILTER (NOT ref) AS nb, avg(y) FILTER (ref) AS ma, avg(y) FILTER (NOT ref) AS mb, "
    "var_samp(y) FILTER (ref) AS va, var_samp(y) FILTER (NOT ref) AS vb, stddev_pop(y) FILTER (ref) AS sa, stddev_pop(y) FILTER (NOT ref) AS sb FROM p GROUP BY 1), "
    "tt AS (SELECT *, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0 / na + 1.0 / nb)) AS t FROM mo)"
)


@query("drf2_t_test", f"{T_SQL} SELECT series_id, {sq('t')} AS t, {sq('ma')} AS ma, {sq('mb')} AS mb, na AS n_ref, nb AS n_new FROM tt")
def _(spark, sf):
    t = drift.t_test(P.raw(spark, sf), "y", is_ref(), ["series_id"])
    return t.select("series_id", q("t").alias("t"), q("ma").alias("ma"), q("mb").alias("mb"), F.col("na").alias("n_ref"), F.col("nb").alias("n_new"))


@query("drf3_shift_terms", f"{T_SQL} SELECT series_id, {sq('least(abs(ma - mb) / sa, 1)')} AS mean_shift, {sq('least(abs(sa - sb) / sa, 1)')} AS std_shift FROM tt")
def _(spark, sf):
    d = drift.drift_score(P.raw(spark, sf), "y", is_ref(), ["series_id"])
    return d.select("series_id", q("mean_shift").alias("mean_shift"), q("std_shift").alias("std_shift"))


def _simpson(limit: str) -> str:
    weight = "CASE WHEN i = 0 OR i = 400 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END"
    return f"(SELECT sum({weight} * exp((dof - 1) * ln(greatest(1 - 2 * pow(sin({limit} / 800 * i), 2), 1e-300)))) * ({limit} / 400) / 3 FROM range(0, 401) x(i))"


SCORE_SQL = (
    f"{T_SQL}, j AS (SELECT tt.series_id, ks, t, ks * sqrt(n_ref * n_new / (n_ref + n_new)::DOUBLE) AS lam, (na + nb - 2)::DOUBLE AS dof, least(abs(ma - mb) / sa, 1) AS ms, least(abs(sa - sb) / sa, 1) AS ss FROM tt JOIN ks USING (series_id)), "
    "l AS (SELECT *, least(atan(abs(t) / sqrt(dof)), 12 / sqrt(dof)) AS up, least(pi() / 2, 12 / sqrt(dof)) AS full_up FROM j), "
    f"pv AS (SELECT *, greatest(1 - {_simpson('up')} / {_simpson('full_up')}, 0) AS t_p, "
    "CASE WHEN lam < 0.2 THEN 1 ELSE least(greatest(2 * (SELECT sum((CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * k * k * lam * lam)) FROM range(1, 101) y(k)), 0), 1) END AS ks_p FROM l) "
    f"SELECT series_id, {sq('ks_p', 5)} AS ks_p, {sq('t_p', 5)} AS t_p, {sq('((1 - ks_p) + (1 - t_p) + ms + ss) / 4', 5)} AS drift_score, (((1 - ks_p) + (1 - t_p) + ms + ss) / 4 > 0.05)::INT AS flag, (ks_p < 0.05 OR t_p < 0.05)::INT AS differs FROM pv"
)


@query("drf3_drift_score", SCORE_SQL)
def _(spark, sf):
    d = drift.drift_score(P.raw(spark, sf), "y", is_ref(), ["series_id"])
    return d.select("series_id", q("ks_p", 5).alias("ks_p"), q("t_p", 5).alias("t_p"), q("drift_score", 5).alias("drift_score"), "flag", "differs")


@query("drf4_isolation_drift")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "value", F.hour("ts").cast("double").alias("hour"))
    return drift.isolation_drift(e, ["value", "hour"], is_ref(), ["event_id"])


@query("drf4_hybrid_drift")
def _(spark, sf):
    raw = P.raw(spark, sf)
    h = drift.hybrid_score(drift.drift_score(raw, "y", is_ref(), ["series_id"]), drift.isolation_drift(raw, ["y"], is_ref(), ["event_id"]))
    return h.select("series_id", "statistical_score", "isolation_score", "hybrid_score", "hybrid_flag")


# --- monitoring ---------------------------------------------------------------------

SNAP = ("mean", "std", "min", "max", "missing_rate", "autocorrelation", "trend")
SNAP_SQL = (
    f"{P.ctes('raw')}, s AS (SELECT *, lag(y) OVER w AS p, row_number() OVER w - 1 AS t FROM raw WINDOW w AS (PARTITION BY series_id ORDER BY ts, event_id)), "
    "m AS (SELECT series_id, avg(y) AS mean, stddev_pop(y) AS std, min(y) AS min, max(y) AS max, CAST(1 - count(y) / count(*) AS DOUBLE) AS missing_rate, corr(y, p) AS autocorrelation, regr_slope(y, t) AS trend FROM s GROUP BY 1), "
    f"u AS (SELECT series_id, k AS metric, v AS value FROM (UNPIVOT m ON {', '.join(SNAP)} INTO NAME k VALUE v))"
)


@query("mon1_snapshot", f"{SNAP_SQL} SELECT series_id, metric, {sq('value')} AS value FROM u")
def _(spark, sf):
    s = monitor.snapshot(P.raw(spark, sf), tie=("event_id",))
    return monitor.long_metrics(s, ["series_id"]).select("series_id", "metric", q("value").alias("value"))


LIMITS = {"mean": 51.0, "autocorrelation": 0.01, "missing_rate": 0.05}


@query(
    "mon2_alerts",
    f"{SNAP_SQL}, th(metric, threshold) AS (VALUES {', '.join(f'({k!r}, {v}::DOUBLE)' for k, v in LIMITS.items())}) SELECT series_id, metric, {sq('value')} AS value, threshold FROM u JOIN th USING (metric) WHERE value > threshold",
)
def _(spark, sf):
    m = monitor.long_metrics(monitor.snapshot(P.raw(spark, sf), tie=("event_id",)), ["series_id"])
    return monitor.alerts(m, LIMITS).select("series_id", "metric", q("value").alias("value"), "threshold")


@query(
    "mon3_history",
    f"{P.ctes('daily')}, r AS (SELECT series_id AS metric, ts, y AS value, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS i FROM daily) SELECT metric, {sday('ts')} AS d, {sq('value')} AS value FROM r WHERE i <= 5 AND metric = 'purchase'",
)
def _(spark, sf):
    log = P.daily(spark, sf).select(F.col("series_id").alias("metric"), "ts", F.col("y").alias("value"))
    h = monitor.history(log, "purchase", 5)
    return h.select("metric", day("ts").alias("d"), q("value").alias("value"))


# --- augmentation -----------------------------------------------------------------


@query(
    "aug1_noise",
    f"{P.ctes('wide')}, u AS (SELECT *, stddev_pop(y) OVER (PARTITION BY series_id) AS sd, {uniform_sql(42, 'series_id', 'ts')} AS u FROM wide) "
    f"SELECT series_id, {sday('ts')} AS d, {sq('y + 0.1 * sd * ' + normal_quantile_sql('u'), 3)} AS y FROM u",
)
def _(spark, sf):
    return augment.noise(P.wide(spark, sf), draw=portable_uniform).select("series_id", day("ts").alias("d"), q("y", 3).alias("y"))


@query(
    "aug2_time_warp",
    f"{P.ctes('monthly')}, p AS (SELECT *, row_number() OVER w - 1 AS t, count(*) OVER (PARTITION BY series_id) AS n FROM monthly {WSQL}), "
    "s AS (SELECT series_id, max(n) AS n, CAST(floor(max(n) * CAST(1.15 AS DOUBLE)) AS BIGINT) AS m FROM p GROUP BY 1), "
    "g AS (SELECT series_id, i, i * (n - 1) / (m - 1)::DOUBLE AS x FROM s, range(0, 5000) r(i) WHERE i < m) "
    f"SELECT g.series_id, CAST(i AS BIGINT) AS i, {sq('a.y + (b.y - a.y) * (x - floor(x))', 4)} AS y FROM g JOIN p a ON a.series_id = g.series_id AND a.t = floor(x) JOIN p b ON b.series_id = g.series_id AND b.t = ceil(x)",
)
def _(spark, sf):
    w = augment.time_warp(P.monthly(spark, sf), F.lit(1.15))
    return w.select("series_id", F.col("i").cast("bigint").alias("i"), q("y", 4).alias("y"))


@query(
    "aug3_scale_and_dropout",
    f"{P.ctes('wide')} SELECT series_id, {sday('ts')} AS d, {sq('CASE WHEN ' + uniform_sql(42, 'series_id', 'ts') + ' > 0.1 THEN y * (1 + 0.1 * (2 * ' + uniform_sql(42, 'series_id') + ' - 1)) ELSE 0 END', 3)} AS y FROM wide",
)
def _(spark, sf):
    df = augment.dropout(augment.scale(P.wide(spark, sf), draw=portable_uniform), draw=portable_uniform)
    return df.select("series_id", day("ts").alias("d"), q("y", 3).alias("y"))


COPIES_SQL = (
    f"{P.ctes('monthly')}, p AS (SELECT *, row_number() OVER w - 1 AS t, count(*) OVER (PARTITION BY series_id) AS n, stddev_pop(y) OVER (PARTITION BY series_id) AS sd FROM monthly {WSQL}), "
    f"cp AS (SELECT DISTINCT series_id, n, sd, copy, {uniform_sql(42, 'series_id', 'copy')} AS u, {uniform_sql(43, 'series_id', 'copy')} AS f FROM p, range(1, 5) r(copy)), "
    "kd AS (SELECT *, CASE WHEN u < 0.25 THEN 'noise' WHEN u < 0.625 THEN 'warp' WHEN u < 0.90625 THEN 'scale' ELSE 'dropout' END AS kind FROM cp), "
    f"fl AS (SELECT kd.series_id, copy, kind, t AS i, y, kd.sd, f, {uniform_sql(43, 'kd.series_id', 'copy', 'ts')} AS v FROM kd JOIN p USING (series_id) WHERE kind <> 'warp'), "
    "wm AS (SELECT *, CAST(floor(n * (1 + 0.2 * (2 * f - 1))) AS BIGINT) AS m FROM kd WHERE kind = 'warp'), "
    "wp AS (SELECT series_id, copy, kind, i, i * (n - 1) / (m - 1)::DOUBLE AS x FROM wm, range(0, 5000) r(i) WHERE i < m) "
    f"SELECT series_id, copy, kind, i, {sq('CASE kind WHEN ' + chr(39) + 'noise' + chr(39) + ' THEN y + 0.1 * sd * ' + normal_quantile_sql('v') + ' WHEN ' + chr(39) + 'scale' + chr(39) + ' THEN y * (1 + 0.1 * (2 * f - 1)) ELSE CASE WHEN v > 0.1 THEN y ELSE 0 END END', 3)} AS y FROM fl "
    f"UNION ALL SELECT wp.series_id, copy, kind, i, {sq('a.y + (b.y - a.y) * (x - floor(x))', 3)} FROM wp JOIN p a ON a.series_id = wp.series_id AND a.t = floor(x) JOIN p b ON b.series_id = wp.series_id AND b.t = ceil(x)"
)


@query("aug4_random_copies", COPIES_SQL)
def _(spark, sf):
    c = augment.random_copies(P.monthly(spark, sf), 4, draw=portable_uniform)
    return c.select("series_id", F.col("copy").cast("bigint").alias("copy"), "kind", F.col("i").cast("bigint").alias("i"), q("y", 3).alias("y"))


@query(
    "aug5_bootstrap_windows",
    f"{P.ctes('monthly')}, p AS (SELECT *, row_number() OVER w - 1 AS t FROM monthly {WSQL}), n AS (SELECT series_id, count(*) AS n, stddev_pop(y) AS sd FROM p GROUP BY 1), "
    f"s AS (SELECT series_id, sd, sample, CAST(floor({uniform_sql(42, 'series_id', 'sample')} * (n - 12 + 1)) AS BIGINT) AS start FROM n, range(1, 21) r(sample)), "
    f"u AS (SELECT s.series_id, sample, start, t - start AS pos, y, sd, {uniform_sql(43, 's.series_id', 'sample', 't - start')} AS u FROM s JOIN p ON p.series_id = s.series_id AND t BETWEEN start AND start + 11) "
    f"SELECT series_id, sample, start, pos, {sq('y + 0.05 * sd * ' + normal_quantile_sql('u'), 3)} AS v FROM u",
)
def _(spark, sf):
    b = augment.bootstrap_windows(P.monthly(spark, sf), 20, draw=portable_uniform)
    cells = b.select("series_id", F.col("sample").cast("bigint").alias("sample"), F.col("start").cast("bigint").alias("start"), F.posexplode("window").alias("pos", "v"))
    return cells.select("series_id", "sample", "start", F.col("pos").cast("bigint").alias("pos"), q("v", 3).alias("v"))
