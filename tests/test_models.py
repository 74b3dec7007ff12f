"""Intervals, drift, augmentation, forecasting and models against plain computations."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tidewell.functions import distribution as dist
from tidewell.functions.draws import gaussian, poisson_one, uniform
from tidewell.operators import agents, augment, callables, drift, forecast, intervals, models, monitor, summary
from tidewell.operators import windows as win

LAGS = ["lag_1", "lag_2"]


@pytest.fixture(scope="module")
def panel(make_panel):
    rng = np.random.default_rng(0)

    def ar(n, c, phi):
        out = [c / (1 - phi)]
        for _ in range(n - 1):
            out.append(c + phi * out[-1] + rng.normal())
        return out

    return make_panel({"a": ar(90, 2.0, 0.6), "b": ar(70, 5.0, -0.3), "short": [1.0, 2.0, 3.0]})


@pytest.fixture(scope="module")
def framed(panel):
    return panel.withColumns(win.lags(ks=(1, 2))).na.drop().persist()


def test_normal_functions(spark):
    x = [-8.0, -3.0, -1.0, -0.1, 0.0, 0.5, 2.0, 6.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    got = [r[0] for r in df.select(dist.normal_cdf(F.col("x"))).collect()]
    assert np.allclose(got, [0.5 * math.erfc(-v / math.sqrt(2)) for v in x], rtol=1e-9)
    back = [r[0] for r in df.where("abs(x) < 7").select(dist.normal_quantile(dist.normal_cdf(F.col("x")))).collect()]
    assert np.allclose(back, [v for v in x if abs(v) < 7], atol=1e-6)


def test_student_tail(spark):
    # known two-sided values
    cases = [(12.7062, 1.0, 0.05), (2.228139, 10.0, 0.05), (1.959964, 5e4, 0.05), (2.750, 30.0, 0.01), (0.0, 5.0, 1.0), (1.962339, 1000.0, 0.05)]
    df = spark.createDataFrame(cases, "t double, d double, p double")
    for r in df.withColumn("got", dist.student_tail(F.col("t"), F.col("d"))).collect():
        assert r["got"] == pytest.approx(r["p"], abs=2e-5)


def test_crps_against_integral(spark):
    r = spark.range(1).select(dist.gaussian_crps(F.lit(1.3), F.lit(0.4), F.lit(0.8)).alias("c")).first()["c"]
    grid = np.linspace(-10, 10, 400001)
    cdf = 0.5 * (1 + np.vectorize(math.erf)((grid - 0.4) / 0.8 / math.sqrt(2)))
    assert r == pytest.approx(np.trapezoid((cdf - (grid >= 1.3)) ** 2, grid), abs=1e-4)


def test_keyed_draws_repeat(spark):
    df = spark.range(20000).withColumns({"u": uniform(1, ["id"]), "z": gaussian(2, ["id"]), "w": poisson_one(3, ["id"])})
    a, b = df.orderBy("id").toPandas(), df.repartition(7).orderBy("id").toPandas()
    assert a.equals(b)
    assert 0 < a["u"].min() and a["u"].max() < 1 and abs(a["u"].mean() - 0.5) < 0.01
    assert abs(a["z"].mean()) < 0.03 and abs(a["z"].std() - 1) < 0.03
    assert abs(a["w"].mean() - 1) < 0.03 and abs(a["w"].var() - 1) < 0.05


def test_conformal_coverage(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(y), 0.0) for y in rng.normal(size=157)], "y double, yhat double")
    q2 = intervals.finite_sample_conformal(df).first()["q"]
    s = np.sort(np.abs([r["y"] for r in df.collect()]))
    assert q2 == s[math.ceil(158 * 0.9 - 1e-9) - 1]
    assert np.mean(s <= q2) >= 0.9
    assert intervals.split_conformal(df).first()["q"] == pytest.approx(np.quantile(s, 0.9))


def test_robust_scale_falls_back(spark):
    df = spark.createDataFrame([(v,) for v in [0.0] * 95 + [1.0, 2.0, 3.0, 4.0, 50.0]], "z double")
    r = intervals.robust_scale(df, "z").first()
    assert r["q"] == pytest.approx(np.quantile([0.0] * 95 + [1, 2, 3, 4, 50], 0.95))
    big = spark.createDataFrame([(float(v),) for v in range(100)], "z double")
    assert intervals.robust_scale(big, "z").first()["q"] == pytest.approx(49.5 + 2.5 * 25.0)


def test_quantile_regression_share(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 10, 1500)
    y = 3 + 2 * x + rng.exponential(4, 1500)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(2)
    beta = intervals.quantile_regression(df, ["x"], {"q": 0.9})["q"]
    assert np.mean(y <= beta[0] + beta[1] * x) == pytest.approx(0.9, abs=0.01)


def test_bootstrap_draw_summary(spark, framed):
    fits = intervals.bootstrap_models(framed, LAGS, 30)
    drawn = intervals.bootstrap_draws(fits, framed, LAGS, ["series_id", "ts"])
    got = intervals.draw_summary(drawn, ["series_id", "ts"]).join(drawn, ["series_id", "ts"]).limit(5).toPandas()
    for r in got.itertuples():
        d = np.asarray(r.draws)
        assert len(d) == 30 and r.std == pytest.approx(d.std()) and r.p975 == pytest.approx(np.percentile(d, 97.5))


def test_posterior_centre(framed):
    one = framed.where("series_id = 'a'")
    post = intervals.posterior_models(one, LAGS, 400).toPandas()
    pdf = one.toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf[LAGS]])
    beta, rss, *_ = np.linalg.lstsq(x, pdf["y"], rcond=None)
    draws = np.stack(post["beta"])
    sd = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * rss[0] / (len(pdf) - 3))
    assert np.all(np.abs(draws.mean(axis=0) - beta) < 4 * sd / math.sqrt(400) + 1e-9)
    assert np.allclose(draws.std(axis=0), sd, rtol=0.2)


def ks(a, b):
    grid = np.sort(np.concatenate([a, b]))
    return np.max(np.abs(np.searchsorted(np.sort(a), grid, "right") / len(a) - np.searchsorted(np.sort(b), grid, "right") / len(b)))


def test_drift(spark):
    rng = np.random.default_rng(3)
    a, b = np.round(rng.normal(0, 1, 400), 1), np.round(rng.normal(0.5, 1.5, 300), 1)
    rows = [("x", True, float(v)) for v in a] + [("x", False, float(v)) for v in b] + [("flat", True, 1.0), ("flat", False, 1.0), ("gone", True, 2.0)]
    df = spark.createDataFrame(rows, "g string, ref boolean, v double").repartition(3)
    got = {r["g"]: r for r in drift.drift_score(df, "v", F.col("ref"), ["g"]).collect()}
    assert got["x"]["ks"] == pytest.approx(ks(a, b))
    sp = math.sqrt((399 * a.var(ddof=1) + 299 * b.var(ddof=1)) / 698 * (1 / 400 + 1 / 300))
    assert got["x"]["t"] == pytest.approx((a.mean() - b.mean()) / sp)
    assert got["x"]["differs"] == 1 and got["x"]["ks_p"] < 1e-6
    assert got["flat"]["ks"] == 0.0 and got["gone"]["ks"] is None


def test_isolation_scores_outliers_higher(spark):
    rng = np.random.default_rng(4)
    pts = rng.normal(0, 1, (600, 2))
    pts[:3] = [[9, 9], [-8, 7], [10, -9]]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id long, a double, b double")
    trees = drift.isolation_forest(df, ["a", "b"], ["id"], trees=40)
    got = drift.isolation_score(df, trees, ["a", "b"]).orderBy(F.desc("score")).limit(3).collect()
    assert len(trees) == 40 and {r["id"] for r in got} == {0, 1, 2}


def test_alerts_and_history(spark, panel):
    m = monitor.long_metrics(monitor.snapshot(panel.withColumn("yhat", F.col("y") + 20), yhat="yhat", extra={"run": 3}), ["series_id"])
    hit = monitor.alerts(m).collect()
    assert {r["metric"] for r in hit} == {"mae"} and all(r["value"] == pytest.approx(20) for r in hit)
    flat = spark.createDataFrame([("c", i) for i in range(5)], "series_id string, i int").selectExpr("series_id", "timestamp_seconds(i) ts", "4.0D y")
    stats = dict(monitor.long_metrics(monitor.snapshot(flat), []).collect())
    assert stats["autocorrelation"] is None and stats["std"] == 0


def test_augmentation(make_panel, panel):
    p = make_panel({"s": range(11)})
    w = augment.time_warp(p, F.lit(1.9)).orderBy("i").toPandas()
    assert np.allclose(w["y"], np.interp(np.linspace(0, 10, 20), np.arange(11), np.arange(11)))
    d = augment.dropout(panel, 0.1).join(panel.withColumnRenamed("y", "y0"), ["series_id", "ts"]).toPandas()
    kept = d["y"] == d["y0"]
    assert 0.75 < kept.mean() < 1 and (d["y"][~kept] == 0).all()
    s = augment.scale(panel).join(panel.withColumnRenamed("y", "y0"), ["series_id", "ts"]).withColumn("f", F.col("y") / F.col("y0")).groupBy("series_id").agg(F.stddev("f").alias("sd"), F.avg("f").alias("f")).toPandas()
    assert (s["sd"].fillna(0) < 1e-12).all() and s["f"].between(0.9, 1.1).all()
    r = augment.random_copies(panel, 8).groupBy("series_id", "copy").agg(F.countDistinct("kind").alias("k")).toPandas()
    assert len(r) == 24 and (r["k"] == 1).all()
    b = augment.bootstrap_windows(panel, 5, width=12)
    assert b.count() == 10 and b.where(F.size("window") != 12).count() == 0


def test_forecasts(panel, make_panel):
    pdf = panel.where("series_id = 'a'").orderBy("ts").toPandas()
    y = pdf["y"].to_numpy()
    phi, c = np.polyfit(y[:-1], y[1:], 1)
    s2 = np.mean((y[1:] - c - phi * y[:-1]) ** 2)
    got = forecast.ar1_forecast(panel, 4).where("series_id = 'a'").orderBy("step").toPandas()
    mean, var, m, v = [], [], y[-1], 0.0
    for _ in range(4):
        m, v = c + phi * m, s2 + phi * phi * v
        mean.append(m)
        var.append(v)
    assert np.allclose(got["yhat"], mean) and np.allclose(got["var"], var)
    t = np.arange(84)
    wave = 10 + 0.3 * t + 2 * np.sin(2 * np.pi * t / 12)
    f = forecast.trend_season_forecast(make_panel({"w": wave}), 6).orderBy("step").toPandas()
    tt = np.arange(84, 90)
    assert np.allclose(f["yhat"], 10 + 0.3 * tt + 2 * np.sin(2 * np.pi * tt / 12), atol=1e-6)
    g = forecast.trend_season_forecast(make_panel({"w": np.exp(wave / 20)}), 6, multiplicative=True).orderBy("step").toPandas()
    assert np.allclose(np.log(g["yhat"]) * 20, f["yhat"], atol=1e-6)
    chain = {r["series_id"]: r["method"] for r in forecast.forecast_chain(panel, 2).collect()}
    assert chain == {"a": "trend_season", "b": "trend_season", "short": "naive"}


def test_recursive_paths_agree(panel):
    train = panel.withColumns(win.lags(ks=(1, 2))).where("series_id = 'a'").na.drop()
    model = models.inner(models.on_features(models.linear(), LAGS).fit(train))
    one = panel.where("series_id = 'a'")
    a = forecast.recursive_forecast(one, model, 5, 2).orderBy("step").toPandas()
    b = forecast.linear_recursive_forecast(one, 5, 2).orderBy("step").toPandas()
    assert np.allclose(a["yhat"], b["yhat"], atol=1e-6) and a["step"].tolist() == [1, 2, 3, 4, 5]


def test_fusion(spark):
    df = spark.createDataFrame([(10.0, 4.0, 14.0, 1.0), (1.0, 0.0, 3.0, 2.0)], "a double, va double, b double, vb double")
    got = forecast.fuse(df, [("a", "va"), ("b", "vb")]).collect()
    assert got[0]["fused_mean"] == pytest.approx((10 / 4 + 14) / 1.25) and got[0]["fused_variance"] == pytest.approx(0.8)
    assert all(r["fused_variance"] <= min(max(r["va"], 1e-10), r["vb"]) + 1e-12 for r in got)
    means, variances = forecast.fusion_columns(["VAR_A", "pred_b", "x"])
    assert means == [None, "pred_b"] and variances == ["VAR_A", None]


def test_ridge_mapping(framed):
    pdf = framed.toPandas()
    x, y = pdf[LAGS].to_numpy(), pdf["y"].to_numpy()
    m = models.inner(models.on_features(models.ridge(3.0, len(y), y.std()), LAGS).fit(framed))
    xc, yc = x - x.mean(axis=0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 3.0 * np.eye(2), xc.T @ yc)
    assert np.allclose(m.coefficients.toArray(), want, atol=1e-6)


def test_one_job_folds_equal_single_fits(framed):
    a = models.linear_fold_predictions(framed, LAGS, {"m": 0.0}, k=3).orderBy("series_id", "ts").toPandas()
    b = models.fold_predictions(framed, LAGS, {"m": models.linear()}, k=3).orderBy("series_id", "ts").toPandas()
    assert np.allclose(a["yhat"], b["yhat"], atol=1e-6) and len(a) == len(b)


def test_stack_and_repair(spark):
    rows = [("s", i, float(i), float(i) + 0.1 if i % 4 else None, None, 2.0 * i) for i in range(40)] + [("s", 99, 1.0, None, None, None)]
    oof = spark.createDataFrame(rows, "series_id string, t int, y double, m1 double, dead double, m2 double")
    fixed, kept = models.repair_oof(oof, ["m1", "dead", "m2"])
    assert kept == ["m1", "m2"] and fixed.count() == 40 and fixed.where("m1 IS NULL").count() == 0
    stack = models.fit_stack(fixed, kept, alpha=1e-6)
    err = models.predict_stack(fixed, stack).agg(F.max(F.abs(F.col("stacked") - F.col("y")))).first()[0]
    assert err < 0.5


def test_permutation_uses_every_value_once(framed):
    p = models.permuted(framed, {"other": "lag_1"}, 5, ["series_id", "ts"])
    pdf = p.toPandas()
    assert len(pdf) == framed.count()
    assert np.allclose(np.sort(pdf["other"]), np.sort(pdf["lag_1"])) and not np.allclose(pdf["other"], pdf["lag_1"])


def test_importance_finds_the_signal(framed):
    df = framed.withColumn("noise", uniform(9, ["series_id", "ts"]))
    names = [*LAGS, "noise"]
    hits = models.shadow_selection(df, ["lag_1", "noise"], ["series_id", "ts"], rounds=2, trees=10)
    assert hits["lag_1"] == 2
    table = models.permutation_importance(models.on_features(models.linear(), names).fit(df), df, names, ["series_id", "ts"]).toPandas().set_index("feature")
    assert table["increase"].idxmax() == "lag_1"


def test_models_with_missing_columns(framed, tmp_path):
    m = models.on_features(models.linear(), LAGS).fit(framed)
    path = str(tmp_path / "m")
    m.write().overwrite().save(path)
    got = models.evaluate_models({"saved": PipelineModel.load(path)}, framed.drop("lag_2"), LAGS).first()
    assert got["n"] == framed.count()


def test_metrics_skip_zero_targets(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0), (4.0, 5.0)], "y double, yhat double")
    r = summary.regression_metrics(df, []).first()
    assert r["mape"] == pytest.approx(100 * (0.5 + 0.25) / 2) and r["mae"] == 1.0 and r["r2"] == pytest.approx(1 - 3 / 8)
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, yhat double")
    assert summary.regression_metrics(flat, []).first()["r2"] is None


def test_normal_plot(spark):
    v = [3.0, 1.0, 2.0, 2.0]
    df = spark.createDataFrame([("g", x) for x in v], "g string, v double")
    got = summary.normal_plot(df, "v", ["g"]).orderBy("v").collect()
    assert [(r["first_rank"], r["last_rank"]) for r in got] == [(1, 1), (2, 3), (4, 4)]
    assert got[0]["low"] == pytest.approx(-got[2]["high"]) and got[1]["low"] == pytest.approx(-got[1]["high"], abs=1e-9)


def test_registry(panel, spark, tmp_path):
    path = str(tmp_path / "ar1")
    agents.get_agent("ar1").fit(panel).save(path)
    got = agents.PanelModel.load(path).predict(panel)
    want = forecast.ar1_forecast(panel, 1).select("series_id", "yhat")
    both = got.join(want, "series_id").toPandas()
    assert np.allclose(both["mu"].astype(float), both["yhat"].astype(float), equal_nan=True)
    with pytest.raises(KeyError):
        agents.get_agent("nope")


@pytest.mark.parametrize("name", sorted(agents.REGISTRY))
def test_component_saves_loads_and_predicts(panel, tmp_path, name):
    fitted = agents.get_agent(name).fit(panel)
    path = str(tmp_path / name)
    fitted.save(path)
    back = agents.PanelModel.load(path)
    assert back.uid == fitted.uid and back.getOrDefault("component") == name

    def rows(df):
        return sorted(str(tuple(r)) for r in df.collect())

    assert rows(back.transform(panel)) == rows(fitted.transform(panel))
    ahead = back.predict(panel).collect()
    assert {r["series_id"] for r in ahead} == {"a", "b", "short"} and all(r["mu"] is not None and r["mode"] in ("predict", "naive") for r in ahead)


def test_components_in_a_pipeline(panel, tmp_path):
    from pyspark.ml import Pipeline

    stages = [agents.get_agent("profile"), agents.get_agent("harmonics", k=2), agents.get_agent("ar1")]
    fitted = Pipeline(stages=stages).fit(panel)
    fitted.save(str(tmp_path / "whole"))
    Pipeline(stages=stages).save(str(tmp_path / "plan"))
    want = sorted(str(tuple(r)) for r in fitted.transform(panel).collect())
    assert sorted(str(tuple(r)) for r in PipelineModel.load(str(tmp_path / "whole")).transform(panel).collect()) == want
    again = Pipeline.load(str(tmp_path / "plan")).fit(panel)
    assert sorted(str(tuple(r)) for r in again.transform(panel).collect()) == want


def test_each_model_is_judged_alone(framed, tmp_path):
    good = models.on_features(models.linear(), LAGS).fit(framed)
    text = models.on_features(models.linear(), ["code"]).fit(framed.withColumn("code", F.col("lag_1")))
    path = str(tmp_path / "good")
    good.save(path)
    test = framed.drop("lag_2").withColumn("code", F.lit("x"))
    got = {r["model"]: r for r in models.evaluate_each({"good": good, "saved": path, "text": text, "gone": str(tmp_path / "gone")}, test).collect()}
    want = models.evaluate_models({"good": good}, test, LAGS).first()
    for name in ("good", "saved"):
        assert got[name]["filled"] == ["lag_2"] and got[name]["rmse"] == pytest.approx(want["rmse"]) and got[name]["eval_error"] is None
    assert got["text"]["rmse"] is None and "code" in got["text"]["eval_error"]
    assert got["gone"]["load_error"] and got["gone"]["eval_error"] is None


def test_given_functions(spark, framed):
    rows = framed.toPandas()

    def broken(x, y):
        if len(y) > 60:
            raise RuntimeError("too many")
        return callables.mean_model(x, y)

    out = callables.fold_predictions(framed, LAGS, [("mean", callables.mean_model), ("broken", broken)], 3).toPandas()
    assert set(out["model"]) == {"mean", "broken"} and out[out["model"] == "mean"]["error"].isna().all()
    bad = out[out["error"].notna()]
    assert len(bad) and set(bad["model"]) == {"broken"} and bad["yhat"].isna().all() and bad["error"].str.contains("too many").all()
    with pytest.raises(ValueError, match="most_rows"):
        callables.bootstrap_intervals(framed, framed, LAGS, callables.mean_model, 3, most_rows=10)
    got = callables.bootstrap_intervals(framed, framed.limit(5), LAGS, callables.mean_model, 80).toPandas()
    sd = rows["y"].std() / math.sqrt(len(rows))
    assert (got["fits"] == 80).all() and ((got["median"] - rows["y"].mean()).abs() < sd).all()
    assert ((got["upper"] - got["lower"]).between(2 * sd, 6 * sd)).all()


def test_dated_folds_see_no_later_date(spark):
    import datetime as dt

    from tidewell.operators import splits

    rows = [(k, dt.datetime(2000 + (s + i) // 12, (s + i) % 12 + 1, 1), float(i)) for k, s, n in (("long", 0, 60), ("late", 40, 20), ("early", 0, 12)) for i in range(n)]
    folded = splits.dated_folds(spark.createDataFrame(rows, "series_id string, ts timestamp, y double"), 5).toPandas()
    for _, g in folded.groupby("fold"):
        assert g[g["part"] == "train"]["ts"].max() < g[g["part"] == "test"]["ts"].min()
    assert sorted(folded["fold"].unique()) == [1, 2, 3, 4, 5]
    late = splits.expanding_folds(spark.createDataFrame(rows, "series_id string, ts timestamp, y double"), 5).toPandas()
    assert any(g[g["part"] == "train"]["ts"].max() > g[g["part"] == "test"]["ts"].min() for _, g in late.groupby("fold"))


def test_sample_statistics(spark):
    rng = np.random.default_rng(7)
    d = rng.normal(size=(40, 3))
    rows = [(j, i, i % 4, float(d[i, j]), 0.2) for i in range(40) for j in range(3)]
    df = spark.createDataFrame(rows, "point int, sample int, grp int, yhat double, y double")
    v = summary.variance_split(df, ["point"]).orderBy("point").toPandas()
    for j in range(3):
        groups = [d[np.arange(40) % 4 == g, j] for g in range(4)]
        assert v["epistemic"][j] == pytest.approx(np.var([g.mean() for g in groups], ddof=1))
        assert v["aleatoric"][j] == pytest.approx(np.mean([g.var(ddof=1) for g in groups]))
    pits = summary.pit(df, ["point"]).orderBy("point").toPandas()["pit"]
    assert np.allclose(pits, (d <= 0.2).mean(axis=0))
    curve = intervals.calibration_curve(df, ["point"], [0.5, 0.9]).orderBy("level").toPandas()
    for r in curve.itertuples():
        lo, hi = np.percentile(d, [50 * (1 - r.level), 50 * (1 + r.level)], axis=0)
        assert r.coverage == pytest.approx(np.mean((lo <= 0.2) & (0.2 <= hi)))
    assert isinstance(curve, pd.DataFrame)


def test_full_stack_scores_new_rows(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [("a", (pd.Timestamp("2000-01-01") + pd.Timedelta(days=i)).to_pydatetime(), float(x), float(z), float(3.0 * x - 2.0 * z + rng.normal(0, 0.01))) for i, (x, z) in enumerate(rng.normal(size=(120, 2)))]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, x double, z double, y double")
    full = models.fit_full_stack(df, {"one": (models.linear(), ["x"]), "two": (models.linear(), ["z"])}, k=4, alpha=0.01)
    models.save_full_stack(full, str(tmp_path / "stack"), spark)
    back = models.load_full_stack(str(tmp_path / "stack"), spark)
    new = spark.createDataFrame([(1.0, 0.5), (-2.0, None)], "x double, z double")
    got = models.predict_full_stack(new, back).toPandas()
    assert got.stacked[0] == pytest.approx(2.0, abs=0.5)
    assert got.stacked.tolist() == models.predict_full_stack(new, full).toPandas().stacked.tolist()
    assert np.isfinite(got.stacked[1])


def test_missing_features_keep_their_rows(spark, tmp_path):
    from tidewell.sources import writers

    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(20)] + [(None, 1.0), (float("nan"), 1.0)], "x double, y double")
    for est in (models.linear(), models.forest(3, 2), models.boosted(2, 2)):
        model = models.on_features(est, ["x"]).fit(df)
        path = writers.save_predictions(model, df, str(tmp_path / type(est).__name__))
        got = spark.read.parquet(path).toPandas()
        assert len(got) == 22 and got.pred.isna().sum() == 2


def test_summary_keeps_all_rows(spark, tmp_path):
    from tidewell.sources import writers

    path = writers.save_summary(spark.createDataFrame([(1,), (2,)], "a int"), str(tmp_path / "s"))
    assert spark.read.json(path).count() == 2


def test_panel_keeps_small_values(spark):
    from pyspark.sql import functions as F

    from tidewell.panel import to_panel

    df = spark.createDataFrame([("a", pd.Timestamp("2000-01-01").to_pydatetime(), 0.004), ("a", pd.Timestamp("2000-01-02").to_pydatetime(), 0.012345)], "k string, ts timestamp, v double")
    got = to_panel(df, F.col("k"), F.col("ts"), F.col("v"), "month").first()["y"]
    assert got == pytest.approx(0.0081725, rel=1e-12)


def test_short_series_are_forecast_too(spark, make_panel):
    panel = make_panel({"long": range(40), "short": [5.0, 7.0]})
    got = forecast.linear_recursive_forecast(panel, 3, (1, 24)).toPandas()
    assert sorted(got.series_id.unique()) == ["long", "short"] and got.yhat.notna().all()
    model = models.inner(models.on_features(models.linear(), ["lag_1", "lag_3"]).fit(panel.withColumns(win.lags(ks=(1, 3)))))
    assert forecast.recursive_forecast(panel, model, 2, (1, 3)).count() == 4


def test_median_imputer_takes_the_lower_middle_value(spark):
    df = spark.createDataFrame([(1.0, None), (9.0, 2.0), (3.0, 8.0), (None, float("nan")), (7.0, 5.0)], "a double, b double")
    got = models.MedianImputer(strategy="median", inputCols=["a", "b"], outputCols=["c", "d"]).fit(df)
    assert tuple(got.surrogateDF.first()) == (3.0, 5.0)


@pytest.mark.parametrize("n", [900, 25000])
def test_boosting_on_cells_gives_the_trees_of_rows(spark, n):
    rng = np.random.default_rng(n)
    x = np.column_stack([rng.normal(50, 20, n), rng.integers(0, 9, n), rng.gamma(2, 3, n)])
    y = x[:, 0] * (x[:, 1] > 4) + np.abs(x[:, 2] - 5) + rng.normal(size=n)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double").repartition(3).cache()
    odd = spark.createDataFrame([(None, 1.0, 2.0, 3.0), (1.0, float("nan"), 2.0, 3.0), (1.0, 1.0, 2.0, None)], df.schema)
    names, rows = ["a", "b", "c"], df.unionByName(odd)
    plain, cells = (models.on_features(e, names).fit(rows) for e in (models.boosted(rounds=6), models.BoostedOnCells(rounds=6)))
    both = cells.transform(plain.transform(rows).withColumnRenamed("prediction", "was"))
    assert both.columns == ["a", "b", "c", "y", "was", "prediction"]
    got = both.toPandas()
    assert got["was"].isna().sum() == got["prediction"].isna().sum() == 2
    assert np.allclose(got["was"], got["prediction"], rtol=1e-9, equal_nan=True)


def test_boosting_on_cells_falls_back_to_rows(spark, monkeypatch):
    monkeypatch.setattr(models, "CELLS", 4)
    df = spark.createDataFrame([(float(i), float(i % 7)) for i in range(60)], "a double, y double")
    fits = [models.on_features(e, ["a"]).fit(df).transform(df).orderBy("a").toPandas()["prediction"] for e in (models.boosted(rounds=2), models.BoostedOnCells(rounds=2))]
    assert np.allclose(*fits)
