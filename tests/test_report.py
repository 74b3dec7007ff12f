"""Distances, information, scores of draws and chained models against plain computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import distribution as dist
from tidewell.operators import drift, intervals, models, summary, weather


def area(a, b):
    x = np.sort(np.concatenate([a, b]))
    gap = [abs((a <= v).mean() - (b <= v).mean()) for v in x[:-1]]
    return float(np.dot(gap, np.diff(x)))


def test_wasserstein(spark):
    rng = np.random.default_rng(3)
    parts = {
        "shifted": (rng.normal(0, 1, 300), rng.normal(0.7, 2, 200)),
        "ties": (rng.integers(-3, 4, 500).astype(float), rng.integers(-2, 6, 100).astype(float)),
        "narrow": (1e9 + rng.random(200), 1e9 + rng.random(100) * 2),  # all in few value bins
        "equal": (np.array([2.0, 2.0]), np.array([2.0])),
        "far": (np.array([-1e6, 0.0, 1e-9]), np.array([5.0, 1e6])),
    }
    rows = [(k, float(v), r) for k, (a, b) in parts.items() for side, r in ((a, True), (b, False)) for v in side]
    rows += [("one", 1.0, True), ("one", 2.0, True), ("shifted", None, True), ("shifted", math.nan, False)]
    got = {r["k"]: r for r in drift.wasserstein(spark.createDataFrame(rows, "k string, v double, r boolean").repartition(5), "v", F.col("r"), ["k"]).collect()}
    for k, (a, b) in parts.items():
        assert got[k]["wasserstein"] == pytest.approx(area(a, b), rel=1e-9, abs=1e-12)
        assert (got[k]["n_ref"], got[k]["n_new"]) == (len(a), len(b))
    assert got["one"]["wasserstein"] is None


def test_mutual_information(spark):
    rng = np.random.default_rng(4)
    n = 3000
    y = rng.normal(size=n)
    cols = {"copy": y * 2, "noisy": y + rng.normal(size=n), "square": y**2, "noise": rng.normal(size=n), "flat": np.ones(n)}
    rows = [tuple(float(cols[c][i]) for c in cols) + (float(y[i]),) for i in range(n)] + [(None, None, None, None, None, 1.0), (math.nan, 0.0, 0.0, 0.0, 1.0, None)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in (*cols, "y")))
    got = {r["feature"]: r for r in summary.mutual_information(df, list(cols), bins=12).collect()}

    def cut(v):
        return np.minimum(np.floor((v - v.min()) / (v.max() - v.min()) * 12), 11) if v.max() > v.min() else np.zeros(len(v))

    for c, v in cols.items():
        joint = np.histogram2d(cut(v), cut(y), bins=[np.arange(13) - 0.5] * 2)[0] / n
        px, py = joint.sum(1, keepdims=True), joint.sum(0, keepdims=True)
        want = (joint[joint > 0] * np.log(joint[joint > 0] / (px @ py)[joint > 0])).sum()
        assert got[c]["information"] == pytest.approx(want, abs=1e-3 if c in ("noisy", "noise") else 1e-9) and got[c]["n"] == n
    assert summary.most_informative(df, list(cols), 2, bins=12) == ["copy", "square"]


def test_sample_crps(spark):
    rng = np.random.default_rng(5)
    points = {i: (float(rng.normal()), np.round(rng.normal(size=int(rng.integers(1, 60))), 1)) for i in range(30)}
    rows = [(i, y, float(x)) for i, (y, xs) in points.items() for x in xs] + [(99, None, 1.0), (0, points[0][0], None)]
    got = {r["p"]: r for r in intervals.sample_crps(spark.createDataFrame(rows, "p int, y double, yhat double").repartition(4), ["p"]).collect()}
    for i, (y, xs) in points.items():
        want = np.abs(xs - y).mean() - np.abs(xs[:, None] - xs[None, :]).mean() / 2
        assert got[i]["crps"] == pytest.approx(want, abs=1e-12) and got[i]["n"] == len(xs)
    assert got[99]["crps"] is None and got[99]["y"] is None


def test_sample_crps_of_gaussian_draws_is_the_closed_form(spark):
    n = 4000
    draws = spark.range(n).select(((F.col("id") + 0.5) / n).alias("u")).select(F.lit(1.3).alias("y"), (2 + 0.8 * dist.normal_quantile(F.col("u"))).alias("yhat"), F.lit(1).alias("p"))
    one = draws.limit(1).select(F.lit(1.3).alias("y"), F.lit(2.0).alias("mu"), F.lit(0.64).alias("var"))
    closed = intervals.gaussian_scores(one).first()["crps"]
    assert intervals.sample_crps(draws, ["p"]).first()["crps"] == pytest.approx(closed, abs=1e-4)


def test_scores_count_what_they_leave_out(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (1.0, 2.0, 0.0), (None, 2.0, 1.0), (1.0, None, 1.0)], "y double, mu double, var double")
    got = intervals.gaussian_scores(df).first()
    assert (got["n"], got["n_left_out"]) == (1, 3)


def test_student_tail_has_no_switch(spark):
    # 1.96 at many degrees of freedom nears the normal tail from above
    tails = [spark.range(1).select(dist.student_tail(F.lit(1.959964), F.lit(float(d)))).first()[0] for d in (9e3, 9999.0, 10001.0, 1e5, 1e7, 1e9)]
    assert tails == sorted(tails, reverse=True) and tails[-1] == pytest.approx(0.05, abs=1e-6)
    assert tails[1] - tails[2] < 1e-8


def test_second_model_on_the_output_of_a_first(spark):
    rows = [(float(i % 7), float(i % 5), 2.0 * (i % 7) + (i % 5) ** 2) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    first = models.on_features(models.linear(), ["a"], "y", "one").fit(df)
    seen = first.transform(df).withColumn("rest", F.col("y") - F.col("one"))
    second = models.on_features(models.forest(5, 4), ["b"], "rest").fit(seen)
    out = second.transform(seen)
    assert out.columns == ["a", "b", "y", "one", "rest", "prediction"]
    assert out.where("prediction IS NULL").count() == 0


def test_outliers_and_fills(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 2, 3, 2, 1, 2, 3, 50])] + [("b", i, 4.0) for i in range(3)], "series_id string, ts int, y double")
    got = {(r["series_id"], r["ts"]): r["outlier"] for r in weather.modified_z(df).collect()}
    assert [k for k, v in got.items() if v] == [("a", 7)]
    gaps = spark.createDataFrame([("a", 1, None), ("a", 2, 2.0), ("a", 3, None), ("a", 4, None), ("a", 5, 8.0), ("a", 6, None), ("c", 1, None)], "series_id string, ts int, y double")
    filled = [r["y"] for r in gaps.withColumn("y", weather.weighted_fill(alpha=0.75)).orderBy("series_id", "ts").collect()]
    assert filled == [2.0, 2.0, 3.5, 3.5, 8.0, 8.0, None]
    days = weather.degree_days(df, heat=2.5, cool=10.0, grow=1.0).orderBy("series_id").collect()
    assert [tuple(r)[1:] for r in days] == [(4.5, 40.0, 56.0), (0.0, 0.0, 9.0)]
