"""Distances, clustering, spectral and regime operators against NumPy."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidewell.functions import arrays, dynamics
from tidewell.operators import clustering, distances, gram, regimes, sequences, spectral


def dtw(a, b, band=None):
    n, m = len(a), len(b)
    d = np.full((n + 1, m + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            if band is None or abs(i - j) <= band:
                d[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return math.sqrt(d[n, m])


@pytest.mark.parametrize("band", [None, 2])
def test_warping_and_bound(spark, band):
    rng = np.random.default_rng(0)
    pairs = [(i, rng.normal(size=9).tolist(), rng.normal(size=9).tolist()) for i in range(40)]
    df = spark.createDataFrame(pairs, "i int, a array<double>, b array<double>")
    low, high = arrays.envelope(F.col("b"), 2)
    got = df.select("i", arrays.dtw(F.col("a"), F.col("b"), band).alias("d"), arrays.lb_keogh(F.col("a"), low, high).alias("lb")).orderBy("i").collect()
    for r, (_, a, b) in zip(got, pairs):
        assert r["d"] == pytest.approx(dtw(a, b, band), rel=1e-12)
        if band == 2:
            assert r["lb"] <= r["d"] + 1e-12


def test_z_norm_of_flat_window(spark):
    df = spark.createDataFrame([([2.0, 2.0, 2.0],), ([1.0, 2.0, 3.0],)], "a array<double>")
    a, b = [r[0] for r in df.select(arrays.z_norm(F.col("a"))).collect()]
    assert a == [0.0, 0.0, 0.0] and np.std(b) == pytest.approx(1.0)


def test_pruned_distance(make_panel):
    rng = np.random.default_rng(1)
    w = sequences.sliding_windows(make_panel({"a": rng.normal(size=40)}), 6)
    centers = {"x": [0.0, 1, 0, -1, 0, 1], "y": [1.0, 1, 1, 0, 0, 0]}
    got = distances.pruned_dtw(w, "window", centers, ["start"], 2, keep=0.5).toPandas()
    raw = {r["start"]: r["window"] for r in w.collect()}
    for r in got.itertuples():
        assert r.distance == pytest.approx(dtw(raw[r.start], centers[r.centroid], 2) if r.exact else r.bound)
    for _, g in got.groupby("centroid"):
        assert (g["exact"] == (g["bound"] <= np.quantile(g["bound"], 0.5))).all()


def test_windows_skip_gaps_and_stride(make_panel):
    w = sequences.sliding_windows(make_panel({"a": [1, 2, None, 4, 5, 6, 7]}), 3, stride=1).orderBy("start").collect()
    assert [(r["start"], r["stop"], r["window"]) for r in w] == [(3, 5, [4, 5, 6]), (4, 6, [5, 6, 7])]
    assert [r["start"] for r in sequences.sliding_windows(make_panel({"a": range(8)}), 3, stride=2).orderBy("start").collect()] == [0, 2, 4]


def test_elbow():
    assert clustering.elbow([2, 3, 4, 5, 6], [100, 40, 30, 25, 22]) == 3
    assert clustering.elbow([2, 3], [5, 4]) == 2
    assert clustering.elbow([2, 3, 4], [1, 1, 1]) in (2, 3)


def test_silhouette_matches_definition(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (15, 2)), rng.normal(4, 1, (12, 2))])
    lab = [0] * 15 + [1] * 12
    df = spark.createDataFrame([(i, lab[i], x[i].tolist()) for i in range(27)], "i long, label int, a array<double>").withColumn("z", array_to_vector("a"))
    got = clustering.silhouette_sample(df, 100, 1, ["i"]).orderBy("i").toPandas()
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    lab = np.array(lab)
    for i in range(27):
        own = d[i][lab == lab[i]].sum() / ((lab == lab[i]).sum() - 1)
        other = d[i][lab != lab[i]].mean()
        assert got["silhouette"][i] == pytest.approx((other - own) / max(own, other))


def test_choose_k_scores_all_rows(spark):
    rng = np.random.default_rng(6)
    # 300 rows in two large groups and a small one
    x = np.vstack([rng.normal(0, 1, (150, 2)), rng.normal(6, 1, (147, 2)), rng.normal(30, 0.1, (3, 2))])
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(300)], "i long, a array<double>").withColumn("z", array_to_vector("a")).cache()
    got = clustering.choose_k(df, (2, 3), restarts=2, keys=("i",))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    for k, score in zip(got["ks"], got["scores"]):
        fit = clustering.fit_kmeans(df, k, 2).transform(df)
        lab = np.array([r["label"] for r in fit.orderBy("i").select("label").collect()])
        s = []
        for i in range(300):
            own = d[i][lab == lab[i]].sum() / max((lab == lab[i]).sum() - 1, 1)
            other = min(d[i][lab == g].mean() for g in set(lab) - {lab[i]})
            s.append((other - own) / max(own, other))
        assert score == pytest.approx(np.mean(s), abs=1e-9)


@pytest.mark.parametrize("width", [1, 2])
def test_choose_k_has_no_sample(spark, width, monkeypatch):
    rng = np.random.default_rng(7)
    # a group of three among 2303 rows: a sample would miss it, or weigh it wrongly; rows come twice
    x = np.vstack([rng.normal(m, s, (n, width)) for m, s, n in ((0, 1, 1200), (9, 1, 1100), (60, 0.1, 2))])
    x = np.vstack([x, x[-1:]])
    monkeypatch.setattr(clustering, "BLOCK", 500)
    monkeypatch.setattr(clustering, "ROWS_PER_PART", 1000)
    df = spark.createDataFrame([(v.tolist(),) for v in x], "a array<double>").repartition(3).select(array_to_vector("a").alias("z")).cache()
    got = clustering.choose_k(df, (2, 3, 4), restarts=2)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    fits = clustering.fit_kmeans_each(df, (2, 3, 4), 2)
    for k, score in zip(got["ks"], got["scores"]):
        lab = np.linalg.norm(x[:, None] - fits[k].centers[None], axis=2).argmin(1)
        mean = np.stack([d[:, lab == g].sum(1) / max((lab == g).sum(), 1) for g in range(k)], 1)
        size = np.bincount(lab, minlength=k)[lab]
        own = mean[np.arange(len(x)), lab] * size / np.maximum(size - 1, 1)
        mean[np.arange(len(x)), lab] = np.inf
        s = np.where(size == 1, 0, (mean.min(1) - own) / np.maximum(own, mean.min(1)))
        assert score == pytest.approx(s.mean(), abs=1e-9)


def test_reduction_inverts_centroids(make_panel):
    rng = np.random.default_rng(3)
    w = sequences.sliding_windows(make_panel({"a": rng.normal(size=60)}), 6)
    model, z = clustering.reduce_windows(w, components=6)
    first = z.orderBy("start").first()
    assert np.allclose(clustering.to_window_space(model, first["z"].toArray()), first["window"])


def test_reduction_holds_windows_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(rng.normal(size=4).tolist(),) for _ in range(90)], "window array<double>").repartition(40)
    held = spark.sparkContext._jsc.getPersistentRDDs
    for rows, most in ((10, 32), (200_000, 8)):
        # once dealt to more partitions, once to fewer
        monkeypatch.setattr(clustering, "spread", lambda d, n=most if rows > 10 else 60: d.coalesce(n) if n < 40 else d.repartition(n))
        before = set(held())
        _, z = clustering.reduce_windows(df.where(f"size(window) < {rows}"), components=2)
        assert z.count() == 90
        assert len(set(held()) - before) == 1


def test_strongest_frequencies(make_panel):
    t = np.arange(120)
    got = spectral.top_frequencies(make_panel({"s": 5 * np.sin(2 * np.pi * t / 12) + 2 * np.cos(2 * np.pi * t / 30)}), 2).orderBy("rank").collect()
    assert [round(2 * math.pi / r["omega"]) for r in got] == [12, 30]


def test_decompose_adds_up(make_panel):
    t = np.arange(72)
    y = 0.1 * t + 3 * np.sin(2 * np.pi * t / 12)
    got = spectral.decompose(make_panel({"s": y})).orderBy("ts").toPandas()
    inner = got.dropna()
    assert len(inner) == 60
    assert np.allclose(inner["trend"] + inner["seasonal"] + inner["resid"], inner["y"])
    assert np.allclose(inner["trend"], 0.1 * inner["t"]) and np.allclose(inner["seasonal"], 3 * np.sin(2 * np.pi * inner["t"] / 12))


def test_filter_bank_keeps_energy(make_panel):
    rng = np.random.default_rng(6)
    y = rng.normal(size=64)
    got = {r["level"]: r["energy"] for r in spectral.wavelet_energies(make_panel({"s": y})).collect()}
    sizes = {"d1": 32, "d2": 16, "d3": 8, "a3": 8}
    assert set(got) == set(sizes)
    assert sum(got[k] * n for k, n in sizes.items()) == pytest.approx(float(y @ y))


def test_damped_fit_recovers_and_restores_mean(make_panel):
    t = np.arange(96)
    y = 20 + 4 * np.exp(-0.02 * t) * np.cos(2 * np.pi * t / 12 + 0.4)
    p = make_panel({"s": y})
    got = spectral.fit_damped(p).first()
    assert got["params"][0]["decay"] == 0.02
    assert got["params"][0]["amplitude"] == pytest.approx(4, rel=0.1)
    from tidewell.panel import with_position

    pred = with_position(p).crossJoin(spectral.fit_damped(p).select("mean", "params")).select("t", "y", (F.col("mean") + dynamics.damped_sum(F.col("t"), F.col("params"))).alias("f")).toPandas()
    assert np.sqrt(np.mean((pred["f"] - pred["y"]) ** 2)) < 0.3


def test_koopman_against_numpy(make_panel):
    rng = np.random.default_rng(8)
    y = np.sin(np.arange(60) / 3) + 0.1 * rng.normal(size=60)
    got = spectral.koopman_modes(make_panel({"s": y})).orderBy("mode").toPandas()
    z = (y - y.mean()) / y.std()

    def g(i):
        out = [1.0]
        for k in range(3):
            x = z[i - k]
            out += [x, x * x, math.sin(x), math.cos(x)]
        return out

    m = np.array([g(i) for i in range(2, 60)]).T
    k = (m[:, 1:] @ m[:, :-1].T) @ np.linalg.pinv(m[:, :-1] @ m[:, :-1].T)
    want = np.sort(np.abs(np.linalg.eigvals(k)))[::-1]
    assert np.allclose(np.sort(got["modulus"])[::-1], want, atol=1e-5)


def segment_cost(v, cuts):
    edges = [0, *cuts, len(v)]
    return sum(((v[a:b] - v[a:b].mean()) ** 2).sum() for a, b in zip(edges, edges[1:]))


def test_change_points(make_panel):
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.normal(0, 0.5, 60), rng.normal(5, 0.5, 60)])
    got = sorted(r["breakpoint"] for r in regimes.change_points(make_panel({"s": v, "flat": [1.0] * 40}), 10.0).collect())
    assert got == [60]
    small = rng.normal(0, 1, 24) + np.repeat([0, 3, -2], 8)
    found = sorted(r["breakpoint"] for r in regimes.change_points(make_panel({"s": small}), 3.0, jump=2).collect())
    import itertools

    best = min(
        (segment_cost(small, c) + 3.0 * (len(c)), c) for k in range(0, 4) for c in itertools.combinations(range(2, 24, 2), k)
    )
    assert segment_cost(small, found) + 3.0 * len(found) <= best[0] + 1e-9


def test_binary_segmentation(make_panel):
    rng = np.random.default_rng(10)
    v = np.concatenate([rng.normal(0, 0.3, 40), rng.normal(4, 0.3, 30), rng.normal(1, 0.3, 50)])
    got = regimes.binary_segmentation(make_panel({"s": v}), 10.0).toPandas()
    assert sorted(set(got["segment_start"])) == [0, 40, 70] and len(got) == 120


def test_regime_numbers_grow(make_panel, spark):
    from tidewell.panel import with_position

    p = with_position(make_panel({"s": range(10)}))
    breaks = spark.createDataFrame([("s", 4), ("s", 7)], "series_id string, breakpoint int")
    got = [r["regime"] for r in regimes.label_regimes(p, breaks).orderBy("t").collect()]
    assert got == [0] * 4 + [1] * 3 + [2] * 3


def test_gram_is_least_squares(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(1e5, 10, (200, 3))
    y = x @ [1.0, -2.0, 0.5] + 7 + rng.normal(size=200)
    rows = [("g", *map(float, r), float(v)) for r, v in zip(x, y)]
    df = spark.createDataFrame(rows, "g string, a double, b double, c double, y double").repartition(4)
    beta = gram.fit_linear(df, ["g"], ["a", "b", "c"]).first()["beta"]
    want = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0]
    assert np.allclose(beta[1:], want[1:], rtol=1e-3)
    m = 1.0 * gram.predict_linear(df, gram.fit_linear(df, ["g"], ["a", "b", "c"]), ["g"], ["a", "b", "c"]).agg(F.avg(F.abs(F.col("yhat") - F.col("y")))).first()[0]
    assert m < 2.0


def test_quantiles_of_values_that_share_a_bin(spark):
    """A million distinct values within 0.01 per cent, and a value that half of the rows have."""
    import numpy as np

    from tidewell.operators import quantiles

    n = 1_000_000
    df = spark.range(n).select(F.lit("near").alias("k"), (1.7e9 + F.pmod(F.xxhash64("id"), F.lit(170_000_000)) / 1000.0).alias("v"))
    half = spark.range(200_000).select(F.lit("half").alias("k"), F.when(F.col("id") % 2 == 0, 5.0).otherwise(5.0 + F.col("id") * 1e-9).alias("v"))
    both = df.unionByName(half)
    probs = {"a": 0.001, "b": 0.25, "c": 0.5, "d": 0.9}
    got = {(r["k"], r["label"]): r["value"] for r in quantiles.order_stats(both, "v", {k: (lambda m, p=p: F.lit(p) * (m - 1)) for k, p in probs.items()}, ["k"], most_in_bin=500).collect()}
    for k in ("near", "half"):
        v = both.where(F.col("k") == k).toPandas()["v"].to_numpy()
        for label, p in probs.items():
            assert got[(k, label)] == pytest.approx(np.quantile(v, p), rel=1e-15)


def test_shared_passes_reach_the_fits_of_mllib(spark):
    from pyspark.ml.clustering import KMeans

    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(c, 1, (100, 2)) for c in (0, 4, 9)])
    df = spark.createDataFrame([(r.tolist(),) for r in x], "a list<double>".replace("list", "array")).select(array_to_vector("a").alias("z")).cache()
    got = clustering.fit_kmeans_each(df, (2, 3), restarts=3)
    for k in (2, 3):
        fits = [KMeans(k=k, seed=42 + i, featuresCol="z", maxIter=50).fit(df) for i in range(3)]
        best = min(fits, key=lambda m: m.summary.trainingCost)
        assert got[k].cost == pytest.approx(best.summary.trainingCost, rel=1e-9)
        assert np.allclose(got[k].clusterCenters(), best.clusterCenters())
        old = [r["prediction"] for r in best.transform(df).collect()]
        assert [r["label"] for r in got[k].transform(df).collect()] == old


def test_normalising_works_out_mean_and_deviation_once(spark):
    from tidewell.functions import arrays

    df = spark.createDataFrame([([1.0, 2.0, 6.0],), ([4.0, 4.0],), (None,)], "a array<double>").select(arrays.z_norm(F.col("a")).alias("z"))
    assert df._jdf.queryExecution().analyzed().toString().count("aggregate(") <= 3
    rows = [r["z"] for r in df.collect()]
    assert rows[0] == pytest.approx([(v - 3) / np.std([1, 2, 6]) for v in (1, 2, 6)]) and rows[1:] == [[0.0, 0.0], None]


def test_spread_bounds_the_rows_of_a_partition(spark):
    from tidewell.session import spread

    one = spark.range(1000).coalesce(1).cache()
    assert spread(one, 100).rdd.getNumPartitions() == 10 and spread(one, 100).count() == 1000
    assert spread(one).rdd.getNumPartitions() == 1
    assert spread(spark.range(0, 100, 1, 300)).rdd.getNumPartitions() == 32
