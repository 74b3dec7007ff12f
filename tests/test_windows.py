"""Window features against pandas, and their edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import features as feat
from tidewell.operators import windows as win
from tidewell.panel import with_position


@pytest.fixture(scope="module")
def panel(make_panel):
    rng = np.random.default_rng(5)
    return make_panel({"a": rng.normal(20, 3, 70), "b": rng.normal(0, 1, 41), "const": [4.0] * 30, "short": [1.0, 2.0]})


def frame(df):
    return df.toPandas().sort_values(["series_id", "ts"]).reset_index(drop=True)


def by_series(pdf, fn):
    return pdf.groupby("series_id")["y"].transform(fn)


def test_rolls_and_moments(panel):
    cols = win.roll_mean() | win.roll_std() | win.roll_extremes() | win.roll_moments() | win.z_score() | win.diffs()
    got = frame(panel.withColumns(cols))
    for w in (3, 6, 12):
        roll = lambda s, w=w: s.shift(1).rolling(w, min_periods=1)
        assert np.allclose(got[f"roll_mean_{w}"], by_series(got, lambda s: roll(s).mean()), equal_nan=True)
        assert np.allclose(got[f"roll_std_{w}"], by_series(got, lambda s: roll(s).std().fillna(0)), atol=1e-9)
        assert np.allclose(got[f"roll_min_{w}"], by_series(got, lambda s: roll(s).min()), equal_nan=True)
    real = got[got["series_id"].isin(["a", "b"])]
    for w in (6, 12):
        assert np.allclose(real[f"roll_skew_{w}"], by_series(real, lambda s: s.shift(1).rolling(w, min_periods=1).skew().fillna(0)), atol=1e-6)
        assert np.allclose(real[f"roll_kurt_{w}"], by_series(real, lambda s: s.shift(1).rolling(w, min_periods=1).kurt().fillna(0)), atol=1e-6)
    flat = got[got["series_id"] == "const"]
    assert (flat["roll_zscore_3"] == 0).all() and (flat["roll_skew_6"] == 0).all()


def test_quantile_with_back_fill(panel):
    names = win.current_quantile()
    got = frame(win.back_filled(win.add(panel, names), list(names)))
    for w in (3, 12):
        assert np.allclose(got[f"roll_q90_{w}"], by_series(got, lambda s: s.rolling(w, min_periods=1).quantile(0.9).bfill()))


def test_trend_and_autocorrelation(panel):
    got = frame(win.with_autocorrelation(win.with_trend(with_position(panel))))

    def slope(s, w):
        z = s.shift(1).ffill().fillna(0).to_numpy()
        out = [0.0]
        for i in range(1, len(z)):
            a = max(0, i - w + 1)
            out.append(np.polyfit(np.arange(a, i + 1), z[a : i + 1], 1)[0])
        return np.array(out[: len(z)])

    for w in (12, 24):
        assert np.allclose(got[f"roll_trend_{w}"], by_series(got, lambda s: slope(s, w)), atol=1e-8)
    real = got[got["series_id"].isin(["a", "b"])]
    for k in (1, 12, 24):
        want = by_series(real, lambda s: s.shift(1).rolling(36, min_periods=1).apply(lambda x: x.autocorr(k) if len(x) > k else 0.0, raw=False).fillna(0))
        assert np.allclose(real[f"autocorr_lag_{k}"], want, atol=1e-7)


def test_exponential_mean(panel):
    got = frame(win.add(panel, win.ewm()))
    assert np.allclose(got["ewm_12"], by_series(got, lambda s: s.shift(1).ewm(span=12, adjust=False).mean()), equal_nan=True)


def test_smoothing_keeps_a_quadratic(make_panel):
    q = [0.5 * i * i - 3 * i + 2 for i in range(12)]
    got = frame(win.smooth5(make_panel({"q": q, "tiny": [1.0, 5.0, 2.0]})))
    assert np.allclose(got[got.series_id == "q"]["smooth"], q)
    assert np.allclose(got[got.series_id == "tiny"]["smooth"], [1.0, 5.0, 2.0])


def test_existing_columns_survive(panel):
    got = frame(feat.builder_features(panel.withColumn("lag_1", F.lit(-1.0))))
    assert (got["lag_1"] == -1.0).all()


def test_warmup_only_where_long_enough(panel):
    got = frame(feat.drop_warmup(with_position(panel), 13))
    sizes = got.groupby("series_id").size().to_dict()
    assert sizes == {"a": 57, "b": 28, "const": 17, "short": 2}


def test_bundles_repeat_and_have_no_gaps(panel):
    a = frame(feat.extended_features(panel))
    b = frame(feat.extended_features(panel))
    assert a.shape == b.shape and a.shape[1] > 55
    long = a[a["series_id"] == "a"]
    assert not long.isna().any().any()


def test_leaky_columns_are_named(panel):
    names = feat.leak_free(feat.extended_features(panel).columns)
    assert "roll_mean_12" in names and not any(c.startswith(("diff_", "roll_zscore", "zscore")) for c in names)


def test_one_sort_for_many_features(panel, spark):
    plan = feat.lag_matrix(panel)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_exponential_mean_over_gaps(make_panel):
    import pandas as pd

    values = [1.0, None, 3.0, 4.0, None, None, 2.0, 5.0]
    got = make_panel({"a": values, "b": [None, 2.0, None, 1.0, 1.0, 7.0, None, 3.0]}).withColumns(win.ewm()).orderBy("series_id", "ts").toPandas()
    for name in ("a", "b"):
        part = got[got.series_id == name]
        want = part.y.ewm(span=12, adjust=False).mean().shift(1)
        pd.testing.assert_series_equal(part.ewm_12, want, check_names=False)
