"""Long series: positions, parts, hot keys and order statistics against plain computations."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.operators import longseries, quantiles
from tidewell.operators import windows as win
from tidewell.panel import join_parts, number_rows, split_series


@pytest.fixture(scope="module")
def hot(spark):
    """One series holds most rows; many rows share a time stamp."""
    rng = np.random.default_rng(1)
    rows = []
    start = dt.datetime(2024, 1, 1)
    for i in range(900):
        rows.append(("hot", start + dt.timedelta(minutes=int(rng.integers(0, 3000))), i, float(np.round(rng.exponential(10), 2)) if i % 11 else None))
    for i in range(60):
        rows.append((f"s{i % 4}", start + dt.timedelta(minutes=int(rng.integers(0, 3000))), 1000 + i, float(i)))
    return spark.createDataFrame(rows, "series_id string, ts timestamp, event_id long, y double").repartition(5)


def ordered(df):
    pdf = df.toPandas().sort_values(["series_id", "ts", "event_id"]).reset_index(drop=True)
    return pdf


def test_number_rows(hot):
    got = ordered(number_rows(hot, tie=("event_id",)))
    assert (got["t"].to_numpy() == got.groupby("series_id").cumcount().to_numpy()).all()
    assert (got["n"].to_numpy() == got.groupby("series_id")["t"].transform("size").to_numpy()).all()


def test_split_keeps_every_row_once(hot):
    rows = number_rows(hot, tie=("event_id",))
    back = join_parts(split_series(rows, 50, before=20, after=10))
    assert sorted(r["event_id"] for r in back.select("event_id").collect()) == sorted(r["event_id"] for r in hot.select("event_id").collect())


def test_split_refuses_too_wide_windows(hot):
    with pytest.raises(ValueError):
        split_series(number_rows(hot, tie=("event_id",)), 10, before=11)


def test_windows_cross_part_borders(hot):
    by, order = ("series_id", "part_id"), ("t",)
    cols = win.lags(ks=(1, 36), by=by, order=order) | win.roll_mean(windows=(12,), by=by, order=order)
    got = ordered(longseries.windowed(hot, cols, reach=36, tie=("event_id",), part_rows=50))
    g = got.groupby("series_id")["y"]
    for k in (1, 36):
        assert np.allclose(got[f"lag_{k}"], g.shift(k), equal_nan=True)
    want = g.transform(lambda s: s.shift(1).rolling(12, min_periods=1).mean())
    assert np.allclose(got["roll_mean_12"], want, equal_nan=True)


def test_expanding_crosses_part_borders(hot):
    filled = hot.na.fill(3.5, ["y"])
    got = ordered(longseries.expanding(filled, tie=("event_id",)))
    g = got.groupby("series_id")["y"]
    assert np.allclose(got["cum_mean_past"], g.transform(lambda s: s.shift(1).expanding().mean()), equal_nan=True)
    assert np.allclose(got["cum_std_past"], g.transform(lambda s: s.shift(1).expanding().std()).fillna(0))
    assert np.allclose(got["cum_abs"], g.transform(lambda s: s.abs().cumsum()))


@pytest.mark.parametrize("slot", ["hour", "day"])
def test_fill_crosses_part_borders(hot, slot):
    holed = hot.withColumn("y", F.when(F.col("event_id") % 3 == 0, F.col("y")))
    got = ordered(longseries.fill_gaps(holed, tie=("event_id",), slot=slot))
    want = got.groupby("series_id")["y"].transform(lambda s: s.ffill().bfill())
    assert np.allclose(got["filled"], want, equal_nan=True)


def test_exponential_mean_on_parts(hot):
    filled = hot.na.fill(3.5, ["y"])
    depth = win.ewm_depth(12)
    got = ordered(longseries.windowed(filled, win.ewm(by=("series_id", "part_id"), order=("t",)), reach=depth, tie=("event_id",), part_rows=depth))
    want = got.groupby("series_id")["y"].transform(lambda s: s.shift(1).ewm(span=12, adjust=False).mean())
    assert np.allclose(got["ewm_12"], want, equal_nan=True, rtol=1e-12)


def test_quantiles_both_ways(spark):
    rng = np.random.default_rng(2)
    data = {
        "hot": np.round(rng.normal(0, 1, 3000), 1),  # many ties, both signs, zeros
        "wide": rng.normal(0, 1, 200) * 10.0 ** rng.integers(-8, 9, 200),
        "one": np.array([7.25]),
        "flat": np.full(50, -3.0),
    }
    rows = [(k, float(x)) for k, v in data.items() for x in v] + [("hot", None), ("hot", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.9, "e": 1.0}
    got = quantiles.quantile_columns(df, "v", probs, ["g"]).toPandas().set_index("g")
    for k, v in data.items():
        for name, p in probs.items():
            assert got.loc[k, name] == pytest.approx(np.quantile(v, p), rel=1e-12, abs=1e-15), (k, name)
    whole = quantiles.quantiles(df, "v", {"m": 0.37}).collect()
    everything = np.concatenate(list(data.values()))
    assert whole[0]["value"] == pytest.approx(np.quantile(everything, 0.37), rel=1e-12)


def test_order_statistic_rank(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 20)], "v double")
    ranks = {"k": lambda n: F.least(F.ceil((n + 1) * 0.9), n) - 1}
    assert quantiles.order_stats(df, "v", ranks, ()).first()["value"] == 18.0


def test_cumulative_counts(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(0, 5, 500), 0)
    df = spark.createDataFrame([(float(x), int(i % 2)) for i, x in enumerate(v)], "v double, k int").repartition(3)
    got = quantiles.cumulative_counts(df, "v", {"a": F.col("k"), "n": F.lit(1)}).orderBy("v").toPandas()
    pdf = pd.DataFrame({"v": v, "k": np.arange(500) % 2})
    want = pdf.groupby("v")["k"].agg(["sum", "size"]).cumsum()
    assert (got["a_cum"].to_numpy() == want["sum"].to_numpy()).all()
    assert (got["n_cum"].to_numpy() == want["size"].to_numpy()).all()


def test_value_bin_grows_with_value(spark):
    v = sorted([0.0, -0.0, 1e-300, -1e-300, 1.0, 1.0001, -5.0, 1e300, -1e300, 3.3, 3.3000001])
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v double")
    bins = [r["b"] for r in df.orderBy("i").select(quantiles.value_bin(F.col("v")).alias("b")).collect()]
    assert bins == sorted(bins)


def test_long_change_points_equal_the_search_per_series(spark):
    import numpy as np

    from tidewell.operators import regimes

    rng = np.random.default_rng(12)
    rows, want = [], set()
    for name, n, level in (("a", 30000, 100.0), ("b", 700, 0.0), ("c", 1, 5.0), ("d", 9, -3.0)):
        steps = np.repeat(rng.normal(0, 2, n // 500 + 1), 500)[:n]
        v = level + steps + rng.normal(size=n)
        rows += [(name, i, float(x)) for i, x in enumerate(v)]
        want |= {(name, c) for c in regimes._pelt(v, 25.0, 2, 5)}
    df = spark.createDataFrame(rows, "series_id string, i long, y double").selectExpr("series_id", "i", "y", "timestamp_seconds(i * 60) AS ts").repartition(7)
    got = {tuple(r) for r in regimes.long_change_points(df, 25.0, tie=("i",)).collect()}
    assert got == want and len(want) > 20
    assert regimes.long_change_points(df.limit(0), 25.0).count() == 0
