"""Drift state over several micro-batches equals one batch over all; a replayed batch changes nothing."""

import datetime as dt
import glob
import os

import numpy as np
import pytest

from tidewell.session import scratch_path
from tidewell.streaming import monitor, state


@pytest.fixture(scope="module")
def parts(spark):
    rng = np.random.default_rng(9)
    day = dt.datetime(2024, 1, 1)
    rows = [(k, day + dt.timedelta(hours=i), float(v), r) for k, shift in (("a", 0.0), ("b", 1.5)) for r in (True, False) for i, v in enumerate(rng.normal(0 if r else shift, 2, 400))]
    rows += [("c", day, 1.0, False), ("a", day, None, False), ("b", day, float("nan"), True)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, y double, ref boolean")
    folder = scratch_path(spark, "events")
    df.where("NOT ref").select("series_id", "ts", "y").repartition(5).write.parquet(folder)
    return df, folder


def test_several_batches_equal_one(spark, parts):
    df, folder = parts
    out, progress = scratch_path(spark, "state"), scratch_path(spark, "progress")
    stream = monitor.read_events(spark, f"{folder}/*.parquet", files_per_batch=1)
    start = lambda: state.running_drift(stream, df.where("ref"), out, progress, 0.25, delay="40 days")
    monitor.run_to_end(start)
    history = spark.read.parquet(out)
    assert history.select("batch").distinct().count() == 5
    want = {r["series_id"]: tuple(r) for r in state.binned_drift(df.where("ref"), df.where("NOT ref"), 0.25).collect()}
    got = {r["series_id"]: tuple(r) for r in state.latest(history).collect()}
    assert set(got) == set(want) == {"a", "b"}
    for k in want:
        assert got[k][1:3] == want[k][1:3] == (400, 400)
        assert got[k][3:] == pytest.approx(want[k][3:], abs=1e-12)
    # a restart without new files does nothing, one with the last commit missing replays that batch
    before = sorted(map(tuple, history.collect()))
    monitor.run_to_end(start)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == before
    last = max(glob.glob(f"{progress}/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    os.remove(last)
    for crc in glob.glob(f"{progress}/commits/.{os.path.basename(last)}.crc"):
        os.remove(crc)
    monitor.run_to_end(start)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == before


def test_binned_drift_is_the_distance_of_binned_values(spark, parts):
    df, _ = parts
    rows = df.where("y IS NOT NULL AND NOT isnan(y)").collect()
    got = {r["series_id"]: r for r in state.binned_drift(df.where("ref"), df.where("NOT ref"), 0.5).collect()}
    for k in ("a", "b"):
        a, b = (np.sort([np.floor(r["y"] / 0.5) for r in rows if r["series_id"] == k and r["ref"] == side]) for side in (True, False))
        x = np.unique(np.concatenate([a, b]))
        gap = np.array([abs((a <= v).mean() - (b <= v).mean()) for v in x])
        assert got[k]["ks"] == pytest.approx(gap.max()) and got[k]["area"] == pytest.approx((gap[:-1] * np.diff(x)).sum() * 0.5)


def test_a_silent_series_is_forgotten(spark):
    day = dt.datetime(2024, 1, 1)
    reference = spark.createDataFrame([(k, day, float(i)) for k in "ab" for i in range(10)], "series_id string, ts timestamp, y double")
    folder, out = scratch_path(spark, "events"), scratch_path(spark, "state")
    # a is silent for 50 days, b is not
    for i, rows in enumerate([[("a", 0, 1.0), ("b", 0, 1.0)], [("b", 50, 2.0)], [("b", 51, 2.0)], [("a", 52, 3.0)]]):
        spark.createDataFrame([(k, day + dt.timedelta(days=d), v) for k, d, v in rows], "series_id string, ts timestamp, y double").coalesce(1).write.parquet(f"{folder}/{i}")
        progress = f"{out}-progress"
        stream = spark.readStream.schema("series_id string, ts timestamp, y double").option("recursiveFileLookup", "true").parquet(folder)
        monitor.run_to_end(lambda: state.running_drift(stream, reference, out, progress, 1.0, keep="20 days"))  # noqa: B023
    got = {r["series_id"]: r["n_new"] for r in state.latest(spark.read.parquet(out)).collect()}
    # a starts again; b, which came 50 days after its first event and before the watermark moved, goes on
    assert got == {"a": 1, "b": 3}
