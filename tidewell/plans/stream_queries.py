"""Streaming monitoring over the events table, and the drift history."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import drift
from tidewell.plans import panels as P
from tidewell.plans.registry import day, q, query, sday, sq, table
from tidewell.plans.uncertainty_queries import KS_SQL, RAW_PARTS, is_ref
from tidewell.session import scratch_path
from tidewell.streaming import monitor as stream
from tidewell.streaming import state

CLOSED = "d AS (SELECT event_type AS series_id, date_trunc('day', ts) AS dd, value FROM events), e AS (SELECT max(ts) - INTERVAL 1 DAY AS edge FROM events)"
DAILY_SQL = f"WITH {CLOSED}, m AS (SELECT series_id, dd, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, max(value) AS max FROM d, e WHERE dd + INTERVAL 1 DAY <= edge GROUP BY 1, 2)"


def closed_days(spark, sf):
    path = scratch_path(spark, "daily")
    events = stream.read_events(spark, f"{sf}/events.parquet")
    stream.run_to_end(lambda: stream.write_closed(stream.daily_metrics(events), path, scratch_path(spark, "daily-progress")))
    return spark.read.parquet(path)


@query("stream_daily_metrics", f"{DAILY_SQL} SELECT series_id, {sday('dd')} AS d, n, {sq('mean')} AS mean, {sq('std')} AS std, max FROM m")
def _(spark, sf):
    return closed_days(spark, sf).select("series_id", day("day").alias("d"), "n", q("mean").alias("mean"), q("std").alias("std"), "max")


@query("stream_alerts", f"{DAILY_SQL} SELECT series_id, {sday('dd')} AS d, 'mean' AS metric, {sq('mean')} AS value FROM m WHERE mean > 60")
def _(spark, sf):
    a = stream.alert_rows(closed_days(spark, sf), {"mean": 60.0})
    return a.select("series_id", day("day").alias("d"), "metric", q("value").alias("value"))


@query("stream_drift", f"{KS_SQL} SELECT series_id, {sq('ks')} AS ks, n_ref, n_new FROM ks")
def _(spark, sf):
    path = scratch_path(spark, "drift")
    events = stream.read_events(spark, f"{sf}/events.parquet").select(F.col("event_type").alias("series_id"), "ts", F.col("value").alias("y"))
    reference = P.raw(spark, sf).where(is_ref())
    stream.run_to_end(lambda: stream.drift_batches(events.where(~is_ref()), reference, path, scratch_path(spark, "drift-progress")))
    return spark.read.parquet(path).select("series_id", q("ks").alias("ks"), "n_ref", "n_new")


STATE_SQL = (
    f"WITH {RAW_PARTS}, v AS (SELECT series_id, floor(y / 0.5) AS bin, sum(ref::INT) AS a, sum((NOT ref)::INT) AS b FROM p WHERE y IS NOT NULL GROUP BY 1, 2), "
    "c AS (SELECT series_id, bin, abs(sum(a) OVER w / sum(a) OVER t - sum(b) OVER w / sum(b) OVER t) AS g, sum(a) OVER t AS na, sum(b) OVER t AS nb, lead(bin) OVER (PARTITION BY series_id ORDER BY bin) AS nxt FROM v "
    "WINDOW w AS (PARTITION BY series_id ORDER BY bin ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY series_id)) "
    f"SELECT series_id, max(na)::BIGINT AS n_ref, max(nb)::BIGINT AS n_new, {sq('max(g)')} AS ks, {sq('sum(g * (nxt - bin) * 0.5)', 5)} AS area FROM c GROUP BY 1"
)


@query("stream_drift_state", STATE_SQL)
def _(spark, sf):
    """Events in several files, one file a batch; the counts are kept between batches."""
    raw = P.raw(spark, sf).select("series_id", "ts", "y")
    folder, path = scratch_path(spark, "events"), scratch_path(spark, "state")
    raw.where(~is_ref()).repartition(4, "ts").write.parquet(folder)
    events = stream.read_events(spark, f"{folder}/*.parquet", files_per_batch=1)
    stream.run_to_end(lambda: state.running_drift(events, raw.where(is_ref()), path, scratch_path(spark, "state-progress"), 0.5, "400 days", "400 days"))
    last = state.latest(spark.read.parquet(path))
    return last.select("series_id", "n_ref", "n_new", q("ks").alias("ks"), q("area", 5).alias("area"))


@query("drf5_drift_history", f"{KS_SQL} SELECT run, series_id, {sq('ks')} AS ks FROM ks, (VALUES ('a'), ('b')) r(run)")
def _(spark, sf):
    path = scratch_path(spark, "drift-history")
    for run in ("a", "b"):
        drift.append_history(drift.ks_statistic(P.raw(spark, sf), "y", is_ref(), ["series_id"]), path, run)
    return spark.read.parquet(path).select("run", "series_id", q("ks").alias("ks"))
