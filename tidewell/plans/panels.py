"""Panels over the given tables, and the same panels as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.panel import to_panel
from tidewell.plans.registry import table

#: Decimals of the given tables' amounts.
MONEY = 2


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return to_panel(o, F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"), "month", MONEY)


def monthly_total(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return to_panel(o, F.lit("all"), F.col("o_orderdate"), F.col("o_totalprice"), "month", MONEY)


def daily(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return to_panel(e, F.col("event_type"), F.col("ts"), F.col("value"), "day", MONEY)


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return to_panel(e, F.col("event_type"), F.col("ts"), F.col("value"), "hour", MONEY)


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """Many short series: one per part."""
    li = table(spark, sf, "lineitem")
    return to_panel(li, F.col("l_partkey"), F.col("l_shipdate"), F.col("l_extendedprice"), "month", MONEY)


def raw(spark: SparkSession, sf: str) -> DataFrame:
    """Long series: every event, one series per event type."""
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("series_id"), "ts", "event_id", F.col("value").alias("y"))


def forecasts(panel: DataFrame) -> DataFrame:
    """Two cheap forecasters in long form: (series_id, ts, t, y, model, yhat)."""
    from tidewell.operators import windows as win
    from tidewell.panel import with_position

    cols = {"persistence": win.lags(ks=(1,))["lag_1"], "rolling": win.roll_mean(windows=(12,))["roll_mean_12"]}
    return with_position(panel).withColumns(cols).unpivot(["series_id", "ts", "t", "y"], list(cols), "model", "yhat").where("yhat IS NOT NULL")


def forecasts_sql(panel: str) -> str:
    w = "PARTITION BY series_id ORDER BY ts"
    return (
        f"fc AS (SELECT series_id, ts, row_number() OVER ({w}) - 1 AS t, y, lag(y) OVER ({w}) AS persistence, "
        f"avg(y) OVER ({w} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS rolling FROM {panel}), "
        "ml AS MATERIALIZED (SELECT series_id, ts, t, y, 'persistence' AS model, persistence AS yhat FROM fc WHERE t > 0 "
        "UNION ALL SELECT series_id, ts, t, y, 'rolling', rolling FROM fc WHERE t > 0)"
    )


def draws(panel: DataFrame, n: int = 60) -> DataFrame:
    """A sample table: evenly scattered draws around the rolling mean of every point."""
    from tidewell.operators import windows as win

    cols = {"m": win.roll_mean(windows=(12,))["roll_mean_12"], "s": win.roll_std(windows=(12,))["roll_std_12"]}
    base = panel.withColumns(cols).where("m IS NOT NULL").withColumn("sample_id", F.explode(F.sequence(F.lit(1), F.lit(n))))
    u = (F.col("sample_id") * 37) % 61 / 61.0
    return base.select(
        "series_id", "ts", "y", "sample_id", (F.col("sample_id") % 10).alias("grp"), (F.col("m") + F.col("s") * (u - 0.5) * 3.4).alias("yhat")
    )


def draws_sql(panel: str, n: int = 60) -> str:
    f = "OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"
    return (
        f"rl AS (SELECT series_id, ts, y, avg(y) {f} AS m, coalesce(stddev_samp(y) {f}, 0) AS s FROM {panel}), "
        "dr AS (SELECT series_id, ts, y, CAST(k AS BIGINT) AS sample_id, CAST(k % 10 AS BIGINT) AS grp, m + s * ((k * 37) % 61 / 61.0 - 0.5) * 3.4 AS yhat "
        f"FROM rl, range(1, {n + 1}) x(k) WHERE m IS NOT NULL)"
    )


def _sql_panel(name, key, ts, value, grain, src):
    return (
        f"{name} AS (SELECT {key} AS series_id, date_trunc('{grain}', {ts}) AS ts, "
        f"CAST(SUM(CAST({value} AS DECIMAL(18,2))) AS DOUBLE) / COUNT({value}) AS y FROM {src} GROUP BY 1, 2)"
    )


SQL = {
    "monthly": _sql_panel("monthly", "o_orderpriority", "o_orderdate", "o_totalprice", "month", "orders"),
    "monthly_total": _sql_panel("monthly_total", "'all'", "o_orderdate", "o_totalprice", "month", "orders"),
    "daily": _sql_panel("daily", "event_type", "ts", "value", "day", "events"),
    "hourly": _sql_panel("hourly", "event_type", "ts", "value", "hour", "events"),
    "wide": _sql_panel("wide", "CAST(l_partkey AS VARCHAR)", "l_shipdate", "l_extendedprice", "month", "lineitem"),
    "raw": "raw AS (SELECT event_type AS series_id, ts, event_id, value AS y FROM events)",
}


def ctes(*names: str) -> str:
    """``WITH`` clause with the named panels; callers append their own CTEs."""
    return "WITH " + ", ".join(SQL[n] for n in names)
