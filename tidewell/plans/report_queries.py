"""Drift distance, information, scores of draws, outliers and degree days (X*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import drift, intervals, weather
from tidewell.operators import summary as sm
from tidewell.operators import windows as win
from tidewell.plans import panels as P
from tidewell.plans.registry import day, q, query, sday, sq, table
from tidewell.plans.uncertainty_queries import RAW_PARTS, is_ref
from tidewell.plans.window_queries import WSQL


AREA_SQL = (
    f"WITH {RAW_PARTS}, v AS (SELECT series_id, y, sum(ref::INT) AS a, sum((NOT ref)::INT) AS b FROM p WHERE y IS NOT NULL GROUP BY 1, 2), "
    "c AS (SELECT series_id, y, sum(a) OVER w / sum(a) OVER t - sum(b) OVER w / sum(b) OVER t AS g, sum(a) OVER t AS na, sum(b) OVER t AS nb, lead(y) OVER (PARTITION BY series_id ORDER BY y) AS nxt FROM v "
    "WINDOW w AS (PARTITION BY series_id ORDER BY y ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY series_id)) "
    f"SELECT series_id, {sq('sum(abs(g) * (nxt - y))', 5)} AS wasserstein, CAST(max(na) AS BIGINT) AS n_ref, CAST(max(nb) AS BIGINT) AS n_new FROM c GROUP BY 1"
)


@query("x6_wasserstein_drift", AREA_SQL)
def _(spark, sf):
    d = drift.wasserstein(P.raw(spark, sf), "y", is_ref(), ["series_id"])
    return d.select("series_id", q("wasserstein", 5).alias("wasserstein"), "n_ref", "n_new")


TOLD = ("lag_1", "lag_2", "lag_12", "roll_mean_6", "roll_std_6", "month")


def told_frame(spark, sf):
    cols = win.lags(ks=(1, 2, 12)) | win.roll_mean(windows=(6,)) | win.roll_std(windows=(6,)) | {"month": F.month("ts").cast("double")}
    return P.wide(spark, sf).withColumns(cols)


def _told_sql(bins: int = 16) -> str:
    w6 = "OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)"
    place = "least(floor((v - a) / (b - a) * {n}), {n} - 1)::INT".replace("{n}", str(bins))
    ends = ", ".join(f"min({c}) AS a_{i}, max({c}) AS b_{i}" for i, c in enumerate((*TOLD, "y")))
    cells = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {place.replace('v', c).replace('(b', f'(b_{i}').replace('- a)', f'- a_{i})')} AS x, {place.replace('v', 'y').replace('(b', '(b_6').replace('- a)', '- a_6)')} AS z FROM f, e WHERE {c} IS NOT NULL AND y IS NOT NULL"
        for i, c in enumerate(TOLD)
    )
    return (
        f"{P.ctes('wide')}, f AS (SELECT y, lag(y, 1) OVER w AS lag_1, lag(y, 2) OVER w AS lag_2, lag(y, 12) OVER w AS lag_12, avg(y) {w6} AS roll_mean_6, coalesce(stddev_samp(y) {w6}, 0) AS roll_std_6, month(ts)::DOUBLE AS month FROM wide {WSQL}), "
        f"e AS (SELECT {ends} FROM f), g AS ({cells}), j AS (SELECT feature, x, z, count(*)::DOUBLE AS c FROM g GROUP BY 1, 2, 3), "
        "m AS (SELECT *, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, x) AS cx, sum(c) OVER (PARTITION BY feature, z) AS cz FROM j) "
        f"SELECT feature, {sq('greatest(sum(c / n * ln(c * n / (cx * cz))), 0)', 5)} AS information, any_value(n)::BIGINT AS n FROM m GROUP BY 1"
    )


@query("x4_mutual_information", _told_sql())
def _(spark, sf):
    return sm.mutual_information(told_frame(spark, sf), TOLD).select("feature", q("information", 5).alias("information"), "n")


@query("x4_most_informative", f"SELECT feature FROM ({_told_sql()}) ORDER BY information DESC, feature LIMIT 3")
def _(spark, sf):
    best = sm.most_informative(told_frame(spark, sf), TOLD, 3)
    return told_frame(spark, sf).select(F.explode(F.array(*[F.lit(b) for b in best])).alias("feature")).distinct()


@query(
    "x5_sample_crps",
    f"{P.ctes('monthly')}, {P.draws_sql('monthly')}, o AS (SELECT series_id, ts, y, yhat, row_number() OVER (PARTITION BY series_id, ts ORDER BY yhat) AS i, count(*) OVER (PARTITION BY series_id, ts) AS n FROM dr) "
    f"SELECT series_id, {sday('ts')} AS d, {sq('avg(abs(yhat - any_y)) - sum((2 * i - n - 1) * yhat) / any_value(n) / any_value(n)', 3)} AS crps, any_value(n) AS n FROM (SELECT *, y AS any_y FROM o) GROUP BY series_id, ts",
)
def _(spark, sf):
    c = intervals.sample_crps(P.draws(P.monthly(spark, sf)), ["series_id", "ts"])
    return c.select("series_id", day("ts").alias("d"), q("crps", 3).alias("crps"), "n")


@query(
    "x1_modified_z",
    f"{P.ctes('daily')}, m AS (SELECT series_id, median(y) AS m FROM daily GROUP BY 1), d AS (SELECT series_id, median(abs(y - m)) AS mad FROM daily JOIN m USING (series_id) GROUP BY 1) "
    f"SELECT series_id, {sday('ts')} AS d, {sq('0.6745 * (y - m) / mad')} AS modified_z, coalesce(abs(0.6745 * (y - m) / mad) > 2.5, false) AS outlier FROM daily JOIN m USING (series_id) JOIN d USING (series_id)",
)
def _(spark, sf):
    z = weather.modified_z(P.daily(spark, sf), limit=2.5)
    return z.select("series_id", day("ts").alias("d"), q("modified_z").alias("modified_z"), "outlier")


GAPS = "CASE WHEN day(ts) % 4 = 0 THEN NULL ELSE y END"


@query(
    "x2_weighted_fill",
    f"{P.ctes('daily')}, g AS (SELECT series_id, ts, {GAPS} AS v FROM daily), "
    "b AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, first_value(v IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM g) "
    f"SELECT series_id, {sday('ts')} AS d, {sq('coalesce(v, 0.7 * p + (1 - 0.7) * n, p, n)')} AS y FROM b",
)
def _(spark, sf):
    df = P.daily(spark, sf).withColumn("y", F.expr(GAPS))
    return df.withColumn("y", weather.weighted_fill(alpha=0.7)).select("series_id", day("ts").alias("d"), q("y").alias("y"))


QUARTILES = "k AS (SELECT series_id, quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.75) AS b FROM daily GROUP BY 1)"


@query("x3_quartile_scaling", f"{P.ctes('daily')}, {QUARTILES} SELECT series_id, {sday('ts')} AS d, {sq('(y - a) / (b - a)')} AS scaled FROM daily JOIN k USING (series_id)")
def _(spark, sf):
    return weather.quartile_scaled(P.daily(spark, sf)).select("series_id", day("ts").alias("d"), q("scaled").alias("scaled"))


@query("x8_quartile_outliers", f"{P.ctes('daily')}, {QUARTILES} SELECT series_id, {sday('ts')} AS d, y < a - 1.0 * (b - a) OR y > b + 1.0 * (b - a) AS outlier FROM daily JOIN k USING (series_id)")
def _(spark, sf):
    return weather.quartile_outliers(P.daily(spark, sf), reach=1.0).select("series_id", day("ts").alias("d"), "outlier")


@query("x8_exact_duplicates", "SELECT DISTINCT l_partkey, l_shipdate, l_quantity FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_partkey", "l_shipdate", "l_quantity").dropDuplicates()


@query(
    "x7_degree_days",
    f"{P.ctes('daily')} SELECT series_id, {sq('sum(greatest(50 - y, 0))', 3)} AS heating, {sq('sum(greatest(y - 52, 0))', 3)} AS cooling, {sq('sum(greatest(y - 45, 0))', 3)} AS growing FROM daily WHERE y IS NOT NULL GROUP BY 1",
)
def _(spark, sf):
    d = weather.degree_days(P.daily(spark, sf), heat=50.0, cool=52.0, grow=45.0)
    return d.select("series_id", *[q(c, 3).alias(c) for c in ("heating", "cooling", "growing")])
