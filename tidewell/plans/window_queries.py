"""Calendar and window queries (CAL*, WIN*) and the feature bundles."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import calendar as cal
from tidewell.functions import distribution as dist
from tidewell.operators import features as feat
from tidewell.operators import longseries
from tidewell.operators import spectral
from tidewell.operators import windows as win
from tidewell.panel import with_position
from tidewell.plans import panels as P
from tidewell.plans.registry import day, q, query, sday, sq

TAU = "2 * pi()"
WSQL = "WINDOW w AS (PARTITION BY series_id ORDER BY ts)"


def frame(a: str, b: str) -> str:
    return f"OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {a} AND {b})"


def past(w: int) -> str:
    return frame(f"{w} PRECEDING", "1 PRECEDING")


def cur(w: int) -> str:
    return frame(f"{w - 1} PRECEDING", "CURRENT ROW")


def out(df, cols, digits=4, ints=()):
    """series, day and the named columns, rounded."""
    return df.select("series_id", day("ts").alias("d"), *[q(c, digits).alias(c) for c in cols], *[F.col(c).cast("bigint").alias(c) for c in ints])


def sql_out(panel: str, exprs: dict[str, str], digits=4, ints: dict[str, str] | None = None, where: str = "", extra: str = "") -> str:
    cols = [f"{sq(e, digits)} AS {n}" for n, e in exprs.items()] + [f"CAST({e} AS BIGINT) AS {n}" for n, e in (ints or {}).items()]
    src = extra or panel
    return f"{P.ctes(panel)} SELECT series_id, {sday('ts')} AS d, {', '.join(cols)} FROM {src} {where}"


# --- calendar -----------------------------------------------------------

CAL1 = ("year", "month", "day", "hour", "weekday", "dayofyear")


@query(
    "cal1_calendar_parts",
    "SELECT event_id, year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, "
    "(dayofweek(ts) + 6) % 7 AS weekday, dayofyear(ts) AS dayofyear FROM events",
)
def _(spark, sf):
    e = P.table(spark, sf, "events")
    return e.select("event_id", *[c.cast("bigint").alias(n) for n, c in cal.calendar_parts(F.col("ts")).items()])


@query(
    "cal2_quarter_season",
    "SELECT o_orderkey, (month(o_orderdate) - 1) // 3 + 1 AS quarter, (month(o_orderdate) % 12 + 3) // 3 AS season FROM orders",
)
def _(spark, sf):
    m = F.month("o_orderdate")
    return P.table(spark, sf, "orders").select("o_orderkey", cal.quarter_of(m).alias("quarter"), cal.season_of(m).alias("season"))


@query(
    "cal3_date_primitives",
    "SELECT event_id, value, CAST((dayofweek(ts) + 6) % 7 >= 5 AS BIGINT) AS is_weekend, month(ts) AS month, "
    "(dayofweek(ts) + 6) % 7 AS weekday FROM events",
)
def _(spark, sf):
    e = P.table(spark, sf, "events")
    return e.select(
        "event_id", "value", cal.is_weekend(F.col("ts")).cast("bigint").alias("is_weekend"),
        F.month("ts").cast("bigint").alias("month"), F.weekday("ts").cast("bigint").alias("weekday"),
    )


@query(
    "cal4_month_dummies",
    "SELECT o_orderkey, " + ", ".join(f"CAST(month(o_orderdate) = {k} AS BIGINT) AS m_{k}" for k in range(1, 13)) + " FROM orders",
)
def _(spark, sf):
    d = cal.month_dummies(F.month("o_orderdate"))
    return P.table(spark, sf, "orders").select("o_orderkey", *[c.cast("bigint").alias(n) for n, c in d.items()])


def _cycle_sql(phase: int) -> str:
    ang = f"{TAU} * (month(o_orderdate) - {phase}) / 12.0"
    return f"SELECT o_orderkey, {sq(f'sin({ang})')} AS month_sin, {sq(f'cos({ang})')} AS month_cos FROM orders"


def _cycle(spark, sf, phase):
    s, c = cal.cycle(F.month("o_orderdate"), phase=phase)
    return P.table(spark, sf, "orders").select("o_orderkey", q(s).alias("month_sin"), q(c).alias("month_cos"))


@query("cal5_month_cycle", _cycle_sql(0))
def _(spark, sf):
    return _cycle(spark, sf, 0)


@query("cal6_month_cycle_from_zero", _cycle_sql(1))
def _(spark, sf):
    return _cycle(spark, sf, 1)


FOURIER = {f"fourier_{f}_{k}": f"{f}({TAU} * {k} * t / 12.0)" for k in (1, 2, 3) for f in ("sin", "cos")}


@query(
    "cal7_fourier_terms",
    f"{P.ctes('monthly')} SELECT series_id, {sday('ts')} AS d, t, "
    + ", ".join(f"{sq(e)} AS {n}" for n, e in FOURIER.items())
    + " FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS t FROM monthly)",
)
def _(spark, sf):
    df = with_position(P.monthly(spark, sf)).withColumns(cal.fourier_terms(F.col("t")))
    return df.select("series_id", day("ts").alias("d"), F.col("t").cast("bigint").alias("t"), *[q(c).alias(c) for c in FOURIER])


SPECTRUM_SQL = """pos AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS t,
  count(*) OVER (PARTITION BY series_id) AS n, y - avg(y) OVER (PARTITION BY series_id) AS c FROM monthly),
freq AS (SELECT series_id, k, any_value(n) AS n, sum(c * cos(2 * pi() * k * t / n)) AS re, -sum(c * sin(2 * pi() * k * t / n)) AS im
  FROM pos, range(1, 5000) r(k) WHERE k <= n // 2 GROUP BY series_id, k),
top AS (SELECT *, 2 * pi() * k / n AS omega, sqrt(re * re + im * im) AS amp,
  row_number() OVER (PARTITION BY series_id ORDER BY round(sqrt(re * re + im * im), 4) DESC, k) AS rank FROM freq)"""


@query(
    "cal8_harmonic_features",
    f"{P.ctes('monthly')}, {SPECTRUM_SQL}, w AS (SELECT series_id, "
    + ", ".join(f"max(CASE WHEN rank = {j} THEN omega END) AS w{j}" for j in (1, 2, 3))
    + f" FROM top GROUP BY series_id) SELECT series_id, {sday('ts')} AS d, "
    + ", ".join(f"{sq(f'{f}(w{j} * t)')} AS harm_{f}_{j}" for j in (1, 2, 3) for f in ("sin", "cos"))
    + " FROM pos JOIN w USING (series_id)",
)
def _(spark, sf):
    df = P.monthly(spark, sf)
    freqs = spectral.top_frequencies(df, k=3)
    wide = feat.harmonic_features(with_position(df), freqs, 3)
    return out(wide, [f"harm_{f}_{j}" for j in (1, 2, 3) for f in ("sin", "cos")], 6)


INTER = {
    **{f"y_lag_{k}_x_month_{f}": f"lag(y, {k}) OVER w * {f}({TAU} * (month(ts) - 1) / 12.0)" for k in (1, 12) for f in ("sin", "cos")},
    **{f"roll_mean_{w}_x_year": f"avg(y) {past(w)} * year(ts)" for w in (3, 12)},
}


@query("cal9_interactions", sql_out("monthly", INTER, 3, where=WSQL))
def _(spark, sf):
    df = feat.extended_features(P.monthly(spark, sf), drop_initial=False)
    return out(df, list(INTER), 3)


@query(
    "cal10_row_mean_std",
    f"SELECT l_orderkey, l_linenumber, {sq('(l_quantity + l_extendedprice + l_discount + l_tax) / 4')} AS row_mean, "
    f"{sq('list_aggregate([l_quantity, l_extendedprice, l_discount, l_tax], ' + chr(39) + 'stddev_samp' + chr(39) + ')')} AS row_std FROM lineitem",
)
def _(spark, sf):
    li = P.table(spark, sf, "lineitem")
    df = feat.row_mean_std(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return df.select("l_orderkey", "l_linenumber", q("row_mean").alias("row_mean"), q("row_std").alias("row_std"))


@query(
    "cal11_density_cumulative_abs",
    f"{P.ctes('monthly')}, r AS (SELECT *, y - lag(y) OVER w AS residual FROM monthly {WSQL}), "
    "s AS (SELECT *, avg(residual) OVER (PARTITION BY series_id) AS m, stddev_pop(residual) OVER (PARTITION BY series_id) AS sd FROM r WHERE residual IS NOT NULL) "
    f"SELECT series_id, {sday('ts')} AS d, {sq('exp(-0.5 * ((residual - m) / sd) * ((residual - m) / sd)) / (sd * sqrt(2 * pi()))', 12)} AS density, "
    f"{sq('sum(abs(residual)) ' + frame('UNBOUNDED PRECEDING', 'CURRENT ROW'), 3)} AS cum_abs FROM s",
)
def _(spark, sf):
    df = P.monthly(spark, sf).withColumns({"residual": win.diffs(ks=(1,))["diff_1"]}).where("residual IS NOT NULL")
    s = Window.partitionBy("series_id")
    m, sd = F.avg("residual").over(s), F.stddev_pop("residual").over(s)
    df = df.withColumns({"density": dist.normal_pdf((F.col("residual") - m) / sd) / sd, "cum_abs": feat.cumulative_abs()})
    return df.select("series_id", day("ts").alias("d"), q("density", 12).alias("density"), q("cum_abs", 3).alias("cum_abs"))


# --- windows over the wide panel: many short series -----------------------


def simple(name, panel_name, columns, sql_exprs, digits=4, ints=(), sql_ints=None, where=""):
    """A query that adds window columns to a panel and shows them."""
    source = getattr(P, panel_name)

    @query(name, sql_out(panel_name, sql_exprs, digits, sql_ints, where))
    def _(spark, sf):
        return out(win.add(source(spark, sf), columns()), list(sql_exprs), digits, ints)


simple("win1_lags", "wide", lambda: win.lags(ks=win.LAGS_LONG), {f"lag_{k}": f"lag(y, {k}) OVER w" for k in win.LAGS_LONG}, where=WSQL)
simple(
    "win1_lags_hourly", "hourly", lambda: win.lags(ks=win.LAGS_HOURLY), {f"lag_{k}": f"lag(y, {k}) OVER w" for k in win.LAGS_HOURLY}, where=WSQL
)
simple("win2_diffs", "wide", lambda: win.diffs(), {f"diff_{k}": f"y - lag(y, {k}) OVER w" for k in (1, 12)}, where=WSQL)
simple("win3_rolling_mean", "wide", lambda: win.roll_mean(), {f"roll_mean_{w}": f"avg(y) {past(w)}" for w in win.ROLLS})
simple("win4_rolling_std", "wide", lambda: win.roll_std(), {f"roll_std_{w}": f"coalesce(stddev_samp(y) {past(w)}, 0)" for w in win.ROLLS}, 3)
simple(
    "win5_rolling_min_max", "wide", lambda: win.roll_extremes(),
    {f"roll_{f}_{w}": f"{f}(y) {past(w)}" for w in win.ROLLS for f in ("min", "max")},
)
simple(
    "win6_current_rolling", "wide", lambda: win.current_roll(),
    {f"cur_mean_{w}": f"avg(y) {cur(w)}" for w in (3, 12)} | {f"cur_std_{w}": f"coalesce(stddev_samp(y) {cur(w)}, 0)" for w in (3, 12)}, 3,
)


@query("win7_rolling_quantile", sql_out("wide", {f"roll_q90_{w}": f"quantile_cont(y, 0.9) {cur(w)}" for w in (3, 12)}))
def _(spark, sf):
    names = win.current_quantile()
    return out(win.back_filled(win.add(P.wide(spark, sf), names), list(names)), list(names))


simple(
    "win8_full_window", "wide", lambda: win.full_window(),
    {f"full_{n}_10": f"CASE WHEN count(y) {cur(10)} >= 10 THEN {f}(y) {cur(10)} ELSE 0 END" for n, f in (("mean", "avg"), ("std", "stddev_samp"))}, 3,
)
Z = {w: f"coalesce((y - avg(y) {past(w)}) / nullif(stddev_samp(y) {past(w)}, 0), 0)" for w in win.ROLLS}
simple("win9_rolling_zscore", "monthly", lambda: win.z_score(), {f"roll_zscore_{w}": e for w, e in Z.items()}, 6)


@query("win10_extreme_flag", sql_out("wide", {"z": Z[12]}, 3, {"is_extreme": f"abs({Z[12]}) > 2"}))
def _(spark, sf):
    df = win.add(P.wide(spark, sf), {"z": win.z_score(windows=(12,))["roll_zscore_12"]})
    return out(df.withColumn("is_extreme", win.extreme_flag(F.col("z"))), ["z"], 3, ["is_extreme"])


def _moment(fn, w, least):
    return f"CASE WHEN count(y) {past(w)} >= {least} THEN coalesce({fn}(y) {past(w)}, 0) ELSE 0 END"


simple(
    "win11_rolling_moments", "monthly", lambda: win.roll_moments(),
    {f"roll_skew_{w}": _moment("skewness", w, 3) for w in (6, 12)} | {f"roll_kurt_{w}": _moment("kurtosis", w, 4) for w in (6, 12)}, 6,
)
EXP = {f: f"{f}(y) {frame('UNBOUNDED PRECEDING', '1 PRECEDING')}" for f in ("avg", "stddev_samp")}
simple("win12_expanding", "wide", lambda: win.expanding(), {"cum_mean_past": EXP["avg"], "cum_std_past": f"coalesce({EXP['stddev_samp']}, 0)"}, 3)


@query(
    "win13_rolling_trend",
    f"{P.ctes('wide')}, z AS (SELECT *, coalesce(lag(y) OVER w, 0) AS z, row_number() OVER w - 1 AS t FROM wide {WSQL}) "
    f"SELECT series_id, {sday('ts')} AS d, "
    + ", ".join(f"{sq(f'CASE WHEN t > 0 THEN regr_slope(z, t) {cur(w)} ELSE 0 END', 3)} AS roll_trend_{w}" for w in (12, 24)) + " FROM z",
)
def _(spark, sf):
    return out(win.with_trend(with_position(P.wide(spark, sf))), ["roll_trend_12", "roll_trend_24"], 3)


@query(
    "win14_rolling_autocorrelation",
    f"{P.ctes('monthly')}, z AS (SELECT *, lag(y, 1) OVER w AS a, "
    + ", ".join(f"lag(y, {1 + k}) OVER w AS b{k}" for k in (1, 12, 24))
    + f" FROM monthly {WSQL}), c AS (SELECT *, "
    + ", ".join(f"corr(a, b{k}) {frame(f'{35 - k} PRECEDING', 'CURRENT ROW')} AS c{k}" for k in (1, 12, 24))
    + f" FROM z) SELECT series_id, {sday('ts')} AS d, "
    + ", ".join(f"{sq(f'CASE WHEN c{k} IS NULL OR isnan(c{k}) THEN 0 ELSE c{k} END')} AS autocorr_lag_{k}" for k in (1, 12, 24)) + " FROM c",
)
def _(spark, sf):
    return out(win.with_autocorrelation(P.monthly(spark, sf)), [f"autocorr_lag_{k}" for k in (1, 12, 24)], 6)


EWM_SQL = """, z AS (SELECT series_id, ts, y, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i FROM {p}),
e AS (SELECT series_id, ts, i, CAST(NULL AS DOUBLE) AS past, y FROM z WHERE i = 1
  UNION ALL SELECT z.series_id, z.ts, z.i, CASE WHEN e.past IS NULL THEN e.y ELSE e.past + (e.y - e.past) * 2.0 / 13 END, z.y
  FROM e JOIN z ON z.series_id = e.series_id AND z.i = e.i + 1)"""


@query("win15_exponential_mean", P.ctes("wide").replace("WITH", "WITH RECURSIVE") + EWM_SQL.format(p="wide") + f" SELECT series_id, {sday('ts')} AS d, {sq('past', 4)} AS ewm_12 FROM e")
def _(spark, sf):
    return out(win.add(P.wide(spark, sf), win.ewm()), ["ewm_12"])


@query(
    "win16_residual_rolls",
    f"{P.ctes('daily')}, r AS (SELECT *, y - lag(y) OVER w AS residual FROM daily {WSQL}), k AS (SELECT * FROM r WHERE residual IS NOT NULL) "
    f"SELECT series_id, {sday('ts')} AS d, {sq('avg(abs(residual)) ' + cur(3))} AS roll_mae, {sq('avg(residual) ' + cur(3))} AS roll_bias FROM k",
)
def _(spark, sf):
    df = P.daily(spark, sf).withColumns({"residual": win.diffs(ks=(1,))["diff_1"]}).where("residual IS NOT NULL")
    return out(df.withColumns(win.residual_rolls(window=win.residual_window(29))), ["roll_mae", "roll_bias"], 6)


@query(
    "win17_head_and_tail",
    f"{P.ctes('wide')}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS a, "
    "row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS b FROM wide) "
    f"SELECT series_id, {sday('ts')} AS d, {sq('y', 4)} AS y, 'head' AS part FROM r WHERE a <= 5 UNION ALL "
    f"SELECT series_id, {sday('ts')} AS d, {sq('y', 4)} AS y, 'tail' AS part FROM r WHERE b <= 1",
)
def _(spark, sf):
    df = P.wide(spark, sf)
    both = win.head_rows(df, 5).withColumn("part", F.lit("head")).unionByName(win.tail_rows(df, 1).withColumn("part", F.lit("tail")))
    return both.select("series_id", day("ts").alias("d"), q("y", 4).alias("y"), "part")


@query(
    "win18_naive_forecast",
    f"{P.ctes('wide')}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS b FROM wide) "
    f"SELECT series_id, {sq('avg(y)', 4)} AS mu, {sq('coalesce(var_samp(y), 0)', 2)} AS var, 'naive' AS mode FROM r WHERE b <= 12 GROUP BY series_id",
)
def _(spark, sf):
    return win.naive_forecast(P.wide(spark, sf)).select("series_id", q("mu", 4).alias("mu"), q("var", 2).alias("var"), "mode")


def _smooth_sql():
    def dot(weights, offsets):
        return " + ".join(f"{c} * {'y' if k == 0 else ('lag' if k < 0 else 'lead') + f'(y, {abs(k)}) OVER w'}" for c, k in zip(weights, offsets))

    mid, (e1, e2) = win.SMOOTH_MID, win.SMOOTH_EDGE
    cases = [
        ("i > 2 AND j > 2", dot(mid, (-2, -1, 0, 1, 2))), ("i = 1", dot(e1, (0, 1, 2, 3, 4))), ("i = 2", dot(e2, (-1, 0, 1, 2, 3))),
        ("j = 1", dot(e1, (0, -1, -2, -3, -4))), ("j = 2", dot(e2, (1, 0, -1, -2, -3))),
    ]
    body = " ".join(f"WHEN {c} THEN ({e}) / 35.0" for c, e in cases)
    return (
        f"{P.ctes('monthly')}, p AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i, "
        "row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS j FROM monthly) "
        f"SELECT series_id, {sday('ts')} AS d, {sq(f'CASE {body} END', 4)} AS smooth FROM p {WSQL}"
    )


@query("win19_smooth_five_points", _smooth_sql())
def _(spark, sf):
    return out(win.smooth5(P.monthly(spark, sf)), ["smooth"])


SAFE = {f"lag_{k}": f"lag(y, {k}) OVER w" for k in win.LAGS} | {"roll_mean_3": f"avg(y) {past(3)}"}
SAFE |= {"month_sin": f"sin({TAU} * month(ts) / 12.0)", "month_cos": f"cos({TAU} * month(ts) / 12.0)"}


@query(
    "win20_safe_lag_features",
    P.ctes("monthly").replace("WITH", "WITH RECURSIVE") + EWM_SQL.format(p="monthly")
    + f", b AS (SELECT series_id, ts, {', '.join(f'{e} AS {n}' for n, e in SAFE.items())} FROM monthly {WSQL}) "
    f"SELECT b.series_id, {sday('b.ts')} AS d, {', '.join(f'{sq(n, 4)} AS {n}' for n in SAFE)}, {sq('past', 4)} AS ewm_12 "
    "FROM b JOIN e ON b.series_id = e.series_id AND b.ts = e.ts",
)
def _(spark, sf):
    return out(feat.safe_lag_features(P.monthly(spark, sf)), [*SAFE, "ewm_12"])


# --- bundles --------------------------------------------------------------

MATRIX = {f"lag_{k}": f"lag(y, {k}) OVER w" for k in range(1, 13)} | {f"roll_mean_{w}": f"avg(y) {past(w)}" for w in win.ROLLS}
MATRIX |= {"month_sin": f"sin({TAU} * month(ts) / 12.0)", "month_cos": f"cos({TAU} * month(ts) / 12.0)"}


def matrix_sql(panel):
    inner = ", ".join(f"{e} AS {n}" for n, e in MATRIX.items())
    return (
        f"{P.ctes(panel)}, f AS (SELECT series_id, ts, y, month(ts) AS month_num, {inner} FROM {panel} {WSQL}) "
        f"SELECT series_id, {sday('ts')} AS d, month_num, {sq('y', 4)} AS y, {', '.join(f'{sq(n, 4)} AS {n}' for n in MATRIX)} FROM f WHERE lag_12 IS NOT NULL"
    )


def feature_matrix(panel):
    df = feat.lag_matrix(panel)
    return df.select(
        "series_id", day("ts").alias("d"), F.col("month_num").cast("bigint").alias("month_num"), q("y", 4).alias("y"), *[q(c, 4).alias(c) for c in MATRIX]
    )


@query("bundle_feature_matrix", matrix_sql("monthly"))
def _(spark, sf):
    return feature_matrix(P.monthly(spark, sf))


@query("bundle_feature_matrix_wide", matrix_sql("wide"))
def _(spark, sf):
    return feature_matrix(P.wide(spark, sf))


def _ext_exprs():
    e = {f"y_lag_{k}": f"lag(y, {k}) OVER w" for k in win.LAGS_LONG} | {f"diff_{k}": f"y - lag(y, {k}) OVER w" for k in (1, 12)}
    for w in (3, 6, 12, 24):
        e |= {f"roll_mean_{w}": f"avg(y) {past(w)}", f"roll_std_{w}": f"coalesce(stddev_samp(y) {past(w)}, 0)"}
        e |= {f"roll_min_{w}": f"min(y) {past(w)}", f"roll_max_{w}": f"max(y) {past(w)}"}
    e["cum_mean_past"] = EXP["avg"]
    e |= {"quarter": "(month(ts) - 1) // 3 + 1", "season": "(month(ts) % 12 + 3) // 3", "year": "year(ts)"}
    e |= {"month_sin": f"sin({TAU} * (month(ts) - 1) / 12.0)", "month_cos": f"cos({TAU} * (month(ts) - 1) / 12.0)"}
    e |= {f"fourier_{f}_{k}": f"{f}({TAU} * {k} * t / 12.0)" for k in (1, 2, 3) for f in ("sin", "cos")}
    return e | INTER


EXT = _ext_exprs()


@query(
    "bundle_extended_features",
    f"{P.ctes('monthly')}, p AS (SELECT *, row_number() OVER w - 1 AS t, count(*) OVER (PARTITION BY series_id) AS n FROM monthly {WSQL}), "
    f"f AS (SELECT series_id, ts, t, n, {', '.join(f'{e} AS {n}' for n, e in EXT.items())} FROM p {WSQL}) "
    f"SELECT series_id, {sday('ts')} AS d, {', '.join(f'{sq(n, 3)} AS {n}' for n in EXT)} FROM f WHERE t >= 37 OR n <= 37",
)
def _(spark, sf):
    return out(feat.extended_features(P.monthly(spark, sf)), list(EXT), 3)


SIMPLE = {f"{p}lag_{k}": f"lag(y, {k}) OVER w" for p in ("", "y_") for k in win.LAGS}
SIMPLE |= {f"{p}roll_mean_{w}": f"avg(y) {past(w)}" for p in ("", "y_") for w in win.ROLLS}
SIMPLE |= {f"{p}roll_std_{w}": f"coalesce(stddev_samp(y) {past(w)}, 0)" for p in ("", "y_") for w in win.ROLLS}


@query(
    "bundle_simple_extended",
    f"{P.ctes('wide')}, p AS (SELECT *, row_number() OVER w - 1 AS t, count(*) OVER (PARTITION BY series_id) AS n FROM wide {WSQL}), "
    f"f AS (SELECT series_id, ts, t, n, {', '.join(f'{e} AS {n}' for n, e in SIMPLE.items())} FROM p {WSQL}) "
    f"SELECT series_id, {sday('ts')} AS d, {', '.join(f'{sq(n, 3)} AS {n}' for n in SIMPLE)} FROM f WHERE t >= 13 OR n <= 13",
)
def _(spark, sf):
    return out(feat.simple_extended(P.wide(spark, sf)), list(SIMPLE), 3)


BUILD = {f"lag_{k}": f"lag(y, {k}) OVER w" for k in win.LAGS} | {f"roll_mean_{w}": f"avg(y) {past(w)}" for w in win.ROLLS}
BUILD |= {"year": "year(ts)", "month": "month(ts)", "day": "day(ts)", "weekday": "(dayofweek(ts) + 6) % 7", "dayofyear": "dayofyear(ts)"}


@query("bundle_builder_features", sql_out("daily", BUILD, 4, where=WSQL))
def _(spark, sf):
    return out(feat.builder_features(P.daily(spark, sf)), list(BUILD))


MODEL = SAFE | {f"roll_min_{w}": f"min(y) {past(w)}" for w in win.ROLLS} | {f"trend_diff_{k}": f"y - lag(y, {k}) OVER w" for k in (1, 12)}


@query("bundle_model_features", sql_out("monthly", MODEL | {"exog_y2": "2 * y"}, 4, where=WSQL))
def _(spark, sf):
    df = feat.model_features(P.monthly(spark, sf).withColumn("y2", 2 * F.col("y")), exogenous=["y2"])
    return out(df, [*MODEL, "exog_y2"])


CAND = {f"lag_{k}": f"lag(y, {k}) OVER w" for k in win.LAGS} | {f"cur_mean_{w}": f"avg(y) {cur(w)}" for w in (3, 12)}
CAND |= {f"roll_q90_{w}": f"quantile_cont(y, 0.9) {cur(w)}" for w in (3, 12)}


@query("bundle_candidates", sql_out("monthly", CAND, 4, where=WSQL))
def _(spark, sf):
    return out(feat.candidate_features(P.monthly(spark, sf)), list(CAND))


AGGF = {f"lag_{k}": f"lag(y, {k}) OVER w" for k in win.LAGS} | {"expanding_mean_prev": EXP["avg"]}
for _g in ("month", "year"):
    AGGF[f"{_g}_mean" + ("_all" if _g == "month" else "")] = f"avg(y) OVER (PARTITION BY series_id, {_g}(ts))"
    AGGF[f"{_g}_std" + ("_all" if _g == "month" else "")] = f"stddev_samp(y) OVER (PARTITION BY series_id, {_g}(ts))"


@query(
    "bundle_aggregate_features",
    f"{P.ctes('monthly')}, f AS (SELECT series_id, ts, {', '.join(f'{e} AS {n}' for n, e in AGGF.items())} FROM monthly {WSQL}) "
    f"SELECT series_id, {sday('ts')} AS d, {', '.join(f'{sq(n, 3)} AS {n}' for n in AGGF)} FROM f WHERE lag_12 IS NOT NULL AND year_std IS NOT NULL AND month_std_all IS NOT NULL",
)
def _(spark, sf):
    return out(feat.aggregate_features(P.monthly(spark, sf)), list(AGGF), 3)


# --- long series: windows over every event ---------------------------------

RAW_W = "OVER (PARTITION BY series_id ORDER BY ts, event_id ROWS BETWEEN {} AND {})"


@query(
    "long_series_windows",
    f"{P.ctes('raw')} SELECT event_id, row_number() OVER w - 1 AS t, lag(y, 1) OVER w AS lag_1, lag(y, 36) OVER w AS lag_36, "
    f"{sq('avg(y) ' + RAW_W.format('12 PRECEDING', '1 PRECEDING'), 5)} AS roll_mean_12, "
    f"{sq('coalesce(stddev_samp(y) ' + RAW_W.format('12 PRECEDING', '1 PRECEDING') + ', 0)', 5)} AS roll_std_12, "
    f"{sq('max(y) ' + RAW_W.format('24 PRECEDING', '1 PRECEDING'), 5)} AS roll_max_24 FROM raw WINDOW w AS (PARTITION BY series_id ORDER BY ts, event_id)",
)
def _(spark, sf):
    by, order = ("series_id", "part_id"), ("t",)
    cols = win.lags(ks=(1, 36), by=by, order=order) | win.roll_mean(windows=(12,), by=by, order=order)
    cols |= win.roll_std(windows=(12,), by=by, order=order) | {"roll_max_24": win.roll_extremes(windows=(24,), by=by, order=order)["roll_max_24"]}
    df = longseries.windowed(P.raw(spark, sf), cols, reach=36, tie=("event_id",), part_rows=1_000)
    return df.select("event_id", "t", "lag_1", "lag_36", *[q(c, 5).alias(c) for c in ("roll_mean_12", "roll_std_12", "roll_max_24")])


@query(
    "long_series_expanding",
    f"{P.ctes('raw')} SELECT event_id, {sq('avg(y) ' + RAW_W.format('UNBOUNDED PRECEDING', '1 PRECEDING'), 5)} AS cum_mean_past, "
    f"{sq('coalesce(stddev_samp(y) ' + RAW_W.format('UNBOUNDED PRECEDING', '1 PRECEDING') + ', 0)', 5)} AS cum_std_past, "
    f"{sq('sum(abs(y)) ' + RAW_W.format('UNBOUNDED PRECEDING', 'CURRENT ROW'), 3)} AS cum_abs FROM raw",
)
def _(spark, sf):
    df = longseries.expanding(P.raw(spark, sf), tie=("event_id",))
    return df.select("event_id", q("cum_mean_past", 5).alias("cum_mean_past"), q("cum_std_past", 5).alias("cum_std_past"), q("cum_abs", 3).alias("cum_abs"))


@query("long_series_exponential_mean", P.ctes("raw").replace("WITH", "WITH RECURSIVE") + """,
z AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts, event_id) AS i FROM raw),
e AS (SELECT series_id, event_id, i, CAST(NULL AS DOUBLE) AS past, y FROM z WHERE i = 1
  UNION ALL SELECT z.series_id, z.event_id, z.i, CASE WHEN e.past IS NULL THEN e.y ELSE e.past + (e.y - e.past) * 2.0 / 13 END, z.y
  FROM e JOIN z ON z.series_id = e.series_id AND z.i = e.i + 1)""" + f" SELECT event_id, {sq('past', 5)} AS ewm_12 FROM e")
def _(spark, sf):
    cols = win.ewm(by=("series_id", "part_id"), order=("t",))
    df = longseries.windowed(P.raw(spark, sf), cols, reach=win.ewm_depth(12), tie=("event_id",))
    return df.select("event_id", q("ewm_12", 5).alias("ewm_12"))
