"""Cleaning, projection, filter, join, split and top-k queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions.draws import portable_uniform
from tidewell.functions.numbers import extract_number, to_number
from tidewell.operators import clean, longseries, relate, splits
from tidewell.operators import features as feat
from tidewell.operators import windows as win
from tidewell.panel import over, with_position
from tidewell.plans import panels as P
from tidewell.plans.registry import day, q, query, sday, sq, table, uniform_sql
from tidewell.plans.window_queries import WSQL

# --- projection -------------------------------------------------------------


@query(
    "prj1_detect_target",
    f"SELECT event_type AS series_id, 'value' AS target, {sq('CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE)', 2)} AS total FROM events GROUP BY 1",
)
def _(spark, sf):
    e = table(spark, sf, "events").drop("event_id", "user_id")
    target = clean.detect_target(e.schema)
    total = F.sum(F.col(target).cast("decimal(18,2)"))
    return e.groupBy(F.col("event_type").alias("series_id")).agg(F.lit(target).alias("target"), q(total, 2).alias("total"))


@query("prj2_find_column", "SELECT 'o_totalprice' AS found, count(*) AS n FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders")
    found = clean.find_column(o.columns, ["TEMP", "O_TotalPrice"])
    return o.agg(F.lit(found).alias("found"), F.count(found).alias("n"))


@query("prj3_canonical_columns", f"SELECT {sday('o_orderdate')} AS d, o_totalprice AS y FROM orders")
def _(spark, sf):
    out = clean.canonical(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    return out.select(day("ts").alias("d"), "y")


@query(
    "prj4_align_schema",
    "SELECT l_orderkey, l_linenumber, CAST(l_tax AS DOUBLE) AS l_tax, CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(-1 AS DOUBLE) AS absent FROM lineitem",
)
def _(spark, sf):
    return clean.align_schema(table(spark, sf, "lineitem"), ["l_tax", "l_quantity", "absent"], -1.0, keep=["l_orderkey", "l_linenumber"])


@query(
    "prj5_numeric_projection",
    "SELECT CAST(0 AS DOUBLE) AS absent, CAST(p_retailprice AS DOUBLE) AS p_retailprice, CAST(p_partkey AS DOUBLE) AS p_partkey, "
    "CAST(p_size AS DOUBLE) AS p_size, CAST(p_size > 25 AS INT)::DOUBLE AS large FROM part",
)
def _(spark, sf):
    p = table(spark, sf, "part").withColumn("large", F.col("p_size") > 25)
    return clean.numeric_projection(p, ["absent", "p_retailprice"])


@query("prj6_strip_prefix", "SELECT p_partkey, p_type || '_' || p_brand AS name, p_size AS size FROM part")
def _(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey", clean.strip_prefix(F.concat(F.lit("num__"), "p_type", F.lit("_"), "p_brand")).alias("cat__name"), F.col("p_size").alias("num__size")
    )
    return clean.strip_prefixes(p)


@query("prj7_exogenous", "SELECT l_orderkey, l_linenumber, l_tax AS exog_l_tax, l_discount AS exog_l_discount FROM lineitem")
def _(spark, sf):
    return clean.exogenous(table(spark, sf, "lineitem"), ["l_tax", "l_discount"], keep=["l_orderkey", "l_linenumber"])


# --- filters ----------------------------------------------------------------

LAGGED = f"l AS (SELECT *, lag(y, 1) OVER w AS lag_1, lag(y, 12) OVER w AS lag_12, lag(y, 36) OVER w AS lag_36, lag(y, 500) OVER w AS lag_500 FROM wide {WSQL})"


def lagged(spark, sf):
    return win.add(P.wide(spark, sf), win.lags(ks=(1, 12, 36, 500)))


@query("flt1_drop_bad_rows", f"{P.ctes('wide')}, {LAGGED} SELECT series_id, {sday('ts')} AS d, {sq('lag_12', 4)} AS lag_12 FROM l WHERE lag_12 IS NOT NULL")
def _(spark, sf):
    return lagged(spark, sf).na.drop(subset=["ts", "lag_12"]).select("series_id", day("ts").alias("d"), q("lag_12", 4).alias("lag_12"))


@query(
    "flt2_drop_any_null",
    f"{P.ctes('wide')}, {LAGGED} SELECT series_id, {sday('ts')} AS d, {sq('y', 4)} AS y, {sq('lag_1', 4)} AS lag_1, {sq('lag_12', 4)} AS lag_12 FROM l WHERE lag_1 IS NOT NULL AND lag_12 IS NOT NULL",
)
def _(spark, sf):
    df = lagged(spark, sf).drop("lag_36", "lag_500").na.drop("any")
    return df.select("series_id", day("ts").alias("d"), *[q(c, 4).alias(c) for c in ("y", "lag_1", "lag_12")])


@query(
    "flt3_drop_warmup",
    f"{P.ctes('wide')}, p AS (SELECT *, row_number() OVER w - 1 AS t, count(*) OVER (PARTITION BY series_id) AS n FROM wide {WSQL}) "
    f"SELECT series_id, {sday('ts')} AS d, t, {sq('y', 4)} AS y FROM p WHERE t >= 13 OR n <= 13",
)
def _(spark, sf):
    df = feat.drop_warmup(with_position(P.wide(spark, sf)), 13)
    return df.select("series_id", day("ts").alias("d"), F.col("t").cast("bigint").alias("t"), q("y", 4).alias("y"))


def _kept_sql(keep):
    return (
        f"{P.ctes('wide')}, {LAGGED}, c AS (SELECT count(*) AS n, "
        + ", ".join(f"count({c}) AS {c}" for c in ("y", "lag_1", "lag_12", "lag_36", "lag_500"))
        + " FROM l) SELECT k AS name, CAST(v AS BIGINT) AS filled FROM (UNPIVOT c ON y, lag_1, lag_12, lag_36, lag_500 INTO NAME k VALUE v) WHERE "
        + keep
    )


def _filled(df):
    cols = [c for c in df.columns if c not in ("series_id", "ts")]
    return df.agg(*[F.count(c).alias(c) for c in cols]).unpivot([], cols, "name", "filled")


@query("flt4_drop_sparse_columns", _kept_sql("v >= 0.5 * n"))
def _(spark, sf):
    return _filled(clean.drop_sparse(lagged(spark, sf)))


@query("flt5_drop_empty_columns", _kept_sql("v > 0"))
def _(spark, sf):
    return _filled(clean.drop_empty(lagged(spark, sf)))


@query(
    "flt6_drop_high_cardinality",
    "WITH c AS (SELECT 'text' AS name, count(DISTINCT text) + max(CASE WHEN text IS NULL THEN 1 ELSE 0 END) AS d, count(*) AS n FROM documents UNION ALL "
    "SELECT 'lang', count(DISTINCT lang) + max(CASE WHEN lang IS NULL THEN 1 ELSE 0 END), count(*) FROM documents UNION ALL "
    "SELECT 'source', count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END), count(*) FROM documents), "
    "f AS (SELECT (SELECT count(text) FROM documents) AS text, (SELECT count(lang) FROM documents) AS lang, (SELECT count(source) FROM documents) AS source) "
    "SELECT c.name, CASE c.name WHEN 'text' THEN f.text WHEN 'lang' THEN f.lang ELSE f.source END AS filled FROM c, f WHERE NOT (d > 0.5 * n)",
)
def _(spark, sf):
    df = clean.drop_high_cardinality(table(spark, sf, "documents").select("text", "lang", "source"))
    return df.agg(*[F.count(c).alias(c) for c in df.columns]).unpivot([], df.columns, "name", "filled")


@query(
    "flt7_drop_duplicate_columns",
    "SELECT 'y_price' AS name, count(*) AS filled FROM lineitem UNION ALL SELECT 'price', count(*) FROM lineitem UNION ALL SELECT 'tax', count(*) FROM lineitem",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("price"), (F.col("l_extendedprice") * 1.01).alias("y_price"), F.col("l_tax").alias("tax"), (F.col("l_tax") + 1e-12).alias("y_tax")
    )
    return _filled(clean.drop_duplicates_of(li))


@query(
    "flt8_numeric_pairs",
    "SELECT event_id, TRY_CAST(CASE WHEN user_id % 7 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS truth, value * 2 AS pred FROM events WHERE user_id % 7 <> 0",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    messy = e.select("event_id", F.when(F.col("user_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("truth"), (F.col("value") * 2).alias("pred"))
    return clean.numeric_pairs(messy, "truth", "pred")


# --- coercion ---------------------------------------------------------------


@query(
    "cln1_numeric_coercion",
    "SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderstatus = 'F' THEN '?' || o_totalprice ELSE CAST(o_totalprice AS VARCHAR) END AS DOUBLE) AS price FROM orders",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    text = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("?"), F.col("o_totalprice").cast("string"))).otherwise(F.col("o_totalprice").cast("string"))
    return o.select("o_orderkey", to_number(text).alias("price"))


@query(
    "cln2_coerce_objects",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE o_totalprice END AS price, CAST(epoch(o_orderdate) AS DOUBLE) AS placed, CAST(0 AS DOUBLE) AS priority FROM orders",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "none").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("placed"),
        F.col("o_orderpriority").alias("priority"),
    )
    return clean.coerce_objects(o, ["price", "placed", "priority"])


@query(
    "cln3_extract_number",
    "SELECT event_id, CAST(props->>'$.k' AS DOUBLE) AS from_json, value AS from_text, -value AS from_list, "
    "CAST(CASE WHEN value = floor(value) THEN floor(value) ELSE value END AS DOUBLE) AS from_noise FROM events",
)
def _(spark, sf):
    v = F.col("value").cast("string")
    return table(spark, sf, "events").select(
        "event_id",
        extract_number(F.col("props")).alias("from_json"),
        extract_number(F.concat(F.lit(" about "), v, F.lit("% of it"))).alias("from_text"),
        extract_number(F.concat(F.lit('["none", -'), v, F.lit(", 7]"))).alias("from_list"),
        extract_number(F.concat(F.lit("('"), v, F.lit("', 5)"))).alias("from_noise"),
    )


@query(
    "cln4_numeric_ratio",
    "WITH c AS (SELECT count(*) AS total, count(TRY_CAST(o_orderpriority AS DOUBLE)) AS o_orderpriority, count(o_totalprice) AS o_totalprice_value, "
    "count(TRY_CAST(CASE WHEN o_orderstatus = 'F' THEN '1' ELSE 'x' END AS DOUBLE)) AS flag FROM orders), "
    "u AS (UNPIVOT c ON o_orderpriority, o_totalprice_value, flag INTO NAME k VALUE v) "
    f"SELECT k AS name, CAST(v AS BIGINT) AS numeric, total, {sq('v / total')} AS ratio, {sq('v / total + 0.05 + CASE WHEN k = ' + chr(39) + 'o_totalprice_value' + chr(39) + ' THEN 0.25 ELSE 0 END')} AS score FROM u",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderpriority", F.col("o_totalprice").alias("o_totalprice_value"), F.when(F.col("o_orderstatus") == "F", "1").otherwise("x").alias("flag")
    )
    df = clean.numeric_ratio(o, o.columns, keywords=("price",))
    return df.select(F.col("column").alias("name"), "numeric", "total", q("ratio").alias("ratio"), q("score").alias("score"))


@query(
    "cln15_month_number",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN month(o_orderdate) ELSE month(o_orderdate) END AS month_num FROM orders",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 2 == 0, F.month("o_orderdate").cast("string")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("month"),
        F.col("o_orderdate").alias("date"),
    )
    return o.select("o_orderkey", clean.month_number(o).cast("bigint").alias("month_num"))


# --- filling ----------------------------------------------------------------

GRID = (
    "sp AS (SELECT series_id, min(ts) AS a, max(ts) AS b FROM wide GROUP BY 1), "
    "g AS (SELECT series_id, unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS ts FROM sp), "
    "gy AS (SELECT g.series_id, g.ts, y FROM g LEFT JOIN wide USING (series_id, ts))"
)


@query(
    "cln5_fill_both_ways",
    f"{P.ctes('wide')}, {GRID}, s AS (SELECT series_id, ts, CASE WHEN month(ts) IN (1, 2) THEN NULL ELSE y END AS y FROM gy) "
    f"SELECT series_id, {sday('ts')} AS d, {sq('coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))', 4)} AS filled FROM s",
)
def _(spark, sf):
    g = clean.regular_grid(P.wide(spark, sf))
    holed = g.withColumn("y", F.when(~F.month("ts").isin(1, 2), F.col("y")))
    return holed.select("series_id", day("ts").alias("d"), q(clean.fill_both_ways("y"), 4).alias("filled"))


@query(
    "cln5_fill_long_series",
    f"{P.ctes('raw')}, s AS (SELECT series_id, event_id, ts, CASE WHEN y < 20 THEN NULL ELSE y END AS y FROM raw) "
    "SELECT event_id, coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
    "first_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM s",
)
def _(spark, sf):
    holed = P.raw(spark, sf).withColumn("y", F.when(F.col("y") >= 20, F.col("y")))
    return longseries.fill_gaps(holed, tie=("event_id",)).select("event_id", "filled")


MED = "m AS (SELECT median(lag_12) AS m12, median(lag_36) AS m36 FROM l)"


@query(
    "cln6_fill_median",
    f"{P.ctes('wide')}, {LAGGED}, {MED} SELECT series_id, {sday('ts')} AS d, {sq('coalesce(lag_12, m12, 0)', 4)} AS lag_12, {sq('coalesce(lag_36, m36, 0)', 4)} AS lag_36, {sq('coalesce(lag_500, 0)', 4)} AS lag_500 FROM l, m",
)
def _(spark, sf):
    df = clean.fill_median(lagged(spark, sf), ["lag_12", "lag_36", "lag_500"])
    return df.select("series_id", day("ts").alias("d"), *[q(c, 4).alias(c) for c in ("lag_12", "lag_36", "lag_500")])


def _chain(c):
    up = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    down = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    return (
        f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts {up}), first_value({c} IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts {down}), "
        f"median({c}) OVER (PARTITION BY series_id), median(y) OVER (PARTITION BY series_id))"
    )


@query(
    "cln7_impute_lags",
    f"{P.ctes('wide')}, {LAGGED} SELECT series_id, {sday('ts')} AS d, {sq(_chain('lag_1'), 4)} AS lag_1, {sq(_chain('lag_12'), 4)} AS lag_12, {sq(_chain('lag_500'), 4)} AS lag_500 FROM l",
)
def _(spark, sf):
    df = clean.impute_lags(lagged(spark, sf), ["lag_1", "lag_12", "lag_500"])
    return df.select("series_id", day("ts").alias("d"), *[q(c, 4).alias(c) for c in ("lag_1", "lag_12", "lag_500")])


@query(
    "cln8_fitted_imputers",
    f"{P.ctes('wide')}, {LAGGED}, tr AS (SELECT * FROM l WHERE ts < TIMESTAMP '2000-01-01'), "
    "f AS (SELECT avg(lag_1) AS a, median(lag_12) AS m FROM tr), "
    "k AS (SELECT month(ts) AS mode FROM tr GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) "
    f"SELECT series_id, {sday('ts')} AS d, {sq('coalesce(lag_1, a)', 3)} AS lag_1, {sq('coalesce(lag_12, m)', 3)} AS lag_12, "
    "CAST(CASE WHEN month(ts) = 2 THEN mode ELSE month(ts) END AS BIGINT) AS mon FROM l, f, k",
)
def _(spark, sf):
    df = lagged(spark, sf).withColumn("mon", F.month("ts"))
    train = df.where(F.col("ts") < "2000-01-01")
    values = clean.fit_imputer(train, ["lag_1"], "mean") | clean.fit_imputer(train, ["lag_12"], "median") | clean.fit_imputer(train, ["mon"], "most_frequent")
    holed = df.withColumn("mon", F.when(F.col("mon") != 2, F.col("mon")))
    out = clean.apply_imputer(holed, values)
    return out.select("series_id", day("ts").alias("d"), q("lag_1", 3).alias("lag_1"), q("lag_12", 3).alias("lag_12"), F.col("mon").cast("bigint").alias("mon"))


@query("cln9_fill_constant", f"{P.ctes('wide')}, {LAGGED} SELECT series_id, {sday('ts')} AS d, {sq('coalesce(lag_12, 0)', 4)} AS lag_12 FROM l")
def _(spark, sf):
    return lagged(spark, sf).na.fill(0.0, ["lag_12"]).select("series_id", day("ts").alias("d"), q("lag_12", 4).alias("lag_12"))


@query("cln10_regular_grid", f"{P.ctes('wide')}, {GRID} SELECT series_id, {sday('ts')} AS d, {sq('y', 4)} AS y FROM gy")
def _(spark, sf):
    return clean.regular_grid(P.wide(spark, sf)).select("series_id", day("ts").alias("d"), q("y", 4).alias("y"))


@query(
    "cln11_infer_frequency",
    f"{P.ctes('wide')}, g AS (SELECT series_id, date_diff('day', lag(ts) OVER w, ts) AS g FROM wide {WSQL}), "
    "m AS (SELECT series_id, CAST(floor(median(g)) AS BIGINT) AS gap_days FROM g WHERE g IS NOT NULL GROUP BY 1) "
    "SELECT series_id, gap_days, CASE WHEN gap_days % 30 = 0 OR gap_days BETWEEN 28 AND 31 THEN 'MS' ELSE 'D' END AS freq FROM m",
)
def _(spark, sf):
    return clean.infer_frequency(P.wide(spark, sf)).select("series_id", F.col("gap_days").cast("bigint").alias("gap_days"), "freq")


@query(
    "cln12_repeat_last",
    f"{P.ctes('wide')}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS i FROM wide), "
    "a AS (SELECT series_id, ts, y FROM wide UNION ALL SELECT series_id, ts + to_months(CAST(k AS INT)), y FROM r, range(1, 4) x(k) WHERE i = 1) "
    f"SELECT series_id, {sday('ts')} AS d, {sq('y', 4)} AS y FROM a",
)
def _(spark, sf):
    return clean.repeat_last(P.wide(spark, sf), 3).select("series_id", day("ts").alias("d"), q("y", 4).alias("y"))


@query(
    "cln13_future_frame",
    f"{P.ctes('wide')}, l AS (SELECT series_id, max(ts) AS a FROM wide GROUP BY 1), f AS (SELECT series_id, CAST(k AS BIGINT) AS step, a + to_months(CAST(k AS INT)) AS ts FROM l, range(1, 13) x(k)) "
    f"SELECT series_id, step, {sday('ts')} AS d, CAST(year(ts) AS DOUBLE) AS year, {sq('sin(2 * pi() * month(ts) / 12.0)')} AS month_sin, {sq('cos(2 * pi() * month(ts) / 12.0)')} AS month_cos FROM f",
)
def _(spark, sf):
    f = clean.future_frame(P.wide(spark, sf), 12)
    return f.select("series_id", F.col("step").cast("bigint").alias("step"), day("ts").alias("d"), "year", q("month_sin").alias("month_sin"), q("month_cos").alias("month_cos"))


@query(
    "cln14_synthetic_dates",
    f"{P.ctes('wide')}, p AS (SELECT *, row_number() OVER w - 1 AS t FROM wide {WSQL}) "
    f"SELECT series_id, t, strftime(make_date(CAST(2000 + t // 12 AS INT), CAST(month(ts) AS INT), 1), '%Y-%m-%d') AS d FROM p",
)
def _(spark, sf):
    p = with_position(P.wide(spark, sf))
    return p.select("series_id", F.col("t").cast("bigint").alias("t"), day(clean.synthetic_date(F.col("t"), F.month("ts"))).alias("d"))


# --- joins and sets ---------------------------------------------------------


@query(
    "joi1_group_statistics",
    f"{P.ctes('wide')}, s AS (SELECT series_id, month(ts) AS m, avg(y) AS mean, stddev_samp(y) AS std FROM wide GROUP BY 1, 2) "
    f"SELECT w.series_id, {sday('w.ts')} AS d, {sq('mean', 3)} AS month_mean, {sq('std', 3)} AS month_std FROM wide w LEFT JOIN s ON w.series_id = s.series_id AND month(w.ts) = s.m",
)
def _(spark, sf):
    df = feat.group_stats(P.wide(spark, sf).withColumn("m", F.month("ts")), ["m"], "month_mean", "month_std")
    return df.select("series_id", day("ts").alias("d"), q("month_mean", 3).alias("month_mean"), q("month_std", 3).alias("month_std"))


@query(
    "joi3_join_without_duplicates",
    f"{P.ctes('wide')}, f AS (SELECT series_id, ts, -y AS y, month(ts) AS m FROM wide WHERE month(ts) > 3) "
    f"SELECT w.series_id, {sday('w.ts')} AS d, {sq('w.y', 4)} AS y, CAST(f.m AS DOUBLE) AS m FROM wide w LEFT JOIN f USING (series_id, ts)",
)
def _(spark, sf):
    w = P.wide(spark, sf)
    f = w.where(F.month("ts") > 3).select("series_id", "ts", (-F.col("y")).alias("y"), F.month("ts").cast("double").alias("m"))
    return relate.join_without_duplicates(w, f, ["series_id", "ts"]).select("series_id", day("ts").alias("d"), q("y", 4).alias("y"), "m")


@query(
    "joi4_concat_columns",
    f"{P.ctes('monthly', 'daily')}, a AS (SELECT *, row_number() OVER w - 1 AS t FROM monthly {WSQL}), "
    "b AS (SELECT series_id, ts, y, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) - 1 AS t FROM monthly) "
    f"SELECT a.series_id, {sday('a.ts')} AS d, {sq('a.y', 4)} AS y, {sq('b.y', 4)} AS back FROM a LEFT JOIN b USING (series_id, t)",
)
def _(spark, sf):
    m = P.monthly(spark, sf)
    back = m.select("series_id", (-F.unix_timestamp("ts")).alias("ts"), F.col("y").alias("back"))
    return relate.concat_columns(m, back).select("series_id", day("ts").alias("d"), q("y", 4).alias("y"), q("back", 4).alias("back"))


@query(
    "joi5_mention_join",
    "WITH h AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages) "
    "SELECT p.page_id, min(h.host) AS host FROM pages p LEFT JOIN h ON contains(p.html, h.host) AND h.host <> '' GROUP BY p.page_id",
)
def _(spark, sf):
    p = table(spark, sf, "pages")
    hosts = p.select(F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host")).distinct()
    return relate.first_mention(p.select("page_id", "html"), "page_id", "html", hosts, "host", q=12).select("page_id", "host")


@query(
    "joi6_lookup_status",
    f"SELECT c_custkey, {sq('r.total', 2)} AS total, CASE WHEN r.total IS NULL THEN 'missing' ELSE 'ok' END AS status FROM customer LEFT JOIN "
    "(SELECT o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) r ON c_custkey = r.o_custkey",
)
def _(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'")
    r = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    out = relate.lookup_status(table(spark, sf, "customer").select("c_custkey"), r, "c_custkey", "total")
    return out.select("c_custkey", q("total", 2).alias("total"), "status")


SEASONAL_SQL = (
    "e AS (SELECT series_id, max(ts) AS a, max_by(y, ts) AS last_y FROM hourly GROUP BY 1), "
    "p AS (SELECT h.series_id, hour(h.ts) AS hr, avg(y) AS profile FROM hourly h JOIN e USING (series_id) WHERE h.ts > e.a - INTERVAL 7 DAYS GROUP BY 1, 2), "
    "f AS (SELECT e.series_id, CAST(k AS BIGINT) AS step, a + to_hours(CAST(k AS INT)) AS ts, last_y FROM e, range(1, 49) x(k))"
)


@query(
    "joi7_hour_profile_lookup",
    f"{P.ctes('hourly')}, {SEASONAL_SQL} SELECT f.series_id, step, strftime(f.ts, '%Y-%m-%d %H') AS h, {sq('coalesce(profile, last_y)')} AS yhat FROM f LEFT JOIN p ON f.series_id = p.series_id AND hour(f.ts) = p.hr",
)
def _(spark, sf):
    f = relate.seasonal_naive(P.hourly(spark, sf), 48)
    return f.select("series_id", F.col("step").cast("bigint").alias("step"), F.date_format("ts", "yyyy-MM-dd HH").alias("h"), q("yhat").alias("yhat"))


@query(
    "set1_union_frames",
    f"{P.ctes('monthly', 'daily')} SELECT series_id, {sday('ts')} AS d, {sq('y', 4)} AS y, CAST(NULL AS VARCHAR) AS grain FROM monthly UNION ALL SELECT series_id, {sday('ts')}, {sq('y', 4)}, 'day' FROM daily",
)
def _(spark, sf):
    out = P.monthly(spark, sf).unionByName(P.daily(spark, sf).withColumn("grain", F.lit("day")), allowMissingColumns=True)
    return out.select("series_id", day("ts").alias("d"), q("y", 4).alias("y"), "grain")


@query("set2_missing_columns", "SELECT 'absent' AS name, (SELECT count(*) FROM orders) AS n_rows UNION ALL SELECT 'o_clerk', (SELECT count(*) FROM orders)")
def _(spark, sf):
    o = table(spark, sf, "orders")
    missing = sorted({"o_orderkey", "absent", "o_clerk"} - set(o.columns))
    return o.agg(F.count(F.lit(1)).alias("n_rows")).select(F.explode(F.array(*[F.lit(c) for c in missing])).alias("name"), "n_rows")


# --- top-k ------------------------------------------------------------------


def _extreme_sql(direction):
    return f"{P.ctes('wide')} SELECT series_id, {sday('ts')} AS d, {sq('y', 4)} AS y FROM wide ORDER BY wide.y {direction}, ts, series_id LIMIT 5"


@query("top1_hottest", _extreme_sql("DESC"))
def _(spark, sf):
    return splits.extremes(P.wide(spark, sf), 5, ties=["ts", "series_id"]).select("series_id", day("ts").alias("d"), q("y", 4).alias("y"))


@query("top1_coldest", _extreme_sql("ASC"))
def _(spark, sf):
    return splits.extremes(P.wide(spark, sf), 5, hottest=False, ties=["ts", "series_id"]).select("series_id", day("ts").alias("d"), q("y", 4).alias("y"))


@query(
    "top2_largest_abs",
    "SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY abs(c_acctbal) DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 25",
)
def _(spark, sf):
    top = splits.largest_abs(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), 25, "c_acctbal", ["c_custkey"])
    return top.withColumn("rank", F.col("rank").cast("bigint"))


# --- splits -----------------------------------------------------------------

POS = f"p AS (SELECT *, row_number() OVER w - 1 AS t, count(*) OVER (PARTITION BY series_id) AS n FROM wide {WSQL})"


def split_query(name, make, start_sql):
    @query(name, f"{P.ctes('wide')}, {POS} SELECT series_id, {sday('ts')} AS d, CASE WHEN t >= {start_sql} THEN 'test' ELSE 'train' END AS split FROM p")
    def _(spark, sf):
        return make(P.wide(spark, sf)).select("series_id", day("ts").alias("d"), "split")


split_query("spl1_last_rows", lambda df: splits.tag_last(df, 6), "n - 6")
split_query("spl2_test_share", lambda df: splits.tag_at(df, splits.test_share(0.2)), "n - greatest(1, CAST(ceil(n * CAST(0.2 AS DOUBLE)) AS BIGINT))")
split_query("spl2_train_share", lambda df: splits.tag_at(df, splits.train_share(0.8)), "floor(n * CAST(0.8 AS DOUBLE))")
split_query(
    "spl3_holdout_rule", lambda df: splits.tag_at(df, splits.holdout_rule(12, 30)),
    "n - CASE WHEN n >= 30 THEN 12 ELSE greatest(1, CAST(round_even(n * CAST(0.15 AS DOUBLE), 0) AS BIGINT)) END",
)
split_query("spl6_calibration_tail", lambda df: splits.tag_at(df, splits.calibration_tail(0.15)), "floor(n * CAST(0.85 AS DOUBLE))")


@query(
    "spl4_expanding_folds",
    f"{P.ctes('wide')}, {POS}, f AS (SELECT p.*, CAST(k AS BIGINT) AS fold, n // 6 AS s, n - (6 - k) * (n // 6) AS a FROM p, range(1, 6) x(k) WHERE n // 6 > 0) "
    f"SELECT series_id, {sday('ts')} AS d, fold, CASE WHEN t < a THEN 'train' ELSE 'test' END AS part FROM f WHERE t < a + s",
)
def _(spark, sf):
    f = splits.expanding_folds(P.wide(spark, sf), 5)
    return f.select("series_id", day("ts").alias("d"), F.col("fold").cast("bigint").alias("fold"), "part")


@query(
    "spl5_walk_forward",
    f"{P.ctes('monthly')}, p AS (SELECT *, row_number() OVER w - 1 AS t, count(*) OVER (PARTITION BY series_id) AS n FROM monthly {WSQL}), "
    "c AS (SELECT DISTINCT series_id, n, CAST(k AS BIGINT) AS fold, CAST(floor(n // 2 + k * (n - 1 - n // 2) / 2.0) AS BIGINT) AS cut FROM p, range(0, 3) x(k)), "
    "v AS (SELECT *, least(greatest(CAST(floor((n - cut) / (4.0 - fold)) AS BIGINT), 10), n - cut) AS size FROM c) "
    f"SELECT p.series_id, {sday('ts')} AS d, fold, cut, CASE WHEN t < cut THEN 'train' ELSE 'test' END AS part FROM p JOIN v USING (series_id) WHERE cut >= 30 AND size >= 10 AND t < cut + size",
)
def _(spark, sf):
    # at the operator's 50 rows these series, some 80 months long, would lose their first fold
    f = splits.walk_forward(P.monthly(spark, sf), least_train=30)
    return f.select("series_id", day("ts").alias("d"), F.col("fold").cast("bigint").alias("fold"), F.col("cut").cast("bigint").alias("cut"), "part")


@query("spl7_random_calibration", f"SELECT event_id, CASE WHEN {uniform_sql(7, 'event_id')} < 0.2 THEN 'calibration' ELSE 'train' END AS split FROM events")
def _(spark, sf):
    return splits.random_share(table(spark, sf, "events"), 0.2, 7, ["event_id"], portable_uniform).select("event_id", "split")


@query("smp1_sample_rows", f"SELECT event_id, value FROM events ORDER BY {uniform_sql(11, 'event_id')}, event_id LIMIT 100")
def _(spark, sf):
    return splits.sample_rows(table(spark, sf, "events"), 100, 11, ["event_id"], portable_uniform).select("event_id", "value")


@query(
    "smp2_tail_sample",
    f"{P.ctes('wide')}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS i FROM wide) SELECT series_id, {sday('ts')} AS d, {sq('y', 4)} AS y FROM r WHERE i <= 3",
)
def _(spark, sf):
    return splits.tail_sample(P.wide(spark, sf), 3).select("series_id", day("ts").alias("d"), q("y", 4).alias("y"))
