"""Source and sink queries (SRC*, SNK*): tables go out through a sink and come back through a reader."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tidewell.operators import models, monitor
from tidewell.operators import summary as sm
from tidewell.operators import windows as win
from tidewell.plans import panels as P
from tidewell.plans.registry import day, q, query, sday, sq, table
from tidewell.plans.summary_queries import METRIC_SQL
from tidewell.plans.uncertainty_queries import lag_frame
from tidewell.plans.window_queries import WSQL
from tidewell.session import scratch_path
from tidewell.sources import readers, writers


@query(
    "src1_load_series",
    f"{P.ctes('wide')} SELECT series_id, {sday('ts')} AS d, {sq('y', 4)} AS y FROM wide WHERE month(ts) NOT IN (1, 2)",
)
def _(spark, sf):
    w = P.wide(spark, sf)
    out = w.select(
        "series_id",
        F.when(F.month("ts") == 1, "not a date").otherwise(F.date_format(F.col("ts") + F.expr("INTERVAL 9 DAYS"), "yyyy-MM-dd")).alias("month"),
        F.when(F.month("ts") == 2, "n/a").otherwise(F.col("y").cast("string")).alias("mean_temp"),
    )
    path = writers.save_csv(out, scratch_path(spark, "series"))
    return readers.load_series(spark, path, extra=["series_id"]).select("series_id", day("ts").alias("d"), q("y", 4).alias("y"))


@query("src2_load_by_extension", "SELECT c_custkey, c_acctbal, 'parquet' AS kind FROM customer UNION ALL SELECT c_custkey, c_acctbal, 'json' FROM customer")
def _(spark, sf):
    path = writers.append_json(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), scratch_path(spark, "customer") + ".json")
    a = readers.load(spark, f"{sf}/customer.parquet").select("c_custkey", "c_acctbal", F.lit("parquet").alias("kind"))
    b = readers.load(spark, path, "c_custkey bigint, c_acctbal double").select("c_custkey", "c_acctbal", F.lit("json").alias("kind"))
    return a.unionByName(b)


@query("src3_load_indexed", f"SELECT {sday('o_orderdate')} AS d, o_totalprice AS price FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("when"), F.col("o_totalprice").alias("price"))
    path = writers.save_csv(o, scratch_path(spark, "indexed"))
    return readers.load_indexed(spark, path, "when", "when timestamp, price double").select(day("ts").alias("d"), "price")


HEADER = ("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("src4_header_columns", " UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT {c}) AS n FROM customer" for c in HEADER))
def _(spark, sf):
    path = writers.save_csv(table(spark, sf, "customer").select(*HEADER), scratch_path(spark, "customers"))
    names = readers.header_columns(spark, path)
    found = spark.read.option("header", True).csv(path).select(*names)
    return found.agg(*[F.countDistinct(c).alias(c) for c in names]).unpivot([], names, "name", "n")


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("src5_inventory", " UNION ALL ".join(f"SELECT '{t}.parquet' AS name, count(*) AS n FROM {t}" for t in TABLES))
def _(spark, sf):
    found = [r["path"] for r in readers.inventory(spark, sf, "*.parquet").select("path").collect()]
    rows = None
    for path in found:
        one = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).select(F.lit(path.rstrip("/").rsplit("/", 1)[-1]).alias("name"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query(
    "src6_union_tables",
    "SELECT 'orders' AS kind, count(*) AS n, CAST(NULL AS VARCHAR) AS segment FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'customers', count(*), c_mktsegment FROM customer GROUP BY c_mktsegment",
)
def _(spark, sf):
    a = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    pa = writers.save_csv(a, scratch_path(spark, "meta-orders"))
    pb = writers.save_csv(b, scratch_path(spark, "meta-customers"))
    u = readers.union_tables(spark, [pa, pb])
    return u.select(F.regexp_extract("source_file", r"meta-(\w+)-", 1).alias("kind"), F.col("n").cast("bigint").alias("n"), "segment")


@query("src7_registry", "SELECT p_brand AS key, count(*) AS parts, max(p_size)::BIGINT AS size FROM part GROUP BY 1")
def _(spark, sf):
    per = table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("parts"), F.max("p_size").cast("bigint").alias("size"))
    # one entry per brand: a registry document is as long as the list of names in it
    doc = per.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p_brand", F.struct("parts", "size"))))).alias("value"))
    path = scratch_path(spark, "registry")
    doc.coalesce(1).write.text(path)
    return readers.load_registry(spark, path, "struct<parts: bigint, size: bigint>").select("key", "value.*")


@query("src8_first_metrics_file", "SELECT doc_id, quality, toxic FROM labels")
def _(spark, sf):
    files = readers.inventory(spark, sf, "*.parquet")
    first = readers.first_match(files, [r"^model_test_metrics", r"^la.*\.parquet$", r".*"]).first()
    return spark.read.parquet(first["path"]).select("doc_id", "quality", "toxic")


@query("src9_sample_load", "SELECT count(*) AS n FROM (SELECT * FROM orders LIMIT 200)")
def _(spark, sf):
    return readers.load_sample(spark, f"{sf}/orders.parquet").agg(F.count(F.lit(1)).alias("n"))


@query(
    "src10_role_of_name",
    "SELECT page_id, CASE WHEN regexp_matches(lower(url), 'lgb|lightgbm|lgbm') THEN 'lgb' WHEN regexp_matches(lower(url), 'xgb|xgboost') THEN 'xgb' "
    "WHEN regexp_matches(lower(url), 'rf|randomforest|random_forest') THEN 'rf' WHEN regexp_matches(lower(url), 'cat|catboost') THEN 'cat' WHEN regexp_matches(lower(url), 'meta|stack') THEN 'meta' ELSE 'other' END AS role FROM pages",
)
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", readers.role_of(F.col("url")).alias("role"))


@query("snk1_features_csv", f"{P.ctes('wide')} SELECT series_id, {sday('ts')} AS d, y FROM wide")
def _(spark, sf):
    path = writers.save_csv(P.wide(spark, sf).select("series_id", day("ts").alias("d"), "y"), scratch_path(spark, "features-csv"))
    return spark.read.schema("series_id string, d string, y double").option("header", True).csv(path)


@query("snk2_parquet_copy", f"{P.ctes('wide')} SELECT series_id, {sday('ts')} AS d, y FROM wide")
def _(spark, sf):
    path = writers.save_parquet(P.wide(spark, sf).withColumn("year", F.year("ts")), scratch_path(spark, "copy"), ["year"])
    return spark.read.parquet(path).select("series_id", day("ts").alias("d"), "y")


@query(
    "snk3_append_log",
    f"{P.ctes('raw')}, m AS (SELECT series_id, avg(y) AS mean, max(y) AS max FROM raw GROUP BY 1) SELECT run, series_id, {sq('mean')} AS mean, max FROM m, (VALUES ('a'), ('b')) r(run)",
)
def _(spark, sf):
    path = scratch_path(spark, "log")
    for run in ("a", "b"):
        s = monitor.snapshot(P.raw(spark, sf), tie=("event_id",)).select(F.lit(run).alias("run"), "series_id", "metrics")
        writers.append_json(s, path)
    log = spark.read.schema("run string, series_id string, metrics map<string,double>").json(path)
    return log.select("run", "series_id", q(F.col("metrics")["mean"]).alias("mean"), F.col("metrics")["max"].alias("max"))


@query("snk4_json_summary", f"SELECT count(*) AS rows, {sq('min(o_totalprice)', 2)} AS low, {sq('max(o_totalprice)', 2)} AS high FROM orders")
def _(spark, sf):
    s = table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("rows"), q(F.min("o_totalprice"), 2).alias("low"), q(F.max("o_totalprice"), 2).alias("high"))
    path = writers.save_summary(s, scratch_path(spark, "summary"))
    return spark.read.schema("rows bigint, low double, high double").json(path)


@query(
    "snk5_key_value_metrics",
    f"{P.ctes('wide')}, {P.forecasts_sql('wide')}, {METRIC_SQL} SELECT model, k AS key, {sq('v', 4)} AS value FROM (UNPIVOT (SELECT model, mae, rmse, r2 FROM met) ON mae, rmse, r2 INTO NAME k VALUE v)",
)
def _(spark, sf):
    m = sm.regression_metrics(P.forecasts(P.wide(spark, sf)), ["model"])
    path = writers.save_csv(writers.key_values(m, ["model"], ["mae", "rmse", "r2"]), scratch_path(spark, "metrics"))
    return spark.read.schema("model string, key string, value double").option("header", True).csv(path).select("model", "key", q("value", 4).alias("value"))


ONE_LAG_SQL = (
    f"{P.ctes('monthly')}, f AS (SELECT series_id, ts, y, lag(y) OVER w AS x FROM monthly {WSQL}), k AS (SELECT * FROM f WHERE x IS NOT NULL), "
    f"c AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM k) SELECT series_id, {sday('ts')} AS d, {sq('a + b * x', 2)} AS prediction FROM k, c"
)


def one_lag(spark, sf):
    df = P.monthly(spark, sf).withColumns(win.lags(ks=(1,))).where("lag_1 IS NOT NULL")
    return df, models.on_features(models.linear(), ["lag_1"]).fit(df)


@query("snk6_model_round_trip", ONE_LAG_SQL)
def _(spark, sf):
    df, model = one_lag(spark, sf)
    path = writers.save_model(model, scratch_path(spark, "model"))
    back = writers.load_model(PipelineModel, path).transform(df)
    return back.select("series_id", day("ts").alias("d"), q("prediction", 2).alias("prediction"))


@query("snk7_predictions_file", ONE_LAG_SQL)
def _(spark, sf):
    df, model = one_lag(spark, sf)
    path = writers.save_predictions(model, df, scratch_path(spark, "predictions"), "pred_mean_temp")
    return spark.read.parquet(path).select("series_id", day("ts").alias("d"), q("pred_mean_temp", 2).alias("prediction"))
