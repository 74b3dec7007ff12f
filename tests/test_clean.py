"""Cleaning, schema detection, joins and splits on small messy inputs."""

import datetime as dt
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions.numbers import extract_number
from tidewell.operators import clean, relate, splits
from tidewell.plans import queries
from tidewell.sources import readers, writers


@pytest.mark.parametrize(
    "text, want",
    [
        ("12.5", 12.5), ("-5", -5.0), ("1e3", 1000.0), ("12%", 12.0), ("[3.1]", 3.1), ('{"a": 2}', 2.0), ('{"a": "x", "b": "7.5"}', 7.5),
        ('["a5", 7]', 5.0), ("about -.5 or so", -0.5), ("(3, 4)", 3.0), ("", None), ("none", None), (None, None), ('{"a": null}', None),
    ],
)
def test_extract_number(spark, text, want):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(extract_number(F.col("s"))).first()[0] == want


def test_detection(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, "2020-01-01")], "idx int, other double, air_temperature double, when string")
    assert clean.detect_target(df.schema) == "air_temperature"
    assert clean.detect_target(df.drop("air_temperature").schema, skip=("idx",)) == "other"
    assert clean.find_column(df.columns, ["TEMP", "WHEN"]) == "when"
    assert clean.detect_date(df.select("when", "other")) == "when"
    with pytest.raises(ValueError):
        clean.detect_date(df.select("other"))
    with pytest.raises(ValueError):
        clean.detect_target(df.select("when").schema)


def test_align_and_prefix(spark):
    df = spark.createDataFrame([(1, 2, True)], "num__b int, a int, flag boolean")
    assert clean.strip_prefixes(df).columns == ["b", "a", "flag"]
    out = clean.align_schema(df, ["a", "zz"], -1)
    assert out.columns == ["a", "zz"] and tuple(out.first()) == (2.0, -1.0)
    num = clean.numeric_projection(df, ["need"])
    assert num.columns == ["need", "num__b", "a", "flag"] and tuple(num.first()) == (0.0, 1.0, 2.0, 1.0)


def test_imputers_ties_and_empty(spark):
    df = spark.createDataFrame([(1.0, 2, None), (None, 1, None), (4.0, 1, None), (4.5, 2, None)], "a double, k int, e double")
    assert clean.fit_imputer(df, ["a"], "median")["a"] == 4.0
    assert clean.fit_imputer(df, ["k"], "most_frequent")["k"] == 1
    filled = clean.fill_median(df, ["a", "e"]).orderBy("a").toPandas()
    assert filled["a"].tolist() == [1.0, 4.0, 4.0, 4.5] and (filled["e"] == 0).all()


def test_grid_and_frequency(make_panel):
    p = make_panel({"a": [1, 2, 3, 4, 5, 6]}).where(F.month("ts") != 3)
    g = clean.regular_grid(p).orderBy("ts").toPandas()
    assert len(g) == 6 and np.isnan(g["y"][2])
    assert clean.infer_frequency(make_panel({"a": range(8)})).first()["freq"] == "MS"
    more = clean.repeat_last(p, 2).orderBy("ts").toPandas()
    assert more["ts"].tolist()[-2:] == [dt.datetime(2000, 7, 1), dt.datetime(2000, 8, 1)] and more["y"].tolist()[-2:] == [6, 6]


def test_contains_join_is_substring_search(spark):
    rng = np.random.default_rng(4)
    letters = list("abc")
    texts = ["".join(rng.choice(letters, 40)) for _ in range(30)]
    names = sorted({"".join(rng.choice(letters, int(rng.integers(2, 9)))) for _ in range(25)})
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    nm = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r["id"], r["name"]) for r in relate.contains_join(rows, "id", "text", nm, "name", q=4).collect()}
    assert got == {(i, n) for i, t in enumerate(texts) for n in names if n in t}


def test_folds_are_ordered_and_disjoint(make_panel):
    f = splits.expanding_folds(make_panel({"a": range(61), "b": range(7), "tiny": [1, 2]}), 5).toPandas()
    assert "tiny" not in set(f["series_id"])
    for (_, fold), g in f.groupby(["series_id", "fold"]):
        train, test = g[g.part == "train"]["t"], g[g.part == "test"]["t"]
        assert train.max() < test.min() and len(test) == g["n"].iloc[0] // 6
    tests = f[f.part == "test"].groupby("series_id")["t"].apply(list)
    assert all(len(t) == len(set(t)) for t in tests)


def test_walk_forward(make_panel):
    f = splits.walk_forward(make_panel({"a": range(120), "b": range(60)})).toPandas()
    assert set(f["series_id"]) == {"a"}  # the short one never has 50 training rows
    got = {(r.fold, r.cut): (sum(f[f.fold == r.fold].part == "train"), sum(f[f.fold == r.fold].part == "test")) for r in f.itertuples()}
    # cuts of linspace(60, 119, 3) as integers; the last one leaves a single row
    assert got == {(0, 60): (60, 15), (1, 89): (89, 10)}


def test_month_text_is_a_date(spark, tmp_path):
    path = writers.save_csv(spark.createDataFrame([("1982-01", 25.9), ("1982-02", 27.1)], "month string, mean_temp double"), str(tmp_path / "m"))
    got = readers.load_series(spark, path).orderBy("ts").collect()
    assert [r["ts"] for r in got] == [dt.datetime(1982, 1, 1), dt.datetime(1982, 2, 1)]


def test_sources_and_sinks(spark, make_panel, tmp_path):
    raw = spark.createDataFrame([("2020-02-17", "1.5"), ("bad", "2"), ("2020-01-03", "x"), ("2020-01-09", "0.5")], "month string, mean_temp string")
    path = writers.save_csv(raw, str(tmp_path / "sub" / "series"))
    got = readers.load_series(spark, path).orderBy("ts").collect()
    assert [(r["ts"], r["y"]) for r in got] == [(dt.datetime(2020, 1, 1), 0.5), (dt.datetime(2020, 2, 1), 1.5)]
    with pytest.raises(KeyError):
        readers.load_series(spark, path, y="absent")
    with pytest.raises(ValueError):
        readers.load(spark, "table.xlsx")
    with pytest.raises(ValueError):
        readers.load_sample(spark, "model.pkl")
    log = str(tmp_path / "log")
    writers.append_json(raw, log)
    writers.append_json(raw, log)
    assert spark.read.json(log).count() == 8


def test_role_precedence(spark):
    df = spark.createDataFrame([("stack_lgb.bin",), ("XGB.bin",), ("rf_x",), ("catboost",), ("meta1",), ("ridge",)], "n string")
    assert [r[0] for r in df.select(readers.role_of(F.col("n"))).collect()] == ["lgb", "xgb", "rf", "cat", "meta", "other"]


@pytest.mark.parametrize("name_bytes", [1 << 20, 0])
def test_contains_join_by_scan_and_by_pieces(spark, name_bytes):
    import random

    from tidewell.operators import relate

    rng = random.Random(5)
    names = ["abcdef", "abcdefgh", "bcdefa", "été-été", "日本語日本語", "a" * 20, "nowhere", None, "", "x\ny\nz\nx"]
    texts = ["".join(rng.choice(["abcdef", "gh", "a", "b", "été-", "日本語", " ", "x\ny\nz\n"]) for _ in range(rng.randint(0, 30))) for _ in range(80)] + ["a" * 25, "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(3)
    found = relate.contains_join(rows, "k", "text", spark.createDataFrame([(n,) for n in names * 2], "name string"), "name", 6, name_bytes)
    want = {(i, n) for i, t in enumerate(texts) for n in names if t and n and n in t}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 60


def test_inventory_lists_tables_kept_as_folders(spark, tmp_path):
    rows = spark.range(100).withColumnRenamed("id", "doc_id")
    rows.repartition(3).write.parquet(str(tmp_path / "labels.parquet"))
    rows.limit(5).coalesce(1).write.parquet(str(tmp_path / "one"))
    shutil.copy(next((tmp_path / "one").glob("part-*")), tmp_path / "nation.parquet")
    got = {r["name"]: r for r in readers.inventory(spark, str(tmp_path), "*.parquet").collect()}
    assert set(got) == {"labels.parquet", "nation.parquet"}  # not the parts, nor the folder that is no table
    parts = list((tmp_path / "labels.parquet").glob("part-*"))
    assert got["labels.parquet"]["size"] == sum(p.stat().st_size for p in parts)
    first = readers.first_match(readers.inventory(spark, str(tmp_path), "*.parquet"), [r"^none", r"^la.*\.parquet$"]).first()
    assert spark.read.parquet(first["path"]).count() == 100
    assert readers.inventory(spark, str(tmp_path), "{nat,oth}*.parquet").first()["name"] == "nation.parquet"


def test_walk_forward_query_keeps_folds_of_thirty_rows(spark, tmp_path):
    days = [dt.datetime(1994 + i // 12, i % 12 + 1, 3) for i in range(80)]
    spark.createDataFrame([("1-URGENT", d, 100.0 + i) for i, d in enumerate(days)], "o_orderpriority string, o_orderdate timestamp, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    got = queries()["spl5_walk_forward"](spark, str(tmp_path)).groupBy("fold", "cut", "part").count().collect()
    assert sorted(map(tuple, got)) == [(0, 40, "test", 10), (0, 40, "train", 40), (1, 59, "test", 10), (1, 59, "train", 59)]
