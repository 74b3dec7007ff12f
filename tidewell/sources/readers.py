"""Readers: series files, tables by extension, inventories and registries."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.numbers import to_number, to_time

FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "json", ".parquet": "parquet", ".orc": "orc"}


def load_series(spark: SparkSession, path: str, ts: str = "month", y: str = "mean_temp", extra: Sequence[str] = (), required: bool = True) -> DataFrame:
    """CSV of (date, value): bad rows dropped, dates cut to the month, renamed to (ts, y).

    Every column is read as text first, so one bad cell never fails the load.
    """
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in (ts, y) if c not in header]
    if missing and required:
        raise KeyError(f"columns missing from {path}: {missing}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    raw = spark.read.schema(schema).option("header", True).csv(path)
    when = to_time(F.col(ts)) if ts in header else F.lit(None).cast("timestamp")
    return (
        raw.select(*extra, F.date_trunc("month", when).alias("ts"), to_number(F.col(y)).alias("y"))
        .na.drop(subset=["ts", "y"])
    )


def load_indexed(spark: SparkSession, path: str, index: str, schema: str) -> DataFrame:
    """CSV whose index column is a date; the other columns come from the given schema."""
    return spark.read.schema(schema).option("header", True).csv(path).withColumnRenamed(index, "ts")


def load(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Read by file extension; spreadsheets have no public Spark reader."""
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    if extension not in FORMATS:
        raise ValueError(f"unsupported file format: {extension or path}")
    reader = spark.read.format(FORMATS[extension])
    if schema:
        reader = reader.schema(schema)
    if FORMATS[extension] == "csv":
        reader = reader.option("header", True).option("inferSchema", schema is None)
    return reader.load(path)


def load_sample(spark: SparkSession, path: str, rows: int = 200) -> DataFrame:
    """The first rows of a file, for a look at its columns."""
    if os.path.splitext(path)[1].lower() in (".pkl", ".pickle", ".npy", ".joblib"):
        raise ValueError("serialised Python objects are not read")
    return load(spark, path).limit(rows)


def header_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header alone."""
    return spark.read.option("header", True).csv(path).columns


def inventory(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(name, path, size, modified) of the files below a folder; contents are not read.

    A table that a writer left as a folder of part files, told by its extension, is one entry
    with the size of its parts; ``recursive`` lists the files in it instead.
    """
    def listed(glob: str, deep: bool) -> DataFrame:
        found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(deep).lower()).load(path)
        return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))

    files = listed(pattern, recursive)
    if not recursive:
        root = re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "", path).rstrip("/")
        table = rf"^(.*?{re.escape(root)}/[^/]+({'|'.join(map(re.escape, FORMATS))}))/"
        # the pattern is for the names of entries, so parts of any name count
        parts = listed("*", True).withColumn("path", F.regexp_extract("path", table, 1)).where("path <> ''")
        parts = parts.where(F.element_at(F.split("path", "/"), -1).rlike(_glob_regex(pattern)))
        files = files.unionByName(parts.groupBy("path").agg(F.sum("size").alias("size"), F.max("modified").alias("modified")))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "size", "modified")


def _glob_regex(pattern: str) -> str:
    """A file name pattern with ``* ? [] {}`` as a regular expression."""
    out = re.sub(r"[.^$+()|\\]", lambda m: "\\" + m.group(), pattern).replace("*", ".*").replace("?", ".").replace("[!", "[^")
    return "^" + re.sub(r"\{([^}]*)\}", lambda m: f"(?:{m.group(1).replace(',', '|')})", out) + "$"


def union_tables(spark: SparkSession, paths: Sequence[str], tag: str = "source_file") -> DataFrame:
    """CSV files stacked by column name, each row tagged with its file path."""
    frames = [spark.read.option("header", True).csv(p).withColumn(tag, F.col("_metadata.file_path")) for p in paths]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def first_match(files: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """The one file that matches the earliest pattern (regex on the name), ties by path."""
    rank = F.coalesce(*[F.when(F.col("name").rlike(p), F.lit(i)) for i, p in enumerate(patterns)])
    return files.withColumn("priority", rank).where("priority IS NOT NULL").orderBy("priority", "path").limit(1)


def load_registry(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """JSON object keyed by name -> one row (key, value struct) per entry."""
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", f"map<string, {value_schema}>")
    return text.select(F.explode(entries).alias("key", "value"))


# Words in a file name that tell the kind of model it holds, in order of precedence.
ROLE_WORDS = (
    ("lgb", ("lgb", "lightgbm", "lgbm")),
    ("xgb", ("xgb", "xgboost")),
    ("rf", ("rf", "randomforest", "random_forest")),
    ("cat", ("cat", "catboost")),
    ("meta", ("meta", "stack")),
)


def role_of(name: Column) -> Column:
    lowered = F.lower(name)
    out = None
    for role, words in ROLE_WORDS:
        hit = lowered.rlike("|".join(words))
        out = F.when(hit, role) if out is None else out.when(hit, role)
    return out.otherwise("other")
