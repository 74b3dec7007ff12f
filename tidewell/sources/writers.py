"""Sinks.  Each one writes with Spark's own committers, so a lost task is simply retried."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.util import MLReadable, MLWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_csv(df: DataFrame, path: str) -> str:
    """CSV with header; missing folders are created."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def save_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def append_json(df: DataFrame, path: str) -> str:
    """Append rows to a JSON-lines log."""
    df.write.mode("append").json(path)
    return path


def save_summary(df: DataFrame, path: str) -> str:
    """Summary rows as JSON, one document a row."""
    df.coalesce(1).write.mode("overwrite").json(path)
    return path


def key_values(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metric columns to (keys..., key, value) rows."""
    return df.unpivot(list(keys), [F.col(m).cast("double").alias(m) for m in metrics], "key", "value")


def save_model(model: MLWritable, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(kind: type[MLReadable], path: str):
    return kind.load(path)


def save_predictions(model, df: DataFrame, path: str, name: str = "pred") -> str:
    """Input columns plus the model's prediction."""
    drop = [c for c in ("features", "_predicted") if c not in df.columns]
    scored = model.transform(df).withColumnRenamed("prediction", name).drop(*drop)
    scored.write.mode("overwrite").parquet(path)
    return path
