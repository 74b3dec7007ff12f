"""Monitoring an event stream: daily metrics, alerts and drift per micro-batch.

Both jobs keep their progress in a checkpoint below the shared folder and write
to replayable sinks, so a restart goes on where the last batch was committed.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.operators import drift, monitor


def read_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream: ``folder/pattern``, the schema taken from the files already there."""
    folder, pattern = os.path.split(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def daily_metrics(events: DataFrame, delay: str = "1 day", width: str = "1 day") -> DataFrame:
    """(series_id, day, n, mean, std, min, max, missing_rate) per closed window."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    grouped = stamped.groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("series_id"))
    return grouped.agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg(F.col("value").isNull().cast("double")).alias("missing_rate"),
    ).select("series_id", F.col("w.start").alias("day"), "n", "mean", "std", "min", "max", "missing_rate")


def alert_rows(metrics: DataFrame, thresholds=monitor.THRESHOLDS) -> DataFrame:
    """Alerts of a metrics stream, one row per metric above its limit."""
    names = [c for c in ("mean", "std", "min", "max", "missing_rate") if c in metrics.columns]
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return monitor.alerts(metrics.select("series_id", "day", F.inline(cells)), thresholds)


def write_closed(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to Parquet until the input is used up."""
    return (
        stream.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def drift_batches(events: DataFrame, reference: DataFrame, path: str, checkpoint: str, by: Sequence[str] = ("series_id",)) -> StreamingQuery:
    """Score every micro-batch against a reference table and append to the history.

    The batch number is part of the output path, so a replayed batch overwrites
    its own result instead of adding to it.
    """

    def score(batch: DataFrame, batch_id: int) -> None:
        both = batch.select(*by, "y").withColumn("_ref", F.lit(False)).unionByName(reference.select(*by, "y").withColumn("_ref", F.lit(True)))
        scores = drift.drift_score(both, "y", F.col("_ref"), list(by))
        scores.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return events.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(start: Callable[[], StreamingQuery]) -> None:
    query = start()
    query.awaitTermination()
