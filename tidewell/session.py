"""Session settings and the shared folder used for lineage cuts and sinks."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tidewell", cores: int | str = 8, memory: str = "12g") -> SparkSession:
    """A single-JVM session for tests and benches; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one named in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder; on
    a cluster a machine-local folder would be lost with the machine.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="tidewell-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that lost executors do not replay an iteration."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


#: Rows of a partition that iterative work goes over, and partitions that are few enough for any table.
ROWS_PER_PART, FEW_PARTS = 200_000, 32


def spread(df: DataFrame, rows: int = ROWS_PER_PART) -> DataFrame:
    """A persisted or written table in partitions of about ``rows`` rows.

    A file of few bytes a row may come as one partition of millions of rows, which one task
    would have to hold; a small table in many partitions costs a task for each in every pass.
    """
    wanted, have = max(1, -(-df.count() // rows)), df.rdd.getNumPartitions()
    most = max(FEW_PARTS, 4 * wanted)
    return df.repartition(wanted) if have < wanted else df.coalesce(most) if have > most else df
