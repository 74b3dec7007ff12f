"""Sliding windows as rows: sequences, templates and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import arrays
from tidewell.functions.numbers import correlation
from tidewell.operators import quantiles as qt
from tidewell.panel import BY, over, with_position


def sliding_windows(df: DataFrame, width: int, stride: int = 1, y="y", by=BY, order=("ts",), normalise: bool = False) -> DataFrame:
    """(series, start, stop, window): windows with a missing value are left out.

    Long series first go through ``panel.split_series`` with ``after=width-1``
    and pass the part column in ``by``.
    """
    ahead = F.collect_list(y).over(over(by, order).rowsBetween(0, width - 1))
    pos = df if "t" in df.columns else with_position(df, by, order)
    out = pos.withColumn("window", ahead).where((F.size("window") == width) & (F.col("t") % stride == 0))
    keep = [c for c in ("is_halo",) if c in df.columns]
    window = arrays.z_norm(F.col("window")) if normalise else F.col("window")
    return out.select(*by, *keep, F.col("t").alias("start"), (F.col("t") + width - 1).alias("stop"), window.alias("window"))


def supervised(df: DataFrame, width: int, horizon: int = 1, y="y", by=BY, order=("ts",)) -> DataFrame:
    """(series, start, x, target): ``width`` values and the next value, or array of next values."""
    w = over(by, order)
    pos = df if "t" in df.columns else with_position(df, by, order)
    out = pos.withColumns({"x": F.collect_list(y).over(w.rowsBetween(0, width - 1)), "target": F.collect_list(y).over(w.rowsBetween(width, width + horizon - 1))})
    out = out.where((F.size("x") == width) & (F.size("target") == horizon))
    target = F.col("target")[0] if horizon == 1 else F.col("target")
    return out.select(*by, F.col("t").alias("start"), "x", target.alias("target"))


def multivariate(df: DataFrame, features: Sequence[str], width: int, y="y", by=BY, order=("ts",)) -> DataFrame:
    """(series, start, x, target) with x an array of feature vectors; rows with a gap are left out."""
    w = over(by, order)
    pos = df if "t" in df.columns else with_position(df, by, order)
    whole = F.lit(True)
    for f in features:
        whole = whole & F.col(f).isNotNull()
    vector = F.when(whole, F.array(*[F.col(f).cast("double") for f in features]))
    out = pos.withColumn("_v", vector).withColumns({"x": F.collect_list("_v").over(w.rowsBetween(0, width - 1)), "target": F.lead(y, width).over(w)})
    out = out.where((F.size("x") == width) & F.col("target").isNotNull())
    return out.select(*by, F.col("t").alias("start"), "x", "target")


def last_value(x: Column) -> Column:
    """Persistence forecast of a sequence."""
    return F.element_at(x, -1)


def templates(windows: DataFrame, by: Sequence[str] = (), window="window") -> DataFrame:
    """Mean and exact median per position over all windows: (by..., pos, mean, median)."""
    cells = windows.select(*by, F.posexplode(window).alias("pos", "v"))
    mean = cells.groupBy(*by, "pos").agg(F.avg("v").alias("mean"))
    return mean.join(qt.quantile_columns(cells, "v", {"median": 0.5}, [*by, "pos"]), [*by, "pos"])


def cells(sequences: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per (sequence, position, feature)."""
    steps = sequences.select(*keys, F.posexplode("x").alias("pos", "v"))
    return steps.select(*keys, "pos", F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col("v")[i].alias("value")) for i, n in enumerate(names)])))


def profile(sequences: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean and population deviation per position and feature."""
    c = cells(sequences, names, [])
    return c.groupBy("pos", "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def target_link(sequences: DataFrame, names: Sequence[str]) -> DataFrame:
    """|correlation| of every position and feature with the target."""
    c = cells(sequences, names, ["target"])
    return c.groupBy("pos", "feature").agg(F.abs(correlation("value", "target")).alias("abs_r"))


def complexity(sequences: DataFrame, width: int, features: int) -> Column:
    """Population deviation over time, averaged over the features of a sequence."""

    def one(i: int) -> Column:
        return arrays.std(F.transform("x", lambda v: v[i]))

    return sum((one(i) for i in range(1, features)), one(0)) / features


def feature_means(width: int, features: int) -> Column:
    """Mean over features per position of a sequence."""
    return F.transform("x", arrays.mean)
