"""Augmented copies of series.  All randomness comes from row keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.draws import Draw, gaussian, uniform
from tidewell.operators.sequences import sliding_windows
from tidewell.panel import BY, with_position

KEYS = ("series_id", "ts")


def noise(df: DataFrame, share: float = 0.1, seed: int = 42, y="y", by=BY, keys: Sequence[str] = KEYS, draw: Draw = uniform) -> DataFrame:
    """Gaussian noise of ``share`` population deviations; the deviation is a grouped sum, so series may be of any length."""
    spread = df.groupBy(*by).agg(F.stddev_pop(y).alias("_sd"))
    return df.join(spread, list(by)).withColumn(y, F.col(y) + share * F.col("_sd") * gaussian(seed, list(keys), draw)).drop("_sd")


def time_warp(df: DataFrame, factor: Column, y="y", by=BY, order=("ts",)) -> DataFrame:
    """(by..., i, y): each series resampled to int(n * factor) points by linear interpolation."""
    pos = with_position(df, by, order, count=True).select(*by, "t", "n", F.col(y).alias("_y"))
    sized = pos.groupBy(*by).agg(F.max("n").alias("n")).withColumn("m", F.floor(F.col("n") * factor).cast("int")).where("m > 0")
    points = sized.select(*by, "n", "m", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i"))
    place = F.when(F.col("m") > 1, F.col("i") * (F.col("n") - 1) / (F.col("m") - 1)).otherwise(0.0)
    points = points.withColumns({"_x": place}).withColumns({"_a": F.floor("_x"), "_b": F.ceil("_x")})
    low = pos.select(*by, F.col("t").cast("bigint").alias("_a"), F.col("_y").alias("_ya"))
    high = pos.select(*by, F.col("t").cast("bigint").alias("_b"), F.col("_y").alias("_yb"))
    out = points.join(low, [*by, "_a"]).join(high, [*by, "_b"])
    return out.select(*by, "i", (F.col("_ya") + (F.col("_yb") - F.col("_ya")) * (F.col("_x") - F.col("_a"))).alias(y))


def warp_factor(spread: float = 0.2, seed: int = 42, by=BY, draw: Draw = uniform) -> Column:
    return 1 + spread * (2 * draw(seed, list(by)) - 1)


def scale(df: DataFrame, spread: float = 0.1, seed: int = 42, y="y", by=BY, draw: Draw = uniform) -> DataFrame:
    """One factor 1 +- spread per series."""
    return df.withColumn(y, F.col(y) * (1 + spread * (2 * draw(seed, list(by)) - 1)))


def dropout(df: DataFrame, p: float = 0.1, seed: int = 42, y="y", keys: Sequence[str] = KEYS, draw: Draw = uniform) -> DataFrame:
    return df.withColumn(y, F.when(draw(seed, list(keys)) > p, F.col(y)).otherwise(0.0))


# Chance of noise, warp, scale and dropout when the kind is drawn step by step at 1/4, 1/2, 3/4, rest.
ODDS = (("noise", 0.25), ("warp", 0.375), ("scale", 0.28125), ("dropout", 0.09375))


def random_copies(df: DataFrame, copies: int, seed: int = 42, y="y", by=BY, draw: Draw = uniform) -> DataFrame:
    """(by..., copy, kind, i, y): n copies per series, each with a kind drawn by the real odds."""
    base = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    u, cum, kind = draw(seed, [*by, "copy"]), 0.0, F
    for name, odds in ODDS[:-1]:
        cum += odds
        kind = kind.when(u < cum, name)
    base = base.withColumn("kind", kind.otherwise(ODDS[-1][0]))
    keys = [*by, "copy"]
    flat = base.where("kind <> 'warp'")
    made = noise(flat.where("kind = 'noise'"), 0.1, seed + 1, y, keys, [*keys, "ts"], draw)
    made = made.unionByName(scale(flat.where("kind = 'scale'"), 0.1, seed + 1, y, keys, draw))
    made = made.unionByName(dropout(flat.where("kind = 'dropout'"), 0.1, seed + 1, y, [*keys, "ts"], draw))
    made = with_position(made, keys).select(*keys, "kind", F.col("t").alias("i"), y)
    warped = time_warp(base.where("kind = 'warp'"), warp_factor(0.2, seed + 1, keys, draw), y, keys)
    return made.unionByName(warped.withColumn("kind", F.lit("warp")).select(*keys, "kind", F.col("i").alias("i"), y))


def bootstrap_windows(df: DataFrame, samples: int, width: int = 12, jitter: float = 0.05, seed: int = 42, y="y", by=BY, draw: Draw = uniform) -> DataFrame:
    """(by..., sample, start, window): windows drawn with replacement, with a small jitter."""
    sized = df.groupBy(*by).agg(F.count(y).alias("n"), F.stddev_pop(y).alias("sd")).where(F.col("n") >= width)
    drawn = sized.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    start = F.floor(draw(seed, [*by, "sample"]) * (F.col("n") - width + 1))
    picked = drawn.withColumn("start", start).join(sliding_windows(df, width, y=y, by=by), [*by, "start"])
    moved = F.transform("window", lambda v, i: v + jitter * F.col("sd") * gaussian(seed + 1, [*[F.col(k) for k in by], F.col("sample"), i], draw))
    return picked.select(*by, "sample", "start", moved.alias("window"))
