"""Top-k reports, time-ordered splits, folds and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.draws import Draw, uniform
from tidewell.operators import windows as win
from tidewell.panel import BY, with_position


def extremes(df: DataFrame, k: int, y="y", hottest: bool = True, ties: Sequence[str] = ("ts",)) -> DataFrame:
    """The k highest (or lowest) rows of the table; ties in ``ties`` order."""
    return df.orderBy(F.desc(y) if hottest else F.asc(y), *ties).limit(k)


def largest_abs(df: DataFrame, k: int, value: str, ties: Sequence[str]) -> DataFrame:
    """Rows of the k largest absolute values with their rank."""
    top = df.orderBy(F.desc(F.abs(value)), *ties).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.abs(value)), *ties)))


def leaderboard(metrics: DataFrame, by_metric: str, ties: Sequence[str] = ("model",)) -> DataFrame:
    """Models in order of a metric, lowest first, with rank (one row per model)."""
    return metrics.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(by_metric, *ties)))


def tag_last(df: DataFrame, n: int, by=BY, order=("ts",)) -> DataFrame:
    """``split`` = test for the last n rows of a series, train before."""
    if n < 1:
        raise ValueError("the test part needs at least one row")
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("split", F.when(F.row_number().over(w) <= n, "test").otherwise("train"))


def tag_at(df: DataFrame, first_test: Column, by=BY, order=("ts",)) -> DataFrame:
    """Split at a position computed from the series length ``n``."""
    out = with_position(df, by, order, count=True)
    return out.withColumn("split", F.when(F.col("t") >= first_test, "test").otherwise("train"))


def test_share(share: float) -> Column:
    """First test position when ceil(share n), at least one, rows are test."""
    return F.col("n") - F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(share)))


def train_share(share: float = 0.8) -> Column:
    return F.floor(F.col("n") * F.lit(share))


def holdout_rule(rows: int = 74, least: int = 84, share: float = 0.15) -> Column:
    """A fixed holdout for long series, a rounded share (half to even) for short ones."""
    short = F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(share)).cast("int"))
    return F.col("n") - F.when(F.col("n") >= least, F.lit(rows)).otherwise(short)


def calibration_tail(share: float = 0.15) -> Column:
    return F.floor(F.col("n") * F.lit(1 - share))


def expanding_folds(df: DataFrame, k: int = 5, by=BY, order=("ts",)) -> DataFrame:
    """Each row once per fold it belongs to: (fold, part) with part train or test.

    Fold i of k tests n//(k+1) rows and trains on everything before them.
    """
    out = with_position(df, by, order, count=True)
    size = F.floor(F.col("n") / (k + 1))
    out = out.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    start = F.col("n") - (F.lit(k + 1) - F.col("fold")) * size
    part = F.when(F.col("t") < start, "train").when(F.col("t") < start + size, "test")
    return out.withColumn("part", part).where(F.col("part").isNotNull() & (size > 0))


def dated_folds(df: DataFrame, k: int = 5, by=BY, order=("ts",)) -> DataFrame:
    """The same with cuts at dates that all series share: no fold trains on a date that it tests, or on a later one.

    The distinct dates, one row per calendar step, are numbered once; fold i tests a stretch of
    n//(k+1) of them.  ``by`` does not matter, it is there for callers that swap the two.
    """
    date = order[0]
    dates = df.select(F.col(date).alias("_date")).where("_date IS NOT NULL").distinct()
    one = Window.partitionBy(F.lit(0))
    dates = dates.withColumns({"_at": F.row_number().over(one.orderBy("_date")) - 1, "_dates": F.count(F.lit(1)).over(one)})
    out = df.join(dates, df[date] == F.col("_date")).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    size = F.floor(F.col("_dates") / (k + 1))
    start = F.col("_dates") - (F.lit(k + 1) - F.col("fold")) * size
    part = F.when(F.col("_at") < start, "train").when(F.col("_at") < start + size, "test")
    return out.withColumn("part", part).where(F.col("part").isNotNull() & (size > 0)).drop("_date", "_at", "_dates")


def walk_forward(df: DataFrame, points: int = 3, least_train: int = 50, least_val: int = 10, by=BY, order=("ts",)) -> DataFrame:
    """(fold, cut, part): train on everything before a cut, test on a stretch after it.

    Cuts lie evenly from half the series to its last row.  The stretch is the
    remaining length over the folds still to come plus one, at least
    ``least_val`` rows; folds that end up too short on either side are left out.
    """
    out = with_position(df, by, order, count=True)
    out = out.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    half = F.floor(F.col("n") / 2)
    cut = F.floor(half + F.col("fold") * (F.col("n") - 1 - half) / float(max(points - 1, 1)))
    left = F.col("n") - F.col("cut")
    size = F.least(F.greatest(F.floor(left / (points - F.col("fold") + 1)), F.lit(least_val)), left)
    out = out.withColumn("cut", cut).withColumn("_size", size)
    usable = (F.col("cut") >= least_train) & (F.col("_size") >= least_val) & (F.col("t") < F.col("cut") + F.col("_size"))
    return out.where(usable).withColumn("part", F.when(F.col("t") < F.col("cut"), "train").otherwise("test")).drop("_size")


def random_share(df: DataFrame, share: float, seed: int, keys: Sequence[str], draw: Draw = uniform) -> DataFrame:
    """Stable random split by a hash of the row key: no sort, same rows every run."""
    return df.withColumn("split", F.when(draw(seed, keys) < share, "calibration").otherwise("train"))


def sample_rows(df: DataFrame, n: int, seed: int, keys: Sequence[str], draw: Draw = uniform) -> DataFrame:
    """n rows without replacement, chosen by a seeded hash of the row key (a top-n, not a sort)."""
    return df.orderBy(draw(seed, keys), *keys).limit(n)


tail_sample = win.tail_rows
