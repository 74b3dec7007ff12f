"""Training code given as Python functions, one bounded group of rows at a time.

A train function takes the feature frame and the target of a group and returns something with
``predict(features)``.  Groups are bootstrap draws or folds; Spark deals the rows, every group
is one task, and its size is checked against a parameter before anything is trained.  A
function that fails gives its error text and no predictions; the other groups go on.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.draws import Draw, poisson_one, uniform
from tidewell.operators import splits
from tidewell.panel import BY

#: Rows of a group, repeated ones counted, that a task may hold unless the caller says more.
MOST_ROWS = 1_000_000

Trainer = Callable[[pd.DataFrame, pd.Series], object]


def train_and_predict(rows: DataFrame, by: Sequence[str], trainers: Mapping[str, Trainer], features: Sequence[str], y: str = "y", keep: Sequence[str] = ("series_id", "ts"), weight: str | None = None, most_rows: int = MOST_ROWS) -> DataFrame:
    """(by..., keep..., model, y, yhat, error) for the rows whose ``part`` is "test".

    Every group trains each function on its rows whose ``part`` is "train", each as often as
    ``weight`` says.  Groups of more than ``most_rows`` rows are refused before training.
    """
    times = F.when(F.col("part") == "train", F.col(weight) if weight else F.lit(1)).otherwise(1)
    largest = rows.groupBy(*by).agg(F.sum(times).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > most_rows:
        raise ValueError(f"a group has {largest} rows; most_rows is {most_rows}")
    names, wanted = list(trainers), dict(trainers)
    columns = list(dict.fromkeys([*by, *keep]))
    narrow = rows.select(*columns, *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)], F.col(y).cast("double").alias("_y"), (F.col("part") == "train").alias("_train"), times.cast("int").alias("_w"))
    fields = [narrow.schema[c] for c in columns]
    layout = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", model string, y double, yhat double, error string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # a fixed order, so that a repeated task trains on the same frame
        pdf = pdf.sort_values([*columns, *[f"_f{i}" for i in range(len(features))], "_y"], kind="stable")
        train, test = pdf[pdf["_train"]], pdf[~pdf["_train"]]
        train = train.loc[np.repeat(train.index.to_numpy(), train["_w"].to_numpy())]
        inputs = {f"_f{i}": f for i, f in enumerate(features)}
        x, given = (p[list(inputs)].rename(columns=inputs).reset_index(drop=True) for p in (train, test))
        target = train["_y"].reset_index(drop=True).rename(y)
        out = []
        for name in names:
            part = test[columns].reset_index(drop=True).assign(model=name, y=test["_y"].to_numpy(), yhat=np.nan, error=None)
            if len(part):
                try:
                    part["yhat"] = np.asarray(wanted[name](x, target).predict(given), float)
                except Exception as failed:
                    part["error"] = f"{type(failed).__name__}: {failed}"
            out.append(part)
        return pd.concat(out)

    scored = narrow.groupBy(*by).applyInPandas(run, layout)
    return scored.withColumn("yhat", F.nanvl("yhat", F.lit(None).cast("double")))


def bootstrap_intervals(train: DataFrame, points: DataFrame, features: Sequence[str], model_fn: Trainer, n_boot: int = 100, seed: int = 42, keys: Sequence[str] = ("series_id", "ts"), y: str = "y", draw: Draw = uniform, most_rows: int = MOST_ROWS) -> DataFrame:
    """(keys..., lower, median, upper, fits): 2.5, 50 and 97.5 percent of each point's predictions by ``n_boot`` refits.

    A draw repeats each training row by a Poisson count of its keys.  ``fits`` counts the refits
    that gave the point a prediction.
    """
    every = F.explode(F.sequence(F.lit(1), F.lit(n_boot)))
    taken = train.select(*keys, *features, y).withColumn("b", every).withColumn("_times", poisson_one(seed, [*keys, "b"], draw)).where("_times > 0").withColumn("part", F.lit("train"))
    asked = points.select(*keys, *features).withColumn(y, F.lit(None).cast("double")).withColumn("b", every).withColumns({"_times": F.lit(1), "part": F.lit("test")})
    scored = train_and_predict(taken.unionByName(asked), ["b"], {"model": model_fn}, features, y, keys, "_times", most_rows)
    limits = F.percentile("yhat", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    out = scored.groupBy(*keys).agg(limits.alias("_q"), F.count("yhat").alias("fits"))
    return out.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(("lower", "median", "upper"))], "fits")


def fold_predictions(df: DataFrame, features: Sequence[str], trainers: Sequence[tuple[str, Trainer]], k: int = 5, y: str = "y", by=BY, order=("ts",), keep: Sequence[str] = ("series_id", "ts"), folds: Callable[..., DataFrame] = splits.expanding_folds, most_rows: int = MOST_ROWS) -> DataFrame:
    """(keep..., fold, model, y, yhat, error): out-of-fold predictions of (name, train function) pairs."""
    folded = folds(df.na.drop(subset=[*features, y]), k, by, order)
    return train_and_predict(folded, ["fold"], dict(trainers), features, y, keep, None, most_rows).select(*keep, "fold", "model", "y", "yhat", "error")


class Constant:
    """What the mean and the median model return."""

    def __init__(self, value: float):
        self.value = value

    def predict(self, x: pd.DataFrame) -> np.ndarray:
        return np.full(len(x), self.value)


class ThroughOrigin:
    """y = b x of the first feature."""

    def __init__(self, slope: float):
        self.slope = slope

    def predict(self, x: pd.DataFrame) -> np.ndarray:
        return self.slope * x.iloc[:, 0].to_numpy()


def mean_model(x: pd.DataFrame, y: pd.Series) -> Constant:
    return Constant(float(y.mean()))


def origin_model(x: pd.DataFrame, y: pd.Series) -> ThroughOrigin:
    v = x.iloc[:, 0].to_numpy()
    return ThroughOrigin(float(v @ y.to_numpy() / (v @ v)))
