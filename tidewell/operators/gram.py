"""Least squares from grouped sums.

One shuffle of p(p+1)/2 sums per group (combined map-side, so a hot group costs
no more than any other) and a p x p solve per group, batched over Arrow.  The
same job fits one model per series, per fold, per bootstrap draw or per grid cell.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def gram_sums(df: DataFrame, by: Sequence[str], xs: Sequence[Column], y: Column, weight: Column | None = None) -> DataFrame:
    """Per group: n, xtx (row-major p x p), xty, yy."""
    w = F.lit(1.0) if weight is None else weight
    p = len(xs)
    cols = {f"_x{i}": x.cast("double") for i, x in enumerate(xs)}
    base = df.select(*by, *[c.alias(k) for k, c in cols.items()], y.cast("double").alias("_y"), w.cast("double").alias("_w"))
    sums = {}
    for i in range(p):
        wx = F.col("_w") * F.col(f"_x{i}")
        for j in range(i, p):
            sums[f"_g{i}_{j}"] = F.sum(wx * F.col(f"_x{j}"))
        sums[f"_r{i}"] = F.sum(wx * F.col("_y"))
    agg = base.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("_w").alias("sum_w"),
        F.sum(F.col("_w") * F.col("_y") * F.col("_y")).alias("yy"),
        *[c.alias(k) for k, c in sums.items()],
    )
    xtx = F.array(*[F.col(f"_g{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)])
    xty = F.array(*[F.col(f"_r{i}") for i in range(p)])
    return agg.select(*by, "n", "sum_w", "yy", xtx.alias("xtx"), xty.alias("xty"))


def weighted_sums(df: DataFrame, weights: Column, xs: Sequence[Column], y: Column, out: str = "b") -> DataFrame:
    """The same sums for many weightings of the same rows: one row per place (from 1) of the array ``weights``.

    No row is copied: a batch multiplies its weights with its products as matrices and passes on
    one line per weighting.
    """
    p = len(xs)
    base = df.select(weights.cast("array<double>").alias("_w"), *[x.cast("double").alias(f"_x{i}") for i, x in enumerate(xs)], y.cast("double").alias("_y"))
    names = ["n", "sum_w", "yy", *[f"_g{i}_{j}" for i in range(p) for j in range(i, p)], *[f"_r{i}" for i in range(p)]]

    def add(batches):
        for pdf in batches:
            if len(pdf):
                w = np.vstack(pdf["_w"].to_numpy())
                x, t = pdf[[f"_x{i}" for i in range(p)]].to_numpy(float), pdf["_y"].to_numpy(float)
                cells = [t * t, *[x[:, i] * x[:, j] for i in range(p) for j in range(i, p)], *[x[:, i] * t for i in range(p)]]
                sums = np.column_stack([(w > 0).sum(0), w.sum(0), w.T @ np.column_stack(cells)])
                yield pd.DataFrame({out: np.arange(1, w.shape[1] + 1, dtype=np.int32)} | {c: sums[:, i] for i, c in enumerate(names)})

    agg = base.mapInPandas(add, f"{out} int, " + ", ".join(f"{c} double" for c in names)).groupBy(out).agg(*[F.sum(c).alias(c) for c in names])
    xtx = F.array(*[F.col(f"_g{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)])
    return agg.select(out, F.col("n").cast("bigint").alias("n"), "sum_w", "yy", xtx.alias("xtx"), F.array(*[F.col(f"_r{i}") for i in range(p)]).alias("xty"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(xtx: pd.Series, xty: pd.Series, penalty: pd.Series) -> pd.Series:
    """Scaled pseudo-inverse solve of each row's normal equations."""
    if len(xtx) == 0:
        return pd.Series([], dtype=object)
    b = np.stack(xty.to_numpy()).astype(float)
    p = b.shape[1]
    a = np.stack(xtx.to_numpy()).astype(float).reshape(-1, p, p) + np.stack(penalty.to_numpy()).reshape(-1, p)[:, :, None] * np.eye(p)
    scale = np.sqrt(np.maximum(np.einsum("kii->ki", a), 1e-300))
    inverse = np.linalg.pinv(a / scale[:, :, None] / scale[:, None, :], rcond=1e-13, hermitian=True)
    return pd.Series(list(np.einsum("kij,kj->ki", inverse, b / scale) / scale))


def solve(sums: DataFrame, penalty: Sequence[float | Column] | None = None, out: str = "beta") -> DataFrame:
    """Coefficients per group; ``penalty`` is added to the diagonal."""
    if penalty is None:
        pen = F.transform("xty", lambda _: F.lit(0.0))
    else:
        pen = F.array(*[p if isinstance(p, Column) else F.lit(float(p)) for p in penalty])
    return sums.withColumn(out, _solve("xtx", "xty", pen))


def dot(beta: Column, xs: Sequence[Column]) -> Column:
    total = beta[0] * xs[0]
    for i, x in enumerate(xs[1:], 1):
        total = total + beta[i] * x
    return total


def sse(beta: Column, xtx: Column, xty: Column, yy: Column, p: int) -> Column:
    """Residual sum of squares of a solution, from the sums alone."""
    quad = F.lit(0.0)
    for i in range(p):
        for j in range(p):
            quad = quad + beta[i] * beta[j] * xtx[i * p + j]
    return yy - 2 * dot(beta, [xty[i] for i in range(p)]) + quad


def fit_linear(df: DataFrame, by: Sequence[str], features: Sequence[str], label: str = "y", l2: float = 0.0, weight: Column | None = None) -> DataFrame:
    """Linear or ridge model with intercept per group: (by..., n, beta), intercept first and not penalised."""
    xs = [F.lit(1.0)] + [F.col(f) for f in features]
    sums = gram_sums(df.na.drop(subset=[*features, label]), by, xs, F.col(label), weight)
    return solve(sums, [0.0] + [l2] * len(features)).select(*by, "n", "beta")


def predict_linear(df: DataFrame, models: DataFrame, by: Sequence[str], features: Sequence[str], out: str = "yhat") -> DataFrame:
    joined = df.join(models.select(*by, "beta"), list(by), "left")
    return joined.withColumn(out, dot(F.col("beta"), [F.lit(1.0)] + [F.col(f) for f in features])).drop("beta")
