"""Distribution drift between a reference part and a new part."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.distribution import kolmogorov_tail, student_tail
from tidewell.functions.draws import uniform
from tidewell.functions.numbers import safe_ratio
from tidewell.operators import quantiles as qt


def ks_statistic(df: DataFrame, value: str, is_ref: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by..., ks, n_ref, n_new, ks_p): largest gap of the two running shares."""
    tagged = df.select(*by, value, is_ref.alias("_r"))
    sums = {"a": F.col("_r").cast("bigint"), "b": (~F.col("_r")).cast("bigint")}
    c = qt.cumulative_counts(tagged, value, sums, by)
    gap = F.abs(safe_ratio(F.col("a_cum"), F.col("a_total"), None) - safe_ratio(F.col("b_cum"), F.col("b_total"), None))
    out = c.groupBy(*by).agg(F.max(gap).alias("ks"), F.max("a_total").alias("n_ref"), F.max("b_total").alias("n_new"))
    return out.withColumn("ks_p", kolmogorov_tail(F.col("ks"), F.col("n_ref").cast("double"), F.col("n_new").cast("double")))


def wasserstein(df: DataFrame, value: str, is_ref: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by..., wasserstein, n_ref, n_new): area between the two running shares.

    Both running sums and the next distinct value are carried from bin to bin, so each gap
    between neighbouring values is weighed where it begins; nothing is sorted globally.  A
    group with one part only has no distance.
    """
    tagged = df.select(*by, value, is_ref.alias("_r"))
    sums = {"a": F.col("_r").cast("bigint"), "b": (~F.col("_r")).cast("bigint")}
    c = qt.cumulative_counts(tagged, value, sums, by, following="_after")
    gap = F.abs(safe_ratio(F.col("a_cum"), F.col("a_total"), None) - safe_ratio(F.col("b_cum"), F.col("b_total"), None))
    area = F.sum(F.when(F.col("_after").isNull() & gap.isNotNull(), 0.0).otherwise(gap * (F.col("_after") - F.col(value))))
    return c.groupBy(*by).agg(area.alias("wasserstein"), F.max("a_total").alias("n_ref"), F.max("b_total").alias("n_new"))


def t_test(df: DataFrame, value: str, is_ref: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by..., t, t_p, and the moments of both parts): pooled two-sample test in one pass."""
    a, b = F.when(is_ref, F.col(value)), F.when(~is_ref, F.col(value))
    m = df.groupBy(*by).agg(
        F.count(a).alias("na"), F.count(b).alias("nb"), F.avg(a).alias("ma"), F.avg(b).alias("mb"),
        F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"), F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb"),
    )
    dof = F.when((F.col("na") > 1) & (F.col("nb") > 1), F.col("na") + F.col("nb") - 2)
    pooled = ((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / dof
    spread = F.sqrt(pooled * (1 / F.nullif(F.col("na"), F.lit(0)) + 1 / F.nullif(F.col("nb"), F.lit(0))))
    t = safe_ratio(F.col("ma") - F.col("mb"), spread, None)
    return m.withColumn("t", t).withColumn("t_p", student_tail(F.col("t"), dof.cast("double")))


def drift_score(df: DataFrame, value: str, is_ref: Column, by: Sequence[str] = (), level: float = 0.05) -> DataFrame:
    """Mean of 1 - p (both tests) and the normalised shifts of mean and deviation, capped at 1."""
    ks, tt = ks_statistic(df, value, is_ref, by), t_test(df, value, is_ref, by)
    both = qt.attach(ks, tt, by)
    sd = F.nullif(F.col("sa"), F.lit(0.0))
    mean_shift = F.least(F.coalesce(F.abs(F.col("ma") - F.col("mb")) / sd, F.lit(1.0)), F.lit(1.0))
    std_shift = F.least(F.coalesce(F.abs(F.col("sa") - F.col("sb")) / sd, F.lit(1.0)), F.lit(1.0))
    out = both.withColumns({"mean_shift": mean_shift, "std_shift": std_shift})
    score = ((1 - F.col("ks_p")) + (1 - F.col("t_p")) + F.col("mean_shift") + F.col("std_shift")) / 4
    out = out.withColumn("drift_score", score)
    return out.withColumns({"flag": (F.col("drift_score") > level).cast("int"), "differs": ((F.col("ks_p") < level) | (F.col("t_p") < level)).cast("int")})


# --- isolation trees --------------------------------------------------------------


def _average_path(n):
    n = np.asarray(n, float)
    h = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng, depth: int, limit: int) -> list:
    """Nested [feature, cut, left, right], or [size + expected extra depth] at a leaf."""
    spread = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(x.shape[1])
    usable = np.flatnonzero(spread > 0)
    if depth >= limit or len(x) <= 1 or len(usable) == 0:
        return [float(depth + _average_path(len(x)))]
    f = int(rng.choice(usable))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    left = x[:, f] < cut
    return [f, cut, _grow(x[left], rng, depth + 1, limit), _grow(x[~left], rng, depth + 1, limit)]


def _path_length(tree: list, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    left = x[:, tree[0]] < tree[1]
    out = np.empty(len(x))
    out[left] = _path_length(tree[2], x[left])
    out[~left] = _path_length(tree[3], x[~left])
    return out


def isolation_forest(reference: DataFrame, features: Sequence[str], keys: Sequence[str], trees: int = 100, sample: int = 256, seed: int = 42) -> list:
    """Trees grown in parallel, one group per tree, each on its own seeded sample.

    A row joins a tree with probability 1.5 * sample / n by a draw of its own for that tree,
    and the tree takes the ``sample`` smallest draws, so no group holds more than about one
    and a half samples; the grown trees are small and go to the driver.
    """
    import json

    names = list(features)
    whole = reference.na.drop(subset=names)
    share = min(1.0, 1.5 * sample / max(whole.count(), 1))
    row = F.xxhash64(F.lit(seed), *keys)

    def draw(tree):
        return (F.pmod(F.xxhash64(F.col("_row"), tree), F.lit(1 << 40)) + 0.5) / float(1 << 40)

    joined = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) <= share)
    pool = whole.withColumn("_row", row).withColumn("tree", F.explode(joined)).withColumn("_u", draw(F.col("tree")))
    limit = int(np.ceil(np.log2(max(sample, 2))))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(key[0])])
        x = pdf.sort_values(["_u", *names])[names].to_numpy(float)[:sample]
        return pd.DataFrame({"tree": [int(key[0])], "body": [json.dumps(_grow(x, rng, 0, limit))]})

    grown = pool.select("tree", "_u", *names).groupBy("tree").applyInPandas(grow, "tree int, body string")
    return [json.loads(r["body"]) for r in grown.orderBy("tree").collect()]


def isolation_score(df: DataFrame, forest: list, features: Sequence[str], sample: int = 256, out: str = "score") -> DataFrame:
    """Score in (0, 1), higher is more unusual; scored batch by batch where the rows are."""
    from pyspark.sql import types as T

    scale = float(_average_path(sample))
    trees = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf(T.DoubleType())
    def score(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in columns])
        depth = np.mean([_path_length(t, x) for t in trees.value], axis=0) if len(x) else np.zeros(0)
        return pd.Series(np.power(2.0, -depth / scale))

    return df.withColumn(out, score(*[F.col(f).cast("double") for f in features]))


def isolation_drift(df: DataFrame, features: Sequence[str], is_ref: Column, keys: Sequence[str], trees: int = 100, seed: int = 42) -> DataFrame:
    """One row: mean score of both parts and how much the new part exceeds the reference."""
    tagged = df.withColumn("_ref", is_ref)
    forest = isolation_forest(tagged.where("_ref"), features, keys, trees, seed=seed)
    scored = isolation_score(tagged, forest, features)
    out = scored.agg(F.avg(F.when(F.col("_ref"), F.col("score"))).alias("reference_score"), F.avg(F.when(~F.col("_ref"), F.col("score"))).alias("new_score"))
    return out.withColumn("drift_score", F.greatest(F.lit(0.0), F.col("new_score") - F.col("reference_score")))


def hybrid_score(statistical: DataFrame, isolation: DataFrame, level: float = 0.05) -> DataFrame:
    """Both scores and their mean for every row of the statistical frame."""
    one = isolation.select(F.col("drift_score").alias("isolation_score"))
    both = qt.attach(statistical.withColumnRenamed("drift_score", "statistical_score"), one, ())
    mean = (F.col("statistical_score") + F.col("isolation_score")) / 2
    return both.withColumn("hybrid_score", mean).withColumn("hybrid_flag", (F.col("hybrid_score") > level).cast("int"))


def append_history(scores: DataFrame, path: str, run: str) -> str:
    """Append one run's scores to the drift log."""
    scores.withColumn("run", F.lit(run)).write.mode("append").parquet(path)
    return path
