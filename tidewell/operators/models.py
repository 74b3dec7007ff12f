"""MLlib models, time-ordered validation, search, stacking and importance."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import Bucketizer, Imputer, MinMaxScaler, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.draws import Draw, uniform
from tidewell.operators import clean, gram, splits
from tidewell.operators import quantiles as qt
from tidewell.operators import summary as sm
from tidewell.panel import BY, with_position


# --- preprocessing ------------------------------------------------------------------


class MedianImputer(Imputer):
    """MLlib's imputer with exact medians (the lower of two middle values) from counts.

    MLlib's own exact median keeps every value of a column in one sketch on the driver.
    """

    def _fit(self, dataset: DataFrame):
        names = self.getInputCols()
        long = dataset.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in names])).alias("s"))
        # middle of n rows at a relative error of zero
        found = qt.order_stats(long.select("s.k", "s.v"), "v", {"median": lambda n: F.ceil(n / 2) - 1}, ["k"]).collect()
        middle = {r["k"]: r["value"] for r in found}
        row = dataset.sparkSession.createDataFrame([tuple(middle.get(c) for c in names)], ", ".join(f"`{c}` double" for c in names))
        return super()._fit(row)


def preprocessing(numeric: Sequence[str], categorical: Sequence[str], out: str = "features") -> Pipeline:
    """Impute and standardise numbers, index and one-hot categories, assemble.

    Numbers take their median, categories the most frequent value (of equally frequent ones
    the first), both from the rows that the pipeline is fitted on.
    """
    filled = [f"{c}_filled" for c in numeric]
    stages = [
        MedianImputer(strategy="median", inputCols=list(numeric), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_num", handleInvalid="keep"),
        StandardScaler(withMean=True, withStd=True, inputCol="_num", outputCol="_num_scaled"),
    ]
    parts = ["_num_scaled"]
    for c in categorical:
        stages += [
            # the most frequent value has index 0; a missing one takes it, an unseen one gets no slot
            StringIndexer(inputCol=c, outputCol=f"{c}_known", handleInvalid="keep", stringOrderType="frequencyDesc"),
            SQLTransformer(statement=f"SELECT *, CASE WHEN `{c}` IS NULL THEN 0D ELSE `{c}_known` END AS `{c}_index` FROM __THIS__"),
            OneHotEncoder(inputCol=f"{c}_index", outputCol=f"{c}_hot", dropLast=False),
        ]
        parts.append(f"{c}_hot")
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=parts, outputCol=out)])


def fit_scaler(train: DataFrame, columns: Sequence[str], kind: str = "standard") -> dict[str, tuple[float, float]]:
    """(offset, width) per column from the training rows: mean and population deviation, or min and range."""
    if kind == "standard":
        aggs = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("a", F.avg), ("b", F.stddev_pop))]
    elif kind == "minmax":
        aggs = [x for c in columns for x in (F.min(c).alias(f"a_{c}"), (F.max(c) - F.min(c)).alias(f"b_{c}"))]
    else:
        raise ValueError(f"unknown scaler {kind}")
    row = train.agg(*aggs).first()
    return {c: (float(row[f"a_{c}"]), float(row[f"b_{c}"]) or 1.0) for c in columns}


def scale(df: DataFrame, fitted: Mapping[str, tuple[float, float]], suffix: str = "_scaled") -> DataFrame:
    return df.withColumns({c + suffix: (F.col(c) - a) / b for c, (a, b) in fitted.items()})


def unscale(value: Column, fitted: tuple[float, float]) -> Column:
    return value * fitted[1] + fitted[0]


def scaling_stages(columns: Sequence[str], kind: str = "standard", out: str = "features") -> Pipeline:
    scaler = {"standard": StandardScaler(withMean=True, withStd=True), "minmax": MinMaxScaler()}[kind]
    scaler.setInputCol("_raw").setOutputCol(out)
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="_raw"), scaler])


# --- estimators -------------------------------------------------------------------------


def linear(**kw) -> LinearRegression:
    return LinearRegression(**{"solver": "normal", **kw})


def ridge(alpha: float, n: int, sd_y: float, **kw) -> LinearRegression:
    """The penalty of sum of squares + alpha |b|^2: MLlib divides by n and scales by the label's deviation."""
    return LinearRegression(solver="normal", elasticNetParam=0.0, standardization=False, regParam=alpha * sd_y / n, **kw)


def lasso(alpha: float, **kw) -> LinearRegression:
    return LinearRegression(elasticNetParam=1.0, regParam=alpha, **kw)


def forest(trees: int = 50, depth: int = 5, seed: int = 42, **kw) -> RandomForestRegressor:
    return RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed, **kw)


def boosted(rounds: int = 50, depth: int = 4, step: float = 0.1, seed: int = 42, **kw) -> GBTRegressor:
    return GBTRegressor(maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed, **kw)


#: Most combinations of feature bins for which boosting goes over them in place of rows.
CELLS = 1 << 18


class BoostedOnCells:
    """MLlib's boosted trees from one pass over the rows, for ``on_features``.

    MLlib cuts features into bins before it boosts, so rows of equal bins (a cell) have equal
    predictions in every round.  The squared loss of a cell needs its number of rows and their
    mean label, no more: the trees of the cells, weighted, are those of the rows.
    """

    def __init__(self, **kw):
        self.trees = boosted(**kw)


class _CellBoosting(Estimator):
    def __init__(self, trees: GBTRegressor, features: Sequence[str], label: str, out: str):
        super().__init__()
        self.trees, self.features, self.label, self.out = trees, list(features), label, out

    def _fit(self, dataset: DataFrame):
        rows = dataset.na.drop(subset=[*self.features, self.label])
        cuts = _tree_cuts(rows, self.features, self.trees.getMaxBins(), self.trees.getSeed())
        plain = self.trees.getSubsamplingRate() == 1.0 and self.trees.getMinInstancesPerNode() == 1 and self.trees.getMinWeightFractionPerNode() == 0.0
        if not plain or math.prod(len(c) + 1 for c in cuts) > CELLS:
            return on_features(self.trees, self.features, self.label, self.out).fit(dataset)
        bins = [f"_bin{i}" for i in range(len(cuts))]
        # a row lies left of a cut if it is not above it; buckets are closed on the left
        edges = [[-math.inf, *[float(np.nextafter(c, math.inf)) for c in cut], math.inf] if len(cut) else [-math.inf, float(np.finfo(float).max), math.inf] for cut in cuts]
        bucketed = Bucketizer(splitsArray=edges, inputCols=self.features, outputCols=bins, handleInvalid="keep")
        # sums are no categories to MLlib, as buckets are
        cells = bucketed.transform(rows).groupBy(*[(F.col(b) + 0.0).alias(b) for b in bins]).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.avg(F.col(self.label).cast("double")).alias("_label"))
        cells = cells.repartition(1).sortWithinPartitions(*bins).persist()
        before = PipelineModel([bucketed, VectorAssembler(inputCols=bins, outputCol="features", handleInvalid="keep")])
        # with so many bins MLlib takes every bin of every cell, and no sample of cells
        most = max(self.trees.getMaxBins(), math.isqrt(cells.count()) + 1)
        stage = self.trees.copy().setMaxBins(most).setFeaturesCol("features").setLabelCol("_label").setWeightCol("_n").setPredictionCol("_predicted")
        fitted = stage.fit(VectorAssembler(inputCols=bins, outputCol="features").transform(cells).select("features", "_label", "_n"))
        cells.unpersist()
        whole = " AND ".join(f"`{f}` IS NOT NULL AND NOT isnan(`{f}`)" for f in self.features)
        shown = SQLTransformer(statement=f"SELECT * EXCEPT (features, _predicted, {', '.join(bins)}), CASE WHEN {whole} THEN _predicted END AS `{self.out}` FROM __THIS__")
        return PipelineModel([before, fitted, shown])


def _tree_cuts(rows: DataFrame, features: Sequence[str], max_bins: int, seed: int) -> list[list[float]]:
    """The cuts that MLlib's trees choose from: with the rows, bins and seed given, the same as theirs.

    As there, they are ends of about equally many rows, of all rows up to the square of
    ``max_bins`` (10,000 at least) and else of as many drawn ones.
    """
    spark, n = rows.sparkSession, rows.count()
    bins = min(max_bins, n)
    share = min(1.0, max(bins * bins, 10_000) / max(n, 1))
    values = rows.select(*[F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(features)])
    if share < 1:
        # a draw of the RDD, which is what MLlib draws
        draw = spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        drawn = values._jdf.toJavaRDD().sample(False, share, draw)
        values = DataFrame(spark._jsparkSession.createDataFrame(drawn, values._jdf.schema()), spark)
    held, expected, out = np.array(values.collect(), float).reshape(-1, len(features)), share * n, []
    for column in held.T:
        value, count = np.unique(column[column != 0], return_counts=True)
        # zeros are not counted but inferred from the number expected
        missing = expected - count.sum()
        if len(value) and missing > np.finfo(float).eps * count.sum() * 100:
            at = int(np.searchsorted(value, 0.0))
            value, count = np.insert(value, at, 0.0), np.insert(count.astype(float), at, missing)
        middle = (value[:-1] + value[1:]) / 2
        if len(middle) < bins:
            out.append(middle.tolist())
            continue
        stride = expected / bins
        cut, target, sums = [], stride, np.cumsum(count)
        for i in range(1, len(value)):
            if abs(sums[i - 1] - target) < abs(sums[i] - target):
                cut.append(float(middle[i - 1]))
                target += stride
        out.append(cut)
    return out


class CompleteRows(Pipeline):
    """A pipeline fitted on the rows that have all of the named columns."""

    def __init__(self, stages, columns: Sequence[str]):
        super().__init__(stages=stages)
        self.columns = list(columns)

    def _fit(self, dataset: DataFrame):
        return super()._fit(dataset.na.drop(subset=self.columns))


def on_features(estimator, features: Sequence[str], label: str = "y", out: str = "prediction") -> Pipeline:
    """An estimator over named columns.

    It is fitted on complete rows; ``transform`` keeps every row, adds the column ``out`` and
    nothing else, and predicts NULL where a feature is missing.  So a second model can be
    fitted on the output of a first.
    """
    if isinstance(estimator, BoostedOnCells):
        return _CellBoosting(estimator.trees, features, label, out)
    stage = estimator.copy()
    stage.setFeaturesCol("features").setLabelCol(label).setPredictionCol("_predicted")
    whole = " AND ".join(f"`{f}` IS NOT NULL AND NOT isnan(`{f}`)" for f in features)
    shown = SQLTransformer(statement=f"SELECT * EXCEPT (features, _predicted), CASE WHEN {whole} THEN _predicted END AS `{out}` FROM __THIS__")
    return CompleteRows([VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"), stage, shown], [*features, label])


def inner(model):
    """The fitted estimator of a pipeline made by ``on_features``."""
    return model.stages[1]


TRAINERS: dict[str, Callable] = {"linear": linear, "lasso": lasso, "forest": forest, "boosted": boosted}


def trainer(name: str, **kw):
    """Estimator by name with keyword settings."""
    if name not in TRAINERS:
        raise KeyError(f"unknown model {name}; known: {sorted(TRAINERS)}")
    return TRAINERS[name](**kw)


# --- time-ordered validation ------------------------------------------------------------


def fold_predictions(df: DataFrame, features: Sequence[str], models: Mapping[str, object], k: int = 5, label: str = "y", by=BY, order=("ts",), keep: Sequence[str] = ("series_id", "ts"), parallel: int = 4, folds: Callable[..., DataFrame] = splits.expanding_folds) -> DataFrame:
    """(keep..., fold, model, y, yhat) from expanding folds: every fit sees only earlier rows.

    ``folds`` is ``splits.expanding_folds``, which cuts each series by its own positions, or
    ``splits.dated_folds``, which cuts all of them at common dates.  Fits are independent MLlib
    jobs, submitted side by side.
    """
    folded = folds(df.na.drop(subset=[*features, label]), k, by, order).persist()
    jobs = [(i, name, est) for i in range(1, k + 1) for name, est in models.items()]

    def run(job):
        i, name, est = job
        part = folded.where(F.col("fold") == i)
        model = on_features(est, features, label).fit(part.where("part = 'train'"))
        scored = model.transform(part.where("part = 'test'"))
        return scored.select(*keep, "fold", F.lit(name).alias("model"), F.col(label).alias("y"), F.col("prediction").alias("yhat"))

    with ThreadPoolExecutor(parallel) as pool:
        frames = list(pool.map(run, jobs))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def linear_fold_predictions(df: DataFrame, features: Sequence[str], penalties: Mapping[str, float], k: int = 5, label: str = "y", by=BY, order=("ts",), keep=("series_id", "ts"), folds: Callable[..., DataFrame] = splits.expanding_folds) -> DataFrame:
    """The same for ridge models: all folds and penalties come from one aggregation."""
    folded = folds(df.na.drop(subset=[*features, label]), k, by, order)
    xs = [F.lit(1.0)] + [F.col(f) for f in features]
    sums = gram.gram_sums(folded.where("part = 'train'"), ["fold"], xs, F.col(label))
    grid = sums.select("*", F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(float(p)).alias("penalty")) for m, p in penalties.items()])))
    models = gram.solve(grid, [0.0] + [F.col("penalty")] * len(features)).select("fold", "model", "beta")
    scored = folded.where("part = 'test'").join(F.broadcast(models), "fold")  # k x penalties rows
    return scored.select(*keep, "fold", "model", F.col(label).alias("y"), gram.dot(F.col("beta"), xs).alias("yhat"))


def cv_metrics(predictions: DataFrame) -> DataFrame:
    """Fold metrics averaged over folds per model."""
    per_fold = sm.regression_metrics(predictions, ["model", "fold"])
    return per_fold.groupBy("model").agg(F.count(F.lit(1)).alias("folds"), *[F.avg(c).alias(c) for c in ("mae", "mse", "rmse", "r2")])


def grid(params: Mapping[str, Sequence]) -> list[dict]:
    names = list(params)
    return [dict(zip(names, values)) for values in itertools.product(*params.values())]


def random_grid(params: Mapping[str, Sequence], draws: int, seed: int = 42) -> list[dict]:
    """Distinct random settings out of the grid."""
    every = grid(params)
    return random.Random(seed).sample(every, min(draws, len(every)))


def search(df: DataFrame, features: Sequence[str], kind: str, settings: Sequence[dict], k: int = 3, label: str = "y", metric: str = "mae", **kw) -> DataFrame:
    """Settings ranked by a fold-averaged error: (model, folds, errors..., rank), ``model`` naming the setting."""
    named = {", ".join(f"{a}={v}" for a, v in s.items()) or "default": trainer(kind, **s) for s in settings}
    return splits.leaderboard(cv_metrics(fold_predictions(df, features, named, k, label, **kw)), metric)


# --- stacking ---------------------------------------------------------------------------------


def oof_matrix(predictions: DataFrame, models: Sequence[str], keys: Sequence[str] = ("series_id", "ts")) -> DataFrame:
    """One column per base model; rows before the first fold do not appear."""
    return predictions.groupBy(*keys).pivot("model", list(models)).agg(F.first("yhat")).join(
        predictions.groupBy(*keys).agg(F.first("y").alias("y")), list(keys)
    )


def repair_oof(oof: DataFrame, models: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Drop bases without any value and rows without any base, fill the rest with the base's median."""
    counts = oof.agg(*[F.count(m).alias(m) for m in models]).first()
    kept = [m for m in models if counts[m]]
    rows = oof.drop(*[m for m in models if m not in kept]).na.drop("all", subset=kept)
    return clean.fill_median(rows, kept), kept


def fit_stack(oof: DataFrame, bases: Sequence[str], alpha: float = 1.0, label: str = "y") -> dict:
    """Standardise the bases and fit a ridge on them: a small dictionary of numbers."""
    fitted = fit_scaler(oof, bases)
    scaled = scale(oof, fitted, "_z").withColumn("_g", F.lit(1))
    row = gram.fit_linear(scaled, ["_g"], [f"{b}_z" for b in bases], label, alpha).first()
    return {"bases": list(bases), "scaler": fitted, "beta": [float(v) for v in row["beta"]]}


def predict_stack(df: DataFrame, stack: Mapping, out: str = "stacked") -> DataFrame:
    total = F.lit(stack["beta"][0])
    for b, name in zip(stack["beta"][1:], stack["bases"]):
        a, w = stack["scaler"][name]
        total = total + b * (F.col(name) - a) / w
    return df.withColumn(out, total)


def fit_full_stack(train: DataFrame, bases: Mapping[str, tuple[object, Sequence[str]]], k: int = 5, alpha: float = 1.0, label: str = "y", by=BY, order=("ts",), keys: Sequence[str] = ("series_id", "ts")) -> dict:
    """Bases fitted on all rows, and a stack fitted on their out-of-fold predictions.

    ``bases`` maps a name to its estimator and features.
    """
    folds = None
    for name, (estimator, features) in bases.items():
        part = fold_predictions(train, features, {name: estimator}, k, label, by, order, keys)
        folds = part if folds is None else folds.unionByName(part)
    oof, kept = repair_oof(oof_matrix(folds, list(bases), keys), list(bases))
    fitted = {n: on_features(*bases[n], label).fit(train) for n in kept}
    return {"stack": fit_stack(oof, kept, alpha), "models": fitted}


def predict_full_stack(df: DataFrame, full: Mapping, out: str = "stacked") -> DataFrame:
    """Every base scores the rows, seen or new; a missing base prediction counts as 0."""
    scored = df
    for name, model in full["models"].items():
        scored = model.transform(scored).withColumn(name, F.coalesce("prediction", F.lit(0.0))).drop("prediction")
    return predict_stack(scored, full["stack"], out).drop(*full["models"])


def save_full_stack(full: Mapping, path: str, spark) -> None:
    import json

    for name, model in full["models"].items():
        model.write().overwrite().save(f"{path}/{name}")
    spark.createDataFrame([(json.dumps({**full["stack"], "scaler": {k: list(v) for k, v in full["stack"]["scaler"].items()}}),)], "stack string").coalesce(1).write.mode("overwrite").json(f"{path}/stack.json")


def load_full_stack(path: str, spark) -> dict:
    import json

    from pyspark.ml import PipelineModel

    stack = json.loads(spark.read.schema("stack string").json(f"{path}/stack.json").first()["stack"])
    return {"stack": stack, "models": {n: PipelineModel.load(f"{path}/{n}") for n in stack["bases"]}}


def best_on_holdout(train: DataFrame, holdout: DataFrame, features: Sequence[str], candidates: Mapping[str, object], label: str = "y", path: str | None = None):
    """(leaderboard, name, fitted pipeline) of the candidate with the lowest holdout RMSE; saved when a path is given."""
    fitted = {n: on_features(e, features, label).fit(train) for n, e in candidates.items()}
    board = evaluate_models(fitted, holdout, features, label)
    name = board.orderBy("rmse", "model").first()["model"]
    if path:
        fitted[name].write().overwrite().save(path)
    return board, name, fitted[name]


def evaluate_models(models: Mapping[str, object], test: DataFrame, expected: Sequence[str], label: str = "y") -> DataFrame:
    """Metrics of many fitted pipelines on one table; columns a model misses are filled with 0.

    Rows without a prediction, for want of a feature, take no part.
    """
    have = set(test.columns)
    aligned = test.withColumns({c: F.lit(0.0) for c in expected if c not in have})
    parts = [m.transform(aligned).select(F.lit(n).alias("model"), F.col(label).alias("y"), F.col("prediction").alias("yhat")).where("yhat IS NOT NULL") for n, m in models.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return sm.regression_metrics(out, ["model"])


def needed_columns(model) -> list[str]:
    """Input columns of a pipeline's assemblers that no earlier stage makes."""
    wanted, made = [], set()
    for stage in getattr(model, "stages", [model]):
        if isinstance(stage, VectorAssembler):
            wanted += [c for c in stage.getInputCols() if c not in made]
        for name in ("outputCol", "predictionCol"):
            if stage.hasParam(name) and stage.isDefined(name):
                made.add(stage.getOrDefault(name))
        if stage.hasParam("outputCols") and stage.isDefined("outputCols"):
            made.update(stage.getOrDefault("outputCols"))
    return list(dict.fromkeys(wanted))


EVALUATION = "model string, n long, mae double, mse double, rmse double, r2 double, filled array<string>, load_error string, eval_error string"


def evaluate_each(models: Mapping[str, object], test: DataFrame, label: str = "y", parallel: int = 4) -> DataFrame:
    """One row per model: its metrics on the table, or the text of what went wrong.

    A value of ``models`` is a fitted pipeline or the path of a saved one.  Every model is a job
    of its own, side by side with the others, and a failure stays with its model.  Columns that
    a model misses are filled with 0, and named, only when it cannot predict without them.
    Rows without a prediction take no part.
    """
    from pyspark.ml import PipelineModel

    def text(failed: Exception) -> str:
        return f"{type(failed).__name__}: {failed}".split("\n")[0][:500]

    def measure(model, table: DataFrame):
        out = model.transform(table).select(F.lit(0).alias("g"), F.col(label).alias("y"), F.col("prediction").alias("yhat")).where("yhat IS NOT NULL")
        return sm.regression_metrics(out, ["g"]).first()

    def run(item):
        name, model = item
        row = {"model": name, "filled": []}
        try:
            model = PipelineModel.load(model) if isinstance(model, str) else model
        except Exception as failed:
            return row | {"load_error": text(failed)}
        try:
            got = measure(model, test)
        except Exception as failed:
            missing = [c for c in needed_columns(model) if c not in test.columns]
            if not missing:
                return row | {"eval_error": text(failed)}
            row["filled"] = missing
            try:
                got = measure(model, test.withColumns({c: F.lit(0.0) for c in missing}))
            except Exception as again:
                return row | {"eval_error": text(again)}
        return row | ({c: got[c] for c in ("n", "mae", "mse", "rmse", "r2")} if got else {"eval_error": "no row has a prediction"})

    with ThreadPoolExecutor(parallel) as pool:
        rows = list(pool.map(run, models.items()))
    names = [c.split()[0] for c in EVALUATION.split(", ")]
    return test.sparkSession.createDataFrame([tuple(r.get(c) for c in names) for r in rows], EVALUATION)


# --- importance --------------------------------------------------------------------------------


def importance_table(model, features: Sequence[str], like: DataFrame, top: int | None = None) -> DataFrame:
    """(feature, importance, n_rows) of a fitted tree pipeline, strongest first."""
    values = inner(model).featureImportances.toArray()
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(float(v)).alias("importance")) for f, v in zip(features, values)])
    out = like.agg(F.count(F.lit(1)).alias("n_rows")).select(F.inline(rows), "n_rows").orderBy(F.desc("importance"), "feature")
    return out.limit(top) if top else out


def linear_attribution(df: DataFrame, beta: Sequence[float], features: Sequence[str]) -> DataFrame:
    """(feature, mean |contribution|) of a linear model, strongest first."""
    means = df.agg(*[F.avg(f).alias(f) for f in features]).first()
    one = df.agg(*[F.avg(F.abs(F.lit(float(b)) * (F.col(f) - means[f]))).alias(f) for b, f in zip(beta, features)])
    return one.unpivot([], list(features), "feature", "mean_abs").orderBy(F.desc("mean_abs"), "feature")


def top_correlated(df: DataFrame, features: Sequence[str], k: int = 10, label: str = "y") -> list[str]:
    return [r["feature"] for r in sm.target_correlation(df, features, label).limit(k).collect()]


def strong_coefficients(model, features: Sequence[str]) -> list[str]:
    """Features whose absolute coefficient reaches the median."""
    c = [abs(float(v)) for v in inner(model).coefficients]
    ranked = sorted(c)
    mid = len(ranked) // 2
    median = ranked[mid] if len(ranked) % 2 else (ranked[mid - 1] + ranked[mid]) / 2
    return [f for f, v in zip(features, c) if v >= median]


def random_rank(df: DataFrame, seed: int, keys: Sequence[str], out: str, buckets: int = 4096, draw: Draw = uniform) -> DataFrame:
    """A random permutation 1..n without sorting the table in one task: rank inside hash buckets plus bucket offsets."""
    u = df.withColumns({"_u": draw(seed, keys)}).withColumn("_b", F.floor(F.col("_u") * buckets))
    counts = u.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.select("_b", (F.sum("_c").over(Window.partitionBy(F.lit(0)).orderBy("_b")) - F.col("_c")).alias("_o"))
    inner = Window.partitionBy("_b").orderBy("_u", *keys)
    return u.withColumn(out, F.row_number().over(inner)).join(F.broadcast(offsets), "_b").withColumn(out, F.col(out) + F.col("_o")).drop("_u", "_b", "_o")


def permuted(df: DataFrame, columns: Mapping[str, str], seed: int, keys: Sequence[str], draw: Draw = uniform) -> DataFrame:
    """Add columns holding other rows' values: {new name: source}; every value is used once."""
    a = random_rank(df, seed, keys, "_rank", draw=draw)
    b = random_rank(df.select(*keys, *set(columns.values())), seed + 1, keys, "_rank", draw=draw).select("_rank", *[F.col(s).alias(n) for n, s in columns.items()])
    kept = a.drop(*[n for n in columns if n in df.columns])
    return kept.join(b, "_rank").drop("_rank")


def permutation_importance(model, df: DataFrame, features: Sequence[str], keys: Sequence[str], seed: int = 42, label: str = "y", draw: Draw = uniform) -> DataFrame:
    """(feature, rmse, increase): error after one column is shuffled among the rows."""
    base = model.transform(df).select(F.lit("").alias("feature"), F.col(label).alias("y"), F.col("prediction").alias("yhat"))
    out = None
    for i, f in enumerate(features):
        shuffled = permuted(df, {f: f}, seed + 10 * i, keys, draw)
        part = model.transform(shuffled).select(F.lit(f).alias("feature"), F.col(label).alias("y"), F.col("prediction").alias("yhat"))
        out = part if out is None else out.unionByName(part)
    m = sm.regression_metrics(out, ["feature"])
    base_rmse = sm.regression_metrics(base, ["feature"]).first()["rmse"]
    return m.select("feature", "rmse", (F.col("rmse") - base_rmse).alias("increase"))


def shadow_selection(df: DataFrame, features: Sequence[str], keys: Sequence[str], rounds: int = 5, trees: int = 20, seed: int = 42, label: str = "y") -> dict[str, int]:
    """How often each feature beats the best shuffled copy in a forest: {feature: hits}."""
    hits = dict.fromkeys(features, 0)
    shadows = {f"shadow_{f}": f for f in features}
    for r in range(rounds):
        both = permuted(df, shadows, seed + 100 * r, keys)
        names = [*features, *shadows]
        values = inner(on_features(forest(trees, 5, seed + r), names, label).fit(both)).featureImportances.toArray()
        bar = max(values[len(features):])
        for f, v in zip(features, values):
            hits[f] += int(v > bar)
    return hits


def partial_dependence(model, df: DataFrame, feature: str, values: Sequence[float]) -> DataFrame:
    """(value, mean prediction) with one feature held at each grid value."""
    copies = df.withColumn(feature, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return model.transform(copies).groupBy(F.col(feature).alias("value")).agg(F.avg("prediction").alias("mean_prediction"))


def vector_column(df: DataFrame, vector: str, names: Sequence[str]) -> DataFrame:
    a = df.withColumn("_a", vector_to_array(vector))
    return a.withColumns({n: F.col("_a")[i] for i, n in enumerate(names)}).drop("_a")
