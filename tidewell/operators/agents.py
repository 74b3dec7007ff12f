"""Everything that is fitted on a panel, as Spark ML estimators under one registry of names.

A fitted component is a table of parameters, per series or for all, beside its settings; it
saves and loads like any ML stage and may stand in a ``Pipeline`` among others.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.dynamics import damped_sum
from tidewell.operators import drift, features, forecast, gram, intervals, regimes, spectral
from tidewell.operators import summary as sm
from tidewell.operators import windows as win
from tidewell.panel import with_position


@dataclass(frozen=True)
class Component:
    """``learn(df, **settings)`` gives the table, ``apply(df, table, **settings)`` the transformed
    frame, ``ahead(df, table, **settings)`` (series_id, mu, var) of the next step, where there is one."""

    learn: Callable[..., DataFrame]
    apply: Callable[..., DataFrame]
    ahead: Callable[..., DataFrame] | None = None


class _Named(Params):
    component = Param(Params._dummy(), "component", "name in the registry", TypeConverters.toString)
    settings = Param(Params._dummy(), "settings", "keyword settings as JSON", TypeConverters.toString)

    def spec(self) -> tuple[Component, dict]:
        return REGISTRY[self.getOrDefault("component")], json.loads(self.getOrDefault("settings"))


class PanelEstimator(_Named, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Learns a component's table from a panel."""

    def __init__(self, component: str | None = None, settings: str = "{}"):
        super().__init__()
        self._setDefault(settings="{}")
        if component is not None:
            self._set(component=component, settings=settings)

    def _fit(self, dataset: DataFrame) -> PanelModel:
        spec, settings = self.spec()
        return self._copyValues(PanelModel(spec.learn(dataset, **settings)))


class PanelModel(_Named, Model, MLWritable, MLReadable):
    """A component's table and how to apply it."""

    def __init__(self, table: DataFrame | None = None):
        super().__init__()
        self._setDefault(settings="{}")
        self.table = table

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spec, settings = self.spec()
        return spec.apply(dataset, self.table, **settings)

    def predict(self, dataset: DataFrame) -> DataFrame:
        """(series_id, mu, var, mode) of the next step; where the component has none, the last 12 rows tell."""
        spec, settings = self.spec()
        naive = win.naive_forecast(dataset)
        if spec.ahead is None:
            return naive
        own = spec.ahead(dataset, self.table, **settings).select("series_id", F.col("mu").alias("_mu"), F.col("var").alias("_var"))
        good = F.col("_mu").isNotNull() & ~F.isnan("_mu")
        both = naive.join(own, "series_id", "left")
        return both.select("series_id", *[F.when(good, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("mu", "var")], F.when(good, "predict").otherwise("naive").alias("mode"))

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, model: PanelModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.table.write.parquet(f"{path}/table")


class _ModelReader(MLReader):
    def load(self, path: str) -> PanelModel:
        spark = SparkSession.getActiveSession()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = PanelModel(spark.read.parquet(f"{path}/table"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


# --- components ------------------------------------------------------------------------


def _ar1_apply(df: DataFrame, table: DataFrame) -> DataFrame:
    params = table.select("series_id", "c", "phi", "sigma2", (F.col("c") + F.col("phi") * F.col("last_y")).alias("next"))
    return df.join(params, "series_id").withColumn("fitted", F.col("c") + F.col("phi") * win.lags(ks=(1,))["lag_1"])


def _season(t: Column) -> Column:
    return gram.dot(F.col("beta"), forecast._season(t, (1, 2, 3), 12.0))


def _trend_apply(df: DataFrame, table: DataFrame) -> DataFrame:
    joined = with_position(df).join(table.select("series_id", "beta"), "series_id", "left")
    return joined.withColumn("trend_season", _season(F.col("t"))).drop("beta")


def _wave(df: DataFrame, table: DataFrame) -> DataFrame:
    joined = with_position(df).join(table.select("series_id", "mean", "params"), "series_id", "left")
    return joined.withColumn("wave", F.col("mean") + damped_sum(F.col("t"), F.col("params"))).drop("mean", "params")


def _wave_learn(df: DataFrame, modes: int = 2) -> DataFrame:
    sizes = df.where("y IS NOT NULL").groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    return spectral.fit_damped(df, modes=modes).join(sizes, "series_id")


def _chosen_learn(df: DataFrame, k: int = 5) -> DataFrame:
    wide = features.candidate_features(df)
    names = [c for c in wide.columns if c not in df.columns]
    return sm.target_correlation(wide, names).limit(k)


def _chosen_apply(df: DataFrame, table: DataFrame, k: int = 5) -> DataFrame:
    return features.candidate_features(df).select(*df.columns, *[r["feature"] for r in table.orderBy(F.desc(F.abs("r")), "feature").collect()])


def _profile_learn(df: DataFrame) -> DataFrame:
    return df.groupBy("series_id", F.month("ts").alias("month")).agg(F.avg("y").alias("profile"))


def _profile_apply(df: DataFrame, table: DataFrame) -> DataFrame:
    return df.withColumn("month", F.month("ts")).join(table, ["series_id", "month"], "left").drop("month")


def _profile_ahead(df: DataFrame, table: DataFrame) -> DataFrame:
    nxt = forecast.ahead(df, 1).select("series_id", F.month("ts").alias("month"))
    rest = _profile_apply(df, table).groupBy("series_id").agg(F.var_samp(F.col("y") - F.col("profile")).alias("var"))
    return nxt.join(table, ["series_id", "month"], "left").join(rest, "series_id").select("series_id", F.col("profile").alias("mu"), F.coalesce("var", F.lit(0.0)).alias("var"))


def _interval_learn(df: DataFrame, alpha: float = 0.1) -> DataFrame:
    return intervals.split_conformal(df.withColumn("yhat", win.lags(ks=(1,))["lag_1"]).where("yhat IS NOT NULL"), alpha, ["series_id"])


def _interval_apply(df: DataFrame, table: DataFrame, alpha: float = 0.1) -> DataFrame:
    return intervals.band(df.withColumn("yhat", win.lags(ks=(1,))["lag_1"]).join(table, "series_id", "left"))


def _drift_apply(df: DataFrame, table: DataFrame) -> DataFrame:
    both = df.select("series_id", "y").withColumn("_ref", F.lit(False)).unionByName(table.select("series_id", "y").withColumn("_ref", F.lit(True)))
    return drift.drift_score(both, "y", F.col("_ref"), ["series_id"])


def _modes_apply(df: DataFrame, table: DataFrame, lag: int = 3) -> DataFrame:
    first = table.where("mode = 1").select("series_id", F.col("modulus").alias("mode_modulus"), F.col("omega").alias("mode_omega"))
    return df.join(first, "series_id", "left")


REGISTRY: dict[str, Component] = {
    "harmonics": Component(lambda df, k=3: spectral.top_frequencies(df, k), lambda df, p, k=3: features.harmonic_features(with_position(df), p, k)),
    "ar1": Component(forecast.ar1_models, _ar1_apply, lambda df, p: p.select("series_id", (F.col("c") + F.col("phi") * F.col("last_y")).alias("mu"), F.col("sigma2").alias("var"))),
    "regimes": Component(lambda df, penalty=10.0: regimes.change_points(df, penalty), lambda df, p, penalty=10.0: regimes.label_regimes(with_position(df), p)),
    "candidates": Component(_chosen_learn, _chosen_apply),
    "trend_season": Component(forecast.trend_season_models, _trend_apply, lambda df, p: p.select("series_id", _season(F.col("n")).alias("mu"), F.lit(0.0).alias("var"))),
    "damped_wave": Component(
        _wave_learn, lambda df, p, modes=2: _wave(df, p),
        lambda df, p, modes=2: p.select("series_id", (F.col("mean") + damped_sum(F.col("n"), F.col("params"))).alias("mu"), (F.col("sse") / F.col("n")).alias("var")),
    ),
    "modes": Component(lambda df, lag=3: spectral.koopman_modes(df, lag=lag), _modes_apply),
    "profile": Component(_profile_learn, _profile_apply, _profile_ahead),
    "interval": Component(_interval_learn, _interval_apply),
    "drift": Component(lambda df: df.select("series_id", "y"), _drift_apply),
    "wavelet": Component(spectral.wavelet_energies, lambda df, p: df.join(p.groupBy("series_id").pivot("level").agg(F.first("energy")), "series_id", "left")),
}


def get_agent(name: str, **config) -> PanelEstimator:
    if name not in REGISTRY:
        raise KeyError(f"unknown component {name}; known: {sorted(REGISTRY)}")
    return PanelEstimator(name, json.dumps(config))
