"""Model columns, matrices, fits, selection on validation rows, and one evaluation on test rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial, reduce
from typing import TypeVar

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..spec import FeatureContract
from .metrics import prediction_metrics, select_best

T = TypeVar("T")
SEED = 314159
#: Fits that run at the same time.
FITS_AT_ONCE = 4
KEYS = ("key", "target_utc", "horizon_hours")


@dataclass(frozen=True)
class Config:
    """One row of a grid: family linear (regParam) or trees (maxDepth, maxIter, stepSize)."""

    name: str
    family: str
    reg: float = 0.0
    depth: int = 4
    rounds: int = 10
    step: float = 0.1

    def estimator(self):
        if self.family == "linear":
            return LinearRegression(featuresCol="features", labelCol="label", predictionCol="raw_prediction", solver="normal", standardization=True, regParam=self.reg, elasticNetParam=0.0)
        return GBTRegressor(featuresCol="features", labelCol="label", predictionCol="raw_prediction", maxDepth=self.depth, maxIter=self.rounds, stepSize=self.step, seed=SEED)


GRID = (Config("linear_0.01", "linear", 0.01), Config("linear_0.1", "linear", 0.1), Config("linear_1", "linear", 1.0), Config("trees_4", "trees", depth=4, rounds=15, step=0.1), Config("trees_5", "trees", depth=5, rounds=25, step=0.05))


def model_columns(df: DataFrame, contract: FeatureContract) -> DataFrame:
    """The keys, label, and typed copies: c_ strings and n_ doubles. One projection."""
    return df.select(*[c for c in (*KEYS, "split") if c in df.columns], F.col(contract.target).cast("double").alias("label"), *[F.col(c).cast("string").alias(f"c_{c}") for c in contract.categorical], *[F.col(c).cast("double").alias(f"n_{c}") for c in contract.numeric])


def preprocessing(contract: FeatureContract) -> Pipeline:
    """Index by frequency (ties by value), one-hot with a slot for unseen values, assemble; a null numeric raises."""
    indexed = [f"i_{c}" for c in contract.categorical]
    hot = [f"h_{c}" for c in contract.categorical]
    return Pipeline(stages=[
        StringIndexer(inputCols=[f"c_{c}" for c in contract.categorical], outputCols=indexed, handleInvalid="keep", stringOrderType="frequencyDesc"),
        OneHotEncoder(inputCols=indexed, outputCols=hot, handleInvalid="keep", dropLast=False),
        VectorAssembler(inputCols=[*hot, *[f"n_{c}" for c in contract.numeric]], outputCol="features", handleInvalid="error"),
    ])


def fit_preprocessing(train: DataFrame, contract: FeatureContract) -> PipelineModel:
    return preprocessing(contract).fit(model_columns(train, contract))


def matrix(model: PipelineModel, df: DataFrame, contract: FeatureContract) -> DataFrame:
    rows = model.transform(model_columns(df, contract))
    return rows.select(*[c for c in KEYS if c in rows.columns], "label", "features")


def vocabularies(model: PipelineModel, contract: FeatureContract) -> dict[str, list[str]]:
    return dict(zip(contract.categorical, map(list, model.stages[0].labelsArray), strict=True))


def vocabulary_table(train: DataFrame, contract: FeatureContract) -> DataFrame:
    """column, value, position as the indexer gives them, as one aggregate."""
    long = model_columns(train, contract).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c_{c}").alias("value")) for c in contract.categorical])).alias("v")).select("v.*")
    counts = long.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("position", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))) - 1)


def side_by_side(spark: SparkSession, jobs: Sequence[Callable[[], T]], width: int = FITS_AT_ONCE) -> list[T]:
    """The jobs' results, ``width`` at a time, so that the small jobs of one fit fill the cores that those of another leave idle. The first failure is raised.

    Each job's Spark jobs go to a pool of their own, which shares the cores fairly where the scheduler's mode is FAIR.
    """

    @inheritable_thread_target(spark)
    def run(k: int) -> T:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{k % width}")
        return jobs[k]()

    with ThreadPoolExecutor(width) as pool:
        return [f.result() for f in [pool.submit(run, k) for k in range(len(jobs))]]


@dataclass(frozen=True)
class Fit:
    """A fitted config of one horizon (None: of all rows) and contract."""

    hours: int | None
    contract: FeatureContract
    config: Config
    prepared: PipelineModel
    model: Model

    def predict(self, rows: DataFrame) -> DataFrame:
        """Keys, actual, raw_prediction, prediction (0 at least), feature_set, family and config of the horizon's rows."""
        own = rows if self.hours is None else rows.filter(F.col("horizon_hours") == self.hours)
        predicted = self.model.transform(matrix(self.prepared, own, self.contract))
        keys = [c for c in KEYS if c in predicted.columns]
        names = [F.lit(x).alias(c) for c, x in (("feature_set", self.contract.name), ("family", self.config.family), ("config", self.config.name))]
        return predicted.select(*keys, F.col("label").alias("actual"), "raw_prediction", F.greatest("raw_prediction", F.lit(0.0)).alias("prediction"), *names)


def fit_each(train: DataFrame, horizons: Sequence[int | None], contracts: Sequence[FeatureContract], configs: Sequence[Config]) -> list[Fit]:
    """Every config for every horizon and contract, side by side. Each matrix is made once, kept for all its configs, and released when all are fitted."""
    spark, cases = train.sparkSession, [(h, c) for h in horizons for c in contracts]

    def prepared(hours: int | None, contract: FeatureContract) -> tuple[PipelineModel, DataFrame]:
        own = train if hours is None else train.filter(F.col("horizon_hours") == hours)
        fitted = fit_preprocessing(own, contract)
        return fitted, matrix(fitted, own, contract).persist(StorageLevel.MEMORY_AND_DISK)

    matrices = side_by_side(spark, [partial(prepared, *case) for case in cases])
    try:
        fits = [(case, fitted, rows, config) for case, (fitted, rows) in zip(cases, matrices, strict=True) for config in configs]
        models = side_by_side(spark, [partial(config.estimator().fit, rows) for _, _, rows, config in fits])
        return [Fit(*case, config, fitted, model) for (case, fitted, _, config), model in zip(fits, models, strict=True)]
    finally:
        for _, rows in matrices:
            rows.unpersist()


def predict_each(fits: Sequence[Fit], rows: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [f.predict(rows) for f in fits])


def scores(predicted: DataFrame) -> DataFrame:
    """Errors of predictions by family, config, feature_set and, if there is one, horizon."""
    return prediction_metrics(predicted, [c for c in ("family", "config", "feature_set", "horizon_hours") if c in predicted.columns])


def fit_and_score(train: DataFrame, validation: DataFrame, contract: FeatureContract, grid: Sequence[Config] = GRID) -> DataFrame:
    """One row of validation metrics for each config. Preprocessing and models see training rows only."""
    return scores(predict_each(fit_each(train, [None], [contract], grid), validation))


def select_configs(scores: DataFrame) -> DataFrame:
    """The best config of each horizon, feature set and family: lowest MAE, then RMSE, then name. Takes validation scores only."""
    return select_best(scores, ["horizon_hours", "feature_set", "family"], ["mae", "rmse", "config"])


def evaluate_frozen(fit_on: DataFrame, test: DataFrame, contract: FeatureContract, config: Config) -> DataFrame:
    """Refit a frozen config and predict test rows once: keys, actual, prediction, feature_set."""
    return predict_each(fit_each(fit_on, [None], [contract], [config]), test).drop("family", "config")
