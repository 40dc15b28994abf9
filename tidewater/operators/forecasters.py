"""Candidates that fit on a table and predict on another; built-in ones use Spark ML."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Candidate(Protocol):
    def fit(self, train: DataFrame) -> Candidate: ...

    def predict(self, rows: DataFrame) -> DataFrame: ...


@dataclass
class Fitted:
    """A Spark ML regressor over named feature columns; a constant target is predicted as such."""

    features: tuple[str, ...]
    target: str
    estimator: Callable[[int, float], object]
    models: list[Model] = field(default_factory=list)
    constant: float | None = None

    def _assembled(self, rows: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=list(self.features), outputCol="_features", handleInvalid="skip").transform(rows)

    def fit(self, train: DataFrame) -> Fitted:
        n, sd, mean = train.agg(F.count(self.target), F.stddev_samp(self.target), F.avg(self.target)).first()
        if not n or not sd:
            self.constant = float(mean or 0.0)
            return self
        estimator = self.estimator(n, float(sd))
        self.models = [estimator.setFeaturesCol("_features").setLabelCol(self.target).setPredictionCol("predicted").fit(self._assembled(train))]
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        if self.constant is not None:
            return rows.withColumn("predicted", F.lit(self.constant))
        return self.models[0].transform(self._assembled(rows)).drop("_features")


def ridge(alpha: float = 10.0) -> Callable[[int, float], LinearRegression]:
    """Least squares with alpha times the squared weights: Spark's objective is scaled by n and the target's deviation.

    The normal equations need one pass over the rows, however many steps their solution takes.
    """
    return lambda n, sd: LinearRegression(regParam=alpha * sd / n, elasticNetParam=0.0, standardization=False, solver="normal")


def elastic_net(alpha: float, ratio: float) -> Callable[[int, float], LinearRegression]:
    def make(n: int, sd: float) -> LinearRegression:
        total = alpha * ratio + alpha * (1 - ratio) * sd
        return LinearRegression(regParam=total, elasticNetParam=alpha * ratio / total, standardization=False, solver="normal")

    return make


def boosted(seed: int) -> Callable[[int, float], GBTRegressor]:
    return lambda n, sd: GBTRegressor(maxIter=10, maxDepth=3, seed=seed)


@dataclass
class RandomFeatures:
    """Ridge on fixed rectified projections, whose weights are hashes of the seed."""

    features: tuple[str, ...]
    target: str
    seed: int
    width: int = 16
    inner: Fitted | None = None

    def _projected(self, rows: DataFrame) -> DataFrame:
        weight = lambda j, k: F.pmod(F.xxhash64(F.lit(self.seed), F.lit(j), F.lit(k)), F.lit(2001)) / 1000.0 - 1.0
        made = {f"_r{j}": F.greatest(F.lit(0.0), sum((weight(j, k) * F.col(c) for k, c in enumerate(self.features)), weight(j, -1))) for j in range(self.width)}
        return rows.withColumns(made)

    def fit(self, train: DataFrame) -> RandomFeatures:
        self.inner = Fitted(tuple(f"_r{j}" for j in range(self.width)), self.target, ridge(1.0)).fit(self._projected(train))
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.inner.predict(self._projected(rows)).drop(*(f"_r{j}" for j in range(self.width)))


def windows_to_columns(rows: DataFrame, lookback: int, kernel: int = 5) -> DataFrame:
    """trend_k and rest_k of an array column ``window``: a centred moving average with repeated edges, and what remains."""
    half = kernel // 2
    at = lambda k: F.element_at("window", min(max(k, 0), lookback - 1) + 1)
    trend = {k: sum((at(j) for j in range(k - half, k + half + 1)), F.lit(0.0)) / kernel for k in range(lookback)}
    return rows.withColumns({f"trend_{k}": t for k, t in trend.items()} | {f"rest_{k}": at(k) - t for k, t in trend.items()})


@dataclass
class Decomposed:
    """Two ridges, on trend and on rest, whose predictions are added."""

    lookback: int
    target: str
    parts: list[Fitted] = field(default_factory=list)

    def fit(self, train: DataFrame) -> Decomposed:
        wide = windows_to_columns(train, self.lookback).withColumn("_half", F.col(self.target) / 2)
        self.parts = [Fitted(tuple(f"{p}_{k}" for k in range(self.lookback)), "_half", ridge(1.0)).fit(wide) for p in ("trend", "rest")]
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        out = self.parts[0].predict(windows_to_columns(rows, self.lookback)).withColumnRenamed("predicted", "_first")
        return self.parts[1].predict(out).withColumn("predicted", F.col("predicted") + F.col("_first")).drop("_first")


#: Name of a candidate family -> factory(features, target, seed).
CANDIDATES: dict[str, Callable[..., Candidate]] = {
    "ridge": lambda features, target, seed: Fitted(tuple(features), target, ridge()),
    "elastic_net": lambda features, target, seed: Fitted(tuple(features), target, elastic_net(1.0, 0.5)),
    "boosted_trees": lambda features, target, seed: Fitted(tuple(features), target, boosted(seed)),
    "random_features": lambda features, target, seed: RandomFeatures(tuple(features), target, seed),
} | {f"elastic_net_a{a:g}_l{r:g}": (lambda features, target, seed, a=a, r=r: Fitted(tuple(features), target, elastic_net(a, r))) for a in (0.001, 0.01, 0.1, 1.0) for r in (0.15, 0.5)}
