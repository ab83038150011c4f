"""Regression candidates on standardised features."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from tidewright.operators import metrics


@dataclass(frozen=True)
class Candidate:
    name: str
    grid: tuple[dict, ...]


def _product(**axes) -> tuple[dict, ...]:
    return tuple(dict(zip(axes, v)) for v in itertools.product(*axes.values()))


#: Search spaces and budgets. Fixed values. The second boosting space stands in
#: for a histogram booster that is not installed: its least child weight is the
#: least rows of a leaf, its column sampling is by node, and it has no L1 and
#: L2. The trees here know no least rows of a split.
SPACES = {
    "quick": {
        "ridge": _product(alpha=(0.1, 1.0, 10.0)),
        "random_forest": _product(trees=(40, 60), depth=(8, 12), leaf=(2, 4), features=(0.7, 1.0)),
        "gradient_boosting": _product(rounds=(40, 60), rate=(0.05, 0.1), depth=(2, 3), rows=(0.7, 1.0)),
        "gradient_boosting_deep": _product(rounds=(60, 100), rate=(0.05, 0.1), depth=(3, 5), leaf=(1, 5), rows=(0.7, 1.0), features=(0.7, 1.0)),
    },
    "normal": {
        "ridge": _product(alpha=(0.01, 0.1, 1.0, 10.0, 100.0)),
        "random_forest": _product(trees=(60, 100, 120), depth=(8, 12), leaf=(2, 4), features=(0.7, 1.0)),
        "gradient_boosting": _product(rounds=(60, 90, 120), rate=(0.03, 0.07, 0.1), depth=(2, 3), rows=(0.7, 1.0)),
        "gradient_boosting_deep": _product(rounds=(80, 140, 200), rate=(0.03, 0.07, 0.1), depth=(3, 5), leaf=(1, 5, 10), rows=(0.7, 1.0), features=(0.7, 1.0)),
    },
}
BUDGET = {
    "quick": {"random_forest": 2, "gradient_boosting": 2, "gradient_boosting_deep": 2},
    "normal": {"random_forest": 6, "gradient_boosting": 6, "gradient_boosting_deep": 8},
}


def trials(name: str, mode: str, seed: int = 42) -> list[dict]:
    """The configurations tried: a ridge's whole grid, else the first of the grid in seeded hash order."""
    import hashlib
    import json

    grid = list(SPACES[mode][name])
    if name == "ridge":
        return grid
    return sorted(grid, key=lambda p: hashlib.sha256(f"{seed}{json.dumps(p, sort_keys=True)}".encode()).hexdigest())[: BUDGET[mode][name]]


def assembled(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def estimator(name: str, params: dict, train: DataFrame, target: str, seed: int = 42):
    common = dict(featuresCol="features", labelCol=target, predictionCol="prediction")
    if name == "ridge":
        # the library divides the squared error by 2n and scales the penalty by the label's deviation
        n, s = train.agg(F.count("*"), F.stddev_pop(target)).first()
        return LinearRegression(**common, solver="normal", elasticNetParam=0.0, standardization=False, regParam=params["alpha"] * (s or 1.0) / max(n, 1))
    if name == "linear":
        return LinearRegression(**common, solver="normal")
    if name == "random_forest":
        return RandomForestRegressor(**common, numTrees=params["trees"], maxDepth=params["depth"], minInstancesPerNode=params["leaf"], featureSubsetStrategy=str(params.get("features", 0.7)), seed=seed)
    more = {"minInstancesPerNode": params.get("leaf", 1), "subsamplingRate": params.get("rows", 0.7), "featureSubsetStrategy": str(params.get("features", 1.0))}
    return GBTRegressor(**common, maxIter=params["rounds"], stepSize=params["rate"], maxDepth=params["depth"], seed=seed, **more)


def search(name: str, mode: str, train: DataFrame, validation: DataFrame, target: str):
    """(model, best, trials): every trial is scored on all validation rows; ties go to the first by its JSON."""
    import json

    done = []
    for p in trials(name, mode):
        m = estimator(name, p, train, target).fit(train)
        score = metrics.metrics(m.transform(validation).select(F.col(target).alias("y"), F.col("prediction").alias("p"))).first().asDict()
        done.append((score["mae"], json.dumps(p, sort_keys=True), m, score))
    done.sort(key=lambda t: t[:2])
    return done[0][2], {"params": json.loads(done[0][1]), **done[0][3]}, [{"params": json.loads(t[1]), **t[3]} for t in done]
