"""Learners: names, parameters and the Spark ML estimators behind them.

Parameters that depend on the training rows (row count, label spread, number of
classes) are settled inside ``fit``, so one estimator serves any table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, Param, Params, TypeConverters
from pyspark.ml.regression import LinearRegression
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from ..functions import constants as K
from ..functions.names import canonical_learner
from ..session import materialise, scratch_path
from .kernel import KernelClassifier, KernelRegressor
from .neighbors import average, neighbours, vote
from .preprocess import FEATURES, LABEL
from .trees import HistogramBooster, HistogramForest


class FitTimeLearner(Estimator, HasFeaturesCol, HasLabelCol, DefaultParamsReadable,
                     DefaultParamsWritable):
    """Base of estimators that finish their parameters from the training rows."""

    def _io(self) -> dict:
        return {"featuresCol": self.getFeaturesCol(), "labelCol": self.getLabelCol()}


class PenalisedLogistic(FitTimeLearner):
    """Logistic regression with inverse penalty 1 spread over the rows."""

    maxIter = Param(Params._dummy(), "maxIter", "iterations", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol=FEATURES, labelCol=LABEL, maxIter=3000):
        super().__init__()
        self._setDefault(featuresCol=FEATURES, labelCol=LABEL, maxIter=3000)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> Model:
        return LogisticRegression(
            **self._io(), maxIter=self.getOrDefault(self.maxIter), regParam=1.0 / dataset.count(),
            elasticNetParam=0.0, standardization=False).fit(dataset)


class Ridge(FitTimeLearner):
    """Linear regression with squared penalty ``alpha`` on the whole sum of squares."""

    alpha = Param(Params._dummy(), "alpha", "penalty", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol=FEATURES, labelCol=LABEL, alpha=1.0):
        super().__init__()
        self._setDefault(featuresCol=FEATURES, labelCol=LABEL, alpha=1.0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> Model:
        label = F.col(self.getLabelCol())
        n, spread = dataset.agg(F.count(label), F.stddev_pop(label)).first()
        width = len(dataset.select(self.getFeaturesCol()).first()[0])
        # The closed form is limited to 4096 features; past that, and with its own
        # scaling of the label, the iterative solver takes over.
        solver = "normal" if width <= 4096 else "l-bfgs"
        if solver == "l-bfgs":
            spread = dataset.agg(F.stddev_samp(label)).first()[0]
        return LinearRegression(
            **self._io(), elasticNetParam=0.0, standardization=False, solver=solver,
            regParam=self.getOrDefault(self.alpha) * (spread or 0.0) / n).fit(dataset)


class Neighbours(FitTimeLearner):
    """k nearest neighbours, exact or approximate: votes for classes, the mean for numbers."""

    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)
    regression = Param(Params._dummy(), "regression", "average instead of vote",
                       TypeConverters.toBoolean)
    method = Param(Params._dummy(), "method", "exact or approximate", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol=FEATURES, labelCol=LABEL, k=5, regression=False,
                 method="exact"):
        super().__init__()
        self._setDefault(featuresCol=FEATURES, labelCol=LABEL, k=5, regression=False, method="exact")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "NeighboursModel":
        # The training rows are the model; they stay in files all executors can read.
        path = scratch_path(dataset.sparkSession, "neighbours")
        # Ties are settled by a hash of the row: the same however the rows are dealt.
        rows = dataset.select(
            vector_to_array(F.col(self.getFeaturesCol())).alias("vector"),
            F.col(self.getLabelCol()).cast("double").alias("outcome"),
        ).select(F.xxhash64("vector", "outcome").alias("key"), "vector", "outcome")
        rows.write.parquet(path)
        return NeighboursModel(
            featuresCol=self.getFeaturesCol(), k=self.getOrDefault(self.k),
            regression=self.getOrDefault(self.regression), trainPath=path,
            method=self.getOrDefault(self.method))


class NeighboursModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """Stored training rows, searched when scoring. Batch frames only."""

    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)
    regression = Param(Params._dummy(), "regression", "average instead of vote",
                       TypeConverters.toBoolean)
    trainPath = Param(Params._dummy(), "trainPath", "stored training rows",
                      TypeConverters.toString)
    method = Param(Params._dummy(), "method", "exact or approximate", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol=FEATURES, k=5, regression=False, trainPath=None,
                 method="exact"):
        super().__init__()
        self._setDefault(featuresCol=FEATURES, k=5, regression=False, method="exact")
        self._set(**self._input_kwargs)

    def training_rows(self, spark) -> DataFrame:
        return spark.read.parquet(self.getOrDefault(self.trainPath))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        # Row numbers are only stable once stored.
        numbered = materialise(
            dataset.withColumn("ts_row", F.monotonically_increasing_id())
        )
        query = numbered.select(
            "ts_row", vector_to_array(F.col(self.getFeaturesCol())).alias("vector"))
        found = neighbours(self.training_rows(dataset.sparkSession), query,
                           self.getOrDefault(self.k), "key", "ts_row", "vector", "outcome",
                           self.getOrDefault(self.method))
        if self.getOrDefault(self.regression):
            answers = average(found)
        else:
            answers = vote(found).withColumnRenamed("probability", "ts_vote_share")
        joined = numbered.join(answers, numbered["ts_row"] == answers["query_key"])
        return joined.drop("ts_row", "query_key")




_Make = Callable[..., Estimator]

_IO = {"featuresCol": FEATURES, "labelCol": LABEL}

CLASSIFIER_MAKERS: dict[str, _Make] = {
    "logistic regression": lambda maxIter=3000: PenalisedLogistic(maxIter=maxIter),
    "decision tree": lambda maxDepth=10: DecisionTreeClassifier(
        **_IO, maxDepth=maxDepth, seed=K.SEED),
    "random forest": lambda numTrees=200, maxDepth=15, bootstrap=True, nodeFeatures="sqrt":
        HistogramForest(trees=numTrees, depth=maxDepth, bootstrap=bootstrap, nodeFeatures=nodeFeatures),
    "gradient boosting": lambda trees=100, depth=3: HistogramBooster(trees=trees, depth=depth),
    "knn": lambda k=5, method="exact": Neighbours(k=k, method=method),
    "naive bayes": lambda: NaiveBayes(**_IO, modelType="gaussian"),
    "svm": lambda width=256, maxIter=100, probability=True: KernelClassifier(
        width=width, maxIter=maxIter, probability=probability),
}

REGRESSOR_MAKERS: dict[str, _Make] = {
    "linear regression": lambda: LinearRegression(**_IO, regParam=0.0),
    "ridge": lambda alpha=1.0: Ridge(alpha=alpha),
    # Asking for a regression tree gives boosted trees; callers rely on it.
    "decision tree": lambda trees=100, depth=3: _boosted_regressor(trees, depth),
    "random forest": lambda numTrees=200, maxDepth=15, bootstrap=True: HistogramForest(
        regression=True, trees=numTrees, depth=maxDepth, bootstrap=bootstrap, nodeFeatures="all"),
    "gradient boosting": lambda trees=100, depth=3: _boosted_regressor(trees, depth),
    "knn": lambda k=5, method="exact": Neighbours(k=k, regression=True, method=method),
    "svm": lambda width=256, maxIter=100: KernelRegressor(width=width, maxIter=maxIter),
}


def _boosted_regressor(trees: int, depth: int) -> Estimator:
    return HistogramBooster(regression=True, trees=trees, depth=depth)


def make_learner(name: str, task: str, params: Mapping | None = None) -> Estimator:
    """The estimator for a learner name in any accepted spelling."""
    makers = CLASSIFIER_MAKERS if task == "classification" else REGRESSOR_MAKERS
    known = canonical_learner(name)
    if known not in makers:
        raise ValueError(f"unsupported learner {name!r} for {task}; supported: {list(makers)}")
    return makers[known](**dict(params or {}))


# The benchmark suite: official label -> (scaled features?, estimator).
SUITE_MAKERS: dict[str, tuple[bool, _Make]] = {
    "LogisticRegression": (True, lambda maxIter=2000: PenalisedLogistic(maxIter=maxIter)),
    # Depth 0: as deep as the rows allow.
    "DecisionTree": (False, lambda maxDepth=0: HistogramForest(
        trees=1, depth=maxDepth, bootstrap=False, nodeFeatures="all")),
    "RandomForest": (False, lambda numTrees=200, maxDepth=0: HistogramForest(
        trees=numTrees, depth=maxDepth)),
    "KNN": (True, lambda k=5, method="exact": Neighbours(k=k, method=method)),
    "SVM": (True, lambda width=256, maxIter=100, probability=True: KernelClassifier(
        width=width, maxIter=maxIter, probability=probability)),
    "XGBoost": (False, lambda trees=200, depth=6, rowShare=0.8, columnShare=0.8: HistogramBooster(
        trees=trees, depth=depth, rate=0.1, penalty=1.0, minHessian=1.0, rowShare=rowShare,
        columnShare=columnShare, byHessian=True, prior=False)),
}
