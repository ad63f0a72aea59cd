"""A forest that learns which learner wins from a dataset's meta-features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import constants as K
from ..functions.scalars import col, text_array
from ..operators import benchlog, metrics
from ..operators.preprocess import FEATURES, LABEL, NumericPrep
from ..operators.split import stratified_split
from ..operators.validate import require_columns
from ..sources.artifacts import load_model, save_model

# The deepest trees Spark grows.
DEEPEST = 30


@dataclass
class Selector:
    model: PipelineModel
    features: list[str]
    labels: list[str]
    facts: dict = field(default_factory=dict)

    def save(self, path: str) -> None:
        save_model(self.model, {"features": self.features, "labels": self.labels, **self.facts},
                   path)


def load_selector(spark, path: str) -> Selector | None:
    """The stored selector, or None when there is none to read."""
    found = load_model(spark, path)
    if found is None or "features" not in found[1]:
        return None
    model, meta = found
    extra = {k: v for k, v in meta.items() if k not in ("features", "labels")}
    return Selector(model, meta["features"], meta["labels"], extra)


def selector_table(log: DataFrame, seq: str = "seq") -> DataFrame:
    """Best learner per dataset name with the meta-features to predict it from."""
    require_columns(log, ["dataset_name", "model", "f1_score", *K.SELECTOR_FEATURES])
    best = benchlog.best_per_dataset(log.filter(col("model").isNotNull()), seq)
    return best.select("dataset_name", "model", "f1_score", *K.SELECTOR_FEATURES)


def balanced_weights(table: DataFrame, label: str = "model", output: str = "weight") -> DataFrame:
    """Adds rows / (classes * rows of the class), so every class weighs the same."""
    counts = table.groupBy(col(label).alias("_class")).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.agg(F.sum("_n"), F.count(F.lit(1))).first()
    weighted = counts.select(
        "_class", (F.lit(float(totals[0] or 0)) / (F.lit(totals[1]) * F.col("_n"))).alias(output))
    return table.join(weighted, col(label) == F.col("_class")).drop("_class")


def train_selector(
    log: DataFrame, seq: str = "seq", trees: int = 300, max_depth: int = DEEPEST,
    holdout: bool = False,
) -> Selector:
    """Fit the forest on the best learner of every dataset.

    Accuracy is taken on the training rows, as the selector has always been judged;
    ``holdout`` also measures it on datasets kept aside.
    """
    table = selector_table(log, seq).persist()
    try:
        facts = {}
        if holdout:
            train, test = stratified_split(table, "model", "dataset_name")
            part = _fit(train, trees, max_depth)
            scored = predict_learner(test, part)
            facts["holdout_accuracy"] = metrics.classification_metrics(
                scored, "model", "predicted_model").first()["accuracy"]
        selector = _fit(table, trees, max_depth)
        scored = predict_learner(table, selector)
        facts["training_accuracy"] = metrics.classification_metrics(
            scored, "model", "predicted_model").first()["accuracy"]
        facts["datasets"] = table.count()
        selector.facts = facts
        return selector
    finally:
        table.unpersist()


def _fit(table: DataFrame, trees: int, max_depth: int) -> Selector:
    # Learner names: at most as many as there are learners.
    labels = [r[0] for r in table.select("model").distinct().orderBy("model").collect()]
    names = list(K.SELECTOR_FEATURES)
    index = StringIndexerModel.from_labels(labels, inputCol="model", outputCol=LABEL)
    outputs = [f"ts_num_{i}" for i in range(len(names))]
    model = Pipeline(stages=[
        NumericPrep(inputCols=names, outputCols=outputs, scale=False),
        VectorAssembler(inputCols=outputs, outputCol=FEATURES),
        RandomForestClassifier(
            featuresCol=FEATURES, labelCol=LABEL, weightCol="weight", numTrees=trees,
            maxDepth=max_depth, featureSubsetStrategy="sqrt", seed=K.SEED),
    ]).fit(index.transform(balanced_weights(table)))
    return Selector(model, names, labels)


def _label(labels: Sequence[str], position: Column) -> Column:
    return F.element_at(text_array(labels), position.cast("int") + 1)


def predict_learner(profiles: DataFrame, selector: Selector) -> DataFrame:
    """Adds the predicted learner."""
    scored = selector.model.transform(profiles)
    return scored.select(*[col(c) for c in profiles.columns],
                         _label(selector.labels, F.col("prediction")).alias("predicted_model"))


def rank_learners(profiles: DataFrame, selector: Selector) -> DataFrame:
    """Adds the predicted learner and all learners by falling probability."""
    scored = selector.model.transform(profiles)
    pairs = F.arrays_zip(
        vector_to_array("probability").alias("p"), text_array(selector.labels).alias("m"))
    entries = F.transform(pairs, lambda x: F.struct((-x["p"]).alias("order"), x["m"].alias("m")))
    ranking = F.transform(
        F.array_sort(entries),
        lambda x: F.struct(x["m"].alias("model"), F.round(-x["order"], 4).alias("confidence")))
    return scored.select(
        *[col(c) for c in profiles.columns],
        _label(selector.labels, F.col("prediction")).alias("predicted_model"),
        ranking.alias("ranking"))


def ranking_rows(ranked: DataFrame, by: Sequence[str]) -> DataFrame:
    """The ranking as rows of position, learner and confidence."""
    return ranked.select(
        *[col(c) for c in by], F.posexplode("ranking").alias("position", "entry")
    ).select(*[col(c) for c in by], (F.col("position") + 1).alias("position"),
             F.col("entry.model").alias("model"), F.col("entry.confidence").alias("confidence"))


def rank_confidences(
    scores: DataFrame, by: str, model: str = "model", confidence: str = "confidence"
) -> DataFrame:
    """Learners per group by falling confidence, rounded to 4 digits, numbered from 1."""
    order = Window.partitionBy(col(by)).orderBy(col(confidence).desc_nulls_last(), col(model))
    return scores.select(
        col(by), col(model), F.round(col(confidence), 4).alias(confidence),
        F.row_number().over(order).alias("position"))


def evaluate_selector(table: DataFrame, selector: Selector) -> dict[str, DataFrame]:
    """Per-dataset correctness, metrics, class report, confusion and distributions."""
    scored = metrics.mark_correct(predict_learner(table, selector), "model", "predicted_model")
    return {
        "evaluation": scored.select("dataset_name", "n_samples", "n_features", "n_classes",
                                    "model", "predicted_model", "correct"),
        "metrics": metrics.classification_metrics(scored, "model", "predicted_model"),
        "report": metrics.class_report(scored, "model", "predicted_model"),
        "confusion": metrics.confusion(scored, "model", "predicted_model"),
        "distributions": metrics.label_distributions(scored, "model", "predicted_model"),
        "counts": metrics.correct_counts(scored, "model", "predicted_model"),
    }


def recommend_for(spark, selector: Selector, meta: Mapping) -> DataFrame:
    """Prediction and ranking for one set of meta-features given by value."""
    row = {name: float(meta[name]) for name in selector.features}
    return rank_learners(spark.createDataFrame([row]), selector)
