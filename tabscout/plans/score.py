"""Applying a trained model to new tables, batch or stream."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import col, text_array
from ..operators.dictionary import look_up
from ..operators.profile import class_distribution
from ..operators.validate import reconcile_features


def _probability(scored: DataFrame) -> Column | None:
    """Highest class probability, from whatever the learner leaves behind."""
    if "probability" in scored.columns:
        return F.array_max(vector_to_array("probability"))
    if "ts_vote_share" in scored.columns:
        return col("ts_vote_share")
    if "rawPrediction" in scored.columns:
        # One-against-the-rest boosting: each class's own odds, brought to sum 1.
        odds = F.transform(vector_to_array("rawPrediction"), lambda x: 1 / (1 + F.exp(-2 * x)))
        total = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
        return F.try_divide(F.array_max(odds), total)
    return None


def predicted_value(meta: Mapping, prediction: Column) -> Column:
    """A prediction in the target's own values."""
    if meta["task_type"] != "classification":
        return prediction
    label = F.element_at(text_array(meta["labels"]), prediction.cast("int") + 1)
    kind = meta.get("target_type", "string")
    return label if kind == "string" else label.cast(kind)


def score(df: DataFrame, model: PipelineModel, meta: Mapping) -> DataFrame:
    """Training features in order, prediction, and its probability for classifiers.

    A target column is dropped, extra columns are ignored, missing ones are an error.
    """
    features = reconcile_features(df, meta)
    scored = model.transform(features)
    columns = [col(c) for c in features.columns]
    if isinstance(meta.get("labels"), Mapping):
        # Labels in a table of their own.
        table = df.sparkSession.read.parquet(meta["labels"]["path"])
        scored = look_up(scored.withColumn("ts_class", F.col("prediction").cast("bigint")),
                         "ts_class", table, "ts_class_label", "code", "label")
        kind = meta.get("target_type", "string")
        value = F.col("ts_class_label")
        columns.append((value if kind == "string" else value.cast(kind)).alias("prediction"))
    else:
        columns.append(predicted_value(meta, F.col("prediction")).alias("prediction"))
    if meta["task_type"] == "classification":
        probability = _probability(scored)
        if probability is not None:
            columns.append(probability.alias("prediction_probability"))
    return scored.select(*columns)


def prediction_distribution(scored: DataFrame) -> DataFrame:
    """Rows per predicted value, most frequent first."""
    return class_distribution(scored, "prediction")
