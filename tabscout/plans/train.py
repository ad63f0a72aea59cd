"""Training the final model: detect, advise, evaluate on a holdout, refit on everything."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import DataFrame, functions as F

from ..functions.names import gate
from ..functions.scalars import col
from ..operators import metrics
from ..operators.dictionary import look_up, store_dictionary
from ..operators.learners import make_learner
from ..operators.prepare import drop_identifiers
from ..operators.preprocess import LABEL, prep_stages
from ..operators.profile import target_counts, type_class
from ..operators.split import mark_holdout
from ..operators.validate import drop_null_target, label_text, require_rows
from ..session import hold_for_iteration, materialise
from ..sources.artifacts import save_model
from .recommend import recommend
from .selector import Selector

# Labels of up to this many classes are part of the model, more are a table beside it.
INLINE_CLASSES = 10_000
INLINE_CHARACTERS = 16_000_000

#: Labels in order, or where their table is (path, size).
Labels = list[str] | dict


@dataclass
class Trained:
    model: PipelineModel
    meta: dict

    def save(self, path: str) -> None:
        save_model(self.model, self.meta, path)


def class_labels(df: DataFrame, target: str) -> Labels:
    """All labels as text, in the order of their original values; of very many the stored table."""
    counts = target_counts(df, target).filter("value IS NOT NULL")
    text = label_text("value", counts.schema["value"].dataType)
    named = materialise(counts.select("value", text.alias("label"), "n"))
    n, characters, rows = named.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.length("label")), F.lit(0)), F.sum("n")).first()
    if n <= INLINE_CLASSES and characters <= INLINE_CHARACTERS:
        return [r["label"] for r in sorted(named.collect(), key=lambda r: r["value"])]
    return {"path": store_dictionary(named, n, rows), "size": n}


def with_label(df: DataFrame, target: str, task: str, labels: Labels | None) -> DataFrame:
    """Adds the numeric label learners train on."""
    if task == "regression":
        return df.withColumn(LABEL, col(target).cast("double"))
    text = label_text(target, df.schema[target].dataType)
    named = df.withColumn("ts_label_text", text)
    if isinstance(labels, dict):
        table = df.sparkSession.read.parquet(labels["path"])
        coded = look_up(named, "ts_label_text", table, "ts_label_code", "label")
        kind = {"ml_attr": {"type": "nominal", "num_vals": labels["size"], "name": LABEL}}
        return coded.withColumn(LABEL, F.col("ts_label_code").cast("double").alias(
            LABEL, metadata=kind)).drop("ts_label_text", "ts_label_code")
    index = StringIndexerModel.from_labels(labels, inputCol="ts_label_text", outputCol=LABEL)
    return index.transform(named).drop("ts_label_text")


def build_pipeline(features: DataFrame, learner: str, task: str, params: Mapping | None = None,
                   scale: bool = True, policy: str = "trainer") -> Pipeline:
    """Preprocessing for these columns followed by the learner."""
    return Pipeline(stages=[
        *prep_stages(features, scale, policy), make_learner(learner, task, params)])


def evaluate(scored: DataFrame, task: str) -> dict:
    """Holdout metrics of one scored frame as plain numbers."""
    if task == "classification":
        row = metrics.classification_metrics(scored, LABEL, "prediction").first()
        return {m: row[m] for m in ("accuracy", "balanced_accuracy", "f1_score")}
    return metrics.regression_metrics(scored, LABEL, "prediction").first().asDict()


def _on_holdout(rows: DataFrame, shape: DataFrame, name: str, task: str, params) -> dict:
    """Metrics of a learner fitted on the rows not marked for testing."""
    fitted = build_pipeline(shape, name, task, params).fit(rows.filter(~F.col("ts_test")))
    return evaluate(fitted.transform(rows.filter(F.col("ts_test"))), task)


def holdout_scores(
    df: DataFrame, target: str, key: str | list[str], learner: str, task: str,
    params: Mapping | None = None,
) -> dict:
    """Holdout metrics of one learner on all columns but target and key."""
    known = drop_null_target(df, target)
    keys = [key] if isinstance(key, str) else list(key)
    labels = class_labels(known, target) if task == "classification" else None
    shape = df.drop(*[col(c) for c in (target, *keys)])
    rows = hold_for_iteration(mark_holdout(
        with_label(known, target, task, labels).drop(col(target)),
        LABEL if labels else None, keys, output="ts_test"))
    try:
        return _on_holdout(rows, shape, learner, task, params)
    finally:
        rows.unpersist()


def train_final(
    df: DataFrame,
    target: str,
    key: str | list[str],
    dataset: str | None = None,
    learner: str | None = None,
    params: Mapping | None = None,
    selector: Selector | None = None,
    strict_gate: bool = False,
) -> Trained:
    """Fit the advised (or given) learner, report holdout metrics, keep a model of all rows.

    ``key`` identifies rows for the split; it is no feature when the identifier rule
    removes it.
    """
    require_rows(df)
    known = drop_null_target(df, target)
    advice = recommend(known, target, dataset, selector).first()
    task = advice["task_type"]
    name = learner or gate(advice["recommended_model"], task, strict_gate)
    keys = [key] if isinstance(key, str) else list(key)
    labels = class_labels(known, target) if task == "classification" else None
    labelled = with_label(known, target, task, labels)
    _, removed = drop_identifiers(known.drop(col(target)))
    features = [c for c in df.columns if c != target and c not in removed]
    passing = list(dict.fromkeys([*features, *keys]))
    stratum = LABEL if task == "classification" else None
    rows = hold_for_iteration(mark_holdout(
        labelled.select(*[col(c) for c in passing], LABEL), stratum, keys, output="ts_test"))
    try:
        shape = df.select(*[col(c) for c in features])
        scores = _on_holdout(rows, shape, name, task, params)
        held_out = rows.filter(F.col("ts_test")).count()
        final = build_pipeline(shape, name, task, params).fit(rows)
    finally:
        rows.unpersist()
    meta = {
        "dataset": dataset, "target_column": target, "task_type": task,
        "target_type": _plain_type(df, target), "recommended_model": name,
        "feature_columns": features, "removed_identifier_columns": removed,
        "training_samples": advice["samples"], "evaluation_samples": held_out,
        "labels": labels, **scores,
    }
    return Trained(final, meta)


def _plain_type(df: DataFrame, target: str) -> str:
    dtype = df.schema[target].dataType
    return "string" if type_class(dtype) == "text" else dtype.simpleString()
