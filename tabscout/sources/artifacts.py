"""Saving and loading fitted models with a metadata row, and storing scored tables."""

from __future__ import annotations

import json
import warnings

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from ..operators.learners import NeighboursModel
from .tables import write_table


def _neighbour_stages(model) -> list[NeighboursModel]:
    stages = []
    for stage in getattr(model, "stages", []):
        if isinstance(stage, NeighboursModel):
            stages.append(stage)
        elif isinstance(stage, PipelineModel):
            stages += _neighbour_stages(stage)
    return stages


def save_model(model: PipelineModel, meta: dict, path: str) -> None:
    """Store a model folder with its metadata beside it.

    Training rows and labels that are part of a model are copied along.
    """
    session = SparkSession.getActiveSession()
    labels = meta.get("labels")
    if isinstance(labels, dict) and labels["path"] != f"{path}/labels":
        session.read.parquet(labels["path"]).write.mode("overwrite").parquet(f"{path}/labels")
        meta = {**meta, "labels": {**labels, "path": f"{path}/labels"}}
    for i, stage in enumerate(_neighbour_stages(model)):
        kept = f"{path}/rows-{i}"
        if stage.getOrDefault(stage.trainPath) != kept:
            stage.training_rows(session).write.mode("overwrite").parquet(kept)
            stage.set(stage.trainPath, kept)
    model.write().overwrite().save(f"{path}/model")
    session.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode(
        "overwrite").text(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict] | None:
    """Model and metadata, or None when either is absent or unreadable; a warning says why."""
    try:
        model = PipelineModel.load(f"{path}/model")
        meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    except Exception as reason:
        if "PATH_NOT_FOUND" not in str(reason) and "does not exist" not in str(reason):
            warnings.warn(f"no model can be read from {path}: {reason}", stacklevel=2)
        return None
    for i, stage in enumerate(_neighbour_stages(model)):
        stage.set(stage.trainPath, f"{path}/rows-{i}")
    if isinstance(meta.get("labels"), dict):
        meta["labels"]["path"] = f"{path}/labels"
    return model, meta


def write_scores(scored: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Store features with prediction and, where there is one, its probability."""
    write_table(scored, path, fmt)
