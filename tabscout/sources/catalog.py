"""Listing datasets: ids, target and size of each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.profile import DatasetSpec, row_per_dataset, target_counts
from ..operators.validate import require_columns

def catalog_row(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """One dataset's row. ``n_features`` counts the target, as published catalogs do."""
    require_columns(df, [spec.target])
    return target_counts(df, spec.target).agg(
        F.lit(spec.task_id).cast("bigint").alias("task_id"),
        F.lit(spec.dataset_id).cast("bigint").alias("dataset_id"),
        F.lit(spec.name).alias("dataset_name"),
        F.lit(spec.target).alias("target_column"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_samples"),
        F.lit(len(df.columns)).cast("bigint").alias("n_features"),
        F.count("value").alias("n_classes"),
    )


def build_catalog(
    spark: SparkSession, specs: Sequence[DatasetSpec]
) -> tuple[DataFrame, dict[str, str]]:
    """A row per dataset and the reason for each one that had to be skipped."""
    return row_per_dataset(spark, specs, lambda spec: catalog_row(spec.load(spark), spec))
