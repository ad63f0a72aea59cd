"""Row and column checks, filters and projections."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import constants as K
from ..functions.scalars import col, present


def require_rows(df: DataFrame, message: str = "the table is empty") -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def missing_columns(df: DataFrame, columns: Iterable[str]) -> list[str]:
    have = set(df.columns)
    return [c for c in columns if c not in have]


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    absent = missing_columns(df, columns)
    if absent:
        raise ValueError(f"missing columns {absent}; available: {df.columns}")
    return df


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target is known; NaN counts as unknown."""
    require_columns(df, [target])
    return df.filter(present(target, df.schema[target].dataType).isNotNull())


def label_text(name: str, dtype: T.DataType) -> Column:
    """A target value as text."""
    if isinstance(dtype, T.BooleanType):
        return F.initcap(col(name).cast("string"))
    return present(name, dtype).cast("string")


def clean_target(df: DataFrame, target: str) -> DataFrame:
    """Target as text, rows without a usable label dropped."""
    require_columns(df, [target])
    text = label_text(target, df.schema[target].dataType)
    return df.withColumn(target, text).filter(
        col(target).isNotNull() & ~col(target).isin(K.MISSING_LABELS)
    )


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with every listed column known."""
    require_columns(df, columns)
    for c in columns:
        df = df.filter(present(c, df.schema[c].dataType).isNotNull())
    return df


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly these columns; an absent one is an error."""
    return require_columns(df, columns).select(*[col(c) for c in columns])


def project_available(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Those of the columns that exist, in the given order."""
    have = set(df.columns)
    return df.select(*[col(c) for c in columns if c in have])


def split_target(df: DataFrame, target: str) -> tuple[list[str], str]:
    """Feature column names and the target name."""
    require_columns(df, [target])
    return [c for c in df.columns if c != target], target


def filter_catalog(
    catalog: DataFrame,
    min_rows: int = K.MIN_SAMPLES,
    min_features: int = K.MIN_FEATURES,
    min_classes: int = K.MIN_CLASSES,
    exclude: Sequence[str] = K.EXCLUDED_DATASETS,
) -> DataFrame:
    """Datasets large and varied enough to benchmark. Unnamed datasets stay."""
    named_out = F.coalesce(col("dataset_name").isin(list(exclude)), F.lit(False))
    return catalog.filter(
        (col("n_samples") >= min_rows) & (col("n_features") >= min_features)
        & (col("n_classes") >= min_classes) & ~named_out
    )


def viability_of(rows: Column, features: Column, classes: Column) -> Column:
    return (
        F.when(rows < K.MIN_RUN_ROWS, "too_few_rows")
        .when(features <= 0, "no_features")
        .when(classes < 2, "one_class")
        .otherwise("ok")
    )


def viability(catalog: DataFrame) -> DataFrame:
    """Why a dataset can or cannot be benchmarked, for a whole catalog at once."""
    return catalog.withColumn(
        "viability", viability_of(col("n_samples"), col("n_features"), col("n_classes"))
    )


def reconcile_features(df: DataFrame, meta: Mapping | None) -> DataFrame:
    """The training features in training order; everything else is dropped.

    Without metadata every column is taken as a feature.
    """
    if not meta:
        return df
    if meta.get("target_column") in df.columns:
        df = df.drop(col(meta["target_column"]))
    features = list(meta.get("feature_columns", []))
    absent = missing_columns(df, features)
    if absent:
        raise ValueError(f"missing required features {absent}")
    return df.select(*[col(c) for c in features])


def ignored_columns(meta: Mapping) -> list[str]:
    """Row id and ignored columns named in dataset metadata."""
    ignored = meta.get("ignore_attribute") or []
    if isinstance(ignored, str):
        ignored = [part.strip() for part in ignored.split(",")]
    row_id = meta.get("row_id_attribute")
    return ([row_id] if row_id else []) + list(ignored)


def drop_ignored(df: DataFrame, meta: Mapping, target: str | None = None) -> tuple[DataFrame, str]:
    """Table without row id and ignored columns, and the target to use."""
    name = meta.get("default_target_attribute") or target
    if name is None:
        raise ValueError("no target column named")
    require_columns(df, [name])
    unwanted = [c for c in ignored_columns(meta) if c in df.columns and c != name]
    return df.drop(*[col(c) for c in unwanted]), name


def slice_equal(df: DataFrame, **wanted) -> DataFrame:
    """Rows where each named column equals the given value."""
    for name, value in wanted.items():
        df = df.filter(col(name) == F.lit(value))
    return df
