"""From a table and a target to an advised learner."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import advise
from ..operators.columnstats import one_row
from ..operators.profile import (
    _missing_pct, partition_columns, target_counts, task_aggregates, task_from_aggregates,
    type_class,
)
from ..operators.validate import drop_null_target, require_columns
from ..session import materialise
from .selector import Selector, rank_learners

RANKING = "array<struct<model:string,confidence:double>>"


def facts(df: DataFrame, target: str, dataset: str | None = None) -> DataFrame:
    """Task, sizes and missing share of a table, rows without target left out.

    One wide aggregate and one grouped count of the target.
    """
    require_columns(df, [target])
    dtype = df.schema[target].dataType
    if type_class(dtype) in ("time", "other"):
        raise ValueError(f"unsupported target type {dtype.simpleString()}; cast it to text first")
    known = drop_null_target(df, target)
    numeric, categorical = partition_columns(known, target, "advisor")
    features = [c for c in known.columns if c != target]
    row = one_row(
        known.agg(
            F.count(F.lit(1)).alias("samples"),
            _missing_pct(known, features).alias("missing_percentage"),
            *task_aggregates(target, dtype),
        ),
        target_counts(known, target).agg(F.count("value").alias("classes")),
    )
    task = task_from_aggregates()
    return row.select(
        task.alias("task_type"),
        F.lit(dataset).cast("string").alias("dataset"),
        F.col("samples"),
        F.lit(len(features)).cast("bigint").alias("features"),
        F.when(task == "classification", F.col("classes")).otherwise(0).cast("bigint")
        .alias("classes"),
        F.lit(len(numeric)).cast("bigint").alias("numeric_features"),
        F.lit(len(categorical)).cast("bigint").alias("categorical_features"),
        F.col("missing_percentage"),
    )


def recommend_from_facts(row: DataFrame, selector: Selector | None = None) -> DataFrame:
    """Adds the advised learner and, with a selector, the ranking behind it.

    Works on any number of fact rows. The selector only speaks for classification;
    without it, or should it fail, the rules decide.
    """
    rows, features = F.col("samples"), F.col("features")
    numeric, categorical = F.col("numeric_features"), F.col("categorical_features")
    regression = F.col("task_type") == "regression"
    by_rule = F.when(
        regression, advise.regression_rule(rows, features, numeric, categorical)
    ).otherwise(advise.classification_rule(rows, features, numeric, categorical))
    plain = row.withColumns({
        "recommended_model": by_rule, "ranking": F.lit(None).cast(RANKING),
    })
    if selector is None:
        return plain
    try:
        renamed = row.withColumns({
            "n_samples": rows, "n_features": features, "n_classes": F.col("classes"),
        })
        ranked = rank_learners(renamed, selector)
        learned = F.when(~regression, F.col("predicted_model"))
        learnt = ranked.select(
            *row.columns,
            F.coalesce(learned, by_rule).alias("recommended_model"),
            F.when(~regression, F.col("ranking")).alias("ranking"),
        )
        # Scored here, so that a selector that fails while scoring is noticed.
        return materialise(learnt)
    except Exception:
        return plain


def recommend(
    df: DataFrame, target: str, dataset: str | None = None, selector: Selector | None = None
) -> DataFrame:
    """One row of details: task, sizes, missing share, advised learner, ranking."""
    return recommend_from_facts(facts(df, target, dataset), selector)
