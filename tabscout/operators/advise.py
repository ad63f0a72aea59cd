"""Rules that pick a learner from a table's size and column mix.

They are plain column expressions over a profile table, so any number of datasets
is judged in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import col

SMALL_TABLE, LARGE_TABLE, FEW_FEATURES, MANY_FEATURES = 500, 5000, 20, 30


def classification_rule(rows: Column, features: Column, numeric: Column, categorical: Column):
    forest = F.lit("Random Forest")
    return (
        F.when((rows < SMALL_TABLE) & (numeric > categorical), F.lit("SVM"))
        .when(rows < SMALL_TABLE, F.lit("Logistic Regression"))
        .when(categorical > numeric, forest)
        .when(features > MANY_FEATURES, forest)
        .when(rows >= SMALL_TABLE, forest)
        .otherwise(F.lit("SVM"))
    )


def regression_rule(rows: Column, features: Column, numeric: Column, categorical: Column):
    forest, boosting = F.lit("Random Forest"), F.lit("Gradient Boosting")
    return (
        F.when(categorical > numeric, F.when(rows >= SMALL_TABLE, forest).otherwise(boosting))
        .when(rows < SMALL_TABLE, F.when(features <= FEW_FEATURES, forest).otherwise(boosting))
        .when(rows >= LARGE_TABLE, forest)
        .otherwise(boosting)
    )


def _inputs():
    return col("n_samples"), col("n_features"), col("n_numeric"), col("n_categorical")


def rules_classification(profiles: DataFrame, output: str = "recommended_model") -> DataFrame:
    """Adds the learner advised for a classification target."""
    return profiles.withColumn(output, classification_rule(*_inputs()))


def rules_regression(profiles: DataFrame, output: str = "recommended_model") -> DataFrame:
    """Adds the learner advised for a regression target."""
    return profiles.withColumn(output, regression_rule(*_inputs()))


def rules(profiles: DataFrame, output: str = "recommended_model") -> DataFrame:
    """Adds the advised learner by each row's ``task_type``."""
    choice = F.when(col("task_type") == "regression", regression_rule(*_inputs()))
    return profiles.withColumn(output, choice.otherwise(classification_rule(*_inputs())))
