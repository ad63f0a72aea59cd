"""Evaluation metrics. One grouped count of (truth, prediction) feeds every class metric."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import col


def confusion(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Rows per pair of true and predicted class, optionally per group as well."""
    return df.groupBy(
        *[col(b) for b in by], col(label).alias("label"), col(prediction).alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(
    df: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """The confusion counts as a table, one column per predicted class, labels sorted."""
    counts = confusion(df, label, prediction)
    labels = [
        r[0] for r in counts.select("label").union(counts.select("prediction"))
        .distinct().orderBy("label").collect()
    ]
    return counts.groupBy("label").pivot("prediction", labels).sum("n").na.fill(0).orderBy("label")


def per_class(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Support, predicted rows and hits of every class seen in truth or prediction."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(F.col("label").cast("string").alias("class"), F.col("n").alias("support"),
                 F.lit(0).cast("bigint").alias("predicted"), hit.cast("bigint").alias("hits")),
        F.struct(F.col("prediction").cast("string").alias("class"),
                 F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hits")),
    )
    groups = [col(b) for b in by]
    totals = counts.select(*groups, F.inline(sides)).groupBy(*groups, "class").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "hits")]
    )
    return totals.withColumns({
        "precision": _ratio(F.col("hits"), F.col("predicted")),
        "recall": _ratio(F.col("hits"), F.col("support")),
        "f1_score": _ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")),
    })


def _ratio(a: Column, b: Column) -> Column:
    """a / b, with 0 / 0 taken as 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _weighted(metric: str) -> Column:
    return F.try_divide(F.sum(F.col(metric) * F.col("support")), F.sum("support"))


def metrics_from_classes(classes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row of summary metrics, per group if any, from the per-class table."""
    return classes.groupBy(*[col(b) for b in by]).agg(
        F.try_divide(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        _weighted("f1_score").alias("f1_score"),
        _weighted("precision").alias("precision"),
        _weighted("recall").alias("recall"),
        F.avg("f1_score").alias("f1_macro"),
    )


def classification_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, balanced accuracy, weighted F1, precision and recall, and macro F1."""
    return metrics_from_classes(per_class(confusion(df, label, prediction, by), by), by)


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and the two averages."""
    classes = per_class(confusion(df, label, prediction))
    measures = ("precision", "recall", "f1_score")
    grouped = classes.rollup("class").agg(
        F.grouping("class").alias("overall"),
        F.sum("support").alias("support"),
        F.try_divide(F.sum("hits"), F.sum("support")).alias("hit_rate"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[_weighted(m).alias(f"weighted_{m}") for m in measures],
    )

    def line(name: Column, *values: Column) -> Column:
        return F.struct(
            name.alias("class"),
            *[v.cast("double").alias(m) for m, v in zip(measures, values)],
            F.col("support").alias("support"),
        )

    macro = [F.col(f"macro_{m}") for m in measures]
    weighted = [F.col(f"weighted_{m}") for m in measures]
    lines = F.when(F.col("overall") == 0, F.array(line(F.col("class"), *macro))).otherwise(
        F.array(
            line(F.lit("accuracy"), F.lit(None), F.lit(None), F.col("hit_rate")),
            line(F.lit("macro avg"), *macro),
            line(F.lit("weighted avg"), *weighted),
        )
    )
    return grouped.select(F.inline(lines))


def regression_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Coefficient of determination, mean absolute and root mean squared error."""
    y, p = col(label).cast("double"), col(prediction).cast("double")
    sums = df.agg(
        F.count(y).alias("n"), F.var_pop(y).alias("variance"),
        F.avg(F.pow(y - p, 2)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"),
    )
    r2 = F.when(F.col("variance") > 0, 1 - F.col("mse") / F.col("variance")).otherwise(
        F.when(F.col("mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    )
    return sums.select(r2.alias("r2_score"), "mae", F.sqrt("mse").alias("rmse"))


def mark_correct(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Adds whether truth and prediction agree."""
    return df.withColumn("correct", col(label).eqNullSafe(col(prediction)))


def correct_counts(
    df: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Rows predicted rightly and wrongly."""
    agree = col(label).eqNullSafe(col(prediction))
    return df.agg(F.count_if(agree).alias("correct"), F.count_if(~agree).alias("incorrect"))


def label_distributions(
    df: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Rows per class in truth and in prediction, side by side."""
    return per_class(confusion(df, label, prediction)).select("class", "support", "predicted")
