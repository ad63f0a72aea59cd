"""Profiling: column partition, statistics, target description and meta-features."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.scalars import any_of, as_number, col, is_fractional, present
from ..session import side_by_side
from .columnstats import one_row, per_column
from .correlate import mean_abs_correlation
from .quantiles import exact_quantiles
from .validate import require_columns

# How each part of the system told numbers from categories. A type class missing
# from both lists is not used by that part.
POLICIES = {
    "trainer": {"numeric": {"number"}, "categorical": {"text", "bool"}},
    "suite": {"numeric": {"number", "bool"}, "categorical": {"text", "time", "other"}},
    "advisor": {"numeric": {"number"}, "categorical": {"text", "bool", "time", "other"}},
    "profiler": {"numeric": {"number", "time"}, "categorical": {"text", "bool", "other"}},
    "page": {"numeric": {"number"}, "categorical": {"text", "bool"}},
}


def type_class(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return "other"


def partition_columns(
    df: DataFrame, target: str | None = None, policy: str = "trainer"
) -> tuple[list[str], list[str]]:
    """Numeric and categorical feature names under one of the policies."""
    kinds = POLICIES[policy]
    features = [f for f in df.schema if f.name != target]
    return (
        [f.name for f in features if type_class(f.dataType) in kinds["numeric"]],
        [f.name for f in features if type_class(f.dataType) in kinds["categorical"]],
    )


def column_kinds(df: DataFrame, target: str | None = None, policy: str = "trainer") -> DataFrame:
    """The partition as rows of column name and kind, plus unused columns."""
    numeric, categorical = partition_columns(df, target, policy)
    rows = [
        (f.name, "numeric" if f.name in numeric else
         "categorical" if f.name in categorical else "unused")
        for f in df.schema if f.name != target
    ]
    return df.sparkSession.createDataFrame(rows, "column_name string, kind string")


def type_census(df: DataFrame) -> DataFrame:
    """How many columns there are of each type, timestamps with and without zone as one."""
    rows = [(f.name, f.dataType.simpleString().replace("_ntz", "")) for f in df.schema]
    return (
        df.sparkSession.createDataFrame(rows, "column_name string, data_type string")
        .groupBy("data_type").agg(F.count(F.lit(1)).alias("columns"))
    )


def _nulls(df: DataFrame, names: Sequence[str]) -> Column:
    """Number of missing cells in one row."""
    cells = [
        F.when(present(n, df.schema[n].dataType).isNull(), F.lit(1)).otherwise(F.lit(0))
        for n in names
    ]
    return reduce(lambda a, b: a + b, cells, F.lit(0)).cast("bigint")


def shape(df: DataFrame, target: str | None = None) -> DataFrame:
    """Row count and feature count."""
    features = len([c for c in df.columns if c != target])
    return df.agg(
        F.count(F.lit(1)).alias("n_samples"), F.lit(features).cast("bigint").alias("n_features")
    )


def _missing_pct(df: DataFrame, names: Sequence[str]) -> Column:
    """Aggregate: missing cells per hundred."""
    if not names:
        return F.lit(0.0)
    cells = F.count(F.lit(1)) * F.lit(len(names))
    return F.coalesce(F.try_divide(F.sum(_nulls(df, names)), cells) * 100, F.lit(0.0))


def missing_pct(df: DataFrame, target: str | None = None) -> DataFrame:
    """Missing cells per hundred: features only when a target is given, else all columns."""
    names = [c for c in df.columns if c != target]
    return df.agg(
        F.coalesce(F.sum(_nulls(df, names)), F.lit(0)).cast("bigint").alias("missing_cells"),
        _missing_pct(df, names).alias("missing_percentage"),
    )


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column, one row each."""
    names = list(columns or df.columns)
    flags = {n: present(n, df.schema[n].dataType).isNull() for n in names}
    return per_column(df, flags, {"nulls": F.count_if}, order=False)


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier one; missing values equal each other."""
    keys = [
        present(c, df.schema[c].dataType).alias(f"k{i}")
        for i, c in enumerate(columns or df.columns)
    ]
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows")
    )


def preview(df: DataFrame, key: str | Sequence[str], n: int = 5) -> DataFrame:
    """The first rows in key order."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(*[col(k) for k in keys]).limit(n)


def target_counts(df: DataFrame, target: str) -> DataFrame:
    """Rows per target value, missing targets kept as one null group."""
    value = present(target, df.schema[target].dataType)
    return df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Rows per class, most frequent first."""
    counts = target_counts(df, target).filter(F.col("value").isNotNull())
    return counts.orderBy(F.desc("n"), F.asc("value"))


def class_count(df: DataFrame, target: str, task: str = "classification") -> DataFrame:
    """Distinct classes; a regression target has none."""
    if task == "regression":
        return df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("n_classes"))
    return target_counts(df, target).agg(F.count("value").alias("n_classes"))


def target_summary(df: DataFrame, target: str) -> DataFrame:
    """Minimum, maximum and mean of a target read as a number."""
    v = as_number(target, df.schema[target].dataType)
    return df.agg(
        F.min(v).alias("target_min"), F.max(v).alias("target_max"), F.avg(v).alias("target_mean")
    )


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Classes, entropy in bits and imbalance of a target, from one grouped count.

    Entropy divides by all rows, so missing targets lower it.
    """
    counts = target_counts(df, target)
    known = F.when(F.col("value").isNotNull(), F.col("n"))
    totals = counts.agg(
        F.count("value").alias("n_classes"),
        F.sum("n").alias("total"),
        F.sum(known).alias("known"),
        F.sum(known * F.log2(known)).alias("weighted_logs"),
        (F.min(known) / F.max(known)).alias("imbalance_ratio"),
    )
    # -sum(n/t * log2(n/t)) = log2(t) * sum(n)/t - sum(n * log2(n))/t
    entropy = (F.log2("total") * F.col("known") - F.col("weighted_logs")) / F.col("total")
    return totals.select("n_classes", entropy.alias("target_entropy"), "imbalance_ratio")


def _null_skipping_mean(values: Sequence[Column]) -> Column:
    """Mean of the known values of one row; 0.0 when there are no columns at all."""
    if not values:
        return F.lit(0.0)
    cells = F.filter(F.array(*values), lambda x: x.isNotNull() & ~F.isnan(x))
    total = F.aggregate(cells, F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(total, F.size(cells))


def numeric_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean over columns of their mean, sample deviation and sample variance."""
    return _moments(df, columns)


def _moments(df: DataFrame, columns: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    aggregates = list(extra)
    for i, name in enumerate(columns):
        v = as_number(name, df.schema[name].dataType)
        aggregates += [F.avg(v).alias(f"avg_{i}"), F.var_samp(v).alias(f"var_{i}")]
    if not aggregates:
        aggregates = [F.count(F.lit(1)).alias("rows_seen")]
    row = df.agg(*aggregates)
    span = range(len(columns))
    kept = [c for c in row.columns if not c.startswith(("avg_", "var_", "rows_seen"))]
    return row.select(
        *kept,
        _null_skipping_mean([F.col(f"avg_{i}") for i in span]).alias("mean_feature_mean"),
        _null_skipping_mean([F.sqrt(f"var_{i}") for i in span]).alias("mean_feature_std"),
        _null_skipping_mean([F.col(f"var_{i}") for i in span]).alias("mean_feature_variance"),
    )


def profile(
    df: DataFrame,
    target: str,
    dataset_name: str | None = None,
    task_id: int | None = None,
    policy: str = "trainer",
) -> DataFrame:
    """The 14-field meta-feature row of one table.

    Feature statistics come from one wide aggregate, the target's from one grouped count,
    the correlations from a third pass.
    """
    require_columns(df, [target])
    numeric, categorical = partition_columns(df, target, policy)
    moments_of = [n for n in numeric if type_class(df.schema[n].dataType) == "number"]
    features = [c for c in df.columns if c != target]
    basics = [
        F.count(F.lit(1)).alias("n_samples"),
        _missing_pct(df, features).alias("missing_percentage"),
    ]
    merged = one_row(
        _moments(df, moments_of, basics),
        class_balance(df, target),
        mean_abs_correlation(df, moments_of),
    )
    return merged.select(
        F.lit(task_id).cast("bigint").alias("task_id"),
        F.lit(dataset_name).cast("string").alias("dataset_name"),
        F.col("n_samples"),
        F.lit(len(features)).cast("bigint").alias("n_features"),
        F.lit(len(numeric)).cast("bigint").alias("n_numeric"),
        F.lit(len(categorical)).cast("bigint").alias("n_categorical"),
        F.col("missing_percentage"),
        F.col("n_classes"),
        F.col("imbalance_ratio"),
        F.col("target_entropy"),
        F.col("mean_feature_mean"),
        F.col("mean_feature_std"),
        F.col("mean_feature_variance"),
        F.col("mean_abs_correlation"),
    )


@dataclass(frozen=True)
class DatasetSpec:
    """A table to list or profile: where it is and what to predict."""

    name: str
    target: str
    path: str | None = None
    fmt: str = "parquet"
    task_id: int | None = None
    dataset_id: int | None = None
    frame: DataFrame | None = None

    def load(self, spark: SparkSession) -> DataFrame:
        if self.frame is not None:
            return self.frame
        from ..sources.tables import read_table

        return read_table(spark, self.path, self.fmt)


def profile_many(
    spark: SparkSession, specs: Sequence[DatasetSpec], policy: str = "trainer"
) -> tuple[DataFrame, dict[str, str]]:
    """A profile row per dataset, and the reason for each one skipped."""
    return row_per_dataset(
        spark, specs,
        lambda spec: profile(spec.load(spark), spec.target, spec.name, spec.task_id, policy))


def row_per_dataset(
    spark: SparkSession, specs: Sequence[DatasetSpec], make: Callable[[DatasetSpec], DataFrame],
    at_once: int = 4,
) -> tuple[DataFrame, dict[str, str]]:
    """The one-row frame of each dataset, some at a time, and why others gave none.

    Each is computed by its own jobs, so an unreadable file or a failing expression stops
    its dataset alone. The driver holds one small row per dataset.
    """
    def attempt(spec):
        try:
            frame = make(spec)
            return frame.schema, frame.first(), None
        except Exception as reason:  # a bad dataset must not stop the others
            return None, None, f"{type(reason).__name__}: {reason}"

    with ThreadPool(at_once) as pool:
        found = side_by_side(spark, pool, attempt, specs)
    skipped = {spec.name: why for spec, (_, _, why) in zip(specs, found) if why}
    rows = [(schema, row) for schema, row, why in found if why is None]
    if not rows:
        raise ValueError(f"no dataset gave a row: {skipped}")
    return spark.createDataFrame([row for _, row in rows], rows[0][0]), skipped


def detect_task(df: DataFrame, target: str) -> str:
    """``classification`` or ``regression``, from type and values of the target."""
    return task_facts(df, target).first()["task_type"]


def task_facts(df: DataFrame, target: str) -> DataFrame:
    """One row with the detected task; the aggregate raises on unusable targets."""
    require_columns(df, [target])
    dtype = df.schema[target].dataType
    kind = type_class(dtype)
    if kind in ("time", "other"):
        raise ValueError(f"unsupported target type {dtype.simpleString()}; cast it to text first")
    return df.agg(*task_aggregates(target, dtype)).select(task_from_aggregates().alias("task_type"))


def task_aggregates(target: str, dtype: T.DataType) -> list[Column]:
    known = present(target, dtype)
    fractional = is_fractional(dtype) or isinstance(dtype, T.DecimalType)
    number = col(target).cast("double")
    off_grid = F.bool_or(number != F.floor(number)) if fractional else F.lit(False)
    infinite = F.bool_or(F.abs(number) == F.lit(float("inf"))) if fractional else F.lit(False)
    return [
        F.count(known).alias("known_targets"),
        off_grid.alias("off_grid"),
        infinite.alias("infinite"),
    ]


def task_from_aggregates() -> Column:
    return (
        F.when(F.col("known_targets") == 0, F.raise_error(F.lit("target has no valid values")))
        .when(F.coalesce("infinite", F.lit(False)),
              F.raise_error(F.lit("target has infinite values")))
        .when(F.coalesce("off_grid", F.lit(False)), F.lit("regression"))
        .otherwise(F.lit("classification"))
    )


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, deviation, minimum, exact quartiles and maximum per numeric column."""
    names = list(columns) if columns else [
        f.name for f in df.schema if type_class(f.dataType) == "number"
    ]
    values = {n: as_number(n, df.schema[n].dataType) for n in names}
    stats = per_column(df, values, {
        "count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
    })
    quartiles = exact_quantiles(df, values, [0.25, 0.5, 0.75])
    chosen = F.element_at(
        F.array(*[F.array(*[F.lit(x).cast("double") for x in quartiles[n]]) for n in names]),
        F.col("position") + 1,
    )
    return stats.select(
        "column_name", "count", "mean", "std", "min",
        chosen[0].alias("q25"), chosen[1].alias("q50"), chosen[2].alias("q75"), "max",
    )


def unique_ratio(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values, a missing one counting as a value, per row, for each column.

    Cells are compared as text in long form, so one shuffle serves all columns.
    """
    cells = F.array(*[
        F.struct(F.lit(c).alias("column_name"),
                 present(c, df.schema[c].dataType).cast("string").alias("cell"))
        for c in columns
    ])
    values = (
        df.select(F.inline(cells)).groupBy("column_name", "cell")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return values.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("distinct_values"),
        (F.count(F.lit(1)) / F.sum("n")).alias("unique_ratio"),
    )
