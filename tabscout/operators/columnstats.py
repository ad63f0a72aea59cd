"""One pass of several aggregates over many columns, in long form."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import col

# Beyond this many aggregate expressions generated code is given up, so wide
# tables are turned into (column, value) rows or, if the values differ in type, into
# several aggregates. The results are the same.
WIDE_LIMIT = 240


def per_column(
    df: DataFrame,
    values: Mapping[str, Column],
    measures: Mapping[str, Callable[[Column], Column]],
    order: bool = True,
) -> DataFrame:
    """One row per column with the given measures.

    ``values`` maps the reported column name to the expression measured. Narrow
    tables use a single ungrouped aggregate; wide ones group by column name, or
    aggregate some columns at a time where the values differ in type.
    """
    names = list(values)
    if len(names) * len(measures) <= WIDE_LIMIT:
        result = _side_by_side(df, values, measures, 0)
    elif len({f.dataType for f in df.select(*values.values()).schema}) > 1:
        step = max(1, WIDE_LIMIT // len(measures))
        result = reduce(DataFrame.unionByName, [
            _side_by_side(df, {n: values[n] for n in names[i:i + step]}, measures, i)
            for i in range(0, len(names), step)])
    else:
        cells = F.array(*[
            F.struct(F.lit(i).alias("position"), F.lit(name).alias("column_name"),
                     values[name].alias("cell"))
            for i, name in enumerate(names)
        ])
        result = (
            df.select(F.inline(cells))
            .groupBy("position", "column_name")
            .agg(*[make(F.col("cell")).alias(label) for label, make in measures.items()])
        )
    return result if order else result.drop("position")


def _side_by_side(
    df: DataFrame,
    values: Mapping[str, Column],
    measures: Mapping[str, Callable[[Column], Column]],
    first: int,
) -> DataFrame:
    """One ungrouped aggregate of all columns, turned into a row for each."""
    names = list(values)
    aggregates = [
        make(values[name]).alias(f"m{i}_{label}")
        for i, name in enumerate(names)
        for label, make in measures.items()
    ]
    wide = df.agg(*aggregates)
    rows = [
        F.struct(
            F.lit(first + i).alias("position"),
            F.lit(name).alias("column_name"),
            *[F.col(f"m{i}_{label}").alias(label) for label in measures],
        )
        for i, name in enumerate(names)
    ]
    return wide.select(F.inline(F.array(*rows)))


def collect_measures(
    df: DataFrame,
    values: Mapping[str, Column],
    measures: Mapping[str, Callable[[Column], Column]],
) -> dict[str, dict]:
    """:func:`per_column` brought to the driver: one small record per column."""
    if not values:
        return {}
    found = {r["column_name"]: r.asDict() for r in per_column(df, values, measures).collect()}
    # The grouped form has no row for any column when the table is empty.
    return {name: found.get(name, {label: None for label in measures}) for name in values}


def one_row(*frames: DataFrame) -> DataFrame:
    """Several one-row frames side by side as one row, without joining them."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged.agg(*[F.max(col(c)).alias(c) for c in merged.columns])
