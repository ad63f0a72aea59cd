"""Turning values into codes: the rank of a value among the distinct ones, from 0."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import col
from ..session import materialise

# Dictionaries up to this many entries and characters are ranked in one task and broadcast.
SMALL_DICTIONARY = 100_000
SMALL_CHARACTERS = 16_000_000


def value_dictionaries(
    df: DataFrame, values: Mapping[str, Column], small: int = SMALL_DICTIONARY
) -> dict[str, tuple[DataFrame, bool]]:
    """Per named text expression, a frame of value and code, and whether it is small.

    Distinct values of all columns are found in one pass. A dictionary too large
    for one task is range-partitioned by value, each range numbered on its own and
    shifted by the sizes of the ranges before it.
    """
    if not values:
        return {}
    cells = F.array(*[
        F.struct(F.lit(n).alias("column_name"), v.cast("string").alias("value"))
        for n, v in values.items()
    ])
    distinct = materialise(
        df.select(F.inline(cells)).filter("value IS NOT NULL").distinct()
    )
    sizes = {r[0]: (r[1], r[2]) for r in distinct.groupBy("column_name").agg(
        F.count(F.lit(1)), F.sum(F.length("value"))).collect()}
    result = {}
    for name in values:
        own = distinct.filter(F.col("column_name") == name).select("value")
        entries, characters = sizes.get(name, (0, 0))
        if entries <= small and characters <= SMALL_CHARACTERS:
            codes = F.row_number().over(Window.orderBy("value")) - 1
            result[name] = own.select("value", codes.cast("double").alias("code")), True
        else:
            result[name] = ranked_by_range(own, entries, small), False
    return result


def ranked_by_range(values: DataFrame, size: int, small: int) -> DataFrame:
    """Adds ``code``, the rank of ``value`` from 0, without sorting all values in one task."""
    ranges = -(-size // small) * 2
    placed = materialise(
        values.repartitionByRange(ranges, "value").withColumn("part", F.spark_partition_id())
    )
    counts = sorted((r[0], r[1]) for r in placed.groupBy("part").count().collect())
    starts, seen = [], 0
    for part, n in counts:
        starts.append((part, seen))
        seen += n
    offsets = placed.sparkSession.createDataFrame(starts, "part int, start long")
    within = F.row_number().over(Window.partitionBy("part").orderBy("value")) - 1
    return (
        placed.join(F.broadcast(offsets), "part")
        .select(*values.columns, (F.col("start") + within).cast("double").alias("code"))
    )


def encode_columns(
    df: DataFrame, values: Mapping[str, Column], small: int = SMALL_DICTIONARY
) -> DataFrame:
    """Replace (or add) each named column by the code of its expression; missing stays missing.

    Small dictionaries are broadcast. Large ones are joined by value, where
    adaptive execution splits the partition of a value that dominates the column.
    """
    dictionaries = value_dictionaries(df, values, small)
    for i, (name, expression) in enumerate(values.items()):
        dictionary, is_small = dictionaries[name]
        dictionary = dictionary.select(
            F.col("value").alias(f"_value{i}"), F.col("code").alias(f"_code{i}")
        )
        if is_small:
            dictionary = F.broadcast(dictionary)
        keyed = df.withColumn(f"_key{i}", expression.cast("string"))
        joined = keyed.join(dictionary, F.col(f"_key{i}") == F.col(f"_value{i}"), "left")
        df = joined.withColumn(name, F.col(f"_code{i}")).drop(f"_key{i}", f"_value{i}", f"_code{i}")
    return df
