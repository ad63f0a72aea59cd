"""Deterministic stratified holdout and folds.

Rows are ordered by a hash of their key, so the outcome depends on neither row
order nor partitioning. No class is ever sorted as a whole: rows are counted per
class and hash prefix, which finds the one prefix where a class crosses its quota,
and only the rows sharing that prefix are ranked.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import constants as K
from ..functions.scalars import col
from .validate import require_columns

# Rows of one class that may share a hash prefix, on average.
_PREFIX_ROWS = 50_000
_BROADCAST_CLASSES = 100_000
_BROADCAST_CHARACTERS = 16_000_000


def _hash(keys: Sequence[str], seed: int) -> Column:
    parts = [F.coalesce(col(k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))).cast("binary"))


def _digits(rows: int) -> int:
    """Hex digits of hash prefix that keep the rows per prefix bounded."""
    return min(6, max(2, math.ceil(math.log(max(rows / _PREFIX_ROWS, 1), 16))))


def _small(df: DataFrame, facts) -> DataFrame:
    """Broadcast a one-row-per-class table when number and length of labels allow."""
    fits = (facts["classes"] <= _BROADCAST_CLASSES
            and facts["characters"] <= _BROADCAST_CHARACTERS)
    return F.broadcast(df) if fits else df


def mark_holdout(
    df: DataFrame,
    label: str | None,
    key: str | Sequence[str],
    fraction: float = K.HOLDOUT,
    seed: int = K.SEED,
    output: str = "is_test",
) -> DataFrame:
    """Adds a flag for the held-out rows: ceil(fraction * n) of them.

    Each class gives its share, leftover places going to the largest remainders,
    ties by label. With no label, a single class or a class of one row, the split is plain.
    Rows need a unique key and a known label.
    """
    keys = [key] if isinstance(key, str) else list(key)
    require_columns(df, keys)
    stratum = col(label).cast("string") if label else F.lit("all")
    counts = df.groupBy(stratum.alias("_stratum")).agg(F.count(F.lit(1)).alias("n"))
    seats = F.col("n") * F.lit(float(fraction))
    remainder = F.round(seats - F.floor(seats), 9)
    counts = counts.select(
        "_stratum", "n", F.floor(seats).cast("bigint").alias("base"), remainder.alias("rest")
    )
    facts = counts.agg(
        F.count(F.lit(1)).alias("classes"), F.min("n").alias("smallest"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sum("base").alias("base"),
        F.sum(F.length("_stratum")).alias("characters"),
    ).first()
    if facts["rows"] == 0:
        return df.withColumn(output, F.lit(False))
    if label and (facts["classes"] < 2 or facts["smallest"] < 2):
        return mark_holdout(df, None, keys, fraction, seed, output)
    extra = math.ceil(round(facts["rows"] * fraction, 9)) - facts["base"]
    quota = F.col("base")
    if extra > 0:
        last = (
            counts.orderBy(F.desc("rest"), F.asc("_stratum")).offset(extra - 1).limit(1).first()
        )
        gets_one = (F.col("rest") > last["rest"]) | (
            (F.col("rest") == last["rest"]) & (F.col("_stratum") <= last["_stratum"])
        )
        quota = quota + gets_one.cast("bigint")
    quotas = counts.select("_stratum", quota.alias("quota"))

    digits = _digits(facts["rows"])
    hashed = df.withColumns({"_stratum": stratum, "_hash": _hash(keys, seed)})
    prefixes = (
        hashed.groupBy("_stratum", F.substring("_hash", 1, digits).alias("prefix"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upto = F.sum("n").over(Window.partitionBy("_stratum").orderBy("prefix"))
    crossing = (
        prefixes.withColumn("upto", upto)
        .join(_small(quotas, facts), "_stratum")
        .filter((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("n") < F.col("quota")))
        .select("_stratum", "prefix", (F.col("quota") - F.col("upto") + F.col("n")).alias("need"))
    )
    order = [F.col("_hash"), *[col(k) for k in keys]]
    rank = F.row_number().over(Window.partitionBy("_stratum").orderBy(*order))
    cuts = (
        hashed.select("_stratum", "_hash", *[col(k) for k in keys])
        .join(_small(crossing, facts), "_stratum")
        .filter(F.substring("_hash", 1, digits) == F.col("prefix"))
        .withColumn("rank", rank)
        .filter(F.col("rank") == F.col("need"))
        .select("_stratum", F.col("_hash").alias("_cut_hash"),
                F.struct(*[col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("_cut_key"))
    )
    own_key = F.struct(*[col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    in_test = (F.col("_hash") < F.col("_cut_hash")) | (
        (F.col("_hash") == F.col("_cut_hash")) & (own_key <= F.col("_cut_key"))
    )
    return (
        hashed.join(_small(cuts, facts), "_stratum", "left")
        .withColumn(output, F.coalesce(in_test, F.lit(False)))
        .drop("_stratum", "_hash", "_cut_hash", "_cut_key")
    )


def stratified_split(
    df: DataFrame,
    label: str | None,
    key: str | Sequence[str],
    fraction: float = K.HOLDOUT,
    seed: int = K.SEED,
) -> tuple[DataFrame, DataFrame]:
    """Training rows and held-out rows."""
    marked = mark_holdout(df, label, key, fraction, seed, "_is_test")
    return (
        marked.filter(~F.col("_is_test")).drop("_is_test"),
        marked.filter(F.col("_is_test")).drop("_is_test"),
    )


def stratified_folds(
    df: DataFrame,
    label: str,
    key: str | Sequence[str],
    k: int = K.FOLDS,
    seed: int = K.SEED,
    output: str = "fold",
) -> DataFrame:
    """Adds a fold number from 0; every class is dealt out evenly in hash order."""
    keys = [key] if isinstance(key, str) else list(key)
    stratum = col(label).cast("string")
    digits = _digits(df.count())
    hashed = df.withColumns({"_stratum": stratum, "_hash": _hash(keys, seed)}).withColumn(
        "_prefix", F.substring("_hash", 1, digits)
    )
    prefixes = hashed.groupBy("_stratum", "_prefix").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("_stratum").orderBy("_prefix")) - F.col("n")
    starts = prefixes.select("_stratum", "_prefix", before.alias("_before"))
    within = F.row_number().over(
        Window.partitionBy("_stratum", "_prefix").orderBy("_hash", *[col(x) for x in keys])
    )
    return (
        hashed.withColumn("_within", within)
        .join(starts, ["_stratum", "_prefix"])
        .withColumn(output, F.pmod(F.col("_before") + F.col("_within") - 1, F.lit(k)).cast("int"))
        .drop("_stratum", "_hash", "_prefix", "_within", "_before")
    )
