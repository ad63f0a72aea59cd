"""Mean absolute pairwise correlation over pairwise-complete rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import as_number
from ..session import materialise
from .columnstats import collect_measures

# Up to this many columns the pairs are ordinary aggregates of one pass.
PAIRWISE_LIMIT = 6
# Columns of a block: the six sum matrices of a tile take 48 MB.
TILE = 1000
# Rows that a task turns into matrices at once.
ROWS_AT_ONCE = 1024


def mean_abs_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean of |r| over all column pairs that have a correlation."""
    if len(columns) < 2:
        return df.sparkSession.range(1).select(F.lit(0.0).alias("mean_abs_correlation"))
    if len(columns) <= PAIRWISE_LIMIT:
        value = {c: as_number(c, df.schema[c].dataType) for c in columns}
        row = df.agg(*[_correlation(value[a], value[b]).alias(f"r{i}")
                       for i, (a, b) in enumerate(combinations(columns, 2))])
        pairs = row.select(F.explode(F.array(*[F.col(c) for c in row.columns])).alias("r"))
    else:
        pairs = pair_correlations(df, columns).select("r")
    return pairs.agg(
        F.avg(F.when(~F.isnan("r"), F.abs("r"))).alias("mean_abs_correlation")
    )


def _correlation(a: Column, b: Column) -> Column:
    """Pearson's r over the rows that have both; null if either does not vary there.

    The built-in correlation divides by zero on a constant column.
    """
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    # Equal extremes are exact where a variance may keep a rounding error.
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return F.when(varies, F.try_divide(F.covar_pop(x, y), spread))


def pair_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of column positions ``a`` < ``b`` and their correlation ``r``.

    Each partition folds its rows into masked sum matrices, shifted by a first-pass
    mean for stability, and emits one record per pair. The records are then added pair
    by pair, first within each shuffle partition. More columns than `TILE` are written
    once as numbers and cut into blocks; every two blocks are a branch of one plan that
    reads their columns alone, so that a task holds the sums of one tile, whatever the width.
    """
    p = len(columns)
    cells = df.select(*[as_number(c, df.schema[c].dataType).alias(f"v{i}")
                        for i, c in enumerate(columns)])
    blocks = [range(i, min(i + TILE, p)) for i in range(0, p, TILE)]
    if len(blocks) > 1:
        cells = materialise(cells)
    found = collect_measures(
        cells, {c: F.col(c) for c in cells.columns}, {"low": F.min, "high": F.max, "mean": F.avg})
    # A constant column is shifted by its value, so that its sums are exactly zero.
    shift = [m["low"] if m["low"] == m["high"] else m["mean"] for m in found.values()]
    shift = np.array([0.0 if m is None or not np.isfinite(m) else m for m in shift])

    # A task emits a whole tile, so there should be no more tasks than keep the
    # cluster busy; partitions are merged in place, without a shuffle.
    tiles = list(combinations_with_replacement(blocks, 2))
    tasks = -(-4 * df.sparkSession.sparkContext.defaultParallelism // len(tiles))
    partial = reduce(DataFrame.union, [
        _tile_sums(cells, shift, left, right, tasks) for left, right in tiles])
    totals = partial.groupBy("a", "b").agg(
        *[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")]
    )

    def centred(product: str, left: str, right: str) -> Column:
        return F.col(product) - F.try_divide(F.col(left) * F.col(right), F.col("n"))

    covariance = centred("sab", "sa", "sb")
    spread = centred("saa", "sa", "sa") * centred("sbb", "sb", "sb")
    r = F.when((F.col("n") > 1) & (spread > 0), F.try_divide(covariance, F.sqrt(spread)))
    return totals.select("a", "b", r.alias("r"))


def _tile_sums(
    cells: DataFrame, shift: np.ndarray, left: range, right: range, tasks: int
) -> DataFrame:
    """Partial sums of the pairs of a column of ``left`` and a later one of ``right``.

    The blocks are the same or have no column in common.
    """
    same = left == right
    chosen = [*left] if same else [*left, *right]
    offsets = shift[chosen]
    width = len(left)

    def fold(batches):
        sums = np.zeros((6, width, len(right)))
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(start, ROWS_AT_ONCE)
                x = np.column_stack([
                    c.to_numpy(zero_copy_only=False).astype(float) for c in some.columns
                ]) - offsets
                known = ~np.isnan(x)
                x = np.where(known, x, 0.0)
                m = known.astype(float)
                xa, ma = x[:, :width], m[:, :width]
                xb, mb = (xa, ma) if same else (x[:, width:], m[:, width:])
                sums[0] += ma.T @ mb
                sums[1] += xa.T @ mb
                sums[2] += ma.T @ xb
                sums[3] += (xa * xa).T @ mb
                sums[4] += ma.T @ (xb * xb)
                sums[5] += xa.T @ xb
        for i, a in enumerate(left):
            first = i + 1 if same else 0
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(right) - first, a, dtype=np.int32)),
                pa.array(np.arange(right.start + first, right.stop, dtype=np.int32)),
                *[pa.array(s[i, first:]) for s in sums],
            ], names=["a", "b", "n", "sa", "sb", "saa", "sbb", "sab"])

    return cells.select(*[f"v{i}" for i in chosen]).coalesce(tasks).mapInArrow(
        fold,
        "a int, b int, n double, sa double, sb double, saa double, sbb double, sab double",
    )
