"""Helpers that several operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from tabscout.session import materialise, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the number of groups that hashed work is dealt to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_batches(df: DataFrame, work, schema: str) -> DataFrame:
    """``mapInArrow`` whose function is importable on workers without the checkout.

    A worker serves many tasks of many operators: what a task freed goes back to the system.
    """
    ship_package(df.sparkSession)

    def task(batches):
        yield from work(batches)
        give_back_heap()

    return df.mapInArrow(task, schema)


def in_groups(grouped: GroupedData, work, schema: str) -> DataFrame:
    """``applyInArrow`` for few large groups, whose freed memory goes back to the system too."""
    def task(table):
        out = work(table)
        give_back_heap()
        return out

    return grouped.applyInArrow(task, schema)


def give_back_heap() -> None:
    """Return freed memory of a worker, which stays for the next tasks, to the system.

    Arrow and the C library keep freed blocks between live ones; where the library has no call for it,
    only Arrow's are returned.
    """
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str,
           most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of ``column``; a longer row comes alone."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        column_bytes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(column_bytes.to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable id of every node that has an edge: (node, component).

    Min-label propagation with pointer jumping: each round takes the least label among
    the neighbours and then the label of that label, so long chains shrink by halves.
    Counts are folded before they are shuffled, every round's table is written to the
    shared folder, and only the number of changes reaches the driver.
    """
    there = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    back = edges.select(F.col(b).alias("node"), F.col(a).alias("other"))
    both = materialise(there.union(back).where("node <> other").distinct())
    labels = materialise(both.groupBy("node").agg(
        F.least(F.col("node"), F.min("other")).alias("label")))
    while True:
        near = (both.join(labels.select(F.col("node").alias("other"), "label"), "other")
                .groupBy("node").agg(F.min("label").alias("near")))
        hooked = labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        of = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = materialise(hooked.join(of, "label").select(
            "node", F.least("label", "up").alias("label"),
            (F.least("label", "up") != F.col("old")).alias("changed")))
        if labels.where("changed").limit(1).count() == 0:
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.drop("changed")
