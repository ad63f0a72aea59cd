"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The ring's resolution. Only counters of cells reach the driver, never more than these.
CELLS = 1 << 16


def _cell(position):
    return F.shiftrightunsigned(position, 48).cast("int")


def ring(spark: SparkSession, shards: int, vnodes: int) -> list[tuple[int, int]]:
    """Virtual nodes as (cell, shard) in clockwise order, at most shards x vnodes."""
    points = spark.range(shards * vnodes).select(
        (F.col("id") % shards).cast("int").alias("shard"),
        (F.col("id") / shards).cast("long").alias("copy"))
    placed = points.select("shard", F.xxhash64(F.lit("vnode"), "shard", "copy").alias("at"))
    # Two nodes in one cell: the smaller hash keeps it.
    owner = placed.groupBy(_cell(F.col("at")).alias("cell")).agg(
        F.min_by("shard", "at").alias("shard"))
    return sorted((r["cell"], r["shard"]) for r in owner.collect())


def fill(nodes: list[tuple[int, int]], counts: dict[int, int],
         capacity: list[int]) -> dict[int, list[tuple[int, int, int]]]:
    """Where the rows of each cell go: cell -> [(end, shard, slot shift)].

    Rows arrive at the first node clockwise of their cell. A shard takes arrivals in ring
    order until it is full; the others go on to the next node of a shard that has room,
    and so on. Each round fills a shard or is the last, so there are at most as many rounds as
    shards. Row r of a cell goes to the first piece with r < end and gets slot r + shift.
    """
    starts, owner = [c for c, _ in nodes], [s for _, s in nodes]
    load, pieces = [0] * len(capacity), {}
    waiting = [(bisect_left(starts, cell) % len(nodes), cell, 0, n)
               for cell, n in sorted(counts.items())]
    while waiting:
        waiting.sort()
        over = []
        for node, cell, low, high in waiting:
            shard = owner[node]
            take = min(high - low, capacity[shard] - load[shard])
            if take:
                pieces.setdefault(cell, []).append((low + take, shard, load[shard] - low))
                load[shard] += take
            if low + take < high:
                over.append((node, cell, low + take, high))
        onward, room = {}, None
        for node in [*range(len(nodes)), *range(len(nodes))][::-1]:
            onward[node] = room
            if load[owner[node]] < capacity[owner[node]]:
                room = node
        waiting = [(onward[node], *rest) for node, *rest in over]
    return pieces


def shard_documents(docs: DataFrame, shards: int = 24, vnodes: int = 128, slack: float = 0.0,
                    key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every row into a shard: (doc_id, size, text_crc32, home_shard, shard, slot).

    The key's hash is its place on the ring; rows without a key use the text's checksum.
    With ``slack`` 0 the capacities are the row count divided as evenly as integers allow,
    so counts differ by one at most; with more slack every shard may hold
    ceil((1 + slack) x rows / shards) and fewer rows leave their home. ``home_shard`` is
    where a ring without bounds puts the row. Slots number the rows of a shard from 0.

    Rows are ranked within one of 65,536 equal cells of the ring by hash, key and checksum,
    so no task sorts more than a sliver of the table; rows equal in all of these are
    interchangeable. Null text counts as no bytes; an empty table gives an empty result.
    Other columns are ignored, whatever their names.
    """
    if shards < 1 or vnodes < 1 or shards * vnodes > CELLS // 4:
        raise ValueError("shards x vnodes must lie between 1 and a quarter of the cells")
    spark = docs.sparkSession
    crc = F.coalesce(F.crc32(F.col(text)), F.lit(0))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        crc.alias("text_crc32"),
        F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key))).otherwise(
            F.xxhash64(F.lit("no key"), crc)).alias("at"),
    ).withColumn("cell", _cell(F.col("at")))
    nodes = ring(spark, shards, vnodes)
    # The counters need the key alone (and the checksum where it is null).
    counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}
    total = sum(counts.values())
    if slack > 0:
        capacity = [-int(-(1 + slack) * total // shards)] * shards
    else:
        capacity = [total // shards + (s < total % shards) for s in range(shards)]
    pieces = fill(nodes, counts, capacity)
    starts = [c for c, _ in nodes]
    plan = spark.createDataFrame(
        [(cell, nodes[bisect_left(starts, cell) % len(nodes)][1], parts)
         for cell, parts in pieces.items()],
        "cell int, home_shard int, "
        "parts array<struct<upto: bigint, shard: int, shift: bigint>>")
    ranked = rows.withColumn("rank", F.row_number().over(
        Window.partitionBy("cell").orderBy("at", "doc_id", "text_crc32", "size")) - 1)
    # At most one row for each cell, whatever the input: safe to broadcast.
    return (
        ranked.join(F.broadcast(plan), "cell")
        .withColumn("part", F.filter(
            "parts", lambda p: F.col("rank") < p["upto"])[0])
        .select("doc_id", "size", "text_crc32", "home_shard", F.col("part.shard").alias("shard"),
                (F.col("rank") + F.col("part.shift")).alias("slot")))
