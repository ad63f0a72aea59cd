"""Best-fit packing of token sequences in a hierarchy of local packings."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscout.session import materialise, ship_package

from .common import in_batches, slices


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024,
                 drops_space: bool = False, keep_ids: bool = False, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """Tokens of every document with the end id, cut to pieces of at most ``capacity``.

    (doc_id, piece, start, length, ids_crc32[, ids]). Of a longer document the first piece
    takes what is left over and all others are full. Null text counts as empty: its only
    id is the end id.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    width = 4 * capacity

    def cut(batches):
        from tabscout.llm.tokens import encoder

        encode = encoder(tokenizer, end_id, drops_space).encode
        for batch in slices(batches, "text", 2 << 20):
            out = ([], [], [], [], [], [])
            coded = encode(batch.column("text").to_pylist())
            for name, ids in zip(batch.column("doc_id").to_pylist(), coded, strict=True):
                low, piece = 0, 0
                high = len(ids) % width or min(width, len(ids))
                while low < len(ids):
                    part = ids[low:high]
                    for column, value in zip(out, (
                            name, piece, low // 4, len(part) // 4, zlib.crc32(part),
                            part if keep_ids else None), strict=True):
                        column.append(value)
                    low, high, piece = high, high + width, piece + 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 5 + keep_ids
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out[:n], types[:n], strict=True)], names[:n])
            out = coded = None

    return in_batches(rows, cut, "doc_id bigint, piece int, start bigint, length bigint, "
                      "ids_crc32 bigint" + ", ids binary" * keep_ids)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item: largest first, into the fullest bin with room."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, 0
    chosen, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, at = capacity, bins
            bins += 1
        chosen[i], offset[i] = at, capacity - room
        room -= size
        free[room].append(at)
        mask |= 1 << room
    return chosen, offset


def pack(items: DataFrame, capacity: int, group_items: int = 50_000,
         full_enough: int = 0) -> DataFrame:
    """Pack items (id, size) with 0 < size <= capacity: (id, bin, offset).

    Groups of about ``group_items`` items, dealt by a hash, are packed by best fit. Bins
    with at most ``full_enough`` or less than the smallest item's size left are done; the others become
    items of the next round, which has at most half as many groups, down to one. A round that joins
    nothing is the last. ``bin`` is the id of an item in it. Only counts reach the driver.
    Every round's table is written to the shared folder.
    """
    spark = items.sparkSession
    ship_package(spark)
    facts = items.agg(F.count("*").alias("n"), F.min("size").alias("least")).first()
    n, least = facts["n"], facts["least"]
    if not n:
        return items.select("id", F.col("id").alias("bin"), F.col("size").alias("offset"))
    groups = -(-n // group_items)
    open_items, placed = items.select("id", "size"), None

    def fit(group):
        import pandas as pd

        group = group.sort_values("id")
        ids, sizes = group["id"].to_numpy(), group["size"].to_numpy()
        chosen, offset = best_fit(sizes, capacity)
        first = np.full(chosen.max() + 1, -1, np.int64)
        first[chosen[::-1]] = ids[::-1]
        fill = np.bincount(chosen, weights=sizes).astype(np.int64)
        return pd.DataFrame({"id": ids, "bin": first[chosen], "offset": offset,
                             "fill": fill[chosen]})

    while True:
        salt = F.pmod(F.xxhash64("id"), F.lit(groups)).alias("salt")
        done = materialise(open_items.groupBy(salt).applyInPandas(
            fit, "id bigint, bin bigint, offset bigint, fill bigint"))
        step = done.select("id", "bin", "offset")
        if placed is None:
            placed = step
        else:
            later = step.select(F.col("id").alias("bin"), F.col("bin").alias("outer"),
                                F.col("offset").alias("more"))
            placed = materialise(placed.join(later, "bin", "left").select(
                "id", F.coalesce("outer", "bin").alias("bin"),
                (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset")))
        left = F.lit(capacity) - F.col("fill")
        bins = done.where("id = bin").select("id", F.col("fill").alias("size"), left.alias("left"))
        counts = bins.agg(F.count("*").alias("bins"), F.count_if(
            (F.col("left") > full_enough) & (F.col("left") >= least)).alias("open")).first()
        if groups == 1 or counts["open"] < 2 or counts["bins"] == n:
            return placed
        open_items = bins.where(
            (F.col("left") > full_enough) & (F.col("left") >= least)).select("id", "size")
        n, groups = counts["open"], min(groups // 2, -(-counts["open"] // group_items))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2,
                   drops_space: bool = False, group_items: int = 50_000) -> DataFrame:
    """Sequences of at most ``capacity`` tokens from whole documents.

    (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row for each
    piece; see `token_pieces` for the pieces and `pack` for the rounds. Full pieces are sequences
    of their own. Repeated rows are packed as often as they come; an empty table gives no rows.
    """
    pieces = materialise(
        token_pieces(docs, tokenizer, end_id, capacity, drops_space)
        .withColumn("id", F.monotonically_increasing_id()))
    partial = pieces.where(F.col("length") < capacity).select("id", F.col("length").alias("size"))
    placed = pack(partial, capacity, group_items)
    return pieces.join(placed, "id", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("bin", "id").alias("sequence_id"),
        F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))
