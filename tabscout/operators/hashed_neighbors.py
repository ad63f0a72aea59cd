"""Approximate nearest neighbours by several hash tables of random projections.

A table cuts each of some random projections into slots of one width; rows whose slots all agree
share a bucket (Datar et al., "Locality-sensitive hashing scheme based on p-stable distributions",
2004). A query is compared with the rows of its bucket in every table. Slot width and number of
projections are set from measured distances so that a k-th neighbour is met with the wanted
probability at the least number of comparisons.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import constants as K
from ..session import materialise
from .neighbors import (
    QUERY_BLOCK, TRAIN_BLOCK, _arrow, _best, _distances, _matrix, _nearest, exact_neighbours,
)

TABLES = 16
MOST_PROJECTIONS = 24
#: Queries whose true neighbours are searched, and training rows whose distances to them are taken.
TUNING_QUERIES, TUNING_ROWS = 128, 2_048
#: Buckets up to a block are gathered to about this many rows of the training side for a task.
BUNDLE_ROWS = 16_384


@dataclass(frozen=True)
class Tables:
    """Projections of all tables side by side, cut into slots of one width."""

    weights: np.ndarray
    offsets: np.ndarray
    width: float
    projections: int

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """A 64-bit bucket number of each row in each table."""
        slots = np.floor((vectors @ self.weights) / self.width + self.offsets).astype(np.int64)
        slots = slots.reshape(len(vectors), -1, self.projections)
        out = np.zeros(slots.shape[:2], np.uint64)
        with np.errstate(over="ignore"):
            for i in range(self.projections):
                out = (out ^ slots[:, :, i].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
        return out.view(np.int64)


def meeting(ratio: np.ndarray) -> np.ndarray:
    """Probability that two rows share a slot, by slot width over their distance."""
    c = np.maximum(np.asarray(ratio, float), 1e-12)
    tail = np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in c.ravel()]).reshape(c.shape)
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * c) * (1 - np.exp(-c * c / 2))


def tune(reach: float, distances: np.ndarray, tables: int, recall: float) -> tuple[int, float]:
    """Projections per table and slot width: fewest expected comparisons at that recall."""
    if reach <= 0:
        positive = distances[distances > 0]
        reach = float(positive.min()) / 4 if len(positive) else 1.0
    need_table = 1 - (1 - recall) ** (1 / tables)
    ratios = np.geomspace(0.05, 200, 400)
    met = meeting(ratios)
    best = None
    for n in range(1, MOST_PROJECTIONS + 1):
        at = int(np.searchsorted(met, need_table ** (1 / n)))
        if at == len(ratios):
            break
        width = ratios[at] * reach
        cost = float((meeting(width / np.maximum(distances, 1e-12 * width)) ** n).mean())
        if best is None or cost < best[0] * 0.98:
            best = cost, n, width
    return best[1], best[2]


def _hashed(rows: DataFrame, tables: Tables) -> DataFrame:
    """Rows with their bucket in every table."""
    def work(batches):
        for batch in batches:
            own = tables.buckets(_matrix(batch.column("vector"))) if batch.num_rows else np.zeros((0, 1))
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(batch.num_rows + 1) * own.shape[1], pa.int32()),
                pa.array(own.ravel().astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists],
                                             names=[*batch.schema.names, "buckets"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    hashed = rows.mapInArrow(work, f"{fields}, buckets array<bigint>")
    return hashed.select(*rows.columns, F.posexplode("buckets").alias("table_no", "bucket"))


def _met(query: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of each query in each bucket, buckets cut into blocks on both sides."""
    at = ["table_no", "bucket"]
    sizes = train.groupBy(*at).agg(F.count(F.lit(1)).alias("t")).join(
        query.groupBy(*at).agg(F.count(F.lit(1)).alias("q")), at)
    total = sizes.agg(F.sum("t"), F.count(F.lit(1))).first()
    bundles = max(1, math.ceil((total[0] or 0) / BUNDLE_ROWS))
    plan = sizes.select(
        *at, F.ceil(F.col("t") / TRAIN_BLOCK).cast("int").alias("t_blocks"),
        F.ceil(F.col("q") / QUERY_BLOCK).cast("int").alias("q_blocks")).withColumn(
        "bundle", F.when((F.col("t_blocks") == 1) & (F.col("q_blocks") == 1), F.pmod(
            F.xxhash64(*at), F.lit(bundles))).otherwise(-1 - F.pmod(F.xxhash64(*at), F.lit(1 << 40))))
    plan = materialise(plan)

    def side(rows, own, other, names):
        mine = F.pmod(F.xxhash64("key"), F.col(own)).cast("int").alias(names[0])
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(names[1])
        # Named anew, for each side of the cogroup its own columns.
        own_plan = plan.select(*[F.col(c).alias(c) for c in plan.columns])
        return rows.join(own_plan, at).select(*rows.columns, "bundle", mine, every)

    queries = side(query, "q_blocks", "t_blocks", ("q_block", "t_block"))
    trains = side(train, "t_blocks", "q_blocks", ("t_block", "q_block"))
    schema = pa.schema([
        ("query_key", _arrow(query, "key")), ("train_key", _arrow(train, "key")),
        ("distance", pa.float64()), ("outcome", _arrow(train, "outcome"))])

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        sides = []
        for part in (left, right):
            place = np.array(part.column("table_no")) * np.int64(1 << 58) ^ np.array(part.column("bucket"))
            order = np.argsort(place, kind="stable")
            sides.append((place[order], order, _matrix(part.column("vector"))))
        (q_place, q_order, q_vectors), (t_place, t_order, t_vectors) = sides
        keys = right.column("key").to_numpy()
        out = []
        for place in np.unique(q_place):
            q = q_order[slice(*np.searchsorted(q_place, [place, place + 1]))]
            t = t_order[slice(*np.searchsorted(t_place, [place, place + 1]))]
            if len(t):
                a, b, d = _best(q_vectors[q], t_vectors[t], keys[t], k)
                out.append((q[a], t[b], d))
        if not out:
            return schema.empty_table()
        a, b, d = (np.concatenate([o[i] for o in out]) for i in range(3))
        return pa.table([left.column("key").take(pa.array(a)), right.column("key").take(pa.array(b)),
                         pa.array(d), right.column("outcome").take(pa.array(b))], schema=schema)

    block = ["bundle", "t_block", "q_block"]
    kinds = (query.schema["key"], train.schema["key"], train.schema["outcome"])
    q_key, t_key, outcome = (f.dataType.simpleString() for f in kinds)
    return queries.groupBy(*block).cogroup(trains.groupBy(*block)).applyInArrow(
        match, f"query_key {q_key}, train_key {t_key}, distance double, outcome {outcome}")


def approximate_neighbours(train: DataFrame, query: DataFrame, k: int, recall: float = 0.95,
                           tables: int = TABLES) -> DataFrame:
    """The k nearest rows (key, vector, outcome) of each query (key, vector) that share a bucket.

    Distances are exact; a neighbour that shares no bucket is missed, with a probability of about
    1 - ``recall`` at the distance of the k-th. Queries that meet fewer than k rows are searched
    exactly, so each has k. The tables are tuned on the true neighbours of a bounded sample of
    queries (those of least hash), all rows are hashed.
    """
    if query.limit(1).count() == 0:
        return exact_neighbours(train, query, k)
    spread = F.xxhash64("key")
    asked = query.orderBy(spread, "key").limit(TUNING_QUERIES)
    sample = np.array([r["vector"] for r in asked.select("vector").collect()], float)
    rows = np.array([r["vector"] for r in train.orderBy(spread, "key").limit(TUNING_ROWS).select(
        "vector").collect()], float)
    true = exact_neighbours(train, asked, k)
    farthest = true.groupBy("query_key").agg(F.max("distance").alias("d")).agg(
        F.percentile("d", 0.8)).first()[0]
    n, width = tune(float(farthest or 0.0), _distances(sample, rows).ravel(), tables, recall)
    rng = np.random.default_rng(K.SEED)
    made = Tables(rng.standard_normal((rows.shape[1], tables * n)), rng.random(tables * n), width, n)
    found = _met(materialise(_hashed(query, made)), materialise(_hashed(train, made)), k)
    # A row met in several tables counts once.
    once = materialise(_nearest(found.distinct(), k))
    enough = once.groupBy("query_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    short = query.join(enough, query["key"] == enough["query_key"], "left_anti")
    if short.limit(1).count() == 0:
        return once
    rest = exact_neighbours(train, materialise(short), k)
    kept = once.join(enough.select("query_key"), "query_key", "left_semi")
    return kept.unionByName(rest)
