"""Embedding near-duplicates by a pivot-permutation index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscout.session import materialise, ship_package

from .common import components, in_batches, parallelism

#: Most vectors of a list's block; blocks of a longer list meet pairwise.
BLOCK = 1024


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of equal length, scaled to length one, and which of them are usable.

    A usable vector is not null, not zero and has only finite components; of several
    dimensions in a batch each is handled by its own call.
    """
    rows = column.to_pylist()
    ok = np.zeros(len(rows), bool)
    width = max((len(r) for r in rows if r), default=0)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        if r and None not in r:
            out[i, :len(r)] = r
            ok[i] = True
    ok &= np.isfinite(out).all(1)
    out[~ok] = 0
    scale = np.abs(out).max(1, initial=0)
    ok &= scale > 0
    out[ok] /= scale[ok, None]
    out[ok] /= np.linalg.norm(out[ok], axis=1)[:, None]
    return out, ok


def choose_pivots(vectors: DataFrame, n: int, sample: int = 4096) -> np.ndarray:
    """Reference points: of a bounded sample, the ones that lie far from each other.

    The sample is the ``sample`` usable vectors with the least hash; the first pivot is its
    first vector, each next one the vector whose nearest pivot is farthest away.
    """
    rows = vectors.orderBy(F.xxhash64("vector")).limit(sample).select("vector").collect()
    if not rows:
        return np.zeros((0, 0))
    points = np.array([np.frombuffer(r["vector"], np.float64) for r in rows])
    chosen, nearest = [0], points @ points[0]
    while len(chosen) < min(n, len(points)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, points @ points[chosen[-1]])
    return points[chosen]


def _links(table, least: float, shared: int):
    """Links among the vectors of one block pair that first meet in this list."""
    ids = table.column("node").to_numpy()
    side = table.column("side").to_numpy()
    copies, pivot = table.column("copies").to_numpy(), int(table.column("pivot")[0].as_py())
    points = np.array([np.frombuffer(v, np.float64) for v in table.column("vector").to_pylist()])
    marks = table.column("marks").to_pylist()
    marks = np.array([np.frombuffer(m, np.uint8) for m in marks])
    bits = np.unpackbits(marks, axis=1).astype(np.float32)
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1)
    same = table.column("low")[0] == table.column("high")[0]
    right = left if same else right
    none = np.zeros(0, np.int64)
    out_i, out_j = [none], [none]
    for low in range(0, len(left) if len(right) else 0, 256):
        rows = left[low:low + 256]
        hit = bits[rows] @ bits[right].T >= shared
        # Counted only in the list of the first pivot that both have.
        hit &= bits[rows][:, :pivot] @ bits[right][:, :pivot].T == 0
        hit &= points[rows] @ points[right].T >= least
        if same:
            hit &= np.arange(len(left))[None, :] > np.arange(low, low + len(rows))[:, None]
        i, j = np.nonzero(hit)
        out_i.append(rows[i])
        out_j.append(right[j])
    i, j = np.concatenate(out_i), np.concatenate(out_j)
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    root = np.arange(len(ids))
    while True:
        before = root.copy()
        np.minimum.at(root, i, before[j])
        np.minimum.at(root, j, before[i])
        root = root[root]
        if (root == before).all():
            break
    some = np.unique(np.concatenate((i, j)))
    return pa.table({"node": pa.array(ids[some], pa.int64()),
                     "root": pa.array(ids[root[some]], pa.int64()),
                     "links": pa.array(links[some], pa.int64())})


def near_vectors(embeddings: DataFrame, least: float = 0.93, pivots: int = 64, nearest: int = 8,
                 shared: int = 2, key: str = "vec_id", vector: str = "embedding",
                 group: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row.

    Two vectors link if their groups are equal and not null and their cosine is at least
    ``least``. A vector's description is the ordered list of its ``nearest`` closest pivots;
    inverted lists hold, for each group and pivot, the vectors that have the pivot. Pairs
    with at least ``shared`` pivots in common are compared in double precision, once, in the
    list of their first common pivot. Recall is that of the index: at every found link the
    cosine holds, a link whose ends share fewer pivots is not found.

    Null, zero and non-finite vectors and vectors with a null group or component link with
    nothing and are their own component. Vectors of different lengths never link. Equal
    vectors of a group link; they are handled once, with their number as weight. Rows
    without a key, and repeated keys, take part as rows. Lists of any length are cut in
    blocks of about 1024 that meet pairwise in their own tasks; links leave a task as
    counts and trees, never as pairs.
    """
    spark = embeddings.sparkSession
    ship_package(spark)
    rows = materialise(embeddings.select(
        F.col(key).cast("long").alias("vec_id"), F.col(group).alias("group"),
        F.col(vector).alias("raw")).withColumn("row", F.monotonically_increasing_id()))

    def scaled(batches):
        for batch in batches:
            widths = [len(v) if v is not None else 0 for v in batch.column("raw").to_pylist()]
            for width in sorted(set(widths) - {0}):
                part = batch.filter(pa.array([w == width for w in widths]))
                points, ok = _matrix(part.column("raw"))
                yield pa.RecordBatch.from_arrays([
                    part.column("row"), part.column("vec_id"), part.column("group"),
                    pa.array([p.tobytes() if k else None for p, k in zip(points, ok, strict=True)],
                             pa.binary())], names=["row", "vec_id", "group", "vector"])

    kind = rows.schema["group"].dataType.simpleString()
    usable = materialise(in_batches(
        rows.where("group IS NOT NULL"), scaled,
        f"row bigint, vec_id bigint, group {kind}, vector binary").where("vector IS NOT NULL"))
    classes = materialise(usable.groupBy("group", "vector").agg(
        F.min("row").alias("node"), F.count("*").alias("copies"), F.min("vec_id").alias("least")))
    widths = [r["w"] for r in classes.select(F.length("vector").alias("w")).distinct().collect()]
    found = None
    for width in sorted(widths):
        these = classes.where(F.length("vector") == width)
        points = choose_pivots(these, pivots)
        part = _search(these, points, least, min(nearest, len(points)), min(
            shared, nearest, len(points)))
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"),
                           F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = materialise(found)
    reach = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    label = materialise(
        classes.join(reach, "node", "left").join(degree, "node", "left").select(
            "node", "group", "vector", "least", F.coalesce("component", "node").alias("component"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    smallest = label.groupBy("component").agg(F.min("least").alias("component_id"))
    per_class = label.select("group", "vector", "links", "component").join(smallest, "component")
    per_row = usable.join(per_class, ["group", "vector"]).select("row", "links", "component_id")
    own = rows.select("row", "vec_id").join(per_row, "row", "left")
    component = F.when(F.col("links").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return own.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def _search(classes: DataFrame, points: np.ndarray, least: float, nearest: int,
            shared: int) -> DataFrame:
    n = len(points)

    def describe(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = np.array([np.frombuffer(v, np.float64)
                                for v in batch.column("vector").to_pylist()])
            order = np.argsort(-(vectors @ points.T), axis=1, kind="stable")[:, :nearest]
            marks = np.zeros((len(order), n), bool)
            np.put_along_axis(marks, order, True, axis=1)
            packed = np.packbits(marks, axis=1)
            yield pa.RecordBatch.from_arrays([
                batch.column("node"), batch.column("group"), batch.column("copies"),
                batch.column("vector"), pa.array([m.tobytes() for m in packed], pa.binary()),
                pa.array(order.tolist(), pa.list_(pa.int32()))],
                names=["node", "group", "copies", "vector", "marks", "pivots"])

    kind = classes.schema["group"].dataType.simpleString()
    described = materialise(in_batches(
        classes.select("node", "group", "copies", "vector"), describe,
        f"node bigint, group {kind}, copies bigint, vector binary, marks binary, pivots array<int>"))
    lists = described.select("*", F.explode("pivots").alias("pivot")).drop("pivots")
    blocks = lists.groupBy("group", "pivot").agg(
        F.ceil(F.count("*") / BLOCK).alias("blocks"))
    # Groups x pivots counters, bounded by the group labels: Spark decides on a broadcast.
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    meets = F.explode(F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda other: F.struct(F.least("block", other).alias("low"),
                               F.greatest("block", other).alias("high"))))
    placed = lists.join(blocks, ["group", "pivot"]).withColumn("block", block).withColumn(
        "meet", meets).select(
        "node", "group", "copies", "vector", "marks", "pivot", "meet.low", "meet.high",
        F.when(F.col("block") == F.col("meet.low"), 0).otherwise(1).alias("side"))
    return placed.groupBy("group", "pivot", "low", "high").applyInArrow(
        lambda table: _links(table, least, shared), "node bigint, root bigint, links bigint")
