"""Nearest neighbours, exact, as a pivot-partitioned join; approximate ones by hash tables.

Training rows are grouped into cells around pivots, as in Lu et al., "Efficient
Processing of k Nearest Neighbor Joins using MapReduce" (VLDB 2012). Each query
first searches its closest cells, which bounds the distance to its k-th
neighbour, and is then sent only to cells the triangle inequality cannot rule
out, nor the planes halfway between two pivots. Cells are cut into blocks on both
sides, so no task ever holds more than a block of training rows and a block of
queries however large a cell is, and only the k best per query and block leave a
task. Within a block rows of few columns are halved along the widest one down to
small boxes, and a query is compared only with the boxes that it may need.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise, ship_package

TRAIN_BLOCK = 8_192
QUERY_BLOCK = 2_048
MAX_PIVOTS = 1_024
#: Rows of a box within a block; rows of more columns are not put in boxes, which would rule out little.
BOX_ROWS, BOX_COLUMNS = 64, 24
#: Rows of few columns come in blocks this many times larger.
FEW_COLUMNS = 4
# Pivot coordinates are shipped to every task; their number is limited by size too.
MAX_PIVOT_CELLS = 2_000_000


@dataclass(frozen=True)
class _Layout:
    """Pivots with, per cell, row count, and nearest and farthest training row."""

    pivots: np.ndarray
    counts: np.ndarray
    inner: np.ndarray
    outer: np.ndarray


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _slack(distance):
    """Room for rounding, so that no cell is ruled out by a last digit."""
    return 1e-6 * (1.0 + np.abs(distance))


def _choose_pivots(train: DataFrame, rows: int) -> np.ndarray:
    width = train.select(F.size("vector")).first()[0]
    wanted = min(MAX_PIVOTS, max(1, rows // (2 * TRAIN_BLOCK)), max(1, MAX_PIVOT_CELLS // width))
    picked = train.orderBy(F.md5(F.col("key").cast("string").cast("binary")), "key")
    return np.array([r["vector"] for r in picked.select("vector").limit(wanted).collect()], float)


def _assign(train: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Training rows with their cell and their distance to its pivot."""
    def nearest(batches):
        for batch in batches:
            d = _distances(_matrix(batch.column("vector")), pivots)
            cell = d.argmin(axis=1) if len(d) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)),
                 pa.array(d[np.arange(len(d)), cell])],
                names=[*batch.schema.names, "cell", "reach"],
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in train.schema)
    return train.mapInArrow(nearest, f"{fields}, cell int, reach double")


def _layout(placed: DataFrame, pivots: np.ndarray) -> _Layout:
    n = len(pivots)
    counts, inner, outer = np.zeros(n, int), np.zeros(n), np.zeros(n)
    stats = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("reach").alias("low"), F.max("reach").alias("high")
    )
    for r in stats.collect():
        counts[r["cell"]], inner[r["cell"]], outer[r["cell"]] = r["n"], r["low"], r["high"]
    return _Layout(pivots, counts, inner, outer)


def _send(queries: DataFrame, layout: _Layout, k: int, first: bool) -> DataFrame:
    """Queries repeated once per cell to search.

    The first round takes the closest cells holding k rows. The second takes every
    other cell that may hold a row within ``bound``.
    """
    used = np.flatnonzero(layout.counts)
    between = np.zeros((0, 0)) if first else _distances(layout.pivots[used], layout.pivots[used])
    # Distances come from squares of whole vectors, which lose digits far from the origin.
    reach = float((layout.pivots[used] ** 2).sum(1).max(initial=0.0))

    def chosen(vectors: np.ndarray, bound: np.ndarray | None) -> np.ndarray:
        d = _distances(vectors, layout.pivots[used])
        nearest = d.argmin(axis=1)
        home = np.zeros(d.shape, bool)
        home[np.arange(len(d)), nearest] = True
        few = np.flatnonzero(layout.counts[used][nearest] < k)
        if len(few):
            order = np.argsort(d[few], axis=1, kind="stable")
            held = layout.counts[used][order]
            closest = np.zeros(order.shape, bool)
            np.put_along_axis(closest, order, (np.cumsum(held, axis=1) - held) < k, axis=1)
            home[few] = closest
        if first:
            return home
        bound = bound[:, None]
        slack = _slack(bound) + _slack(d)
        able = ~home & (np.maximum(d - layout.outer[used], layout.inner[used] - d) <= bound + slack)
        # A row of a cell is nearer to its pivot than to the query's nearest one, so it lies behind the
        # plane halfway; squares lose more digits where two pivots are close to each other.
        row, cell = np.nonzero(able)
        far, near, gap = d[row, cell], d[row, nearest[row]], between[nearest[row], cell]
        blur = 1e-12 * (1.0 + far * far + bound[row, 0] ** 2 + reach)
        plane = far * far - near * near - blur > 2 * gap * (bound[row, 0] + slack[row, cell])
        able[row[plane], cell[plane]] = False
        return able

    def route(batches):
        for whole in batches:
            step = max(1, 2_000_000 // len(used))
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                bound = None if first else batch.column("bound").to_numpy(zero_copy_only=False)
                row, cell = np.nonzero(chosen(_matrix(batch.column("vector")), bound))
                picked = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(picked), batch.column("vector").take(picked),
                     pa.array(used[cell].astype(np.int32))],
                    names=["key", "vector", "cell"],
                )

    key_type = queries.schema["key"].dataType.simpleString()
    return queries.mapInArrow(route, f"key {key_type}, vector array<double>, cell int")


def _boxes(rows: np.ndarray, size: int) -> list[np.ndarray]:
    """Positions of the rows in parts of at most ``size``, halved along the widest column."""
    out, open_ = [], [np.arange(len(rows))]
    while open_:
        at = open_.pop()
        if len(at) <= size:
            out.append(at)
            continue
        own = rows[at]
        column = int((own.max(0) - own.min(0)).argmax()) if own.shape[1] else 0
        middle = len(at) // 2
        order = np.argpartition(own[:, column], middle) if own.shape[1] else np.arange(len(at))
        open_ += [at[order[middle:]], at[order[:middle]]]
    return out


def _apart(query: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least distance of each query to each box."""
    squares = np.zeros((len(query), len(low)))
    for column in range(query.shape[1]):
        x = query[:, column, None]
        gap = np.maximum(np.maximum(low[:, column] - x, x - high[:, column]), 0.0)
        squares += gap * gap
    return np.sqrt(squares)


def _best(query: np.ndarray, train: np.ndarray, train_keys: np.ndarray, k: int):
    """Positions of queries and their k nearest training rows with exact distances.

    Small blocks, and rows of many columns, are compared whole. Else the box nearest to a query
    bounds the distance to its k-th neighbour, and only rows of boxes within that are compared.
    Equal distances go to the smaller key.
    """
    rank = np.argsort(np.argsort(train_keys, kind="stable"), kind="stable")
    size = max(BOX_ROWS, 2 * k)
    plain = np.isfinite(train).all() and np.isfinite(query).all()
    if len(train) < 4 * size or train.shape[1] > BOX_COLUMNS or not len(query) or not plain:
        return _compared(query, train, rank, k)
    boxes = _boxes(train, size)
    rows = [train[b] for b in boxes]
    low, high = (np.array([f(r, axis=0) for r in rows]) for f in (np.min, np.max))
    counts = np.array([len(r) for r in rows])
    largest = np.sqrt((train * train).sum(1).max())
    out = []
    # Near queries in a row, so that few boxes are opened for each part.
    turn = np.concatenate(_boxes(query, size))
    step = max(1, 2_000_000 // len(boxes))
    for start in range(0, len(turn), step):
        taken = turn[start:start + step]
        part = query[taken]
        room = 1e-6 * (1.0 + np.sqrt((part * part).sum(1)) + largest)
        least = _apart(part, low, high)
        home, bound = least.argmin(1), np.empty(len(part))
        for b in np.unique(home):
            own = np.flatnonzero(home == b)
            bound[own] = np.partition(_distances(part[own], rows[b]), k - 1, axis=1)[:, k - 1]
        bound += room
        open_ = least <= bound[:, None]
        # Rows that are alike may all be candidates: as many at once as comparing whole would hold.
        piece = np.cumsum(open_ @ counts) // 2_000_000
        for number in np.unique(piece):
            here = slice(*np.searchsorted(piece, (number, number + 1)))
            r, c = [], []
            for b in np.flatnonzero(open_[here].any(0)):
                own = here.start + np.flatnonzero(open_[here, b])
                i, j = np.nonzero(_distances(part[own], rows[b]) <= (bound + room)[own][:, None])
                r.append(own[i])
                c.append(boxes[b][j])
            found = _settled(part, train, rank, np.concatenate(r), np.concatenate(c), k)
            out.append((taken[found[0]], *found[1:]))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def _settled(query, train, rank, r, c, k):
    """Of candidate pairs (query, row) the k nearest of each query, by plain differences."""
    exact = np.empty(len(r))
    for at in range(0, len(r), 200_000):
        cut = slice(at, at + 200_000)
        difference = query[r[cut]] - train[c[cut]]
        exact[cut] = np.sqrt((difference * difference).sum(1))
    order = np.lexsort((rank[c], exact, r))
    r, c, exact = r[order], c[order], exact[order]
    starts = np.searchsorted(r, np.arange(len(query)))
    keep = np.arange(len(r)) - starts[r] < k
    return r[keep], c[keep], exact[keep]


def _compared(query: np.ndarray, train: np.ndarray, rank: np.ndarray, k: int):
    """The same by comparing all pairs.

    Matrix products find candidates, plain differences settle their order, and
    equal distances go to the smaller rank.
    """
    rows, cols, dists = [], [], []
    k = min(k, len(train))
    step = max(1, 2_000_000 // max(len(train), 1))
    for start in range(0, len(query), step):
        part = query[start:start + step]
        rough = _distances(part, train)
        kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
        scale = np.sqrt((part * part).sum(1)) + np.sqrt((train * train).sum(1).max())
        r, c = np.nonzero(rough <= (kth + 1e-6 * (1.0 + scale))[:, None])
        r, c, exact = _settled(part, train, rank, r, c, k)
        rows.append(r + start)
        cols.append(c)
        dists.append(exact)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dists)


def _search(sent: DataFrame, placed: DataFrame, layout: _Layout, k: int) -> DataFrame:
    """The k nearest rows per query and block."""
    per_cell = {r["cell"]: r["n"] for r in sent.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    times = FEW_COLUMNS if layout.pivots.shape[1] <= BOX_COLUMNS else 1
    cells = [
        (cell, max(1, math.ceil(layout.counts[cell] / (times * TRAIN_BLOCK))),
         max(1, math.ceil(n / (times * QUERY_BLOCK))))
        for cell, n in per_cell.items()
    ]
    # At most one row per pivot.
    plan = F.broadcast(sent.sparkSession.createDataFrame(
        [(c, int(t), int(q)) for c, t, q in cells], "cell int, t_blocks int, q_blocks int"))

    def spread(own: str, other: str, names: tuple[str, str]) -> list[Column]:
        mine = F.pmod(F.xxhash64("key"), F.col(own)).cast("int").alias(names[0])
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(names[1])
        return [mine, every]

    query_side = sent.join(plan, "cell").select(
        "key", "vector", "cell", *spread("q_blocks", "t_blocks", ("q_block", "t_block")))
    train_side = placed.join(plan, "cell").select(
        "key", "vector", "outcome", "cell", *spread("t_blocks", "q_blocks", ("t_block", "q_block")))
    out_key = sent.schema["key"].dataType.simpleString()
    in_key = placed.schema["key"].dataType.simpleString()
    outcome = placed.schema["outcome"].dataType.simpleString()
    target = pa.schema([
        ("query_key", _arrow(sent, "key")), ("train_key", _arrow(placed, "key")),
        ("distance", pa.float64()), ("outcome", _arrow(placed, "outcome")),
    ])

    def match(queries: pa.Table, trains: pa.Table) -> pa.Table:
        if not queries.num_rows or not trains.num_rows:
            return target.empty_table()
        keys = trains.column("key").to_numpy()
        q, t, d = _best(_matrix(queries.column("vector")), _matrix(trains.column("vector")), keys, k)
        t = pa.array(t)
        return pa.table(
            [queries.column("key").take(pa.array(q)), trains.column("key").take(t), pa.array(d),
             trains.column("outcome").take(t)], schema=target)

    block = ["cell", "t_block", "q_block"]
    return query_side.groupBy(*block).cogroup(train_side.groupBy(*block)).applyInArrow(
        match, f"query_key {out_key}, train_key {in_key}, distance double, outcome {outcome}")


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def _nearest(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_key").orderBy("distance", "train_key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def neighbours(
    train: DataFrame, query: DataFrame, k: int, train_key: str, query_key: str,
    vector: str, outcome: str, method: str = "exact", recall: float = 0.95,
) -> DataFrame:
    """The k nearest training rows of each query: key, rank, distance and outcome.

    Ties in distance go to the smaller training key; rows that share a key should be alike. With
    ``method="approximate"`` rows are compared by hash tables that find a neighbour with about
    the probability ``recall``: in many dimensions, where the triangle inequality rules out little,
    the exact search compares nearly all pairs.
    """
    if method not in ("exact", "approximate"):
        raise ValueError(f"unknown method {method!r}")
    train = train.select(
        F.col(train_key).alias("key"), F.col(vector).cast("array<double>").alias("vector"),
        F.col(outcome).alias("outcome"))
    query = query.select(
        F.col(query_key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    if method == "exact":
        return exact_neighbours(train, query, k)
    from .hashed_neighbors import approximate_neighbours

    return approximate_neighbours(train, query, k, recall)


def exact_neighbours(train: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """The k nearest rows (key, vector, outcome) of each query (key, vector)."""
    ship_package(train.sparkSession)
    rows = train.count()
    if rows < k:
        raise ValueError(f"{k} neighbours wanted of {rows} training rows")
    pivots = _choose_pivots(train, rows)
    placed = materialise(_assign(train, pivots))
    layout = _layout(placed, pivots)
    home = _nearest(_search(_send(query, layout, k, True), placed, layout, k), k)
    if len(pivots) == 1:
        return home
    home = materialise(home)
    bounds = home.groupBy("query_key").agg(F.max("distance").alias("bound"))
    bounded = query.join(bounds, query["key"] == bounds["query_key"]).drop("query_key")
    away = _search(materialise(_send(bounded, layout, k, False)), placed, layout, k)
    return _nearest(home.drop("rank").unionByName(away), k)


def vote(found: DataFrame) -> DataFrame:
    """Most frequent outcome per query, the smallest on ties, and its share of the votes."""
    votes = found.groupBy("query_key", "outcome").agg(F.count(F.lit(1)).alias("n"))
    best = F.struct((-F.col("n")).alias("n"), F.col("outcome"))
    return votes.groupBy("query_key").agg(
        F.min(best).getField("outcome").alias("prediction"),
        (F.max("n") / F.sum("n")).alias("probability"),
    )


def average(found: DataFrame) -> DataFrame:
    """Mean outcome per query."""
    return found.groupBy("query_key").agg(F.avg("outcome").alias("prediction"))
