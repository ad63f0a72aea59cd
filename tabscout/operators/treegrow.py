"""Growing decision trees from counts per (node, feature, bin).

Large nodes are split level by level: tasks add up the statistics of their rows per node and bin,
one grouped sum brings the parts together and finds the best split of each node. Nodes that
have become small send their rows to one task each, which finishes the subtree (as in Panda et
al., "PLANET", 2009), so depth costs no passes over the data. All statistics are integers: the
trees do not depend on how the rows are dealt.

A row has the statistics G_1..G_K (gradients, or weights per class), H (hessians, or weights)
and N (rows). A split's gain is sum G^2/(D+penalty) on the left and on the right less the same of
the node, with D the hessians or the rows. With G the weights per class and D the weights this
is the decrease of the Gini impurity, with G the labels that of the variance.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bins import Bins, Block, in_batches, large_batches, lists_of

#: Nodes of up to this many rows are finished in one task each.
SMALL_ROWS = 16_384
#: Statistics of (node, bin) cells that are held at once.
CELLS = 1 << 22
#: Bins that are added up and searched together; whole features, so one more feature may exceed it.
CHUNK_BINS = 4096

_U = np.uint64
_MIX_A, _MIX_B = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    h = np.asarray(h, _U)
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _MIX_A
        h = (h ^ (h >> _U(27))) * _MIX_B
        return h ^ (h >> _U(31))


def child_key(key: np.ndarray, side: int) -> np.ndarray:
    """Key of a node's child: the same whatever way the tree is grown."""
    return mixed(np.asarray(key, _U) ^ _U((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[side]))


@dataclass(frozen=True)
class Rules:
    """When and how nodes are split; all amounts in the units of the statistics."""

    classes: int
    depth: int | None = None
    min_hessian: float = 0.0
    penalty: float = 0.0
    #: N counts as this much in D; 0: D is H.
    row_weight: float = 0.0
    #: Features drawn for a node, among those that can split it; None: all.
    node_features: int | None = None
    #: Least gain of a split; None: any split of a node with several classes.
    least_gain: float | None = 0.0


def _weight(stats: np.ndarray, rules: Rules) -> np.ndarray:
    """sum G^2 / (D + penalty); statistics are along axis 1."""
    k = rules.classes
    g = stats[:, :k].astype(np.float64)
    d = stats[:, k + 1] * rules.row_weight if rules.row_weight else stats[:, k].astype(np.float64)
    d = d + rules.penalty
    return np.divide((g * g).sum(1), d, out=np.zeros(d.shape), where=d > 0)


def splittable(stats: np.ndarray, depth: np.ndarray, rules: Rules) -> np.ndarray:
    """Which nodes may be split at all."""
    ok = stats[:, rules.classes + 1] >= 2
    if rules.depth is not None:
        ok &= depth < rules.depth
    if rules.least_gain is None:
        ok &= stats[:, :rules.classes].max(1) < stats[:, rules.classes]
    return ok


def best_splits(hist: np.ndarray, totals: np.ndarray, keys: np.ndarray, features: np.ndarray,
                starts: np.ndarray, default: np.ndarray, rules: Rules):
    """Candidate splits of some nodes: (node, feature, bin, gain, rank, left statistics).

    ``hist`` (node, statistic, bin) lacks the default bins, which hold the rest of the totals.
    Without a draw of features there is one candidate at most for a node: of the highest gain, the lowest
    feature and bin. With a draw there are the best splits of the ``node_features`` features of
    least hash that can split the node.
    """
    sizes = np.diff(np.append(starts, hist.shape[2]))
    hist[:, :, default] += totals[:, :, None] - np.add.reduceat(hist, starts, axis=2)
    left = np.cumsum(hist, axis=2)
    left -= np.repeat(left[:, :, starts] - hist[:, :, starts], sizes, axis=2)
    right = totals[:, :, None] - left
    k = rules.classes
    parts = _weight(left, rules) + _weight(right, rules)
    gain = parts - _weight(totals, rules)[:, None]
    fine = (left[:, k + 1] >= 1) & (right[:, k + 1] >= 1)
    if rules.min_hessian:
        fine &= (left[:, k] >= rules.min_hessian) & (right[:, k] >= rules.min_hessian)
    if rules.least_gain is not None:
        # Rounding of the sums is no gain.
        fine &= gain > np.maximum(rules.least_gain, 1e-12 * parts)
    fine[:, starts + sizes - 1] = False
    gain[~fine] = -np.inf
    owner = np.repeat(np.arange(len(features)), sizes)
    if rules.node_features is None:
        node = np.arange(len(hist))
        at = np.argmax(gain, axis=1)
        rank = np.zeros(len(hist), np.int64)
    else:
        best = np.maximum.reduceat(gain, starts, axis=1)
        order = mixed(keys[:, None] ^ mixed(features.astype(_U))[None, :])
        order[best == -np.inf] = np.iinfo(np.uint64).max
        drawn = np.argsort(order, axis=1, kind="stable")[:, :rules.node_features]
        place = np.arange(gain.shape[1])
        top = gain == np.repeat(best, sizes, axis=1)
        first = np.minimum.reduceat(np.where(top, place, len(place)), starts, axis=1)
        node = np.repeat(np.arange(len(hist)), drawn.shape[1])
        at = first[node, drawn.ravel()]
        rank = (order[node, drawn.ravel()] >> _U(1)).astype(np.int64)
    found = gain[node, at] > -np.inf
    node, at, rank = node[found], at[found], rank[found]
    return (node, features[owner[at]], at - starts[owner[at]], gain[node, at], rank,
            left[node, :, at])


def choose(candidates, rules: Rules) -> dict[int, tuple]:
    """One split (feature, bin, left statistics) of each node, of candidates of several chunks."""
    by_node: dict[int, list] = {}
    for node, feature, local, gain, rank, left in candidates:
        by_node.setdefault(node, []).append((rank, feature, local, gain, left))
    out = {}
    for node, own in by_node.items():
        if rules.node_features is not None:
            own = sorted(own, key=lambda c: c[:2])[:rules.node_features]
        best = min(own, key=lambda c: (-c[3], c[1], c[2]))
        out[node] = best[1], best[2], best[4]
    return out


@dataclass
class Tree:
    """Nodes of a tree; a node without a feature (-1) is a leaf or not yet split."""

    key: int
    feature: list = field(default_factory=list)
    bin: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    stats: list = field(default_factory=list)
    keys: list = field(default_factory=list)
    depth: list = field(default_factory=list)
    #: Features the tree may use; None: all.
    columns: np.ndarray | None = None

    def add(self, stats, key: int, depth: int) -> int:
        for name, value in (("feature", -1), ("bin", 0), ("left", 0), ("right", 0),
                            ("stats", stats), ("keys", int(key)), ("depth", depth)):
            getattr(self, name).append(value)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, local: int, left) -> tuple[int, int]:
        own = self.stats[node]
        sides = left, [int(a) - int(b) for a, b in zip(own, left)]
        made = [self.add([int(s) for s in stats], int(child_key(self.keys[node], side)),
                         self.depth[node] + 1) for side, stats in enumerate(sides)]
        self.feature[node], self.bin[node] = int(feature), int(local)
        self.left[node], self.right[node] = made
        return tuple(made)

    def shape(self) -> "Shape":
        return Shape(*(np.array(getattr(self, n), np.int32)
                       for n in ("feature", "bin", "left", "right")))


@dataclass(frozen=True)
class Shape:
    """What is needed to send rows down a tree."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def nodes(self, block: Block) -> np.ndarray:
        node = np.zeros(block.n, np.int32)
        while True:
            feature = self.feature[node]
            inner = feature >= 0
            if not inner.any():
                return node
            goes_left = block.local(np.where(inner, feature, 0)) <= self.bin[node]
            down = np.where(goes_left, self.left[node], self.right[node])
            node = np.where(inner, down, node)


#: Statistics (row, statistic) of a block's rows for the tree of a number, 0 where not drawn.
Stats = Callable[[Block, int], np.ndarray]
#: Turns a table of stored rows into a block.
ToBlock = Callable[[pa.Table], Block]


def _chunks(bins: Bins) -> np.ndarray:
    """First feature of each chunk, and the number of features at the end."""
    edges = [0]
    while edges[-1] < bins.width:
        limit = bins.offset[edges[-1]] + CHUNK_BINS
        edges.append(max(edges[-1] + 1, int(np.searchsorted(bins.offset, limit, "right")) - 1))
    return np.array(edges)


def grow(rows: DataFrame, n_rows: int, bins: Bins, trees: list[Tree], to_block: ToBlock,
         stats: Stats, rules: Rules) -> None:
    """Grow trees side by side, from their roots on, until no node can be split."""
    small: list[tuple[int, int]] = []
    for t, tree in enumerate(trees):
        tree.add(None, tree.key, 0)
    large = [(t, 0) for t in range(len(trees))]
    if n_rows <= SMALL_ROWS:
        small, large = large, []
    while large:
        splits, totals = _split_level(rows, bins, trees, large, to_block, stats, rules)
        following = []
        for at, (t, node) in enumerate(large):
            tree = trees[t]
            if tree.stats[node] is None:
                tree.stats[node] = totals.get(at, [0] * (rules.classes + 2))
            if at not in splits:
                continue
            for child in tree.split(node, *splits[at]):
                own = np.array([tree.stats[child]])
                if splittable(own, np.array([tree.depth[child]]), rules)[0]:
                    few = own[0, rules.classes + 1] <= SMALL_ROWS
                    (small if few else following).append((t, child))
        large = following
    if small:
        _finish_small(rows, bins, trees, small, to_block, stats, rules)


def _split_level(rows, bins, trees, active, to_block, stats, rules):
    """Best splits and totals of the active (tree, node) pairs, by their place in the list."""
    edges = _chunks(bins)
    n_stats = rules.classes + 2
    step = max(1, CELLS // (bins.total * n_stats))
    splits, totals = {}, {}
    for low in range(0, len(active), step):
        part = active[low:low + step]
        wanted: dict[int, np.ndarray] = {}
        for unit, (t, node) in enumerate(part):
            wanted.setdefault(t, np.full(len(trees[t].feature), -1))[node] = unit
        shapes = {t: trees[t].shape() for t in wanted}
        keys = np.array([trees[t].keys[node] for t, node in part], _U)
        allowed = [trees[t].columns for t, _ in part]
        found = _sums(rows, bins, edges, wanted, shapes, len(part), n_stats, to_block, stats)
        for r in _search(found, bins, edges, keys, allowed, rules, n_stats).collect():
            unit = low + r["unit"]
            totals[unit] = list(r["totals"])
            if r["feature"] >= 0:
                splits.setdefault(unit, []).append(
                    (unit, r["feature"], r["bin"], r["gain"], r["rank"], list(r["left"])))
    chosen = choose((c for own in splits.values() for c in own), rules)
    return chosen, totals


def _sums(rows, bins, edges, wanted, shapes, n_units, n_stats, to_block, stats) -> DataFrame:
    """(unit, chunk, totals, sums) of every task; bins without rows are left out."""
    width = bins.total

    def work(batches):
        sums = np.zeros((n_stats, n_units * width), np.int64)
        totals = np.zeros((n_stats, n_units), np.int64)
        for table in large_batches(batches):
            block = to_block(table)
            for t, unit_of in wanted.items():
                own = stats(block, t)
                unit = unit_of[shapes[t].nodes(block)]
                use = (unit >= 0) & (own[:, -1] > 0)
                entry = use[block.row]
                row = block.row[entry]
                cell = unit[row] * width + block.at[entry]
                for s in range(n_stats):
                    # Sums of a block stay below 2^53, so the doubles are exact.
                    weights = own[:, s].astype(np.float64)
                    part = np.bincount(unit[use], weights[use], n_units)
                    totals[s] += np.rint(part).astype(np.int64)
                    part = np.bincount(cell, weights[row], n_units * width)
                    sums[s] += np.rint(part).astype(np.int64)
        sums = sums.reshape(n_stats, n_units, width)
        out = []
        for unit in np.flatnonzero(totals[-1]).tolist():
            for chunk in range(len(edges) - 1):
                low, high = bins.offset[edges[chunk]], bins.offset[edges[chunk + 1]]
                part = np.ascontiguousarray(sums[:, unit, low:high])
                out.append((unit, chunk, totals[:, unit].tobytes(),
                            part.tobytes() if part.any() else None))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()),
             pa.array([r[2] for r in out], pa.binary()), pa.array([r[3] for r in out], pa.binary())],
            names=["unit", "chunk", "totals", "sums"])

    return in_batches(rows, work, "unit int, chunk int, totals binary, sums binary")


def _search(sums: DataFrame, bins, edges, keys, allowed, rules, n_stats) -> DataFrame:
    """Adds the tasks' sums up and proposes splits of each unit and chunk."""
    def work(batches):
        whole: dict[tuple[int, int], list] = {}
        for batch in batches:
            for unit, chunk, totals, own in zip(*(c.to_pylist() for c in batch.columns)):
                low, high = bins.offset[edges[chunk]], bins.offset[edges[chunk + 1]]
                held = whole.setdefault((unit, chunk), [
                    np.zeros(n_stats, np.int64), np.zeros((n_stats, high - low), np.int64)])
                held[0] += np.frombuffer(totals, np.int64)
                if own is not None:
                    held[1] += np.frombuffer(own, np.int64).reshape(n_stats, -1)
        out = []
        for (unit, chunk), (totals, hist) in whole.items():
            features = np.arange(edges[chunk], edges[chunk + 1])
            starts = bins.offset[features] - bins.offset[features[0]]
            default = bins.default[features] - bins.offset[features[0]]
            own = rules if allowed[unit] is None else None
            if own is None:
                hist, features, starts, default = _only(
                    hist, features, starts, default, allowed[unit])
            out.append((unit, -1, 0, 0.0, 0, [], totals.tolist()))
            if len(features) and splittable(totals[None], np.zeros(1), replace(rules, depth=None))[0]:
                made = best_splits(hist[None], totals[None], keys[unit:unit + 1], features, starts,
                                   default, rules)
                for _, feature, local, gain, rank, left in zip(*made):
                    out.append((unit, int(feature), int(local), float(gain), int(rank),
                                left.tolist(), totals.tolist()))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64(),
                 pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)],
            names=["unit", "feature", "bin", "gain", "rank", "left", "totals"])

    # A fixed number of partitions: the rows are few but hold many sums each.
    spread = int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_batches(
        sums.repartition(min(spread, max(1, len(keys) * (len(edges) - 1))), "unit", "chunk"), work,
        "unit int, feature int, bin int, gain double, rank bigint, left array<bigint>, "
        "totals array<bigint>")


def _only(hist, features, starts, default, columns):
    """The histogram of some columns."""
    sizes = np.diff(np.append(starts, hist.shape[1]))
    use = np.isin(features, columns)
    kept = np.repeat(use, sizes)
    new = np.cumsum(sizes[use]) - sizes[use]
    return hist[:, kept], features[use], new, default[use] - starts[use] + new


def _finish_small(rows, bins, trees, small, to_block, stats, rules) -> None:
    """Finish each small node in one task from its own rows."""
    wanted: dict[int, np.ndarray] = {}
    for unit, (t, node) in enumerate(small):
        wanted.setdefault(t, np.full(len(trees[t].feature), -1))[node] = unit
    shapes = {t: trees[t].shape() for t in wanted}
    keys = np.array([trees[t].keys[node] for t, node in small], _U)
    depths = [trees[t].depth[node] for t, node in small]
    allowed = [trees[t].columns for t, _ in small]

    def gather(batches):
        for table in large_batches(batches):
            block = to_block(table)
            lists = table.column("bins").combine_chunks()
            for t, unit_of in wanted.items():
                own = stats(block, t)
                unit = unit_of[shapes[t].nodes(block)]
                use = np.flatnonzero((unit >= 0) & (own[:, -1] > 0))
                if len(use):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(unit[use].astype(np.int32)),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(len(use) + 1) * own.shape[1], pa.int32()),
                            pa.array(own[use].ravel())),
                        lists.take(pa.array(use))], names=["unit", "stats", "bins"])

    def finish(table):
        unit = table.column("unit")[0].as_py()
        row, at = lists_of(table.column("bins"))
        own = lists_of(table.column("stats"))[1].reshape(table.num_rows, -1)
        shape, sums = grow_here(bins, row, at, own, keys[unit], depths[unit], allowed[unit], rules)
        return pa.table({
            "unit": pa.array([unit], pa.int32()),
            **{n: pa.array([getattr(shape, n)], pa.list_(pa.int32()))
               for n in ("feature", "bin", "left", "right")},
            "stats": pa.array([sums.ravel()], pa.list_(pa.int64()))})

    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gathered = in_batches(rows, gather, "unit int, stats array<bigint>, bins array<int>")
    # A fixed number of partitions keeps the nodes apart; the groups need no other shuffle.
    done = gathered.repartition(min(spread, len(small)), "unit").groupBy("unit").applyInArrow(
        finish, "unit int, feature array<int>, bin array<int>, left array<int>, right array<int>, "
        "stats array<bigint>")
    for r in done.collect():
        t, node = small[r["unit"]]
        tree = trees[t]
        base = len(tree.feature) - 1
        n_stats = rules.classes + 2
        grown = len(r["feature"])
        each = [r["stats"][i * n_stats:(i + 1) * n_stats] for i in range(grown)]
        # The subtree's root takes the node's place, the others follow at the end.
        for name in ("left", "right"):
            moved = [base + c if f >= 0 else 0 for c, f in zip(r[name], r["feature"])]
            getattr(tree, name)[node] = moved[0]
            getattr(tree, name).extend(moved[1:])
        for name, values in (("feature", r["feature"]), ("bin", r["bin"]), ("stats", each)):
            getattr(tree, name)[node] = values[0]
            getattr(tree, name).extend(values[1:])
        tree.keys.extend([0] * (grown - 1))
        tree.depth.extend([0] * (grown - 1))
    for t, node in small:
        if trees[t].stats[node] is None:
            trees[t].stats[node] = [0] * (rules.classes + 2)


def grow_here(bins: Bins, row: np.ndarray, at: np.ndarray, own: np.ndarray, key, depth: int,
              columns, rules: Rules) -> tuple[Shape, np.ndarray]:
    """A whole subtree, and its nodes' statistics, from rows in memory: the same splits as level by
    level."""
    feature = bins.feature_of[at]
    if columns is not None:
        use = np.isin(feature, columns)
        row, at, feature = row[use], at[use], feature[use]
    # Features without an entry have one bin here and cannot split.
    present, column = np.unique(feature, return_inverse=True)
    sizes = bins.sizes[present]
    starts = np.cumsum(sizes) - sizes
    width = int(sizes.sum())
    local = at - bins.offset[feature]
    zero = bins.default[present] - bins.offset[present]
    n_stats = own.shape[1]
    weights = own.astype(np.float64)
    node_of = np.zeros(len(own), np.int64)
    # Nodes level by level: feature, bin, left child, statistics; a right child follows its left.
    levels = [(np.array([-1]), np.zeros(1, np.int64), np.zeros(1, np.int64), own.sum(0)[None])]
    keys, first, made = np.array([key], _U), 0, 1
    step = max(1, CELLS // max(1, width * n_stats))
    while width:
        split, bin_of, left_of, totals = levels[-1]
        active = np.flatnonzero(splittable(totals, np.full(len(totals), depth), rules))
        place = np.full(len(totals), -1)
        place[active] = np.arange(len(active))
        unit = np.where(node_of >= first, place[np.maximum(node_of - first, 0)], -1)
        found = []
        for low in range(0, len(active), step):
            n = min(step, len(active) - low)
            entry = (unit[row] >= low) & (unit[row] < low + n)
            cell = (unit[row[entry]] - low) * width + starts[column[entry]] + local[entry]
            hist = np.stack([
                np.rint(np.bincount(cell, weights[row[entry], s], n * width)).astype(np.int64)
                .reshape(n, width) for s in range(n_stats)], axis=1)
            some = active[low:low + n]
            node, f, b, gain, _, left = best_splits(
                hist, totals[some], keys[some], present, starts, starts + zero, rules)
            order = np.lexsort((b, f, -gain, node))
            order = order[np.diff(node[order], prepend=-1) > 0]
            found.append((some[node[order]], f[order], b[order], left[order]))
        if not found or not sum(len(f[0]) for f in found):
            break
        node, f, b, left = (np.concatenate([x[i] for x in found]) for i in range(4))
        split[node], bin_of[node] = f, b
        left_of[node] = made + 2 * np.arange(len(node))
        both = np.stack((left, totals[node] - left), axis=1).reshape(-1, n_stats)
        keys = np.stack((child_key(keys[node], 0), child_key(keys[node], 1)), axis=1).ravel()
        # Send the rows of split nodes down.
        here = np.flatnonzero(node_of >= first)
        here = here[split[node_of[here] - first] >= 0]
        own_node = node_of[here] - first
        wanted = np.full(len(own), -1)
        wanted[here] = np.searchsorted(present, split[own_node])
        value = np.zeros(len(own), np.int64)
        value[here] = zero[wanted[here]]
        hit = column == wanted[row]
        value[row[hit]] = local[hit]
        node_of[here] = left_of[own_node] + (value[here] > bin_of[own_node])
        first, made = made, made + len(both)
        depth += 1
        levels.append((np.full(len(both), -1), np.zeros(len(both), np.int64),
                       np.zeros(len(both), np.int64), both))
    feature, bins_of, left, stats = (np.concatenate([x[i] for x in levels]) for i in range(4))
    right = np.where(feature >= 0, left + 1, 0)
    shape = Shape(*(a.astype(np.int32) for a in (feature, bins_of, left, right)))
    return shape, stats
