"""Jaccard join of word-shingle sets by prefix filters under several global orders."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscout.session import materialise, ship_package

from .common import components, in_batches, in_groups, parallelism, slices
from .words import mixed, shingle_sets, signature

#: Most documents, and shingles, of a block that is compared with another in one task.
BLOCK_SETS, BLOCK_SHINGLES = 768, 1 << 19
#: A lookup of fewer signatures than this is broadcast, a longer one is shuffled.
SMALL_LOOKUP = 2_000_000


def least_overlap(n, percent):
    """Shingles that a set of n must share with any set it links to."""
    return -(-percent * n // 100)


def _extra(n):
    """How many common shingles the longer prefixes of the first filter guarantee."""
    return n // 10 if n >= 10 else 1


def _needed(n, percent):
    """The least guarantee of any partner, whose size is at least the overlap."""
    return min(_extra(least_overlap(n, percent)), _extra(n))


def _sets_of(batches, size, most=2 << 20):
    for batch in slices(batches, "text", most):
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        yield batch, shingle_sets(texts, size)


def set_sizes(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, sig) of every row: set size and a hash of the set."""
    def work(batches):
        for batch, sets in _sets_of(batches, size):
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([signature(s) for s in sets], pa.int64())], names=["doc_id", "n", "sig"])

    return in_batches(docs, work, "doc_id bigint, n bigint, sig bigint")


def shared_in_prefix(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """First order, by hash: (sig, n_shared), prefix shingles that another set's prefix has.

    A prefix of n - o + l shingles, o the least overlap, shares at least l with the prefix
    of any linked set. Shingles travel packed by bucket, as 32-bit checks next to each set's
    hash; two that agree by chance only let a set pass. A bucket's blobs are merged by one
    task; equal sets of a batch travel once.
    """
    buckets = parallelism(docs.sparkSession)

    def deal(batches):
        for _, sets in _sets_of(batches, size, 4 << 20):
            sets = list({signature(s): s for s in sets if len(s)}.items())
            if not sets:
                continue
            kept = [s[:len(s) - least_overlap(len(s), percent) + _extra(len(s))] for _, s in sets]
            tokens = np.concatenate(kept)
            owner = np.repeat(np.arange(len(kept), dtype=np.int32), [len(k) for k in kept])
            sigs = np.array([sig for sig, _ in sets], np.int64)
            bucket = (tokens % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            checks, owner = (tokens >> np.uint64(32)).astype(np.uint32)[order], owner[order]
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = ([], [], [], [])
            for b in range(buckets):
                low, high = edges[b], edges[b + 1]
                if low < high:
                    mine, counts = np.unique(owner[low:high], return_counts=True)
                    for column, value in zip(out, (
                            b, checks[low:high].tobytes(), sigs[mine].tobytes(),
                            counts.astype(np.uint32).tobytes()), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, [
                    pa.int32(), pa.binary(), pa.binary(), pa.binary()], strict=True)],
                ["bucket", "checks", "sigs", "counts"])

    def merge(table):
        read = lambda name, kind: np.frombuffer(
            b"".join(table.column(name).to_pylist()), kind)
        checks = read("checks", np.uint32)
        sigs = np.repeat(read("sigs", np.int64), read("counts", np.uint32))
        order = np.lexsort((sigs, checks))
        checks, sigs = checks[order], sigs[order]
        new = np.append(True, checks[1:] != checks[:-1])
        pair = new | np.append(True, sigs[1:] != sigs[:-1])
        checks, sigs, new = checks[pair], sigs[pair], new[pair]
        group = np.cumsum(new) - 1
        shared = np.bincount(group)[group] > 1
        found, counts = np.unique(sigs[shared], return_counts=True)
        return pa.table({"sig": pa.array(found, pa.int64()),
                         "n_shared": pa.array(counts, pa.int64())})

    blobs = in_batches(docs, deal, "bucket int, checks binary, sigs binary, counts binary")
    found = in_groups(blobs.groupBy("bucket"), merge, "sig bigint, n_shared bigint")
    return found.groupBy("sig").agg(F.sum("n_shared").alias("n_shared"))


def _lookup(spark, df):
    """Broadcast a written table if it is small, else leave the join to Spark."""
    return F.broadcast(df) if df.count() <= SMALL_LOOKUP else df


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Number of common elements of each pair, over the columns that both sides have."""
    out = np.zeros((len(a), len(b)), np.float32)
    left, right = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(left, right)
    row = np.repeat(np.arange(len(a)), [len(x) for x in a])
    col = np.repeat(np.arange(len(b)), [len(x) for x in b])

    def places(values, owner):
        at = np.searchsorted(common, values)
        at[at == len(common)] = 0
        kept = common[at] == values
        order = np.argsort(at[kept], kind="stable")
        return at[kept][order], owner[kept][order]

    if not len(common):
        return out
    (la, ra), (lb, rb) = places(left, row), places(right, col)
    step = 2048
    for low in range(0, len(common), step):
        width = min(step, len(common) - low)
        sides = []
        for at, owner, n in ((la, ra, len(a)), (lb, rb, len(b))):
            i, j = np.searchsorted(at, (low, low + width))
            m = np.zeros((n, width), np.float32)
            m[owner[i:j], at[i:j] - low] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def linked(a, b, rare_a, rare_b, percent: int, same: bool) -> np.ndarray:
    """Which pairs of two lists of sets link: filters first, then the exact count.

    A candidate must share a shingle of the prefixes under the order by hash, under the
    order by a second hash, and under the order by frequency (``rare``); only sets with a
    candidate are counted whole.
    """
    na, nb = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    small, large = np.minimum.outer(na, nb), np.maximum.outer(na, nb)
    hope = 100 * small >= percent * large
    if same:
        hope &= np.triu(np.ones(hope.shape, bool), 1)

    def prefixes(sets, second):
        for s in sets:
            length = len(s) - least_overlap(len(s), percent) + 1
            if second:
                key = mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                yield s[np.argpartition(key, length - 1)[:length]]
            else:
                yield s[:length]

    orders = ((rare_a, rare_b), *(
        (list(prefixes(a, second)), list(prefixes(b, second))) for second in (False, True)))
    for left, right in orders:
        rows, cols = np.flatnonzero(hope.any(1)), np.flatnonzero(hope.any(0))
        if not len(rows):
            return hope
        some = np.zeros_like(hope)
        some[np.ix_(rows, cols)] = overlaps([left[i] for i in rows], [right[i] for i in cols]) > 0
        hope &= some
    rows, cols = np.flatnonzero(hope.any(1)), np.flatnonzero(hope.any(0))
    if len(rows):
        common = overlaps([a[i] for i in rows], [b[i] for i in cols]).astype(np.int64)
        union = na[rows][:, None] + nb[cols][None, :] - common
        ok = np.zeros_like(hope)
        ok[np.ix_(rows, cols)] = 100 * common >= percent * union
        hope &= ok
    return hope


def _verify(percent):
    def verify(table):
        read = lambda name: [np.frombuffer(x, np.uint64)
                             for x in table.column(name).to_pylist()]
        sigs = table.column("sig").to_numpy()
        cluster, side = table.column("cluster").to_numpy(), table.column("side").to_numpy()
        copies = table.column("copies").to_numpy()
        # A group has one pair of blocks; a partner block that nobody is in links nothing.
        same = table.column("low")[0] == table.column("high")[0]
        sets, rare = read("shingles"), read("rare")
        out_sig, out_root, out_links = [], [], []
        order = np.lexsort((sigs, side, cluster))
        edges = np.flatnonzero(np.diff(cluster[order], prepend=cluster[order[0]] - 1))
        for members in np.split(order, edges[1:]):
            left = members[side[members] == 0]
            right = members[side[members] == 1]
            right = left if same else right
            if not len(left) or not len(right):
                continue
            pick = lambda things, at: [things[i] for i in at]
            hit = linked(pick(sets, left), pick(sets, right), pick(rare, left), pick(rare, right),
                         percent, same)
            i, j = np.nonzero(hit)
            if not len(i):
                continue
            i, j = left[i], right[j]
            links = np.zeros(len(sigs), np.int64)
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            # Least member reachable inside this block: enough to connect all its links.
            root = np.arange(len(sigs))
            while True:
                before = root.copy()
                np.minimum.at(root, i, before[j])
                np.minimum.at(root, j, before[i])
                root = root[root]
                if (root == before).all():
                    break
            some = np.unique(np.concatenate((i, j)))
            out_sig.append(sigs[some])
            out_root.append(sigs[root[some]])
            out_links.append(links[some])
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pa.table({"sig": pa.array(join(out_sig), pa.int64()),
                         "root": pa.array(join(out_root), pa.int64()),
                         "links": pa.array(join(out_links), pa.int64())})

    return verify


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """One row for each row: (doc_id, n_shingles, component_id, n_links).

    Two rows link when 100 x common shingles >= percent x all shingles of both;
    ``n_links`` counts the other rows a row links to, ``component_id`` is the smallest key it
    reaches, its own included. Null, empty and word-less texts have no shingle and link with
    nothing; rows with equal sets link, so equal sets are handled once and weighted. A row
    without a key takes part and shows the smallest key of its component, which is null if
    no member has one. An empty table gives no rows; other columns are ignored.

    1. Order by hash: rows whose longer prefix shares too little with all others are out.
       On usual text these are nearly all, whatever boilerplate they hold.
    2. Order by document frequency among the rest: sets that share a shingle of their
       prefix, which holds the rarest, form clusters; anything that links is in one cluster.
    3. Inside a cluster, block against block, candidates must also share prefix shingles
       under the order by hash and that by a second hash, and are then counted exactly.

    A cluster of any size is cut in blocks that are bounded in sets and in shingles, so no
    task holds it whole, and only links' trees, never pairs, leave a task.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sized = materialise(set_sizes(rows, size))
    classes = sized.where("n > 0").groupBy("sig").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"))
    alpha = -F.floor(F.col("n") * -percent / 100)
    extra = lambda n: F.greatest(F.lit(1), F.floor(n / 10))
    needed = F.least(extra(alpha), extra(F.col("n")))
    alive = materialise(
        classes.join(shared_in_prefix(rows, size, percent), "sig")
        .where(F.col("n_shared") >= needed).select("sig", "rep", "copies"))

    def sets(batches):
        for batch, found in _sets_of(batches, size):
            yield pa.RecordBatch.from_arrays([
                pa.array([signature(s) for s in found], pa.int64()),
                pa.array([len(s) for s in found], pa.int64()),
                pa.array([s.tobytes() for s in found], pa.binary()),
                pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))],
                names=["sig", "n", "shingles", "tokens"])

    lookup = _lookup(spark, alive.select("rep").distinct())
    texts = rows.join(lookup, rows["doc_id"].eqNullSafe(F.col("rep")), "left_semi")
    full = materialise(
        in_batches(texts, sets, "sig bigint, n bigint, shingles binary, tokens array<bigint>")
        .select("sig", "n", "shingles", "tokens").dropDuplicates(["sig"])
        .join(alive.select("sig", "copies"), "sig"))

    tokens = full.select("sig", "n", F.explode("tokens").alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("sig")
    ranked = tokens.join(common, "token").select(
        "sig", "n", "token", F.row_number().over(own.orderBy("df", "token")).alias("rank"),
        F.count("*").over(own).alias("shared"))
    # Shingles that no other set has come first in this order and fill the prefix.
    rare = materialise(ranked.where(
        F.col("n") - F.col("shared") + F.col("rank") <= F.col("n") - alpha + 1
    ).select("sig", "token"))
    least = rare.groupBy("token").agg(F.min("sig").alias("least"))
    trees = rare.join(least, "token").where("sig <> least").select(
        F.col("sig").alias("a"), F.col("least").alias("b")).distinct()
    clusters = components(trees).select(F.col("node").alias("sig"), F.col("component").alias("cluster"))

    prefix = rare.groupBy("sig").agg(F.sort_array(F.collect_list("token")).alias("rare"))
    members = materialise(full.select("sig", "n", "copies", "shingles").join(clusters, "sig")
                          .join(prefix, "sig"))
    blocks = members.groupBy("cluster").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    block = F.pmod(F.xxhash64("sig"), F.col("blocks"))
    # Every block meets itself and each later one; a cluster of one block comes once.
    meets = F.explode(F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda other: F.struct(F.least("block", other).alias("low"),
                               F.greatest("block", other).alias("high"))))
    bundles = 4 * parallelism(spark)
    placed = members.join(blocks, "cluster").withColumn("block", block).withColumn(
        "meet", meets).select(
        "sig", "cluster", "copies", "shingles", F.col("rare").alias("tokens"), "meet.low", "meet.high",
        F.when(F.col("block") == F.col("meet.low"), 0).otherwise(1).alias("side"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(bundles)))
        .otherwise(F.xxhash64("cluster")).alias("bundle"))
    packed = in_batches(
        placed, _pack_rare, "sig bigint, cluster bigint, copies bigint, shingles binary, "
        "rare binary, low bigint, high bigint, side int, bundle bigint")
    found = materialise(in_groups(
        packed.groupBy("bundle", "low", "high"), _verify(percent), "sig bigint, root bigint, links bigint"))

    reach = components(found.select(F.col("sig").alias("a"), F.col("root").alias("b")))
    degree = found.groupBy("sig").agg(F.sum("links").alias("links"))
    label = classes.select("sig", "rep", "copies").join(
        reach.withColumnRenamed("node", "sig"), "sig", "left").join(degree, "sig", "left").select(
        "sig", F.coalesce("component", "sig").alias("component"), "rep",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    label = materialise(label)
    smallest = label.groupBy("component").agg(F.min("rep").alias("least"))
    label = label.join(smallest, "component").select("sig", "least", "links")
    return sized.join(label, "sig", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def _pack_rare(batches):
    names = ["sig", "cluster", "copies", "shingles", "rare", "low", "high", "side", "bundle"]
    for batch in batches:
        rare = [np.array(x, np.int64).tobytes() for x in batch.column("tokens").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rare, pa.binary()) if n == "rare" else batch.column(n) for n in names], names)
