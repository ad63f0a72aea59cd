"""Ranked lexical search: term at a time, rarest first, with limited accumulators."""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscout.session import materialise

from .common import in_batches, slices

#: Text of one index segment; a longer document is a segment of its own.
SEGMENT_BYTES = 16 << 20
#: Distinct query terms that are sent to every task; beyond, the index holds all terms.
VOCABULARY_BYTES = 32 << 20
#: Terms of the items that are searched in one pass over the index.
BLOCK_TERMS = 2_000_000

_LETTERS = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz")
#: Lower-cases A-Z and turns ASCII that is neither letter nor digit into a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or b in _LETTERS else 32 for b in range(256))
_PIECE = 1 << 20


def terms_in(text: str | None):
    """Lists of the terms of a text, in order; long texts come in several lists.

    A term is a longest run of ASCII letters and digits and of all characters beyond ASCII; only
    A-Z are lower-cased.
    """
    data = (text or "").encode().translate(_TABLE)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + _PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


SEGMENT = ("ids array<bigint>, lengths array<bigint>, n_docs bigint, n_terms bigint, "
           "terms array<string>, starts array<bigint>, docs array<int>, counts array<int>")


class _Segment:
    """Postings of some documents while they are read."""

    def __init__(self):
        self.ids, self.lengths = [], []
        self.n_docs = self.n_terms = self.size = 0
        self.postings: dict[bytes, tuple[list, list]] = {}

    def add(self, key, text: str | None, vocabulary) -> None:
        counts: Counter = Counter()
        for terms in terms_in(text):
            counts.update(terms)
        length = counts.total()
        self.size += len(text or "")
        self.n_docs += length > 0
        self.n_terms += length
        shown = counts if vocabulary is None else counts.keys() & vocabulary
        if not shown:
            return
        place = len(self.ids)
        self.ids.append(key)
        self.lengths.append(length)
        for term in shown:
            docs, tf = self.postings.setdefault(term, ([], []))
            docs.append(place)
            tf.append(counts[term])

    def batch(self) -> pa.RecordBatch:
        terms = sorted(self.postings)
        lists = [self.postings[t] for t in terms]
        starts = np.cumsum([0, *(len(d) for d, _ in lists)])
        row = {
            "ids": pa.array([self.ids], pa.list_(pa.int64())),
            "lengths": pa.array([self.lengths], pa.list_(pa.int64())),
            "n_docs": pa.array([self.n_docs], pa.int64()),
            "n_terms": pa.array([self.n_terms], pa.int64()),
            "terms": pa.array([[t.decode() for t in terms]], pa.list_(pa.string())),
            "starts": pa.array([starts.tolist()], pa.list_(pa.int64())),
            "docs": pa.array([[d for docs, _ in lists for d in docs]], pa.list_(pa.int32())),
            "counts": pa.array([[c for _, tf in lists for c in tf]], pa.list_(pa.int32()))}
        return pa.RecordBatch.from_pydict(row)


def build_index(docs: DataFrame, vocabulary: set[bytes] | None = None, key: str = "doc_id",
                text: str = "text") -> DataFrame:
    """Inverted index of all documents, a row for each segment of about 16 MB of text.

    A segment holds its documents' keys and lengths, and for each term (of ``vocabulary``, if
    given) the list of documents with their counts. Lengths and totals count all terms. One pass,
    without a shuffle; no segment depends on another.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary)

    def work(batches):
        known = sent.value
        segment = _Segment()
        for batch in slices(batches, "text"):
            keys = batch.column("key").to_pylist()
            for k, t in zip(keys, batch.column("text").to_pylist(), strict=True):
                segment.add(k, t, known)
                if segment.size >= SEGMENT_BYTES:
                    yield segment.batch()
                    segment = _Segment()
        if segment.n_docs:
            yield segment.batch()

    shown = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return in_batches(shown, work, SEGMENT)


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, key, term): each item row's distinct terms."""
    numbered = items.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn(
        "item", F.monotonically_increasing_id())
    kind = numbered.schema["key"].dataType.simpleString()

    def work(batches):
        for batch in slices(batches, "text"):
            rows = []
            for item, k, t in zip(*(batch.column(c).to_pylist() for c in ("item", "key", "text")),
                                  strict=True):
                for term in sorted({t for terms in terms_in(t) for t in terms}):
                    rows.append((item, k, term.decode()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()),
                 pa.array([r[1] for r in rows], batch.schema.field("key").type),
                 pa.array([r[2] for r in rows], pa.string())], names=["item", "key", "term"])

    return in_batches(numbered, work, f"item bigint, key {kind}, term string")


class _Best:
    """The best documents of an item so far: scores, keys, with missing keys last on ties."""

    def __init__(self, most: int):
        self.most = most
        self.scores = np.zeros(0, np.int64)
        self.keys = np.zeros(0, np.int64)
        self.missing = np.zeros(0, bool)

    @property
    def least(self) -> int:
        """A score that a document needs to get in; ties may."""
        return int(self.scores[-1]) if len(self.scores) == self.most else 1

    def add(self, scores, keys, missing) -> None:
        scores = np.concatenate((self.scores, scores))
        keys = np.concatenate((self.keys, keys))
        missing = np.concatenate((self.missing, missing))
        order = np.lexsort((keys, missing, -scores))[:self.most]
        self.scores, self.keys, self.missing = scores[order], keys[order], missing[order]


def contributions(weights, counts, spread) -> np.ndarray:
    """w * ((10^9 * tf) div (1000 * tf + 20 * m)), in 64-bit integers."""
    return weights * (1_000_000_000 * counts // (1000 * counts + 20 * spread))


def spread_of(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m = 100 - 50 + (50 * n * N) div L of each document."""
    if len(lengths) and 50 * int(lengths.max()) * n_docs >= 1 << 63:
        return np.array([50 + 50 * int(n) * n_docs // n_terms for n in lengths], np.int64)
    return 50 + 50 * lengths * n_docs // n_terms


def search_item(order, starts, docs, gains, bounds, size: int, most: int,
                least: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a segment that may be among the best, with their exact scores.

    ``order`` lists the item's terms, rarest first. While the bounds of the terms to come can
    still lift a new document to the k-th best partial score (or to ``least``), its accumulator is
    created; afterwards the terms only update the accumulators that exist. A document without one
    cannot reach the k-th best score, the others' sums are complete.
    """
    partial = np.zeros(size, np.int64)
    made = np.zeros(size, bool)
    remaining = np.cumsum(bounds[order][::-1])[::-1].tolist() + [0]
    creating = True
    for i, t in enumerate(order.tolist()):
        places, gain = docs[starts[t]:starts[t + 1]], gains[starts[t]:starts[t + 1]]
        if creating and remaining[i] < least:
            creating = False
        if creating:
            partial[places] += gain
            made[places] = True
            # Only a k-th score above what is still to come would end the creation.
            if remaining[i + 1] < partial.max():
                some = partial[made]
                if len(some) >= most:
                    kth = int(np.partition(some, len(some) - most)[len(some) - most])
                    least = max(least, kth)
        else:
            alive = made[places]
            partial[places[alive]] += gain[alive]
    found = np.flatnonzero(made & (partial >= max(least, 1)))
    return found, partial[found]


def _search(index: DataFrame, terms: list[str], weights: np.ndarray, items: list[tuple[int, np.ndarray]],
            n_docs: int, n_terms: int, most: int) -> DataFrame:
    """(item, score, key): every task's best documents of each item."""
    sent = index.sparkSession.sparkContext.broadcast((terms, weights, items))

    def work(batches):
        terms, weights, items = sent.value
        known = {t: i for i, t in enumerate(terms)}
        best = {item: _Best(most) for item, _ in items}
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {c: batch.column(c)[row].values for c in (
                    "ids", "lengths", "terms", "starts", "docs", "counts")}
                missing = np.array(cell["ids"].is_null())
                keys = cell["ids"].fill_null(0).to_numpy()
                starts = cell["starts"].to_numpy()
                docs = cell["docs"].to_numpy()
                # Place of each wanted term in this segment, or -1.
                at = np.full(len(terms), -1)
                own = np.zeros(len(starts) - 1, np.int64)
                for place, term in enumerate(cell["terms"].to_pylist()):
                    wanted = known.get(term, -1)
                    if wanted >= 0:
                        at[wanted] = place
                        own[place] = weights[wanted]
                if not len(docs):
                    continue
                spread = spread_of(cell["lengths"].to_numpy(), n_docs, n_terms)
                gains = contributions(
                    np.repeat(own, np.diff(starts)), cell["counts"].to_numpy().astype(np.int64),
                    spread[docs])
                bounds = np.maximum.reduceat(gains, starts[:-1])
                for item, wanted in items:
                    order = at[wanted]
                    order = order[order >= 0]
                    if len(order):
                        found, scores = search_item(order, starts, docs, gains, bounds, len(keys),
                                                    most, best[item].least)
                        best[item].add(scores, keys[found], missing[found])
        for item, b in best.items():
            if len(b.scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(b.scores), item)), pa.array(b.scores),
                     pa.array(b.keys, mask=b.missing)], names=["item", "score", "key"])

    return in_batches(index, work, "item bigint, score bigint, key bigint")


def search(docs: DataFrame, items: DataFrame, most: int = 50, key: str = "doc_id",
           text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``most`` best documents of each item with a score above 0.

    Scores are integers: each of an item's terms, once, gives w * ((10^9 tf) div (1000 tf + 20 m)) with
    w = floor(1000 ln((2N+2)/(2df+1))) and m = 50 + (50 n N) div L. Equal scores are ranked by the
    key, missing keys last; equal keys are rows of their own. A null or empty text has no terms,
    an item without terms or hits has no rows, items with equal keys are answered one by one.

    The documents' index is written segment by segment; frequencies are sums over the segments.
    Items go to the tasks in blocks of a bounded number of terms; a block is one pass over the
    index, in which a task carries each item's best scores from segment to segment as the bar
    for new accumulators. What a task sends is ``most`` rows an item at most.
    """
    spark = docs.sparkSession
    asked = materialise(item_terms(items, item_key, item_text))
    keys = asked.schema["key"].dataType.simpleString()
    words = materialise(asked.select("term").distinct())
    size = words.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    vocabulary = None
    if size <= VOCABULARY_BYTES:
        vocabulary = {r["term"].encode() for r in words.collect()}
    index = materialise(build_index(docs, vocabulary, key, text))
    total = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    schema = f"{item_key} {keys}, rank int, {key} bigint, score bigint"
    if not total["l"] or not size:
        return spark.createDataFrame([], schema)
    frequencies = index.select("starts", F.posexplode("terms").alias("at", "term")).select(
        "term", F.expr("element_at(starts, at + 2) - element_at(starts, at + 1)").alias("df")).groupBy(
        "term").agg(F.sum("df").alias("df"))
    ranked = materialise(asked.join(frequencies, "term").select("item", "term", "df"))
    n_refs = ranked.count()
    blocks = max(1, math.ceil(n_refs / BLOCK_TERMS))
    found = []
    for block in range(blocks):
        mine = ranked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        df = {r["term"]: r["df"] for r in mine}
        # Rarest first, in one order for all items.
        terms = sorted(df, key=lambda t: (df[t], t))
        place = {t: i for i, t in enumerate(terms)}
        weights = np.array([math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * df[t] + 1)))
                            for t in terms], np.int64)
        own: dict[int, list[int]] = {}
        for r in mine:
            own.setdefault(r["item"], []).append(place[r["term"]])
        wanted = [(item, np.sort(np.array(t))) for item, t in sorted(own.items())]
        if wanted:
            found.append(_search(index, terms, weights, wanted, total["n"], total["l"], most))
    if not found:
        return spark.createDataFrame([], schema)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("key").asc_nulls_last())
    best = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= most)
    named = asked.select("item", F.col("key").alias("item_key")).distinct()
    return best.join(named, "item").select(
        F.col("item_key").alias(item_key), F.col("rank"), F.col("key").alias(key), "score")
