"""Benchmark decontamination by latent semantic retrieval and exact sequence checks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscout.session import materialise

from .common import in_batches, parallelism, slices
from .words import words

#: Characters of benchmark text that one pass over the documents takes as queries.
BLOCK_CHARACTERS = 8_000_000
#: Words of a passage, and the step from passage to passage.
PASSAGE, STEP = 48, 16
#: Longest piece of an item, words of a passage and step from passage to passage: every piece
#: lies whole in some passage of the first line that takes it.
WINDOWS = ((5, 8, 4), (9, 16, 8), (17, 24, 8), (33, PASSAGE, STEP))
PIECE = 32
#: A passage that holds this share of a piece's length is a candidate at any cosine.
LEAST_PART = 0.6
#: Bytes of a part of the sums that the latent space is fitted from.
PART_BYTES = 1 << 20


@dataclass
class Queries:
    """The benchmark items of a block as word hashes, with their vocabulary."""

    ids: list
    items: list[np.ndarray]
    answers: list[int]  # words of the last sentence
    vocabulary: np.ndarray  # ascending

    def features(self, hashes: np.ndarray) -> np.ndarray:
        """Place in the vocabulary, or its size for other words."""
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        at[self.vocabulary[at] != hashes] = len(self.vocabulary)
        return at


def queries_of(rows: list[tuple]) -> Queries:
    ids, items, answers = [], [], []
    for name, text in rows:
        text = text or ""
        own, _ = words([text.lower().encode()], marks=True)
        if len(own):
            ids.append(name)
            items.append(own)
            last = text.rstrip().rstrip(".!?").replace("\n", ". ").rpartition(". ")[2]
            tail, _ = words([last.lower().encode()], marks=True)
            answers.append(max(1, min(len(tail), len(own))))
    known = np.unique(np.concatenate(items)) if items else np.zeros(0, np.uint64)
    return Queries(ids, items, answers, known)


def pieces_of(queries: Queries) -> tuple[list[np.ndarray], np.ndarray]:
    """The items cut into even pieces of at most `PIECE` words, and the item of each piece."""
    cut = [np.array_split(item, -(-len(item) // PIECE)) for item in queries.items]
    return [p for parts in cut for p in parts], np.repeat(np.arange(len(cut)), [len(c) for c in cut])


def encoded(docs: DataFrame, queries: Queries) -> DataFrame:
    """(doc_id, words): every row's words as places in the vocabulary, 32 bits each."""
    def encode(batches):
        for batch in slices(batches, "text", 2 << 20):
            hashes, stops = words([(t or "").lower().encode() for t in batch.column("text").to_pylist()], True)
            parts = np.split(queries.features(hashes).astype(np.int32), stops[:-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([p.tobytes() for p in parts], pa.binary())],
                names=["doc_id", "words"])

    return in_batches(docs, encode, "doc_id bigint, words binary")


def _coded(batches, most=2 << 20):
    for batch in slices(batches, "words", most):
        parts = batch.column("words").to_pylist()
        stops = np.cumsum([len(p) // 4 for p in parts])
        yield batch, np.frombuffer(b"".join(parts), np.int32), stops


def document_frequencies(docs: DataFrame, queries: Queries) -> tuple[np.ndarray, int]:
    """In how many documents each word of the vocabulary occurs, and the number of documents.

    Every task sends one count per word at most; the sums are as many as the vocabulary.
    """
    size = len(queries.vocabulary)

    def count(batches):
        total, seen = np.zeros(size + 1, np.int64), 0
        for batch, at, stops in _coded(batches):
            doc = np.repeat(np.arange(len(stops)), np.diff(stops, prepend=0))
            pairs = np.unique(doc[at < size] * np.int64(size + 1) + at[at < size])
            total += np.bincount(pairs % (size + 1), minlength=size + 1)
            seen += batch.num_rows
        found = np.append(np.flatnonzero(total), -1)
        yield pa.RecordBatch.from_arrays([
            pa.array(found, pa.int64()), pa.array(np.append(total[found[:-1]], seen), pa.int64())],
            names=["word", "docs"])

    sums = in_batches(docs, count, "word bigint, docs bigint").groupBy("word").agg(
        F.sum("docs").alias("docs")).collect()
    df, n = np.zeros(size + 1, np.int64), 0
    for r in sums:
        if r["word"] < 0:
            n = r["docs"]
        else:
            df[r["word"]] = r["docs"]
    return df, n


def idf_weights(df: np.ndarray, n: int, most_share: float = 0.1) -> np.ndarray:
    """Inverse document frequency; words in more than a share of all documents weigh nothing,
    nor does the place for words that no item has."""
    idf = np.log((n + 1) / (df + 1.0))
    idf[df > max(most_share * n, 10)] = 0
    idf[-1] = 0
    return idf.astype(np.float32)


def _sums(table: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the table's rows ``at``, from each start to the next; some starts may be equal.

    The k-th rows of all sums are added at a time, the longest sums first.
    """
    n = np.diff(starts, append=len(at))
    order = np.argsort(-n, kind="stable")
    n, begin = n[order], starts[order]
    sums = np.zeros((len(starts), table.shape[1]), table.dtype)
    for k in range(n[0] if len(n) else 0):
        live = np.searchsorted(-n, -k)
        sums[:live] += table[at[begin[:live] + k]]
    out = np.empty_like(sums)
    out[order] = sums
    return out


def latent_basis(docs: DataFrame, queries: Queries, idf: np.ndarray, rank: int = 256,
                 seed: int = 11) -> np.ndarray:
    """Right singular vectors of the TF-IDF passages, (vocabulary + 1) x rank.

    Randomised SVD in one pass: each task multiplies its passages with a random matrix and
    their transpose with the outcome, the sums give the Nystroem form of A'A, whose leading
    eigenvectors are wanted. The passages are all those of all documents, and the items
    themselves, scaled to weigh four times as much as all the passages. The sums of the tasks are
    folded in parts before the driver gets one of each.
    """
    width = min(rank + 16, len(queries.vocabulary))
    omega = np.random.default_rng(seed).standard_normal((len(idf), width)).astype(np.float32)
    weighted = omega * idf[:, None]

    def passages(at, starts):
        """A'(A omega) of passages given as feature numbers and the first word of each."""
        seen = np.flatnonzero(idf[at] > 0)
        at, starts = at[seen], np.searchsorted(seen, starts)
        y = _sums(weighted, at, starts)
        owner = np.searchsorted(starts, np.arange(len(at)), "right") - 1
        order = np.argsort(at, kind="stable")
        out = np.zeros((len(idf), width), np.float64)
        if len(at):
            first = np.flatnonzero(np.diff(at[order], prepend=-1))
            rows = at[order][first]
            out[rows] = np.add.reduceat(y[owner[order]], first, axis=0) * idf[rows][:, None]
        return out

    def sketch(batches):
        total, n = np.zeros((len(idf), width), np.float64), 0
        for _, at, stops in _coded(batches, 1 << 20):
            starts = np.concatenate([
                np.arange(low, high, PASSAGE) for low, high in zip([0, *stops[:-1]], stops, strict=True)
            ] or [np.zeros(0, np.int64)])
            total += passages(at, starts.astype(np.int64))
            n += len(starts)
        if n:
            yield from sent({k: total[low:low + part] for k, low in enumerate(range(0, len(idf), part))}, n)

    def sent(sums, n):
        for k, values in sums.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([k], pa.int32()), pa.array([n if k == 0 else 0], pa.int64()),
                pa.array([values.astype(np.float32).tobytes()], pa.binary())], names=["part", "n", "sums"])

    def fold(batches):
        sums, n = {}, 0
        for batch in batches:
            for k, more, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = np.frombuffer(values, np.float32)
                sums[k] = sums[k] + values if k in sums else values.astype(np.float64)
                n += more
        yield from sent(sums, n)

    schema = "part int, n bigint, sums binary"
    part = max(1, PART_BYTES // (4 * width))
    spread = parallelism(docs.sparkSession)
    sums = in_batches(in_batches(docs.coalesce(spread), sketch, schema).repartition(spread, "part"), fold, schema)
    items = np.concatenate([queries.features(i) for i in queries.items])
    begins = np.cumsum([0, *[len(i) for i in queries.items[:-1]]])
    own = passages(items, begins)
    total, n = np.zeros_like(own), 0
    for r in sums.toLocalIterator():
        low = r["part"] * part
        total[low:low + part] += np.frombuffer(r["sums"], np.float32).reshape(-1, width)
        n += r["n"]
    total += own * max(1.0, 4 * n / len(queries.items))
    core = omega.T.astype(np.float64) @ total
    core = (core + core.T) / 2
    values, vectors = np.linalg.eigh(core)
    good = values > values.max(initial=0) * 1e-9
    if not good.any():
        return np.zeros((len(idf), 1), np.float32)
    half = total @ (vectors[:, good] / np.sqrt(values[good]))
    u, _, _ = np.linalg.svd(half, full_matrices=False)
    return u[:, :rank].astype(np.float32)


def common_subsequence(item_masks: dict, length: int, text: np.ndarray) -> int:
    """Length of the longest common subsequence, 64 words and more at a time as bits."""
    full = (1 << length) - 1
    row = full
    get = item_masks.get
    for word in text.tolist():
        m = get(word)
        if m:
            hit = row & m
            row = (row + hit | row - hit) & full
    return length - row.bit_count()


def _masks(item: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, word in enumerate(item.tolist()):
        out[word] = out.get(word, 0) | 1 << i
    return out


def most_common(words: list[tuple], at: np.ndarray, item: np.ndarray, low: np.ndarray,
                high: np.ndarray) -> np.ndarray:
    """The most words that each span of a text can share with its item, whatever their order.

    ``words`` are each item's distinct words and their counts. A word counts as often as both
    have it, so no common subsequence is longer.
    """
    n = len(at) + 1
    places = np.sort(at * np.int64(n) + np.arange(len(at)))
    out = np.zeros(len(item), np.int64)
    order = np.lexsort((low, item))
    edges = np.flatnonzero(np.diff(item[order], prepend=-1))
    for members in np.split(order, edges[1:]) if len(order) else ():
        own, counts = words[item[members[0]]]
        base = own[:, None] * np.int64(n)
        for some in np.array_split(members, len(members) // 4096 + 1):
            there = np.searchsorted(places, base + high[some]) - np.searchsorted(places, base + low[some])
            out[some] = np.minimum(there, counts[:, None]).sum(0)
    return out


def _search(docs: DataFrame, queries: Queries, idf: np.ndarray, basis: np.ndarray,
            least_cosine: float, least_match: float, paraphrase: float) -> DataFrame:
    latent = idf[:, None] * basis
    items = [queries.features(i) for i in queries.items]
    pieces, owner = pieces_of(queries)
    pieces = [queries.features(p) for p in pieces]
    vectors = np.array([latent[p].sum(0) for p in pieces])
    norms = np.linalg.norm(vectors, axis=1)
    unit = vectors / np.maximum(norms, 1e-12)[:, None]
    lengths = np.array([len(p) for p in pieces])
    # Items of nothing but common words have no latent vector; their words are looked for
    # by the same sequence check in every passage.
    blank = np.setdiff1d(np.arange(len(items)), owner[norms > 1e-6])
    # At the least match some piece lacks no more than that share of its words, so it shows at
    # least so many weighty ones; a passage with fewer shows no piece.
    shown = np.array([max(1, int((idf[p] > 0).sum()) - int((1 - min(least_match, paraphrase)) * len(p) + 1e-9))
                      for p in pieces])
    lines, shorter = [], 0
    for longest, size, step in WINDOWS:
        own = np.flatnonzero((lengths > shorter) & (lengths <= longest) & (norms > 1e-6))
        shorter = longest
        if len(own):
            # Of an item's pieces any may be the one that shows.
            least = min(shown[np.isin(owner, owner[own]) & (norms > 1e-6)])
            lines.append((size, step, own, least))

    floor = min(least_match, paraphrase)
    sizes = np.array([len(i) for i in items])
    counted = [np.unique(i, return_counts=True) for i in items]

    def find(batches):
        masks = [_masks(i) for i in items]
        tails = [_masks(i[-a:]) for i, a in zip(items, queries.answers, strict=True)]
        for batch, at, stops in _coded(batches, 1 << 20):
            names, out = batch.column("doc_id").to_pylist(), {}
            low_of = np.append(0, stops[:-1])
            heavy = np.flatnonzero(idf[at] > 0)
            pairs = []

            def passages(size, step):
                """Document, first word and end of each passage."""
                n = -(-(stops - low_of) // step)
                doc = np.repeat(np.arange(len(names)), n)
                begin = low_of[doc] + step * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
                return doc, begin, np.minimum(begin + size, stops[doc])

            for size, step, own, least in lines:
                doc, begin, end = passages(size, step)
                first, last = np.searchsorted(heavy, begin), np.searchsorted(heavy, end)
                strong = np.flatnonzero(last - first >= least)
                for some in np.array_split(strong, len(strong) // 2048 + 1):
                    if not len(some):
                        continue
                    n = last[some] - first[some]
                    ahead = np.cumsum(n) - n
                    words_of = heavy[np.repeat(first[some] - ahead, n) + np.arange(n.sum())]
                    sums = _sums(latent, at[words_of], ahead)
                    shared = sums @ unit[own].T
                    i, j = np.nonzero(
                        (shared >= least_cosine * np.maximum(np.linalg.norm(sums, axis=1), 1e-6)[:, None])
                        | (shared >= LEAST_PART * norms[own][None, :]))
                    i = some[i]
                    pairs.append((doc[i], owner[own[j]], begin[i], end[i]))
            if len(blank):
                places = passages(PASSAGE, STEP)
                pairs += [(places[0], np.full(len(places[0]), j), *places[1:]) for j in blank.tolist()]
            doc, item, begin, end = (np.concatenate(c) for c in zip(*pairs)) if pairs else [np.zeros(0, int)] * 4
            reach = sizes[item] + PASSAGE
            begin, end = np.maximum(low_of[doc], begin - reach), np.minimum(stops[doc], end + reach)
            doc, item, begin, end = np.unique(np.stack((doc, item, begin, end)), axis=1)
            # Words out of order only raise the count: what falls short here cannot match.
            near = most_common(counted, at, item, begin, end) >= floor * sizes[item] - 1e-6
            for d, j, low, high in zip(*(x[near].tolist() for x in (doc, item, begin, end)), strict=True):
                best = out.get((d, j), (0.0, 0.0))
                if best[0] >= 1:
                    continue
                text, own = at[low:high], counted[j][0]
                text = text[own[np.minimum(np.searchsorted(own, text), len(own) - 1)] == text]
                match = common_subsequence(masks[j], len(items[j]), text) / len(items[j])
                if match >= best[0]:
                    n = queries.answers[j]
                    out[d, j] = max(best, (match, common_subsequence(tails[j], n, text) / n))
            hits = [(names[d], queries.ids[j], m, a) for (d, j), (m, a) in out.items()
                    if m >= least_match or m >= paraphrase and a >= least_match]
            yield pa.RecordBatch.from_arrays([
                pa.array([h[k] for h in hits], t) for k, t in enumerate(
                    [pa.int64(), pa.int64(), pa.float64(), pa.float64()])],
                names=["doc_id", "item_id", "match", "answer_match"])

    return in_batches(docs, find, "doc_id bigint, item_id bigint, match double, answer_match double")


def leaks(docs: DataFrame, benchmark: DataFrame, least_cosine: float = 0.4,
          least_match: float = 0.8, paraphrase: float = 0.65, rank: int = 256,
          key: str = "doc_id", text: str = "text", item_key: str = "item_id",
          item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, match, answer_match): each document and benchmark item it leaks.

    Texts are lower-cased; words end at ASCII white space and punctuation. Items are cut
    into even pieces of at most 32 words. Passages of 8, 16, 24 or 48 words, so that a piece
    lies whole in one and fills a good part of it, and the pieces become TF-IDF vectors over the
    items' words, with document frequencies over all documents, and are compared in the
    latent space of a randomised SVD: a document and an item are a candidate where the passage has
    the cosine with any piece, or 0.6 of the piece's length along it. For each candidate,
    ``match`` is the longest common
    word subsequence of item and surroundings as a share of the item. A document leaks an item
    at ``least_match``, or from ``paraphrase`` on if the item's last sentence, its answer, is
    found at ``least_match`` too.

    Null and empty documents and items leak nothing. Repeated rows give repeated results,
    equal items each their own. An empty table on either side gives no rows. The items are
    queries in blocks of bounded text; each block is one search over all documents.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    asked = benchmark.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    spark = docs.sparkSession
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks, found = -(-size // BLOCK_CHARACTERS), None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        queries = queries_of([(r["item_id"], r["text"]) for r in part.collect()])
        if not queries.items:
            continue
        coded = materialise(encoded(rows, queries))
        df, n = document_frequencies(coded, queries)
        idf = idf_weights(df, n)
        basis = latent_basis(coded, queries, idf, rank)
        here = _search(coded, queries, idf, basis, least_cosine, least_match, paraphrase)
        found = here if found is None else found.union(here)
    if found is None:
        return spark.createDataFrame(
            [], "doc_id bigint, item_id bigint, match double, answer_match double")
    return found
