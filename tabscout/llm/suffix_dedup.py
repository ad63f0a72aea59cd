"""Removal of repeated long substrings with a sparse suffix array over all documents.

A full suffix array holds a suffix for every byte. Here suffixes start only at anchors: the
place in each window of ``length`` bytes whose ``GRAM`` bytes have the least hash. Equal windows
have their anchor at the same offset, so every repeat is seen from its anchors. Anchors
whose neighbourhood is unique, or equal as a whole to an earlier one, are settled by hashes;
the suffixes of the rest are sorted into front-coded runs, exchanged, and merged by loser trees.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscout.session import materialise, ship_package

from .common import in_batches, parallelism, slices
from .words import _BASE, _BYTES, _powers, mixed

#: Bytes that an anchor is chosen by, a power of two.
GRAM = 32
#: Bytes that are looked at together.
SLICE = 1 << 20
#: Contexts around one anchor that a task sorts and merges; of more, windows are grouped by digest.
MANY_CONTEXTS = 4096
#: Open suffixes of a bucket, about.
BUCKET_SUFFIXES = 50_000
#: Suffixes of very frequent anchors whose windows a bucket holds, about.
HOT_SUFFIXES = 10_000
_FIRST = -(1 << 63)


def window_runs(data: np.ndarray, valid: np.ndarray, length: int):
    """Runs of windows with a common anchor: (first, last, anchor, anchor hash, run hash).

    ``valid`` tells which of the len(data) - length + 1 windows exist. The run hash covers
    all bytes of the run's windows.
    """
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if len(data) < length or not valid.any():
        return none
    codes = _BYTES[data]
    h, span, factor = codes, 1, int(_BASE)
    while span < GRAM:
        h = h[:-span] * np.uint64(factor) + h[span:]
        factor = factor * factor % (1 << 64)
        span *= 2
    h = mixed(h)
    # The place in the low bits makes the leftmost of equal hashes the least.
    bits = max(1, int(len(h) - 1).bit_length())
    low = np.uint64((1 << bits) - 1)
    m = h & ~low | np.arange(len(h), dtype=np.uint64)
    width, span = length - GRAM + 1, 1
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[:len(m) - (width - span)], m[width - span:])
    anchor = (m & low).astype(np.int64)
    change = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
    first = np.append(0, np.flatnonzero(change) + 1)
    last = np.append(first[1:] - 1, len(anchor) - 1)
    keep = valid[first]
    first, last = first[keep], last[keep]
    anchor = anchor[first]
    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes * power[:len(data)], out=sums[1:])
    run = (sums[last + length] - sums[first]) * inverse[first] + (last - first).astype(np.uint64)
    return first, last, anchor, h[anchor], mixed(run)


def _packed(first, last, anchor, kind):
    """First window, number of windows after it, anchor from it, and a flag, in one integer."""
    return first << 17 | (last - first) << 9 | (anchor - first) << 1 | kind


def _unpacked(mark):
    first = mark >> 17
    return first, first + (mark >> 9 & 255), first + (mark >> 1 & 255), mark & 1


def _documents(batch, length):
    """Distinct documents of a batch in order, then their runs with the document's number."""
    names = batch.column("doc_id").to_pylist()
    rows = batch.column("row").to_pylist()
    texts = batch.column("text").to_pylist()
    order = sorted({r: i for i, r in enumerate(rows)}.values(),
                   key=lambda i: (_FIRST if names[i] is None else names[i], rows[i]))
    ids = np.array([_FIRST if names[i] is None else names[i] for i in order], np.int64)
    keys = np.array([rows[i] for i in order], np.int64)
    datas = [(texts[i] or "").encode() for i in order]
    lengths = np.array([len(d) for d in datas], np.int64)
    begins = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(datas), np.uint8)
    found = [[] for _ in range(5)]
    for low in range(0, max(1, len(data) - length + 1), SLICE):
        part = data[low:low + SLICE + length - 1]
        n = len(part) - length + 1
        if n <= 0:
            break
        edge = np.zeros(n + 1, np.int32)
        inside = lengths >= length
        np.add.at(edge, np.clip(begins[inside] - low, 0, n), 1)
        np.add.at(edge, np.clip(begins[inside] + lengths[inside] - length + 1 - low, 0, n), -1)
        runs = window_runs(part, np.cumsum(edge[:-1]) > 0, length)
        for column, value, shift in zip(found, runs, (low, low, low, None, None), strict=True):
            column.append(value if shift is None else value + shift)
    first, last, anchor, h, run = (
        np.concatenate(c) if c else np.zeros(0, np.int64) for c in found)
    doc = np.searchsorted(begins, first, "right") - 1
    # Empty documents share their begin with the next one; take the one with bytes.
    return ids, keys, doc, first - begins[doc], last - begins[doc], anchor - begins[doc], h, run


_BLOB = "bucket int, checks binary, runs binary, marks binary, docs binary, rows binary"


def _anchor_marks(docs: DataFrame, length: int) -> DataFrame:
    """(row, mark, anchor): runs whose windows all occur earlier (flag 0), and the first run of each
    kind that shares its anchor with another kind (flag 1), with part of its anchor's hash."""
    buckets = parallelism(docs.sparkSession)

    def deal(batches):
        for batch in slices(batches, "text", SLICE):
            ids, keys, doc, first, last, anchor, h, run = _documents(batch, length)
            if not len(first):
                continue
            h, run = h.astype(np.uint64), run.astype(np.uint64)
            marks = _packed(first, last, anchor, 0)
            order = np.lexsort((run, h))
            new = np.append(True, (h[order][1:] != h[order][:-1]) | (run[order][1:] != run[order][:-1]))
            # What repeats inside the batch is settled here and needs no comparison.
            later = np.zeros(len(h), bool)
            later[order[~new]] = True
            # A settled run goes to a bucket of its document, so no passage gathers them.
            bucket = np.where(later, keys[doc].astype(np.uint64), h) % np.uint64(buckets)
            checks = (h >> np.uint64(32)).astype(np.uint32)
            group = bucket.astype(np.int64) * 2 + later
            order = np.argsort(group, kind="stable")
            edges = np.searchsorted(group[order], np.arange(2 * buckets + 1))
            out = [[] for _ in range(6)]
            for g in range(2 * buckets):
                at = order[edges[g]:edges[g + 1]]
                if len(at):
                    settled = g % 2
                    values = (g // 2, b"" if settled else checks[at].tobytes(),
                              b"" if settled else run[at].tobytes(), marks[at].tobytes(),
                              ids[doc[at]].tobytes(), keys[doc[at]].tobytes())
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(out)],
                ["bucket", "checks", "runs", "marks", "docs", "rows"])

    def merge(table):
        settled = [c == b"" for c in table.column("checks").to_pylist()]
        read = lambda name, kind, done: np.frombuffer(b"".join(
            x for x, s in zip(table.column(name).to_pylist(), settled, strict=True) if s == done), kind)
        rows, marks = [read("rows", np.int64, True)], [read("marks", np.int64, True)]
        anchors = [np.zeros(len(rows[0]), np.int64)]
        checks, runs = read("checks", np.uint32, False), read("runs", np.uint64, False)
        mark, doc = read("marks", np.int64, False), read("docs", np.int64, False)
        row = read("rows", np.int64, False)
        if len(checks):
            order = np.lexsort((mark, row, doc, runs, checks))
            checks, runs, mark, row = checks[order], runs[order], mark[order], row[order]
            anchor = np.append(True, checks[1:] != checks[:-1])
            kind = anchor | np.append(True, runs[1:] != runs[:-1])
            # The same document in another batch is no repeat.
            same = ~kind & np.append(False, (row[1:] == row[:-1]) & (mark[1:] == mark[:-1]))
            group = np.cumsum(anchor) - 1
            mixed_group = np.bincount(group, weights=kind) > 1
            later = ~kind & ~same
            rows.append(row[later])
            marks.append(mark[later])
            anchors.append(np.zeros(np.count_nonzero(later), np.int64))
            open_ = kind & mixed_group[group]
            rows.append(row[open_])
            marks.append(mark[open_] | 1)
            anchors.append(checks[open_].astype(np.int64))
        return pa.table({"row": pa.array(np.concatenate(rows), pa.int64()),
                         "mark": pa.array(np.concatenate(marks), pa.int64()),
                         "anchor": pa.array(np.concatenate(anchors), pa.int64())})

    return in_batches(docs, deal, _BLOB).groupBy("bucket").applyInArrow(
        merge, "row bigint, mark bigint, anchor bigint")


def front_coded(strings: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Ascending strings as (common prefix lengths, rest lengths, rests), all under 256 long."""
    common, rest, tails, before = bytearray(), bytearray(), [], b""
    for s in strings:
        n, most = 0, min(len(s), len(before))
        if s[:most] == before[:most]:
            n = most
        else:
            high = most
            while n < high:
                mid = (n + high + 1) // 2
                if s[:mid] == before[:mid]:
                    n = mid
                else:
                    high = mid - 1
        common.append(n)
        rest.append(len(s) - n)
        tails.append(s[n:])
        before = s
    return bytes(common), bytes(rest), b"".join(tails)


def unfolded(common: bytes, rest: bytes, tails: bytes):
    """(string, prefix shared with the one before) in order."""
    at, before = 0, b""
    for n, m in zip(common, rest, strict=True):
        before = before[:n] + tails[at:at + m]
        at += m
        yield before, n


def merge_runs(runs: list):
    """Merge sorted (string, common prefix, payload) iterators: a loser tree over prefixes.

    Every waiting string carries the length of the prefix it shares with the last winner.
    Of two strings the one that shares more is the smaller; only on a tie are bytes compared, and
    those from the shared prefix on. Yields (string, prefix shared with the one before, payload).
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads = [next(r, None) for r in runs] + [None] * (k - len(runs))
    shared = [0] * k

    def play(a, b):
        """(winner, loser); the loser's shared prefix becomes that with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (a, b) if y is None else (b, a)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        n, s, t = shared[a], x[0], y[0]
        most = min(len(s), len(t))
        while n < most and s[n] == t[n]:
            n += 1
        if n < most and s[n] > t[n] or n == most and len(s) > len(t):
            a, b = b, a
        shared[b] = n
        return a, b

    losers = [0] * k

    def start(node):
        if node >= k:
            return node - k
        winner, losers[node] = play(start(2 * node), start(2 * node + 1))
        return winner

    top = start(1)
    while heads[top] is not None:
        string, _, payload = heads[top]
        yield string, shared[top], payload
        heads[top] = next(runs[top], None)
        if heads[top] is not None:
            shared[top] = heads[top][1]
        node = (top + k) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def _suffix_runs(batches, length, buckets):
    """Front-coded runs of the open suffixes, one for each bucket and batch."""
    for batch in slices(batches, "text", 4 << 20):
        dealt: dict[int, list] = {}
        for doc, row, text, marks in zip(*(batch.column(c).to_pylist() for c in (
                "doc_id", "row", "text", "marks")), strict=True):
            data, doc = (text or "").encode(), _FIRST if doc is None else doc
            for mark in marks:
                first, last, anchor, _ = _unpacked(mark)
                right = data[anchor:last + length]
                bucket = zlib.crc32(right[:GRAM]) % buckets
                dealt.setdefault(bucket, []).append((right, data[first:anchor], doc, row, mark))
        out = [[] for _ in range(8)]
        for bucket, items in dealt.items():
            items.sort(key=lambda x: x[0])
            ints = [np.array([x[i] for x in items], np.int64).tobytes() for i in (2, 3, 4)]
            values = (bucket, *front_coded([x[0] for x in items]), b"".join(x[1] for x in items), *ints)
            for column, value in zip(out, values, strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(out)],
            ["bucket", "common", "rest", "tails", "lefts", "docs", "rows", "marks"])


def _run(record):
    """A run as an iterator of (suffix, common prefix, (left part, document, row, mark))."""
    ints = [np.frombuffer(record[c], np.int64).tolist() for c in ("docs", "rows", "marks")]
    at, lefts = 0, record["lefts"]
    strings = unfolded(record["common"], record["rest"], record["tails"])
    for (string, n), doc, row, mark in zip(strings, *ints, strict=True):
        size = mark >> 1 & 255
        yield string, n, (lefts[at:at + size], doc, row, mark)
        at += size


def _earlier_windows(group, length):
    """(row, mark) of the windows in a group of suffixes that another one has earlier."""
    # The longest prefix shared with a neighbour bounds how little of a repeated window
    # may lie left of the anchor.
    seen: dict[bytes, tuple] = {}
    probes = []
    for i, (right, shared, (left, doc, row, mark)) in enumerate(group):
        near = max(shared if i else 0, group[i + 1][1] if i + 1 < len(group) else 0)
        first, last, anchor, _ = _unpacked(mark)
        whole = left + right
        stop = min(last, anchor - (length - near))
        for start in range(first, stop + 1):
            window = whole[start - first:start - first + length]
            place = (doc, row, start)
            probes.append((window, place))
            if window not in seen or place < seen[window]:
                seen[window] = place
    for window, place in probes:
        if seen[window] < place:
            yield place[1], _packed(place[2], place[2], place[2], 0)


def _merge_bucket(length):
    def merge(table):
        rows, marks, group = [], [], []

        def settle():
            if len(group) > 1:
                for row, mark in _earlier_windows(group, length):
                    rows.append(row)
                    marks.append(mark)
            group.clear()

        for item in merge_runs([_run(r) for r in table.to_pylist()]):
            if item[1] < GRAM:
                settle()
            group.append(item)
        settle()
        return pa.table({"row": pa.array(rows, pa.int64()), "mark": pa.array(marks, pa.int64())})

    return merge


def _hot_marks(rows: DataFrame, marked: DataFrame, length: int, buckets: int) -> DataFrame:
    """(row, mark) of the windows of very frequent anchors that another one has earlier.

    A window is known by a 128-bit digest and dealt by it, so a bucket holds windows of many anchors
    and no task an anchor's contexts. Of equal windows in a batch only the earliest is compared; the
    others are settled and go to a bucket of their document, so that no passage gathers them.
    """
    def deal(batches):
        for batch in slices(batches, "text", SLICE):
            digests, places = [], []
            for doc, row, text, marks in zip(*(batch.column(c).to_pylist() for c in (
                    "doc_id", "row", "text", "marks")), strict=True):
                data, doc = (text or "").encode(), _FIRST if doc is None else doc
                for mark in marks:
                    first, last, _, _ = _unpacked(mark)
                    for start in range(first, last + 1):
                        digests.append(hashlib.blake2b(data[start:start + length], digest_size=16).digest())
                        places.append((doc, row, start))
            if not places:
                continue
            high, low = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2).T
            doc, row, start = np.array(places, np.int64).T
            later = _later(high, low, doc, row, start)
            group = (np.where(later, row.view(np.uint64), high) % np.uint64(buckets)).astype(np.int64) * 2 + later
            order = np.argsort(group, kind="stable")
            edges = np.flatnonzero(np.diff(group[order], prepend=-1))
            out = [[] for _ in range(6)]
            for at in np.split(order, edges[1:]):
                settled = later[at[0]]
                values = (group[at[0]] // 2, *(
                    b"" if settled and k < 3 else c[at].tobytes()
                    for k, c in enumerate((high, low, doc, row, start))))
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(out)],
                ["bucket", "highs", "lows", "docs", "rows", "starts"])

    def merge(table):
        settled = [c == b"" for c in table.column("docs").to_pylist()]
        read = lambda name, kind, done: np.frombuffer(b"".join(
            x for x, s in zip(table.column(name).to_pylist(), settled, strict=True) if s == done), kind)
        row, start = read("rows", np.int64, False), read("starts", np.int64, False)
        later = _later(read("highs", np.uint64, False), read("lows", np.uint64, False),
                       read("docs", np.int64, False), row, start)
        start = np.append(read("starts", np.int64, True), start[later])
        return pa.table({"row": pa.array(np.append(read("rows", np.int64, True), row[later]), pa.int64()),
                         "mark": pa.array(_packed(start, start, start, 0), pa.int64())})

    named = rows.join(marked, "row").dropDuplicates(["row"]).select("doc_id", "row", "text", "marks")
    return in_batches(named, deal, "bucket int, highs binary, lows binary, docs binary, rows binary, "
                      "starts binary").groupBy("bucket").applyInArrow(merge, "row bigint, mark bigint")


def _later(high, low, doc, row, start):
    """Which windows have an equal one, by both halves of the digest, at an earlier place."""
    order = np.lexsort((start, row, doc, low, high))
    equal = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
    # The same place twice is no repeat: it is later only if another one comes before both.
    again = equal & (row[order][1:] == row[order][:-1]) & (start[order][1:] == start[order][:-1])
    new = np.append(True, ~equal)[:len(order)]
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else order
    same = np.append(False, again)[:len(order)]
    moved = np.cumsum(~same)
    out = np.zeros(len(order), bool)
    out[order] = moved > moved[head] if len(order) else False
    return out


def remove_repeats(docs: DataFrame, length: int = 100, key: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept), one row for each row.

    Removes each byte of the UTF-8 text that lies in a string of ``length`` bytes that also
    starts earlier: in a document with a smaller key, or further left in the same one. Strings
    are judged on the input and never cross documents. ``kept`` is the rest as binary, since a
    cut may fall inside a character.

    Null text counts as empty. Null keys come first; documents with one key are ordered by a
    hash of key and text; rows equal in both are one document and share the result. An
    empty table gives no rows; other columns are ignored.

    Repeats inside a batch are settled before the exchange, so a passage that a third of all
    documents hold arrives once per batch; only contexts that differ around a shared anchor
    are sorted and merged, a group of one anchor at a time. Anchors with more than
    ``MANY_CONTEXTS`` different contexts are settled by digests of their windows instead.
    """
    if not 2 * GRAM <= length <= 200:
        raise ValueError("length must lie between two grams and 200")
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn(
        "row", F.xxhash64("doc_id", "text"))
    settled = materialise(_anchor_marks(rows, length))
    suffixes = settled.where("mark & 1 = 1")
    contexts = materialise(suffixes.groupBy("anchor").agg(F.count("*").alias("n")))
    n_open = contexts.agg(F.sum("n")).first()[0] or 0
    # Of all suffixes at most one in MANY_CONTEXTS names a hot anchor, and never more than 500,000 do.
    hot = contexts.where(F.col("n") > max(MANY_CONTEXTS, n_open // 500_000)).select("anchor")
    any_hot = hot.limit(1).count() > 0
    few = suffixes.join(F.broadcast(hot), "anchor", "left_anti") if any_hot else suffixes
    by_row = lambda marks: marks.groupBy("row").agg(F.collect_list("mark").alias("marks"))
    open_ = by_row(few)
    buckets = max(parallelism(spark), -(-n_open // BUCKET_SUFFIXES))
    runs = in_batches(
        rows.join(open_, "row").dropDuplicates(["row"]).select("doc_id", "row", "text", "marks"),
        lambda batches: _suffix_runs(batches, length, buckets),
        "bucket int, common binary, rest binary, tails binary, lefts binary, docs binary, "
        "rows binary, marks binary")
    found = runs.groupBy("bucket").applyInArrow(_merge_bucket(length), "row bigint, mark bigint")
    if any_hot:
        frequent = by_row(suffixes.join(F.broadcast(hot), "anchor", "left_semi"))
        n_hot = contexts.join(F.broadcast(hot), "anchor", "left_semi").agg(F.sum("n")).first()[0]
        found = found.union(_hot_marks(rows, frequent, length, max(
            parallelism(spark), -(-n_hot // HOT_SUFFIXES))))
    repeats = by_row(settled.where("mark & 1 = 0").select("row", "mark").union(found))

    def cut(batches):
        for batch in slices(batches, "text", 4 << 20):
            out = [[] for _ in range(5)]
            for value, marks in zip(batch.column("text").to_pylist(),
                                    batch.column("marks").to_pylist(), strict=True):
                data, spans = (value or "").encode(), 0
                kept = data
                if marks:
                    first, last, _, _ = _unpacked(np.array(marks, np.int64))
                    edge = np.zeros(len(data) + 1, np.int32)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, last + length, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    spans = int(np.count_nonzero(np.diff(gone.view(np.int8), prepend=0) == 1))
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                for column, item in zip(out, (
                        len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(),
                        kept), strict=True):
                    column.append(item)
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(out, kinds, strict=True)]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return in_batches(
        rows.join(repeats, "row", "left").select("doc_id", "text", "marks"), cut,
        "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
        "kept binary")
