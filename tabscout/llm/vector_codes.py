"""Vector compression by codebooks of parts; nearest entries by equal-average search."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tabscout.session import materialise

from .common import in_batches

#: Components are multiplied by this and rounded down.
SCALE = 256
#: Size of integer components, times a part's width, that keeps every sum of squares in 64 bits.
MOST = 1 << 28
#: Labels whose sums are sent to every task; of more labels only the frequent ones are.
BROADCAST_LABELS = 100_000
#: A label with this many rows is frequent. At most one in that many rows names one.
FREQUENT = 1_000_000
#: Parts searched at once.
_ROWS = 1 << 15


def nearest_entries(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and its squared distance for each part, exactly.

    Entries are sorted by the sum of their components. From the place of a part's own sum the
    search goes outward on both sides. By Cauchy and Schwarz an entry is at least (gap of the
    sums)^2 / width away, and gaps only grow, so a side ends where that bound strictly exceeds
    the best distance; equal bounds are still looked at, so ties go to the lower index.
    All parts of a batch take a step together and leave as their sides end.
    """
    width, n = book.shape[1], len(book)
    sums = book.sum(1)
    order = np.argsort(sums, kind="stable")
    sums, entries = sums[order], book[order]
    index = np.full(len(parts), n)
    distance = np.full(len(parts), np.iinfo(np.int64).max)
    for low in range(0, len(parts), _ROWS):
        x = parts[low:low + _ROWS]
        best, chosen = distance[low:low + _ROWS], index[low:low + _ROWS]
        own = x.sum(1)
        start = np.searchsorted(sums, own)
        everyone = np.arange(len(x))
        sides = [(everyone, start, 1), (everyone, start - 1, -1)]
        while sides:
            open_sides = []
            for rows, place, step in sides:
                inside = (place >= 0) & (place < n)
                rows, place = rows[inside], place[inside]
                gap = sums[place] - own[rows]
                # gap^2 / width <= best: the bound does not exceed it.
                near = -(-gap * gap // width) <= best[rows]
                rows, place = rows[near], place[near]
                if not len(rows):
                    continue
                off = x[rows] - entries[place]
                found = np.einsum("ij,ij->i", off, off)
                entry = order[place]
                better = (found < best[rows]) | ((found == best[rows]) & (entry < chosen[rows]))
                best[rows[better]] = found[better]
                chosen[rows[better]] = entry[better]
                open_sides.append((rows, place + step, step))
            sides = open_sides
    return index, distance


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(256 * x) of all components in a row, each row's first place, and which rows count.

    Null vectors and vectors that hold null or non-finite components do not count.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.array(column.value_lengths().fill_null(0), np.int64)
    starts = np.cumsum(lengths) - lengths
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    values = np.floor(SCALE * values)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    ok = np.array(column.is_valid()) & (bad[starts + lengths] == bad[starts])
    return values, np.column_stack((starts, lengths)), ok


def _rows_of(values: np.ndarray, places: np.ndarray, ok: np.ndarray, width: int,
             parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The counting rows of this width whose components are within the range, as a matrix."""
    here = np.flatnonzero(ok & (places[:, 1] == width))
    found = values[places[here, :1] + np.arange(width)]
    small = (np.abs(found) < MOST // (width // parts)).all(1)
    return here[small], found[small].astype(np.int64)


class Codebooks:
    """Entries as integers: part, entry, position within the part."""

    def __init__(self, books: np.ndarray):
        self.books = books

    @property
    def sha256(self) -> str:
        """Digest of all entries in decimal, by part, entry and position, joined by commas."""
        listed = ",".join(map(str, self.books.ravel().tolist()))
        return hashlib.sha256(listed.encode()).hexdigest()


def _first_rows(embeddings: DataFrame, parts: int, entries: int) -> DataFrame:
    """Number of usable vectors of each length, and their least keys' vectors, per task."""
    def work(batches):
        least: dict[int, list] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            ids = batch.column("vec_id").to_pylist()
            values, places, ok = integers(batch.column("vector"))
            for width in np.unique(places[ok, 1]).tolist():
                if not width or width % parts:
                    continue
                here, found = _rows_of(values, places, ok, width, parts)
                counts[width] = counts.get(width, 0) + len(here)
                keyed = [(ids[i] is None, ids[i] or 0, row) for i, row in zip(
                    here.tolist(), found, strict=True)]
                least[width] = sorted([*least.get(width, []), *keyed],
                                      key=lambda k: (k[0], k[1], k[2].tolist()))[:entries]
        listed = [(w, counts[w], *k) for w, rows in least.items() for k in rows[:1]]
        listed += [(w, 0, *k) for w, rows in least.items() for k in rows[1:]]
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in listed], pa.int32()),
            pa.array([r[1] for r in listed], pa.int64()),
            pa.array([None if r[2] else r[3] for r in listed], pa.int64()),
            pa.array([r[4].tolist() for r in listed], pa.list_(pa.int64()))],
            names=["width", "n", "vec_id", "vector"])

    return in_batches(embeddings, work, "width int, n bigint, vec_id bigint, vector array<bigint>")


def learn(embeddings: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2,
          key: str = "vec_id", vector: str = "embedding") -> Codebooks:
    """Codebooks of all usable vectors: each round assigns every part to its nearest entry and
    replaces an entry by the floor of the mean of its parts; an entry without parts stays.

    A codebook starts as the parts of the ``entries`` vectors with the least keys (then the least
    components; null keys last). Vectors are usable if nothing in them is null or non-finite, their
    length is the most frequent one that ``parts`` divides (of equally frequent ones the smallest)
    and their components times 256 are below 2^28 / (length / parts). Every round is one pass over
    the vectors; a task sends one sum per entry, so what reaches the driver is as large as the
    codebooks.
    """
    shown = embeddings.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    first = materialise(_first_rows(shown, parts, entries))
    width = first.groupBy("width").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "width").first()
    if width is None:
        return Codebooks(np.zeros((parts, 0, 0), np.int64))
    width = width["width"]
    seeds = first.where(F.col("width") == width).orderBy(
        F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    books = np.array([r["vector"] for r in seeds], np.int64).reshape(
        len(seeds), parts, width // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sums = _part_sums(shown, books).select(
            "part", "entry", "count", F.posexplode("sums").alias("at", "sum")).groupBy(
            "part", "entry", "at").agg(
            F.sum("count").alias("count"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))
        for r in sums.collect():
            books[r["part"], r["entry"], r["at"]] = int(r["sum"]) // r["count"]
    return Codebooks(books)


def _part_sums(shown: DataFrame, books: np.ndarray) -> DataFrame:
    parts, entries, size = books.shape

    def work(batches):
        sums = np.zeros((parts, entries, size), np.int64)
        counts = np.zeros((parts, entries), np.int64)
        for batch in batches:
            _, found = _rows_of(*integers(batch.column("vector")), parts * size, parts)
            for p in range(parts):
                part = found[:, p * size:(p + 1) * size]
                chosen, _ = nearest_entries(part, books[p])
                np.add.at(sums[p], chosen, part)
                counts[p] += np.bincount(chosen, minlength=entries)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([
            pa.array(part, pa.int32()), pa.array(entry, pa.int32()),
            pa.array(counts[part, entry]),
            pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))],
            names=["part", "entry", "count", "sums"])

    return in_batches(shown.select("vector"), work,
                      "part int, entry int, count bigint, sums array<bigint>")


def encode(embeddings: DataFrame, model: Codebooks, key: str = "vec_id",
           vector: str = "embedding", keep: str | None = None) -> DataFrame:
    """(key, keep, code, error): the nearest entry of each part, two hex digits each (more from 257
    entries on), and the squared distances summed over the parts.

    Vectors that are null or hold null or non-finite components are dropped; others that are not
    usable (see ``learn``) have a null code and error.
    """
    books = model.books
    parts, entries, size = books.shape
    digits = max(2, len(f"{max(0, entries - 1):x}"))
    names = np.array([f"{e:0{digits}x}" for e in range(entries)], f"<U{digits}")

    def work(batches):
        for batch in batches:
            values, places, ok = integers(batch.column("vector"))
            codes = np.full(batch.num_rows, None, object)
            errors = np.zeros(batch.num_rows, np.int64)
            here = np.zeros(0, np.int64)
            if size:
                here, found = _rows_of(values, places, ok, parts * size, parts)
                shown = np.full(len(here), "", f"<U{digits * parts}")
                for p in range(parts):
                    chosen, off = nearest_entries(found[:, p * size:(p + 1) * size], books[p])
                    errors[here] += off
                    shown = np.char.add(shown, names[chosen])
                codes[here] = shown
            coded = np.isin(np.arange(batch.num_rows), here)
            out = pa.RecordBatch.from_arrays([
                batch.column("vec_id"), batch.column("kept"), pa.array(codes.tolist(), pa.string()),
                pa.array(errors, pa.int64(), mask=~coded)],
                names=["vec_id", "kept", "code", "error"])
            yield out.filter(pa.array(ok))

    kept = F.col(keep) if keep else F.lit(None).cast("int")
    shown = embeddings.select(F.col(key).cast("long").alias("vec_id"), kept.alias("kept"),
                              F.col(vector).alias("vector"))
    kind = shown.schema["kept"].dataType.simpleString()
    return in_batches(shown, work, f"vec_id bigint, kept {kind}, code string, error bigint")


def decode(codes: DataFrame, model: Codebooks, code: str = "code",
           output: str = "vector") -> DataFrame:
    """Adds the vectors that the codes stand for: the middle of each entry's step."""
    books = model.books
    parts, entries, _ = books.shape
    digits = max(2, len(f"{max(0, entries - 1):x}"))

    def work(batches):
        for batch in batches:
            rows = []
            for c in batch.column(code).to_pylist():
                at = [int(c[i:i + digits], 16) for i in range(0, len(c), digits)] if c else []
                entry = books[np.arange(parts), at] if c else None
                rows.append(((entry.ravel() + 0.5) / SCALE).tolist() if c else None)
            yield batch.append_column(output, pa.array(rows, pa.list_(pa.float64())))

    return in_batches(codes, work, StructType([*codes.schema, StructField(
        output, ArrayType(DoubleType()))]))


def compress(embeddings: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2,
             key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), one row for each row that counts.

    ``label_error`` is the sum of ``error`` over the rows with an equal label, null labels
    together; null if no such row has a code or the sum exceeds 64 bits. Repeated keys and rows are
    rows of their own, an empty table gives none. Sums are folded before the shuffle and joined
    back by broadcast up to 100,000 labels; of more, the frequent labels' sums are broadcast and the
    rest is joined by label, so no label's rows gather in one task.
    """
    model = learn(embeddings, parts, entries, rounds, key, vector)
    coded = materialise(encode(embeddings, model, key, vector, label))
    sums = materialise(coded.groupBy("kept").agg(
        F.try_sum("error").alias("label_error"), F.count("*").alias("n")))
    same = coded["kept"].eqNullSafe(sums["kept"])
    if sums.count() <= BROADCAST_LABELS:
        joined = coded.join(F.broadcast(sums), same)
    else:
        often = sums.where((F.col("n") >= FREQUENT) | F.col("kept").isNull())
        near = coded.join(F.broadcast(often), coded["kept"].eqNullSafe(often["kept"]), "left")
        near = near.select("vec_id", coded["kept"], "code", "error", "label_error",
                           F.col("n").isNotNull().alias("done"))
        rest = sums.where((F.col("n") < FREQUENT) & F.col("kept").isNotNull()).select(
            "kept", F.col("label_error").alias("own"))
        far = near.where(~F.col("done")).drop("label_error").join(rest, "kept").withColumnRenamed(
            "own", "label_error")
        names = ["vec_id", "code", "error", "label_error"]
        joined = near.where("done").select(*names).union(far.select(*names))
    return joined.select("vec_id", "code", "error", "label_error",
                         F.lit(model.sha256).alias("codebooks_sha256"))
