"""Token ids as wavelet matrices: succinct bit-planes with access, rank, select and count.

File format: one Parquet file for each range of document ids (a shard). Its rows are blocks of
whole documents; a block holds the documents' ids and lengths and, for each bit of the token
ids from the highest, a plane of packed bits, all compressed with zstandard. Blocks keep the
memory of a task small whatever the size of a shard.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabscout.session import scratch_path

from .common import in_batches, parallelism, slices

BLOCK_SCHEMA = ("part int, block int, n_docs bigint, n_tokens bigint, bits int, "
                "zeros array<bigint>, docs binary, planes binary")


def build(values: np.ndarray, bits: int) -> tuple[list[int], np.ndarray]:
    """Zeros of each level and the planes, one row of packed bits for each level."""
    planes, zeros = [], []
    for shift in range(bits - 1, -1, -1):
        one = ((values >> values.dtype.type(shift)) & values.dtype.type(1)).astype(bool)
        planes.append(np.packbits(one))
        upper = values[one]
        np.logical_not(one, out=one)
        lower = values[one]
        zeros.append(len(lower))
        values = np.concatenate((lower, upper))
    return zeros, np.array(planes, np.uint8).reshape(bits, -1)


class WaveletMatrix:
    """A read-only sequence of ``n`` unsigned integers below 2 ** bits."""

    def __init__(self, n: int, zeros: list[int], planes: np.ndarray):
        self.n, self.zeros, self.planes, self._ranks = n, list(zeros), planes, None

    @property
    def ranks(self) -> np.ndarray:
        """Ones before each byte, by level."""
        if self._ranks is None:
            ones = np.bitwise_count(self.planes).astype(np.int64)
            self._ranks = np.zeros((len(self.zeros), self.planes.shape[1] + 1), np.int64)
            np.cumsum(ones, axis=1, out=self._ranks[:, 1:])
        return self._ranks

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a level."""
        byte, rest = divmod(i, 8)
        count = int(self.ranks[level, byte])
        if rest:
            count += (int(self.planes[level, byte]) >> (8 - rest)).bit_count()
        return count

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level, i // 8]) >> (7 - i % 8) & 1

    def access(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value = value << 1 | bit
            i = zeros + ones if bit else i - ones
        return value

    def _range(self, value: int, low: int, high: int) -> tuple[int, int]:
        for level, zeros in enumerate(self.zeros):
            a, b = self._ones(level, low), self._ones(level, high)
            one = value >> (len(self.zeros) - 1 - level) & 1
            low, high = (zeros + a, zeros + b) if one else (low - a, high - b)
        return low, high

    def rank(self, value: int, i: int) -> int:
        """How often the value occurs among the first i."""
        if value < 0 or value >> len(self.zeros):
            return 0
        low, high = self._range(value, 0, min(i, self.n))
        return high - low

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """Place of the k-th occurrence, from 0: its place at the bottom, walked back up."""
        if value < 0 or value >> len(self.zeros):
            raise IndexError(k)
        low, high = self._range(value, 0, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        place = low + k
        for level in range(len(self.zeros) - 1, -1, -1):
            one = value >> (len(self.zeros) - 1 - level) & 1
            place = self._nth(level, one, place - self.zeros[level] if one else place)
        return place

    def _nth(self, level: int, one: int, k: int) -> int:
        """Place of the k-th one (or zero) of a level, by bisection in its directory."""
        ranks = self.ranks[level]
        low, high = 0, len(ranks) - 1
        while high - low > 1:
            middle = (low + high) // 2
            before = int(ranks[middle]) if one else 8 * middle - int(ranks[middle])
            low, high = (middle, high) if before <= k else (low, middle)
        k -= int(ranks[low]) if one else 8 * low - int(ranks[low])
        byte = int(self.planes[level, low])
        for bit in range(8):
            if byte >> (7 - bit) & 1 == one:
                if k == 0:
                    return 8 * low + bit
                k -= 1
        raise IndexError(k)

    def positions(self, value: int) -> np.ndarray:
        """Ascending places of all occurrences: their bottom range walked back up."""
        if value < 0 or value >> len(self.zeros):
            return np.zeros(0, np.int64)
        low, high = self._range(value, 0, self.n)
        places = np.arange(low, high)
        for level in range(len(self.zeros) - 1, -1, -1):
            if not len(places):
                break
            one = value >> (len(self.zeros) - 1 - level) & 1
            bits = np.unpackbits(self.planes[level], count=self.n).view(bool)
            source = np.flatnonzero(bits if one else ~bits)
            places = source[places - (self.zeros[level] if one else 0)]
        return places

    def values(self) -> np.ndarray:
        """The whole sequence, level by level from the bottom."""
        kind = np.uint16 if len(self.zeros) <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for level in range(len(self.zeros) - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n).view(bool)
            above, split = np.empty(self.n, kind), self.zeros[level]
            above[one] = out[split:] | kind(1 << (len(self.zeros) - 1 - level))
            np.logical_not(one, out=one)
            above[one] = out[:split]
            out = above
        return out


def _pack(tokens: np.ndarray, doc_ids: list, lengths: list[int], bits: int):
    import zstandard

    if len(tokens) and int(tokens.max()) >> bits:
        raise ValueError(f"token id {int(tokens.max())} does not fit {bits} bits")
    press = zstandard.ZstdCompressor(level=1)
    zeros, planes = build(tokens.astype(np.uint16 if bits <= 16 else np.uint32), bits)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    index = np.array([d or 0 for d in doc_ids], np.int64).tobytes()
    docs = known.tobytes() + index + np.array(lengths, np.int64).tobytes()
    return zeros, press.compress(docs), press.compress(planes.tobytes())


def unpack(row: dict) -> tuple[list, np.ndarray, WaveletMatrix]:
    """(document ids, lengths, matrix) of a block."""
    import zstandard

    press, n = zstandard.ZstdDecompressor(), row["n_docs"]
    docs = press.decompress(row["docs"])
    known = np.frombuffer(docs, np.uint8, n)
    ids, lengths = np.frombuffer(docs, np.int64, 2 * n, n).reshape(2, n)
    planes = np.frombuffer(press.decompress(row["planes"]), np.uint8).reshape(row["bits"], -1)
    names = [int(d) if k else None for d, k in zip(ids, known, strict=True)]
    return names, lengths, WaveletMatrix(row["n_tokens"], row["zeros"], planes)


def write_index(docs: DataFrame, tokenizer: str, end_id: int = 2, drops_space: bool = True,
                bits: int = 16, block_tokens: int = 1 << 19, path: str | None = None,
                key: str = "doc_id", text: str = "text") -> str:
    """Tokenize every text and write the index in ascending order of key; returns its path.

    Ids that do not fit ``bits`` are an error. Null text counts as empty and still gets its end id; rows without a key come first;
    rows of one key follow each other in the order of their texts. A document is never
    split over blocks, so one of more than ``block_tokens`` ids makes a block of its own.
    Files go through Spark's writer: a lost executor repeats its task and nothing else.
    """
    path = path or scratch_path(docs.sparkSession, "wavelet")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    shards = rows.repartitionByRange(
        parallelism(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")

    def blocks(batches):
        from pyspark import TaskContext

        from tabscout.llm.tokens import encoder

        encode = encoder(tokenizer, end_id, drops_space, 2_500_000).encode
        part, block = TaskContext.get().partitionId(), 0
        held, names, lengths, total = [], [], [], 0

        def flush():
            tokens = np.frombuffer(b"".join(held), "<u4")
            zeros, index, planes = _pack(tokens, names, lengths, bits)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([block], pa.int32()),
                pa.array([len(names)], pa.int64()), pa.array([total], pa.int64()),
                pa.array([bits], pa.int32()), pa.array([zeros], pa.list_(pa.int64())),
                pa.array([index], pa.binary()), pa.array([planes], pa.binary()),
            ], names=["part", "block", "n_docs", "n_tokens", "bits", "zeros", "docs", "planes"])

        for batch in slices(batches, "text", 2 << 20):
            coded = encode(batch.column("text").to_pylist())
            for name, ids in zip(batch.column("doc_id").to_pylist(), coded, strict=True):
                n = len(ids) // 4
                if held and total + n > block_tokens:
                    yield flush()
                    held, names, lengths, total, block = [], [], [], 0, block + 1
                held.append(ids)
                names.append(name)
                lengths.append(n)
                total += n
        if held:
            yield flush()

    in_batches(shards, blocks, BLOCK_SCHEMA).write.parquet(path)
    return path


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def documents_of(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold of each document: (doc_id, start, n_tokens, ids_crc32).

    ``start`` counts the ids of all documents before it. The sums before a shard and
    before a block come from the manifest columns alone: one row for each shard meets in
    one task, blocks only within their shard.
    """
    blocks = read_blocks(spark, path)

    def digest(batches):
        for row in _rows(batches):
            names, lengths, matrix = unpack(row)
            ids = matrix.values().astype("<u4").tobytes()
            ends = np.cumsum(lengths)
            sums = [zlib.crc32(ids[4 * (e - n):4 * e])
                    for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            count = len(names)
            yield pa.RecordBatch.from_arrays([
                pa.array([row["part"]] * count, pa.int32()),
                pa.array([row["block"]] * count, pa.int32()),
                pa.array(names, pa.int64()), pa.array(ends - lengths, pa.int64()),
                pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()),
            ], names=["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32"])

    found = in_batches(
        blocks, digest, "part int, block int, doc_id bigint, inside bigint, "
        "n_tokens bigint, ids_crc32 bigint")
    sizes = blocks.select("part", "block", "n_tokens")
    earlier = lambda w: F.coalesce(F.sum("n").over(
        w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", earlier(Window.orderBy("part")).alias("shard_base"))
    bases = sizes.withColumnRenamed("n_tokens", "n").select(
        "part", "block", earlier(Window.partitionBy("part").orderBy("block")).alias("base")
    ).join(shards, "part")
    return found.join(bases, ["part", "block"]).select(
        "doc_id", (F.col("shard_base") + F.col("base") + F.col("inside")).alias("start"),
        "n_tokens", "ids_crc32")


def token_counts(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Occurrences of a token in each block, by rank alone: (part, block, n)."""
    def count(batches):
        for row in _rows(batches):
            _, _, matrix = unpack(row)
            yield pa.RecordBatch.from_arrays([
                pa.array([row["part"]], pa.int32()), pa.array([row["block"]], pa.int32()),
                pa.array([matrix.count(token)], pa.int64())], names=["part", "block", "n"])

    return in_batches(read_blocks(spark, path), count, "part int, block int, n bigint")


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Every place of a token: (doc_id, offset in its document)."""
    def find(batches):
        for row in _rows(batches):
            names, lengths, matrix = unpack(row)
            places, ends = matrix.positions(token), np.cumsum(lengths)
            doc = np.searchsorted(ends, places, "right")
            yield pa.RecordBatch.from_arrays([
                pa.array([names[d] for d in doc], pa.int64()),
                pa.array(places - (ends - lengths)[doc], pa.int64())],
                names=["doc_id", "offset"])

    return in_batches(read_blocks(spark, path), find, "doc_id bigint, offset bigint")
