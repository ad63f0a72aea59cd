"""Dictionaries of any size: a table beside the model, joined when rows are coded."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from ..functions.scalars import col
from ..session import scratch_path, ship_package
from .encode import SMALL_DICTIONARY, ranked_by_range

#: A value with at least this share of the rows is looked up without moving rows: at most 1000 values.
OFTEN = 0.001
#: Longer values are not sent to every task; the ones that are take 10 MB at most.
OFTEN_LENGTH = 2_500


def store_dictionary(counts: DataFrame, entries: int, rows: int) -> str:
    """Write values (value, n, ...) with their ranks from 0 to a table and return its path."""
    ranked = ranked_by_range(counts, entries, SMALL_DICTIONARY)
    path = scratch_path(counts.sparkSession, "dictionary")
    often = (F.col("n") >= OFTEN * rows) & (F.length(F.col("value").cast("string")) <= OFTEN_LENGTH)
    ranked.withColumns({"code": F.col("code").cast("bigint"), "often": often}).drop("n").write.parquet(
        path)
    return path


def look_up(df: DataFrame, given: str, dictionary: DataFrame, output: str, key: str = "value",
            result: str = "code") -> DataFrame:
    """Adds what a dictionary says about a column's value, null where it says nothing.

    Frequent values are few and broadcast; the others are joined by value. Rows that are done by
    then, or have no value, are dealt by a hash of the row, so no value's rows gather in one task.
    """
    near, far, first, second, dealt = (f"{output}_{s}" for s in ("near", "far", "first", "second", "deal"))
    often = dictionary.filter("often").select(F.col(key).alias(near), F.col(result).alias(first))
    df = df.join(F.broadcast(often), col(given) == F.col(near), "left").drop(near)
    plain = [f.name for f in df.schema if isinstance(f.dataType, T.AtomicType)]
    open_ = F.col(first).isNull() & col(given).isNotNull()
    rare = dictionary.filter("NOT often").select(
        F.xxhash64(F.col(key)).alias(dealt), F.col(key).alias(far), F.col(result).alias(second))
    own = F.when(open_, F.xxhash64(col(given))).otherwise(F.xxhash64(*[col(c) for c in plain]))
    keyed = df.withColumn(f"{output}_hash", own)
    joined = keyed.join(rare, (F.col(f"{output}_hash") == F.col(dealt))
                        & (col(given) == F.col(far)) & open_, "left")
    return joined.withColumn(output, F.coalesce(F.col(first), F.col(second))).drop(
        far, second, first, dealt, f"{output}_hash")


class StoredOneHot(Transformer, HasInputCol, HasOutputCol, MLWritable, MLReadable):
    """One-hot vectors of a text column by a stored dictionary; an unknown value is all zeros."""

    size = Param(Params._dummy(), "size", "entries of the dictionary", TypeConverters.toInt)
    path = Param(Params._dummy(), "path", "where the dictionary is", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, size=None, path=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def dictionary(self, spark) -> DataFrame:
        return spark.read.parquet(self.getOrDefault(self.path))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship_package(dataset.sparkSession)
        size = self.getOrDefault(self.size)

        def vectors(codes):
            known = np.array(codes.is_valid())
            ends = pa.array(np.append(0, np.cumsum(known)).astype(np.int32))
            at = np.array(codes.drop_null()).astype(np.int32)
            return pa.StructArray.from_arrays([
                pa.array(np.zeros(len(known), np.int8)), pa.array(np.full(len(known), size, np.int32)),
                pa.ListArray.from_arrays(ends, pa.array(at)),
                pa.ListArray.from_arrays(ends, pa.array(np.ones(len(at))))],
                ["type", "size", "indices", "values"])

        output = self.getOutputCol()
        coded = look_up(dataset, self.getInputCol(), self.dictionary(dataset.sparkSession), f"{output}_at")
        return coded.withColumn(
            output, arrow_udf(vectors, VectorUDT())(F.col(f"{output}_at"))).drop(f"{output}_at")

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, instance: StoredOneHot):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.dictionary(self.sparkSession).write.parquet(f"{path}/dictionary")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> StoredOneHot:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.cls()
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage._set(path=f"{path}/dictionary")
