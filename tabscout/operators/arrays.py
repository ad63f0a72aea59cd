"""Models that are numpy arrays: saving them beside Spark's metadata and reading them back."""

from __future__ import annotations

import json
from collections.abc import Mapping

import numpy as np
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReader, MLWriter


class ArrayWriter(MLWriter):
    """Writes what ``instance.state()`` gives: arrays by name and plain facts."""

    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        arrays, facts = self.instance.state()
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.instance, path, spark, {"facts": facts})
        rows = [(name, str(a.dtype), json.dumps(a.shape), a.tobytes()) for name, a in arrays.items()]
        parts = max(1, sum(len(r[3]) for r in rows) >> 25)
        spark.createDataFrame(
            rows, "name string, kind string, shape string, data binary").repartition(
            parts).write.parquet(f"{path}/arrays")


class ArrayReader(MLReader):
    """Builds the class again by its ``of_state(arrays, facts)``."""

    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        arrays: Mapping[str, np.ndarray] = {
            r["name"]: np.frombuffer(r["data"], r["kind"]).reshape(json.loads(r["shape"]))
            for r in spark.read.parquet(f"{path}/arrays").collect()}
        model = self.cls.of_state(arrays, metadata["facts"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
