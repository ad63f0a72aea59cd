"""Scoring a stream of rows with a fitted model.

Scoring keeps no state between rows, so any trigger and output mode works.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..plans.score import score
from ..sources.artifacts import _neighbour_stages


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet",
                files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def score_stream(
    stream: DataFrame, model: PipelineModel, meta: Mapping, sink: str, checkpoint: str,
) -> StreamingQuery:
    """Score everything available and append it to ``sink`` as Parquet.

    Neighbour models search stored rows with joins and aggregates, so they score
    batch by batch; all others run inside the stream itself.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if _neighbour_stages(model):
        def store(batch: DataFrame, epoch: int) -> None:
            # One folder per batch, so a batch that is retried replaces itself.
            score(batch, model, meta).write.mode("overwrite").parquet(f"{sink}/batch={epoch}")

        return writer.foreachBatch(store).start()
    return (
        score(stream, model, meta).writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).format("parquet").option("path", sink)
        .outputMode("append").start()
    )
