"""Photographs as they arrive in a folder: an addition to the batch form, with the same results a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.batch import Result, Settings, analyze
from ..sources.images import read_images


def watch(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[Result, int], None], layout=None, settings: Settings | None = None) -> StreamingQuery:
    """Analyse each batch of new files once and hand its result to ``sink``."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path")

    def each(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.collect()]  # names of one batch's files
        if paths:
            sink(analyze(read_images(spark, paths), layout, settings), number)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
