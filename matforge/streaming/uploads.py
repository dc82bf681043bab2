"""Catalog files as a stream: an extension for landing folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import catalogs


def watch(spark: SparkSession, folder: str, cpse: str, sink: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Standardizes each new CSV file in ``folder`` and calls ``sink(catalog rows, reports, batch)``."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.csv").load(folder)

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.select("path", "content").mapInArrow(catalogs._rows, catalogs._ROW).persist()
        sink(catalogs.standardized(rows, cpse), catalogs.report(rows, cpse), number)
        rows.unpersist()

    writer = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
