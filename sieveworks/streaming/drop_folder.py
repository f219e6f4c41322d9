"""Check deliveries as they arrive in a folder. An extension: the rules know no streams.

A delivery is one file and is judged whole, so that no state crosses batches; each micro-batch is one
batch check, and the checkpoint folder makes every file be checked once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sieveworks.plans.report import Checked, check_binary

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[Checked, int], None], files_per_batch: int = 100) -> StreamingQuery:
    """Start checking; sink gets each batch's result and number."""
    arrived = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).load(folder)

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.col("path").alias("delivery"), F.element_at(F.split("path", "/"), -1).alias("target"), "content")
        if not rows.isEmpty():
            sink(check_binary(rows), number)

    return arrived.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
