"""Panels that arrive as files: the batch operators behind a file stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def process(spark: SparkSession, folder: str, schema: StructType, batch: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Run ``batch`` over the Parquet files that are new in ``folder`` and append its rows to
    ``target`` (Parquet), then stop. A batch that is repeated after a failure replaces its own
    output, so each file counts once. A figure's panels must come in one file."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)

    def write(rows: DataFrame, batch_id: int) -> None:
        batch(rows).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_groups(events: DataFrame, time: str, key: str, gap: str, delay: str) -> DataFrame:
    """Groups of events of a key that are no farther apart than ``gap``: the islands of a
    stream. Groups are final once the watermark (``delay``) has passed them."""
    return events.withWatermark(time, delay).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
