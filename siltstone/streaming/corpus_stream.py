"""The corpus build as a stream: the same filter columns, dedup by hash, and idempotent shard output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.functions import text as tx
from siltstone.operators import filters


def document_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def curated_stream(docs: DataFrame, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Web filter, then the first row of each content hash.

    Without an event time the state holds every hash ever seen; with one, hashes older than the watermark go and a copy
    that comes later than `delay` passes again.
    """
    kept = docs.where(filters.web_reason(F.col("text")).isNull()).withColumn("content_hash", tx.content_hash(F.col("text")))
    if event_time:
        return kept.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["content_hash"])
    return kept.dropDuplicates(["content_hash"])


def write_stream(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch overwrites its own folder, so that a repeated batch leaves no copies."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:08d}")

    return docs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
