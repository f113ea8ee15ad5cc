"""Shards of packed sequences with a manifest (O-13 to O-16)."""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.shared import cut, tasks
from siltstone.sources.arrow_ipc import register

#: Bytes by which a token counts towards a shard's size: three columns of four bytes.
TOKEN_BYTES = 12


def sequences_per_shard(length: int, shard_mb: int = 50, most: int = 2_000) -> int:
    """Sequences until a shard is closed: its size in MiB reached, or `most`."""
    return min(most, -(-shard_mb * 1024 * 1024 // (length * TOKEN_BYTES)))


def shard_assignment(sequences: DataFrame, per_shard: int, first_shard: int = 0) -> DataFrame:
    """Adds shard_index and shard_name from seq_no, which counts from 0."""
    index = (F.floor(F.col("seq_no") / per_shard) + first_shard).cast("int")
    return sequences.withColumns({"shard_index": index, "shard_name": F.format_string("shard_%05d", index)})


class ShardCuts:
    """Where a run of records closes shards, for any open shard at its start.

    A shard is closed by the record with which it reaches `limit` bytes or `most` records.  After the first close all
    others follow from it, and that one comes within `most` records, so `heads` of so many entries tell the whole run.
    """

    def __init__(self, sizes: np.ndarray, limit: int, most: int):
        self.limit, self.most, self.n = limit, most, len(sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        n = self.n
        at = np.minimum(np.searchsorted(ends, ends[:-1] + limit, side="left"), np.arange(n) + most)
        closed, left_bytes, left_count = [0] * (n + 1), (ends[-1] - ends).tolist(), list(range(n, -1, -1))
        for k, j in enumerate(at[::-1].tolist()):
            k = n - 1 - k
            if j <= n:
                closed[k], left_bytes[k], left_count[k] = closed[j] + 1, left_bytes[j], left_count[j]
        m = min(n, most)
        self.ends, self.heads = ends[: m + 1].tolist(), [closed[: m + 1], left_bytes[: m + 1], left_count[: m + 1]]
        self.total = int(ends[-1])

    def packed(self) -> tuple:
        return self.n, self.total, self.ends, *self.heads


def shards_after(state: tuple[int, int, int], limit: int, most: int, n: int, total: int, ends: list[int], closed: list[int], left_bytes: list[int], left_count: list[int]) -> tuple[int, int, int]:
    """(shards closed before, bytes, records of the open one) after a run, from its ShardCuts."""
    before, size, count = state
    # With no size in the table that reaches the limit, the place is behind the table.
    first = min(max(bisect_left(ends, limit - size), 1), most - count)
    if first < len(ends):
        return before + 1 + closed[first], left_bytes[first], left_count[first]
    return before, size + total, count + n


def shards_by_bytes(records: DataFrame, limit: int, most: int = 2_000, order_key: str = "seq_no", size_column: str = "size_bytes", first_shard: int = 0) -> DataFrame:
    """order key, size, shard_index, shard_name for records of different size, in the order of a unique key.

    Keys and sizes are written once, in ranges; a task holds the sizes of its range, at most `most` numbers a range reach
    the driver, and every range then goes on from the shard that the ranges before it leave open.
    """
    if limit < 1 or most < 1:
        raise ValueError("a shard holds one byte and one record at least")
    narrow = records.select(F.col(order_key).cast("long").alias("key"), F.col(size_column).cast("long").alias("size"))
    placed = cut(narrow.repartitionByRange(tasks(records.sparkSession), "key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id().cast("long")))

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, part = [], None
        for batch in batches:
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
                sizes.append(batch.column(1).to_numpy())
        if part is not None:
            found = ShardCuts(np.concatenate(sizes), limit, most).packed()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, *found)], names=["part", "n", "total", "ends", "closed", "left_bytes", "left_count"])

    begin, state = {}, (first_shard, 0, 0)
    lists = ", ".join(f"{c} array<long>" for c in ("ends", "closed", "left_bytes", "left_count"))
    for part, *found in sorted(map(tuple, placed.mapInArrow(cuts, f"part long, n long, total long, {lists}").collect())):
        begin[part] = state
        state = shards_after(state, limit, most, *found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if shard is None:
                shard, size, count = begin[batch.column(2)[0].as_py()]
            out = []
            for n in batch.column(1).to_pylist():
                out.append(shard)
                size, count = size + n, count + 1
                if size >= limit or count >= most:
                    shard, size, count = shard + 1, 0, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=["key", "size", "shard"])

    found = placed.mapInArrow(run, "key long, size long, shard long")
    return found.select(F.col("key").alias(order_key), F.col("size").alias(size_column), F.col("shard").cast("int").alias("shard_index"), F.format_string("shard_%05d", F.col("shard")).alias("shard_name"))


def manifest_rows(sharded: DataFrame, length: int) -> DataFrame:
    """A row a shard: name, index, sequences, estimated bytes, padded and real tokens."""
    n = F.count("*")
    return sharded.groupBy("shard_name", "shard_index").agg(n.alias("num_sequences"), (n * length * TOKEN_BYTES).alias("size_bytes"), (n * length).alias("total_tokens_padded"), F.sum("real_tokens").alias("total_tokens_real"))


def manifest_totals(rows: DataFrame, output_format: str = "parquet") -> DataFrame:
    """One row from manifest_rows: next shard index as num_shards, and sums."""
    return rows.agg(
        F.lit(output_format).alias("output_format"),
        F.coalesce(F.max("shard_index") + 1, F.lit(0)).alias("num_shards"),
        F.coalesce(F.sum("num_sequences"), F.lit(0)).alias("total_sequences"),
        F.coalesce(F.sum("total_tokens_padded"), F.lit(0)).alias("total_tokens_padded"),
        F.coalesce(F.sum("total_tokens_real"), F.lit(0)).alias("total_tokens_real"),
    )


def write_shards(sharded: DataFrame, path: str, output_format: str = "parquet") -> None:
    """A folder (arrow: a file) a shard, one task each: parquet, json (lines) or arrow.

    Writing again replaces what was there.  What a killed or repeated task leaves is never read: Spark commits parquet
    and json by task, and an arrow sink lists its committed files.
    """
    ordered = sharded.repartition("shard_index").sortWithinPartitions("shard_index", "seq_no")
    if output_format == "arrow":
        register(sharded.sparkSession)
        ordered.write.format("arrow_shards").mode("overwrite").option("path", path).save()
    else:
        ordered.write.mode("overwrite").partitionBy("shard_index").format(output_format).save(path)


def write_manifest(rows: DataFrame, path: str, created_at: str, output_format: str = "parquet") -> None:
    """manifest_rows as JSON lines under `path`/shards, in the order of shards, and the totals under `path`/totals.

    The totals come last: a manifest without them is not finished.
    """
    rows.sort("shard_index").write.mode("overwrite").json(f"{path}/shards")
    totals = manifest_totals(rows.sparkSession.read.schema(rows.schema).json(f"{path}/shards"), output_format)
    totals.withColumn("created_at", F.lit(created_at)).coalesce(1).write.mode("overwrite").json(f"{path}/totals")


def next_shard(spark: SparkSession, path: str, fallback: int = 0) -> int:
    """Where a resumed run goes on: the manifest's num_shards, or `fallback` without a finished manifest."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/totals/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return fallback
    return int(spark.read.json(f"{path}/totals").first()["num_shards"])


def append_log(spark: SparkSession, record: dict, path: str) -> None:
    """Adds a JSON line to a log folder."""
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(path)
