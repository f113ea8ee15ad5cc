"""A lasting set of content hashes that have been seen (O-43): increments in buckets, and a Bloom filter a bucket.

A version of the set is one more increment of hashes and the filters over all increments.  Filters have a fixed size,
`buckets` x `bits` / 8 bytes, whatever the set holds, so every task has them; what they do not know is new without any
exchange, and only (key, hash) of the rest is joined with the buckets.  A version is there once its filters' _SUCCESS is,
which comes last; writing a version again replaces it, so a repeated run changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.operators.shared import cut, tasks

#: Bits that a hash sets, each from eight of its hexadecimal digits; its bucket comes from the two last ones.
PROBES = 4
BUCKETS = 256
FILTER = "bucket int, bits binary"


@dataclass(frozen=True)
class SeenSet:
    """A set at `path`.  bits: bits of a bucket's filter, a power of two; a filter of eight bits a hash lets one new hash in forty through."""

    path: str
    bits: int = 1 << 20

    def __post_init__(self) -> None:
        if self.bits < 8 or self.bits & (self.bits - 1):
            raise ValueError("bits is a power of two, 8 at least")

    def versions(self, spark: SparkSession) -> list[int]:
        """Finished versions."""
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/filters")
        store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(place):
            return []
        found = (status.getPath() for status in store.listStatus(place))
        return sorted(int(p.getName().split("=")[1]) for p in found if store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def hashes(self, spark: SparkSession) -> DataFrame | None:
        """h, bucket of all finished versions; null without any."""
        done = self.versions(spark)
        return spark.read.schema("h string, bucket int").option("basePath", f"{self.path}/hashes").parquet(*(f"{self.path}/hashes/version={v}" for v in done)).select("h", "bucket") if done else None

    def filters(self, spark: SparkSession) -> dict[int, bytes]:
        """Bits by bucket of the last version, at most BUCKETS x bits / 8 bytes."""
        done = self.versions(spark)
        return {r.bucket: bytes(r.bits) for r in spark.read.schema(FILTER).parquet(f"{self.path}/filters/version={done[-1]}").collect()} if done else {}

    def add(self, hashes: DataFrame, version: int | None = None) -> int:
        """Adds distinct hashes (column h, hexadecimal SHA-256) as a version, the next one if none is named; its number.

        Only the newest version may be written again.
        """
        spark, bits = hashes.sparkSession, self.bits
        done = self.versions(spark)
        version = (done[-1] + 1 if done else 0) if version is None else version
        if done and version < done[-1]:
            raise ValueError(f"version {version} is older than {done[-1]}")
        rows = hashes.where("h is not null and h <> ''").select("h", bucket_of(F.col("h")).alias("bucket")).distinct()
        rows.repartition(tasks(spark), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/hashes/version={version}")
        fresh = spark.read.schema("h string, bucket int").parquet(f"{self.path}/hashes/version={version}").select("bucket", "h")
        older = [v for v in done if v < version]
        before = spark.read.schema(FILTER).parquet(f"{self.path}/filters/version={older[-1]}") if older else spark.createDataFrame([], FILTER)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                bucket = np.asarray(batch.column(0))
                at = probes(batch.column(1), bits)
                for k in np.unique(bucket).tolist():
                    held.setdefault(k, np.zeros(bits, dtype=bool))[at[bucket == k]] = True
            for k, table in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(table).tobytes()], pa.binary())], names=["bucket", "bits"])

        # A bucket is dealt to one task, which holds its filter; hashes of a bucket come as a stream.
        found = fresh.repartition(tasks(spark), "bucket").mapInArrow(run, FILTER)

        def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    mine = np.frombuffer(raw.as_buffer(), dtype=np.uint8)
                    held[k] = held[k] | mine if k in held else mine
            for k, raw in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([raw.tobytes()], pa.binary())], names=["bucket", "bits"])

        found.unionByName(before).repartition(tasks(spark), "bucket").mapInArrow(either, FILTER).write.mode("overwrite").parquet(f"{self.path}/filters/version={version}")
        return version


def bucket_of(h: Column) -> Column:
    return F.conv(F.right(h, F.lit(2)), 16, 10).cast("int")


def probes(hashes: pa.Array, bits: int) -> np.ndarray:
    """Places in a filter, PROBES a hash, from its hexadecimal digits."""
    raw = np.frombuffer(b"".join(bytes.fromhex(h)[: 4 * PROBES] for h in hashes.to_pylist()), dtype="<u4")
    return raw.reshape(-1, PROBES).astype(np.int64) & (bits - 1)


def marked(narrow: DataFrame, seen: SeenSet) -> DataFrame:
    """key, h, maybe: whether the filters know a row's hash.  No exchange."""
    spark, bits = narrow.sparkSession, seen.bits
    sent = spark.sparkContext.broadcast(seen.filters(spark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: np.unpackbits(np.frombuffer(v, dtype=np.uint8)).astype(bool) for k, v in sent.value.items()}
        for batch in batches:
            bucket, at = np.array([int(h[-2:], 16) for h in batch.column(1).to_pylist()], dtype=np.int64), probes(batch.column(1), bits)
            maybe = np.zeros(batch.num_rows, dtype=bool)
            for k in np.unique(bucket).tolist():
                if k in tables:
                    maybe[bucket == k] = tables[k][at[bucket == k]].all(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maybe)], names=["key", "h", "maybe"])

    return narrow.mapInArrow(run, f"key {narrow.schema['key'].dataType.simpleString()}, h string, maybe boolean")


def unseen_keys(df: DataFrame, seen: SeenSet, order_key: str, text_column: str = "text", normalize: bool = True) -> DataFrame:
    """`order_key` of the rows whose content hash is not in the set; null texts are new.

    Texts are read once; keys and hashes are written once, and only those that the filters know meet the buckets.
    """
    narrow = df.select(F.col(order_key).alias("key"), tx.content_hash(F.coalesce(text_column, F.lit("")), normalize).alias("h"), F.col(text_column).isNull().alias("absent"))
    hashes = seen.hashes(df.sparkSession)
    if hashes is None:
        return df.select(order_key)
    checked = cut(marked(narrow.where("not absent").select("key", "h"), seen))
    new = checked.where("not maybe").select("key")
    rest = checked.where("maybe").withColumn("bucket", bucket_of(F.col("h"))).join(hashes, ["bucket", "h"], "left_anti").select("key")
    return new.unionByName(rest).unionByName(narrow.where("absent").select("key")).withColumnRenamed("key", order_key)
