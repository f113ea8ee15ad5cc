"""Shuffled batches of Arrow shards as an endless stream (O-60): offsets are epoch and batch, and read-ahead is bounded.

An epoch is a permutation of all rows by a keyed Feistel network, which gives any place of it without a list of the
others; a batch is a run of that permutation, read by one task from the record batches that hold its rows.  The last rows
of an epoch that fill no batch are left out, as batches of a training step have one size; fewer rows than one batch are an
error.  A trigger takes `ahead` batches at most, and Spark asks for more once those are worked off.

Spark's interface asks for the latest offset without naming the one a query starts from, so the batches planned are noted
in the `progress` file, which a query that starts again reads: none is skipped and none is given twice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from siltstone.sources import arrow_ipc

ROUNDS = 6


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """64-bit finaliser over values and a key, on unsigned arrays."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def permuted(places: np.ndarray, n: int, seed: int, epoch: int) -> np.ndarray:
    """The rows at given places of an epoch's permutation of 0 to n - 1.

    A Feistel network permutes the least even power of two that holds n; places that fall outside are walked on until they
    are inside, four steps at most on average.
    """
    half = max((max(n - 1, 1).bit_length() + 1) // 2, 1)
    mask = np.uint64((1 << half) - 1)
    keys = [int(k) for k in _mixed(np.arange(ROUNDS, dtype=np.uint64), (seed * 1_000_003 + epoch * 2 + 1) % 2**63)]
    out, open_ = places.astype(np.uint64), np.ones(len(places), dtype=bool)
    while open_.any():
        left, right = out[open_] >> np.uint64(half), out[open_] & mask
        for key in keys:
            left, right = right, left ^ (_mixed(right, key % 2**63) & mask)
        out[open_] = (left << np.uint64(half)) | right
        open_ = out >= n
    return out.astype(np.int64)


class EpochBatch(InputPartition):
    def __init__(self, epoch: int, batch: int):
        self.epoch, self.batch = epoch, batch


class EpochReader(DataSourceStreamReader):
    def __init__(self, path: str, columns: list[str], size: int, seed: int, ahead: int, epochs: int | None, progress: str):
        self.path, self.columns, self.size, self.seed, self.ahead, self.epochs, self.progress = path, columns, size, seed, ahead, epochs, progress
        self.rows = {file: rows for file, rows in arrow_ipc.batch_rows(path).items()}
        self.n = sum(map(sum, self.rows.values()))
        if not 0 < size <= self.n:
            raise ValueError(f"a batch of {size} cannot be filled from {self.n} rows")
        if ahead < 1:
            raise ValueError("a trigger takes one batch at least")
        self.each = self.n // size
        self.at = self._noted()

    def _noted(self) -> int:
        store, place = arrow_ipc.located(self.progress)
        return arrow_ipc.read_json(store, place)["batches"] if store.get_file_info(place).type == pyarrow.fs.FileType.File else 0

    def _offset(self, total: int) -> dict:
        return {"epoch": total // self.each, "batch": total % self.each}

    def _total(self, offset: dict) -> int:
        return offset["epoch"] * self.each + offset["batch"]

    def initialOffset(self) -> dict:
        return self._offset(0)

    def latestOffset(self) -> dict:
        # Spark asks again once what it got is worked off.
        last = self.at + self.ahead
        self.at = last if self.epochs is None else min(last, self.epochs * self.each)
        return self._offset(self.at)

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        first, last = self._total(start), self._total(end)
        self.at = max(self.at, last)
        store, place = arrow_ipc.located(self.progress)
        store.create_dir(place.rpartition("/")[0], recursive=True)
        arrow_ipc.write_json(store, place, {"batches": max(last, self._noted())})
        return [EpochBatch(*divmod(k, self.each)) for k in range(first, last)]

    def read(self, partition: EpochBatch | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        place = np.arange(partition.batch * self.size, (partition.batch + 1) * self.size)
        rows = permuted(place, self.n, self.seed, partition.epoch)
        parts, found, start = [], [], 0
        store, _ = arrow_ipc.located(self.path)
        own = [c for c in self.columns if c not in ("epoch", "batch_no", arrow_ipc.ROW)]
        for file, sizes in self.rows.items():
            if not ((rows >= start) & (rows < start + sum(sizes))).any():
                start += sum(sizes)
                continue
            with store.open_input_file(file) as source, pa.ipc.open_file(source) as reader:
                for k, n in enumerate(sizes):
                    mine = np.flatnonzero((rows >= start) & (rows < start + n))
                    if len(mine):
                        parts.append(reader.get_batch(k).select(own).take(pa.array(rows[mine] - start)))
                        found.append(mine)
                    start += n
        # Back into the order of the permutation.
        table = pa.Table.from_batches(parts).take(pa.array(np.argsort(np.concatenate(found)))).combine_chunks()
        extra = {"epoch": np.full(self.size, partition.epoch), "batch_no": np.full(self.size, partition.batch), arrow_ipc.ROW: rows}
        columns = [pa.array(extra[c]) if c in extra else table.column(c).combine_chunks() for c in self.columns]
        yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], names=self.columns)


class EpochBatches(DataSource):
    @classmethod
    def name(cls) -> str:
        return "epoch_batches"

    def schema(self) -> StructType:
        own = arrow_ipc.ArrowShards({"path": self.options["path"], "columns": self.options.get("columns", ""), arrow_ipc.ROW: "true"}).schema()
        return own.add("epoch", "long", False).add("batch_no", "long", False)

    def streamReader(self, schema: StructType) -> EpochReader:
        o = self.options
        epochs = int(o["epochs"]) if o.get("epochs") else None
        return EpochReader(o["path"], schema.names, int(o["batch"]), int(o.get("seed", "42")), int(o.get("ahead", "4")), epochs, o["progress"])


def epoch_batches(spark: SparkSession, path: str, progress: str, batch: int, seed: int = 42, ahead: int = 4, epochs: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """A stream of the rows of Arrow shards with row_no, epoch and batch_no: one permutation after another, for ever or for `epochs`.

    `progress` is a file of one query; give another query another one.
    """
    spark.dataSource.register(EpochBatches)
    options = {"path": path, "progress": progress, "batch": batch, "seed": seed, "ahead": ahead, "epochs": epochs or "", "columns": ",".join(columns or [])}
    return spark.readStream.format("epoch_batches").options(**options).load()
