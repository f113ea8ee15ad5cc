"""Stateful steps of the streaming build: the first row of each content by an order key, and packing with a carried record.

Both keep RocksDB state by key and survive restarts from the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from siltstone.functions import text as tx
from siltstone.functions.tokens import Tokenizer
from siltstone.operators.packing import IGNORED

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocks(spark: SparkSession) -> None:
    """Stateful processors need this store; queries that are already running keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class FirstByOrder(StatefulProcessor):
    """Of the rows of a key that come within `wait` of the first, the one with the least order value, once the watermark has passed."""

    def __init__(self, schema: StructType, order_key: str, wait: int, forget: int | None):
        self.columns, self.order_key, self.wait, self.forget = schema.names, order_key, wait, forget
        self.schema = schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best, self.settled = handle.getValueState("best", self.schema), handle.getValueState("settled", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, first = self.columns.index(self.order_key), None
        settled = self.settled.exists()
        if settled and self.forget is not None and (until := self.settled.get()[0] + self.forget) <= timerValues.getCurrentWatermarkInMs():
            # The mark's time is over, whether its timer has had its turn or not.
            self.handle.deleteTimer(until)
            self.settled.clear()
            settled = False
        best = None if settled or not self.best.exists() else tuple(self.best.get())
        known = best is not None
        for part in rows:
            if settled:
                continue
            row = part.loc[part[self.order_key].idxmin(), [*self.columns, "event_ms"]]
            seen = int(part["event_ms"].min())
            first = seen if first is None else min(first, seen)
            if best is None or row[self.order_key] < best[at]:
                best = tuple(x.item() if isinstance(x, np.generic) else x for x in row[self.columns])
        if best is not None:
            self.best.update(best)
            if not known:
                self.handle.registerTimer(first + self.wait)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.best.exists():
            self.settled.clear()
            return
        row = self.best.get()
        self.best.clear()
        self.settled.update((expiredTimerInfo.getExpiryTimeInMs(),))
        if self.forget is not None:
            self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.forget)
        yield pd.DataFrame([tuple(row)], columns=self.columns)

    def close(self) -> None:
        return


def firsts_by_order(docs: DataFrame, order_key: str, event_time: str, wait_ms: int, columns: list[str] | None = None, key: Column | None = None, forget_ms: int | None = None) -> DataFrame:
    """The row with the least `order_key` of each content hash, out of those whose event times lie within `wait_ms` of the first to arrive.

    It comes out once the watermark is `wait_ms` past that first row, so arrivals may be in any order within the wait, and
    the result is that of the batch build.  Rows older than the watermark (the latest event time less `wait_ms`) are too late
    and are left out, as are later copies of a content that has come out; its mark stays for good, or for `forget_ms`, after
    which a copy counts as new.  State is one row a content that waits and one number a content that has come out.
    Columns of `docs` may not be called content_key or event_ms.  `columns` (all by default) travel in the state, the order key and event time among them or not.
    """
    with_rocks(docs.sparkSession)
    columns = columns or docs.columns
    kept = list(dict.fromkeys([*columns, order_key]))
    schema = StructType([StructField(f.name, f.dataType) for c in kept for f in docs.schema.fields if f.name == c])
    hashed = tx.content_hash(F.col("text")) if key is None else key
    rows = docs.withWatermark(event_time, f"{wait_ms} milliseconds").withColumns({"content_key": hashed, "event_ms": F.unix_millis(event_time)})
    rows = rows.select("content_key", "event_ms", *dict.fromkeys([event_time, *kept]))
    return rows.groupBy("content_key").transformWithStateInPandas(FirstByOrder(schema, order_key, wait_ms, forget_ms), schema, "Append", "EventTime").select(*columns)


PACKED = "lane long, seq long, input_ids array<int>, labels array<int>, attention_mask array<tinyint>, doc_starts array<int>"


class Packer(StatefulProcessor):
    """Next-fit with the open record as state."""

    def __init__(self, tokenizer: Tokenizer, order_key: str, length: int, least_tokens: int, flush: int | None):
        self.tokenizer, self.order_key, self.length, self.least_tokens, self.flush = tokenizer, order_key, length, least_tokens, flush

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "seq long, ids array<int>, starts array<int>")

    def record(self, lane: int, seq: int, ids: list[int], starts: list[int]) -> tuple:
        gap = self.length - len(ids)
        return lane, seq, ids + [self.tokenizer.padding] * gap, ids + [IGNORED] * gap, [1] * len(ids) + [0] * gap, starts

    def frame(self, records: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(records, columns=[part.split(" ")[0] for part in PACKED.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        lane, length = int(key[0]), self.length
        seq, ids, starts = self.open.get() if self.open.exists() else (0, [], [])
        ids, starts, out = list(ids), list(starts), []
        # The rows of one micro-batch and lane, in order.
        arrived = pd.concat(list(rows)).sort_values(self.order_key, kind="stable")
        for body in arrived["body"]:
            found = np.asarray(self.tokenizer.encode(body), dtype=np.int32).tolist()
            if len(found) + 1 < self.least_tokens:
                continue
            found = [*found[: length - 1], self.tokenizer.eos]
            if ids and len(ids) + len(found) > length:
                out.append(self.record(lane, seq, ids, starts))
                seq, ids, starts = seq + 1, [], []
            starts.append(len(ids))
            ids += found
            if len(ids) == length:
                out.append(self.record(lane, seq, ids, starts))
                seq, ids, starts = seq + 1, [], []
            if len(out) >= 64:
                yield self.frame(out)
                out = []
        self.open.update((seq, ids, starts))
        if self.flush is not None:
            latest = int(arrived["event_ms"].max())
            for timer in list(self.handle.listTimers()):
                latest = max(latest, timer - self.flush)
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(latest + self.flush)
        if out:
            yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seq, ids, starts = self.open.get()
        if ids:
            self.open.update((seq + 1, [], []))
            yield self.frame([self.record(int(key[0]), seq, list(ids), list(starts))])

    def close(self) -> None:
        return


def packed(docs: DataFrame, tokenizer: Tokenizer, order_key: str, length: int, lanes: int = 1, lane: Column | None = None, least_tokens: int = 5, event_time: str | None = None, flush_ms: int | None = None) -> DataFrame:
    """Packed records of a stream of texts, each of `lanes` lanes one next-fit stream whose open record is carried from batch to batch.

    Documents of a micro-batch are packed in the order of `order_key`, micro-batches as they come; with one lane and files
    in that order, the records are those of the batch build.  A record comes out when it is closed; with `event_time` and
    `flush_ms`, also once the watermark is that far past the lane's latest row.  A task holds a lane's rows of one
    micro-batch, so their number follows the files a trigger takes and the lanes.
    """
    if (event_time is None) != (flush_ms is None):
        raise ValueError("event_time and flush_ms go together")
    with_rocks(docs.sparkSession)
    lane = F.pmod(F.xxhash64(order_key), F.lit(lanes)) if lane is None else lane
    rows = docs if event_time is None else docs.withWatermark(event_time, f"{flush_ms} milliseconds")
    extra = [] if event_time is None else [event_time, F.unix_millis(event_time).alias("event_ms")]
    rows = rows.select(lane.cast("long").alias("lane"), F.col(order_key), F.coalesce("text", F.lit("")).alias("body"), *extra)
    mode = "None" if event_time is None else "EventTime"
    return rows.groupBy("lane").transformWithStateInPandas(Packer(tokenizer, order_key, length, least_tokens, flush_ms), PACKED, "Append", mode)
