"""Packing token sequences into records of fixed length, next-fit (O-53 to O-56).

Next-fit is sequential: where a record ends depends on all before it.  What a range of documents does to the open record
is a function, though, from the fill at its start to the records it closes and the fill at its end, and functions compose.
So every range's function is computed at once, one small table a range is composed in order, and every range packs from
the fill that the ranges before it leave.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import fim
from siltstone.functions import text as tx
from siltstone.functions.tokens import BYTES, Tokenizer, byte_token_count
from siltstone.operators.shared import cut, tasks

#: Fixed value: the label that a loss ignores.
IGNORED = -100
#: Up to so many record numbers go to every task, about 40 MB; beyond, texts and numbers meet in a shuffled join.
BROADCAST_NUMBERS = 1_000_000


def next_fit(sizes: np.ndarray, length: int) -> np.ndarray:
    """The sequence of each document.  A document never spans two; one longer than `length` counts as `length`."""
    out, seq, used = np.zeros(len(sizes), dtype=np.int64), 0, 0
    for k, n in enumerate(np.minimum(sizes, length)):
        if used and used + n > length:
            seq, used = seq + 1, 0
        out[k] = seq
        used += n
        if used >= length:
            # A record that is exactly full is closed at once, which shows in the number of the next one only.
            seq, used = seq + 1, 0
    return out


class FillMap:
    """What a run of documents does to the open record, for every fill 0 to length - 1 at its start.

    `closed` is the number of records that it closes.  `fill` is the fill at its end; where nothing is closed, it is the
    fill at the start and `total` more.
    """

    def __init__(self, length: int, closed: np.ndarray | None = None, fill: np.ndarray | None = None):
        self.length = length
        self.closed = np.zeros(length, dtype=np.int64) if closed is None else closed
        self.fill = np.arange(length, dtype=np.int64) if fill is None else fill

    @classmethod
    def of(cls, sizes: np.ndarray, length: int) -> FillMap:
        """The map of one run; sizes are at most `length`."""
        n, ends = len(sizes), np.concatenate([[0], np.cumsum(sizes)])

        def opened(room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The document that begins the next record where the sum may reach `room`, and whether one begins in the run."""
            exact = np.minimum(np.searchsorted(ends, room, side="left"), n)
            full = ends[exact] == room
            at = np.where(full, exact, np.searchsorted(ends, room, side="right") - 1)
            return at, full | (at < n)

        # A record that begins at document k: those it is followed by and the fill at the end, from the last document back.
        at, begins = opened(ends[:-1] + length)
        left = (ends[-1] - ends).tolist()
        count = [0] * (n + 1)
        for k, (b, more) in enumerate(zip(at[::-1].tolist(), begins[::-1].tolist(), strict=True)):
            k = n - 1 - k
            if more:
                count[k], left[k] = count[b] + 1, left[b]
        count, left = np.array(count, dtype=np.int64), np.array(left, dtype=np.int64)
        start = np.arange(length)
        at, begins = opened(length - start)
        return cls(length, np.where(begins, count[at] + 1, 0), np.where(begins, left[at], start + ends[-1]))

    def then(self, later: FillMap) -> FillMap:
        return FillMap(self.length, self.closed + later.closed[self.fill], later.fill[self.fill])

    def steps(self) -> tuple[list[int], list[int], list[int]]:
        """Fills at which closed or the end (less the start, where nothing is closed) change, with both: a few, since runs that close records forget their start."""
        end = np.where(self.closed == 0, self.fill - np.arange(self.length), self.fill)
        change = np.ones(self.length, dtype=bool)
        change[1:] = (self.closed[1:] != self.closed[:-1]) | (end[1:] != end[:-1])
        at = np.flatnonzero(change)
        return at.tolist(), self.closed[at].tolist(), end[at].tolist()


def filled(fill: int, starts: list[int], closed: list[int], end: list[int]) -> tuple[int, int]:
    """Records closed and the fill at the end, from the steps of a map."""
    k = bisect_right(starts, fill) - 1
    return closed[k], end[k] + (fill if closed[k] == 0 else 0)


def stream_sequences(docs: DataFrame, order_key: str, length: int, size_column: str = "tokens") -> DataFrame:
    """key, tokens (after truncation), seq_no: next-fit over all documents as one stream in the order of `order_key`, which is unique.

    Keys and sizes are written once, in ranges.  A task holds a batch of rows and one map of `length` entries; a few steps a
    range reach the driver.
    """
    narrow = docs.select(F.col(order_key).cast("long").alias("key"), F.col(size_column).cast("long").alias("tokens"))
    placed = cut(narrow.repartitionByRange(tasks(docs.sparkSession), "key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id().cast("long")))

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = FillMap(length), None
        for batch in batches:
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
                total = total.then(FillMap.of(np.minimum(batch.column(1).to_numpy(), length), length))
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, *total.steps())], names=["part", "starts", "closed", "ends"])

    begin, fill, seq = {}, 0, 0
    for r in sorted(placed.mapInArrow(maps, "part long, starts array<long>, closed array<long>, ends array<long>").collect(), key=lambda r: r.part):
        begin[r.part] = (fill, seq)
        more, fill = filled(fill, r.starts, r.closed, r.ends)
        seq += more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = seq = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if used is None:
                used, seq = begin[batch.column(2)[0].as_py()]
            sizes = np.minimum(batch.column(1).to_numpy(), length)
            # The open record counts as one more document in front.
            place = next_fit(np.concatenate([[used], sizes]), length)
            last = np.searchsorted(place, place[-1])
            out = seq + place[1:]
            # A batch that ends on a full record leaves an empty one.
            used, seq = int(np.concatenate([[used], sizes])[last:].sum()), seq + int(place[-1])
            if used >= length:
                used, seq = 0, seq + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(out)], names=["key", "tokens", "seq_no"])

    return placed.mapInArrow(run, "key long, tokens long, seq_no long")


def assign_sequences(docs: DataFrame, order_key: str, length: int, group: Column | None = None, size_column: str = "tokens") -> DataFrame:
    """group, key, tokens (after truncation), seq (in its group).

    Without `group`, all documents are one stream, as stream_sequences packs it.  A group is packed in order in one task,
    so it should hold a few thousand documents: state a range of the order key.  Groups add at most one partly filled record
    each.
    """
    if group is None:
        return stream_sequences(docs, order_key, length, size_column).select(F.lit(0).cast("long").alias("group"), "key", "tokens", F.col("seq_no").alias("seq"))
    narrow = docs.select(group.cast("long").alias("group"), F.col(order_key).cast("long").alias("key"), F.col(size_column).cast("long").alias("tokens"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable").reset_index(drop=True)
        return pdf.assign(seq=next_fit(pdf["tokens"].to_numpy(), length), tokens=np.minimum(pdf["tokens"], length))

    return narrow.groupBy("group").applyInPandas(run, "group long, key long, tokens long, seq long")


def global_sequence(assigned: DataFrame) -> DataFrame:
    """Adds seq_no, numbered over groups in order.  The window holds one row a group."""
    sizes = assigned.groupBy("group").agg((F.max("seq") + 1).alias("n"))
    starts = sizes.select("group", F.coalesce(F.sum("n").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return assigned.join(starts, "group").withColumn("seq_no", F.col("start") + F.col("seq")).drop("start")


def packing_stats(assigned: DataFrame, length: int) -> DataFrame:
    """total_sequences, total_docs_packed, total_tokens_packed, total_padding_tokens, padding_ratio, avg_docs_per_seq."""
    by_seq = assigned.groupBy("group", "seq").agg(F.sum("tokens").alias("real"), F.count("*").alias("docs"))
    total = by_seq.agg(F.count("*").alias("total_sequences"), F.coalesce(F.sum("docs"), F.lit(0)).alias("total_docs_packed"), F.coalesce(F.sum("real"), F.lit(0)).alias("total_tokens_packed"))
    padding = F.col("total_sequences") * length - F.col("total_tokens_packed")
    return total.select("*", padding.alias("total_padding_tokens"), tx.ratio(padding, F.col("total_sequences") * length).alias("padding_ratio"), tx.ratio(F.col("total_docs_packed"), F.col("total_sequences")).alias("avg_docs_per_seq"))


def padded(ids: Column, length: int, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(ids), F.lit(0))))


def packed_record(ids: Column, length: int, pad: int) -> Column:
    """struct<input_ids, labels, attention_mask>: ids padded, labels ignored on padding, 1 for real tokens."""
    gap = F.greatest(F.lit(length) - F.size(ids), F.lit(0))
    one, zero = F.lit(1).cast("tinyint"), F.lit(0).cast("tinyint")
    return F.struct(padded(ids, length, pad).alias("input_ids"), F.concat(ids, F.array_repeat(F.lit(IGNORED), gap)).alias("labels"), F.concat(F.array_repeat(one, F.size(ids)), F.array_repeat(zero, gap)).alias("attention_mask"))


PACKED = "group long, seq long, input_ids array<int>, labels array<int>, attention_mask array<tinyint>, doc_starts array<int>"


class Records:
    """Packed records of fixed length, as one Arrow batch."""

    def __init__(self, length: int, pad: int):
        self.length, self.pad, self.rows = length, pad, []

    def add(self, group: int, seq: int, ids: np.ndarray, starts: list[int]) -> None:
        self.rows.append((group, seq, ids, starts))

    def batch(self) -> pa.RecordBatch:
        """The records so far, which are then forgotten."""
        n, length = len(self.rows), self.length
        ids, labels, mask = np.full((n, length), self.pad, dtype=np.int32), np.full((n, length), IGNORED, dtype=np.int32), np.zeros((n, length), dtype=np.int8)
        for k, (_, _, held, _) in enumerate(self.rows):
            ids[k, : len(held)] = labels[k, : len(held)] = held
            mask[k, : len(held)] = 1
        every = pa.array(np.arange(n + 1, dtype=np.int32) * length)
        full = [pa.ListArray.from_arrays(every, pa.array(x.reshape(-1))) for x in (ids, labels, mask)]
        columns = [pa.array([r[0] for r in self.rows], pa.int64()), pa.array([r[1] for r in self.rows], pa.int64()), *full, pa.array([r[3] for r in self.rows], pa.list_(pa.int32()))]
        self.rows = []
        return pa.RecordBatch.from_arrays(columns, names=["group", "seq", "input_ids", "labels", "attention_mask", "doc_starts"])


def bodies(docs: DataFrame, order_key: str, text_column: str, fim_rate: float, code_sources: tuple[str, ...], seed: int = 42, compat: bool = False) -> Column:
    """The text that is packed: null as empty, rearranged for fill-in-the-middle for a share of the code rows."""
    body = F.coalesce(F.col(text_column), F.lit(""))
    if fim_rate and "source" in docs.columns:
        body = fim.maybe_fim(body, F.col("source"), F.col(order_key), fim_rate, seed, code_sources, compat)
    return body


def token_counts(tokenizer: Tokenizer, body: Column) -> Column:
    """Tokens of a body with the end mark, without making them where the tokenizer allows."""
    if tokenizer is BYTES:
        return byte_token_count(body)
    encode = tokenizer.encode

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([len(encode(x or "")) + 1 for x in texts.to_pylist()], pa.int64())

    return run(body)


def packed_stream(docs: DataFrame, tokenizer: Tokenizer, order_key: str, length: int, text_column: str = "text", fim_rate: float = 0.0, code_sources: tuple[str, ...] = ("code",), seed: int = 42, compat: bool = False, least_tokens: int = 5, most_records: int | None = None, batch_records: int = 256, group: Column | None = None, counts: DataFrame | None = None, broadcast_numbers: int = BROADCAST_NUMBERS) -> DataFrame:
    """The records of packed_dataset with seq from 0 over the whole table: all documents as one stream, or one of each `group`, in order.

    Records are numbered from keys and token counts alone; texts then go to the task of their record, and only those of
    the first `most_records` are moved and encoded.  A task holds one open record and at most `batch_records` closed ones.
    `counts` states order key and packed_tokens (of token_counts) of the documents to pack, where they are known: texts
    are not read for them, `group` is made from its columns, and `docs` may hold more rows, which are left out.
    """
    part, key = F.lit(0) if group is None else group, F.col(order_key).cast("long").alias("key")
    body = bodies(docs, order_key, text_column, fim_rate, code_sources, seed, compat)
    sized = docs.withColumn("packed_tokens", token_counts(tokenizer, body)) if counts is None else counts
    counts = sized.select(part.cast("long").alias("group"), key, F.col("packed_tokens").alias("tokens")).where(F.col("tokens") >= least_tokens)
    numbered = stream_sequences(counts, "key", length) if group is None else global_sequence(cut(assign_sequences(counts, "key", length, F.col("group"))))
    numbered = numbered.select("key", "seq_no")
    if most_records is not None:
        numbered = numbered.where(F.col("seq_no") < most_records)
    # With numbers few enough for every task, only texts that are kept are shuffled, and once.
    numbered = cut(numbered)
    if numbered.count() <= broadcast_numbers:
        numbered = F.broadcast(numbered)
    encode, eos, pad = tokenizer.encode, tokenizer.eos, tokenizer.padding
    # Dealt by hash: ranges would be sampled first, which reads and joins all texts once more.
    dealt = docs.select(key, body.alias("body")).join(numbered, "key").repartition(tasks(docs.sparkSession), "seq_no").sortWithinPartitions("seq_no", "key").select("seq_no", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, used, starts, seq = Records(length, pad), np.empty(length, dtype=np.int32), 0, [], None
        for batch in batches:
            for number, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if number != seq:
                    if used:
                        out.add(0, seq, held[:used].copy(), starts)
                        if len(out.rows) >= batch_records:
                            yield out.batch()
                    used, starts, seq = 0, [], number
                ids = np.asarray(encode(body.as_py()), dtype=np.int32)
                n = min(len(ids) + 1, length)
                starts.append(used)
                held[used : used + n - 1] = ids[: n - 1]
                held[used + n - 1] = eos
                used += n
        if used:
            out.add(0, seq, held[:used].copy(), starts)
        if out.rows:
            yield out.batch()

    return dealt.mapInArrow(run, PACKED).drop("group")


def packed_dataset(docs: DataFrame, tokenizer: Tokenizer, order_key: str, length: int, group: Column | None = None, text_column: str = "text", fim_rate: float = 0.0, code_sources: tuple[str, ...] = ("code",), seed: int = 42, compat: bool = False, least_tokens: int = 5, batch_records: int = 256) -> DataFrame:
    """Packed records of whole documents: FIM for a share of code rows, tokens with end mark, documents under `least_tokens` left out.

    Without `group`, all documents are one stream (packed_stream); with it, each group is.  doc_starts lists where
    documents begin in a record.  `compat` turns FIM off.  Texts, not ids, go through the
    exchange; a task holds one open record and at most `batch_records` closed ones.
    """
    body = bodies(docs, order_key, text_column, fim_rate, code_sources, seed, compat)
    if group is None:
        return packed_stream(docs, tokenizer, order_key, length, text_column, fim_rate, code_sources, seed, compat, least_tokens, None, batch_records).select(F.lit(0).cast("long").alias("group"), "*")
    rows = docs.select(group.cast("long").alias("group"), F.col(order_key).cast("long").alias("key"), body.alias("body"))
    encode, eos, pad = tokenizer.encode, tokenizer.eos, tokenizer.padding
    dealt = rows.repartition("group").sortWithinPartitions("group", "key").select("group", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, used, starts, group, seq = Records(length, pad), np.empty(length, dtype=np.int32), 0, [], None, 0

        def close() -> None:
            nonlocal used, starts, seq
            out.add(group, seq, held[:used].copy(), starts)
            used, starts, seq = 0, [], seq + 1

        for batch in batches:
            for g, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.asarray(encode(body.as_py()), dtype=np.int32)
                if len(ids) + 1 < least_tokens:
                    continue
                n = min(len(ids) + 1, length)
                if used and (g != group or used + n > length):
                    close()
                if g != group:
                    group, seq = g, 0
                starts.append(used)
                held[used : used + n - 1] = ids[: n - 1]
                held[used + n - 1] = eos
                used += n
                if used == length:
                    close()
                if len(out.rows) >= batch_records:
                    yield out.batch()
        if used:
            close()
        if out.rows:
            yield out.batch()

    return dealt.mapInArrow(run, PACKED)
