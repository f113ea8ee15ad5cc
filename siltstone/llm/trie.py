"""Prefix trie of conversations by pointer jumping (operator 13).

1. Turns are put in order over ranges of (conversation, turn), and numbered by a scan: a task counts its own rows, and one
   row a task tells what the conversation at a task's start has counted before it.  No conversation has to fit a task.
2. A prefix is known by a digest of 128 bits: the sum of its turns' hashes, each mixed with its position.  Sums go over
   ranges in the same way, so a node and its parent are digests that no one has to walk to.
3. Nodes are groups of equal digests; conversations that hold one prefix meet in a partial aggregate.
4. A node's edge leads to its parent.  In round k an edge leads 2**k levels up and a node has gathered what lies fewer
   than 2**k levels below it; it hands that to the end of its edge, and then takes over the edge of that end.  The number of
   rounds is the logarithm of the greatest depth, and a round holds only the nodes at least 2**k deep.
5. The ids of the conversations that end at a node are joined in chunks over ranges, which one hash then takes in order.

Defined cases: null role or text is empty; turns of a conversation stand in the order of `turn`, null first, and those of
the same turn in the order of a hash of role and text; repeated turns count each.  Rows without conv_id belong to no
conversation and are left out.  Without conversations there is no root and no row.  Only conv_id, turn, role and text are
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import batch_of, cut, map_arrow, splitmix, task_count, whole_text

#: A node: its depth and the two halves of its digest.  The root's are zero.
KEY = ["depth", "d1", "d2"]
NO_END = hashlib.sha256(b"").hexdigest()


def _runs(conv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row at which each row's conversation begins, and its place in it from 0, within one batch."""
    new = np.ones(len(conv), dtype=bool)
    new[1:] = conv[1:] != conv[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(conv)), 0))
    return start, np.arange(len(conv)) - start


def _scan(batches: Iterator[pa.RecordBatch], count: int, sums: tuple[int, int]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches with each row's position from 1, its digest (n x 2) and its parent's; `count` and `sums` hold for the first conversation.

    Rows are conv_id, for digests the two hashes of a turn in columns 1 and 2, and their range in the last column.
    """
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0).to_numpy()
        start, place = _runs(conv)
        # What came before counts for the rows at the start of the batch that go on with the same conversation.
        goes_on = (start == 0) if last is None or conv[0] == last else np.zeros(len(conv), dtype=bool)
        position = place + 1 + np.where(goes_on, count, 0)
        digest = np.zeros((len(conv), 2), dtype=np.uint64)
        parent = digest.copy()
        if batch.num_columns > 3:
            with np.errstate(over="ignore"):
                for k in range(2):
                    own = splitmix(batch.column(1 + k).to_numpy().view(np.uint64) + splitmix(position.astype(np.uint64) + np.uint64(k << 62)))
                    total = np.cumsum(own, dtype=np.uint64)
                    digest[:, k] = total - total[start] + own[start] + np.where(goes_on, np.uint64(sums[k]), np.uint64(0))
                    parent[:, k] = digest[:, k] - own
        last, count, sums = conv[-1], int(position[-1]), (int(digest[-1, 0]), int(digest[-1, 1]))
        yield batch, position, digest, parent


_PART = pa.schema([("part", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("counted", pa.int64()), ("sum1", pa.int64()), ("sum2", pa.int64())])


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows in order over ranges, written once, with the range in `part`; a task that reads a range is not always numbered like it."""
    ranged = rows.repartitionByRange(task_count(rows.sparkSession), *order).sortWithinPartitions(*order)
    return cut(ranged.withColumn("part", F.spark_partition_id().cast("long")))


def peeked(batches: Iterator[pa.RecordBatch]) -> tuple[int | None, Iterator[pa.RecordBatch]]:
    """The range that a task's rows are from (the last column), and the rows."""
    batches = (b for b in batches if b.num_rows)
    first = next(batches, None)
    return (None, iter(())) if first is None else (first.column(first.num_columns - 1)[0].as_py(), chain([first], batches))


def carries(ordered: DataFrame, counts: dict[int, int] | None = None) -> dict[int, tuple[int, tuple[int, int]]]:
    """By task: what the conversation at its start has before it, as a count and a digest.  One row a task reaches the driver.

    Digests need positions, so they are right in a second call that is given the counts of the first.
    """
    counts = counts or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, batches = peeked(batches)
        first = end = None
        for batch, position, digest, _ in _scan(batches, counts.get(part, 0), (0, 0)):
            conv = batch.column(0).to_numpy()
            first = int(conv[0]) if first is None else first
            end = (int(conv[-1]), int(position[-1]), *(int(x) for x in digest[-1].view(np.int64)))
        if end:
            yield batch_of(_PART, [[x] for x in (part, first, *end)])

    found, before, conv, count, sums = {}, {}, None, 0, (0, 0)
    rows = map_arrow(ordered, run, "part long, first long, last long, counted long, sum1 long, sum2 long").collect()
    for r in sorted(rows):
        if r.first == conv:
            before[r.part] = (count, sums)
        same = r.last == conv
        # A count that was given holds what came before already.
        count = r.counted + (count if same and r.part not in counts else 0)
        sums = tuple((x + (y if same else 0)) % 2**64 for x, y in zip((r.sum1, r.sum2), sums, strict=True))
        conv = r.last
    found.update(before)
    return found


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, p (place in the conversation, from 1), m1, m2 (hashes of role and text), n_bytes of the text."""
    text, role = whole_text(), whole_text("role")
    hashes = [F.xxhash64(F.lit(k), role, text).alias(f"m{k}") for k in (1, 2)]
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *hashes, F.octet_length(text).cast("long").alias("n_bytes"))
    order = ["conv_id", "turn", "m1", "m2"]
    ordered = placed(rows, order).drop("turn")
    before = {part: count for part, (count, _) in carries(ordered.select("conv_id", "part")).items()}
    schema = pa.schema([(c, pa.int64()) for c in ("conv_id", "p", "m1", "m2", "n_bytes")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, batches = peeked(batches)
        for batch, position, _, _ in _scan(batches, before.get(part, 0), (0, 0)):
            yield batch_of(schema, [batch.column(0), position, *batch.columns[1:-1]])

    return map_arrow(ordered, run, "conv_id long, p long, m1 long, m2 long, n_bytes long")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, d1, d2, p1, p2 (the parent's digest), n_bytes: a row for each turn, as the node that ends with it."""
    ordered = placed(turns.select("conv_id", "p", "m1", "m2", "n_bytes"), ["conv_id", "p"]).drop("p")
    counts = {part: count for part, (count, _) in carries(ordered.select("conv_id", "part")).items()}
    sums = carries(ordered, counts)
    schema = pa.schema([(c, pa.int64()) for c in ("conv_id", *KEY, "p1", "p2", "n_bytes")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, batches = peeked(batches)
        _, before = sums.get(part, (0, (0, 0)))
        for batch, position, digest, parent in _scan(batches, counts.get(part, 0), before):
            digest, parent = digest.view(np.int64), parent.view(np.int64)
            yield batch_of(schema, [batch.column(0), position, digest[:, 0], digest[:, 1], parent[:, 0], parent[:, 1], batch.column(3)])

    return map_arrow(ordered, run, "conv_id long, depth long, d1 long, d2 long, p1 long, p2 long, n_bytes long")


def end_hashes(ends: DataFrame, chunk: int = 8_192) -> DataFrame:
    """depth, d1, d2, ends_sha256 of the decimal conv_ids that end at a node, ascending, joined by commas."""
    order = [*KEY, "conv_id"]
    rows = ends.select(*order).repartitionByRange(task_count(ends.sparkSession), *order).sortWithinPartitions(*order)
    joined = pa.schema([*((c, pa.int64()) for c in (*KEY, "least")), ("ids", pa.string())])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in range(4)]
            new = np.ones(batch.num_rows, dtype=bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:3]])
            start = np.maximum.accumulate(np.where(new, np.arange(batch.num_rows), 0))
            new |= (np.arange(batch.num_rows) - start) % chunk == 0
            at = np.flatnonzero(new)
            ids = columns[3].tolist()
            texts = [",".join(map(str, ids[a:b])) for a, b in zip(at, [*at[1:], len(ids)], strict=True)]
            yield batch_of(joined, [*(c[at] for c in columns), texts])

    hashed = pa.schema([*((c, pa.int64()) for c in KEY), ("ends_sha256", pa.string())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            out = []
            for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key == held:
                    state.update(b"," + ids.encode())
                    continue
                if held:
                    out.append((*held, state.hexdigest()))
                held, state = key, hashlib.sha256(ids.encode())
            if out:
                yield batch_of(hashed, list(zip(*out, strict=True)))
        if held:
            yield batch_of(hashed, [[x] for x in (*held, state.hexdigest())])

    parts = map_arrow(rows, chunks, "depth long, d1 long, d2 long, least long, ids string")
    parts = parts.repartition(task_count(ends.sparkSession), *KEY).sortWithinPartitions(*KEY, "least")
    return map_arrow(parts, digests, "depth long, d1 long, d2 long, ends_sha256 string")


def rolled_up(nodes: DataFrame, sums: list[str]) -> tuple[DataFrame, int]:
    """Key and the sums over each node's subtree, by pointer jumping along p1, p2; and the number of rounds."""
    greatest = nodes.agg(F.max("depth")).first()[0] or 0
    state, step, gathered, rounds = nodes.where("depth > 0").select(*KEY, F.col("p1").alias("up1"), F.col("p2").alias("up2"), *sums), 1, [nodes.select(*KEY, *sums)], 0
    while step <= greatest:
        given = cut(state.groupBy((F.col("depth") - step).alias("depth"), F.col("up1").alias("d1"), F.col("up2").alias("d2")).agg(*(F.sum(c).alias(c) for c in sums)))
        gathered.append(given)
        rounds += 1
        if 2 * step <= greatest:
            deep = state.where(F.col("depth") >= 2 * step)
            own = given.select(*KEY, *(F.col(c).alias(f"more_{c}") for c in sums))
            ends = state.select((F.col("depth") + step).alias("depth"), F.col("d1").alias("up1"), F.col("d2").alias("up2"), F.col("up1").alias("next1"), F.col("up2").alias("next2"))
            fuller = deep.join(own, KEY, "left").select(*KEY, "up1", "up2", *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums))
            state = cut(fuller.join(ends, ["depth", "up1", "up2"]).select(*KEY, F.col("next1").alias("up1"), F.col("next2").alias("up2"), *sums))
        step *= 2
    total = gathered[0]
    for more in gathered[1:]:
        total = total.unionByName(more)
    return total.groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in sums)), rounds


def trie(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, int]:
    """A row for each distinct prefix, and the number of doubling rounds.

    turns: conv_id, p (ascending in a conversation), m1, m2, n_bytes.  convs: conv_id of every conversation, those without
    turns too.  Columns: depth, d1, d2, conv_id (least member), parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.
    """
    convs = convs.select("conv_id").distinct()
    rows = prefixes(turns)
    ends = rows.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("end"))
    ends = convs.join(ends, "conv_id", "left").select("conv_id", *(F.coalesce(f"end.{c}", F.lit(0)).alias(c) for c in KEY))
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(*(F.lit(0).cast("long").alias(c) for c in KEY), *(F.lit(None).cast("long").alias(c) for c in ("p1", "p2")), F.lit(0).cast("long").alias("n_bytes"), "n_convs", "conv_id")
    nodes = rows.groupBy(*KEY).agg(*(F.first(c).alias(c) for c in ("p1", "p2", "n_bytes")), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    nodes = cut(nodes.unionByName(root))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = cut(nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("n_bytes")))
    sums, rounds = rolled_up(nodes.select(*KEY, "p1", "p2", "n_leaves", "saved_tokens"), ["n_leaves", "saved_tokens"])
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.drop("n_leaves", "saved_tokens", "n_bytes").join(parents, ["depth", "p1", "p2"], "left")
    found = found.join(sums, KEY).join(end_hashes(ends), KEY, "left")
    return found.select(*KEY, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_END)).alias("ends_sha256")), rounds
