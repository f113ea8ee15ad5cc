"""Windows over packed records, batches and limits (O-57 to O-62)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.packing import IGNORED
from siltstone.operators.shared import cut, tasks


def windows_per_record(size: Column | int, width: int) -> Column:
    if width <= 0:
        raise ValueError("a window has at least one place")
    size = F.lit(size) if isinstance(size, int) else size
    return F.ceil(size / width).cast("int")


def token_windows(records: DataFrame, width: int, columns: tuple[str, ...] = ("input_ids",), packed_length: int | None = None, pad: dict[str, int] | None = None) -> DataFrame:
    """One row per window: the record's other columns, `window` from 0, and slices of `columns`.

    The last window is short; with `pad` (a value per column) it is filled.  A record's own length counts unless
    `packed_length` states one.
    """
    size = F.size(columns[0]) if packed_length is None else packed_length
    n = windows_per_record(size, width)
    rows = records.where(F.size(columns[0]) > 0).withColumn("window", F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))))
    for c in columns:
        part = F.slice(c, F.col("window") * width + 1, F.lit(width))
        if pad is not None:
            part = F.concat(part, F.array_repeat(F.lit(pad[c]), F.lit(width) - F.size(part)))
        rows = rows.withColumn(c, part)
    return rows


def window_at(index: int, total: int, per_record: int) -> tuple[int, int]:
    """(record, window) of a window number; negative numbers count from the end."""
    place = index + total if index < 0 else index
    if not 0 <= place < total:
        raise IndexError(f"window {index} of {total}")
    return divmod(place, per_record)


def collated(records: DataFrame, order_key: str, length: int, batch: int, pad: int) -> DataFrame:
    """Records cut and padded to `length`, labels ignored wherever the mask is not 1, with batch_no; the mask is null where every row of a batch is full.

    `order_key` counts rows from 0 without gaps, so batches need no sort.
    """
    cut = lambda c: F.slice(c, F.lit(1), F.lit(length))
    fill = lambda c, v: F.concat(cut(c), F.array_repeat(F.lit(v), F.greatest(F.lit(length) - F.size(c), F.lit(0))))
    mask = fill("attention_mask", 0)
    labels = F.zip_with(fill("labels", IGNORED), mask, lambda x, m: F.when(m == 1, x).otherwise(F.lit(IGNORED)))
    rows = records.select(F.floor(F.col(order_key) / batch).cast("long").alias("batch_no"), order_key, fill("input_ids", pad).alias("input_ids"), labels.alias("labels"), mask.alias("attention_mask"))
    full = F.min(F.when(F.forall("attention_mask", lambda m: m == 1), 1).otherwise(0)).over(Window.partitionBy("batch_no")) == 1
    return rows.withColumn("attention_mask", F.when(~full, F.col("attention_mask")))


def row_numbers(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Adds consecutive numbers from 0 in global order without one task for all rows; ties are numbered in any order.

    Rows are range-partitioned, sorted and written once: partition sizes and numbers come from that one placement, since
    a second exchange would sample other borders.  State `rows` narrow and join the rest by key.  A partition's start is the sum of the sizes before it, one row a partition.
    """
    place = F.monotonically_increasing_id()
    placed = cut(rows.repartitionByRange(tasks(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn("_id", place))
    # The id holds the partition above bit 33 and the row's place in it below.
    placed = placed.withColumns({"_part": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND(2**33 - 1)})
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_place")).drop("_id", "_part", "_place", "_start")


def running_sum(rows: DataFrame, value: str, order: list[str], name: str, by: list[str] | None = None) -> DataFrame:
    """Adds the sum of `value` over earlier rows in `order`, within `by` if given, 0 for the first; `order` must be unique within `by`.

    One window per key would put a hot key into one task.  Rows are range-partitioned by (by, order) and written once, so
    a hot key and clustered order values are dealt evenly; a window over the sums of (key, partition) gives each one's
    start, and a window inside a partition's rows of a key does the rest.  State `rows` narrow.
    """
    by = by or []
    placed = cut(rows.repartitionByRange(tasks(rows.sparkSession), *by, *order).withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy(*by, "_part").agg(F.sum(value).alias("_sum"))
    # A key has as many partial sums as partitions at most.
    start = F.coalesce(F.sum("_sum").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)), F.col("_part").alias("_at"), start.alias("_start"))
    same = F.col("_part") == F.col("_at")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return placed.join(starts, same).withColumn(name, total).select(*rows.columns, name)


def shuffled_batches(rows: DataFrame, key: str, batch: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Adds batch_no by a seeded permutation of an epoch; the last batch is left out unless full.  Fewer rows than a batch give none; `key` is unique."""
    rank = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)), F.lit(str(epoch)))), 1, 15), 16, 10).cast("long")
    # Keys alone are sorted and written; rows meet their batch by key.
    numbered = row_numbers(rows.select(F.col(key).alias("_key"), rank.alias("_rank")), ["_rank", "_key"], "_place_no")
    full = numbered.count() // batch
    placed = numbered.select("_key", F.floor(F.col("_place_no") / batch).cast("long").alias("batch_no")).where(F.col("batch_no") < full)
    return rows.join(placed, F.col(key) == F.col("_key")).drop("_key")


def skip_and_limit(rows: DataFrame, order_key: str, skip: int, limit: int | None, by: str = "source") -> DataFrame:
    """Rows of each `by` after its first `skip`, at most `limit` of them, in order; `order_key` is unique.

    Places come from running sums over narrow keys, so that a hot source is dealt over all tasks.
    """
    placed = running_sum(rows.select(by, order_key, F.lit(1).alias("_one")), "_one", [order_key], "_place", [by])
    kept = placed.where(F.col("_place") >= skip)
    if limit is not None:
        kept = kept.where(F.col("_place") < skip + limit)
    return rows.join(kept.select(F.col(order_key).alias("_key")), F.col(order_key) == F.col("_key"), "left_semi")


def sequences_to(length: int, target_tokens: int) -> int:
    """Sequences up to the one that brings their number times `length` to the target."""
    return -(-target_tokens // length)


def until_target(sequences: DataFrame, length: int, target_tokens: int) -> DataFrame:
    """Sequences up to the one that brings (seq_no + 1) x length to the target."""
    return sequences.where(F.col("seq_no") < sequences_to(length, target_tokens))
