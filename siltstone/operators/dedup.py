"""Exact and near deduplication, first row wins by an explicit order (O-42 to O-46)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.operators.components import components
from siltstone.operators.shared import cut, drop, tasks


def exact_firsts(df: DataFrame, order_key: str, columns: list[str] | None = None, text_column: str = "text", normalize: bool = True, scope: list[str] | None = None) -> DataFrame:
    """`order_key` and `columns` of the first row of each content hash, within `scope` columns if given: one scan, one aggregate.

    `order_key` must be unique.  The aggregate combines before the shuffle, so a text that makes up a third of all rows
    costs one narrow row per task, not one sort.  `columns` should be narrow; full rows come from exact_duplicates_dropped.
    """
    scope, columns = scope or [], columns or []
    hashed = df.select(tx.content_hash(F.col(text_column), normalize).alias("_hash"), *scope, F.struct(F.col(order_key).alias("k"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(columns))).alias("_row"))
    if not columns:
        hashed = hashed.withColumn("_row", F.col("_row.k"))
        return hashed.groupBy("_hash", *scope).agg(F.min("_row").alias(order_key)).select(order_key, *(c for c in scope if c != order_key))
    first = hashed.groupBy("_hash", *scope).agg(F.min("_row").alias("_row"))
    return first.select(F.col("_row.k").alias(order_key), *(F.col(f"_row.c{i}").alias(c) for i, c in enumerate(columns)))


def exact_duplicates_dropped(df: DataFrame, order_key: str, text_column: str = "text", normalize: bool = True, scope: list[str] | None = None, rows: DataFrame | None = None) -> DataFrame:
    """The full row with the least `order_key` of each content hash, within `scope` columns if given.

    Keys of the firsts come from exact_firsts; a semi-join takes their rows from `rows`, which may be the unfiltered
    table that `df` was filtered from, so that filters do not run twice.
    """
    rows = df if rows is None else rows
    keys = exact_firsts(df, order_key, None, text_column, normalize, scope).select(F.col(order_key).alias("_first"))
    return rows.join(keys, F.col(order_key) == F.col("_first"), "left_semi")


def dedup_stats(df: DataFrame, text_column: str = "text", normalize: bool = True) -> DataFrame:
    """total_seen, unique, duplicates_found, dedup_rate."""
    counts = df.groupBy(tx.content_hash(F.col(text_column), normalize).alias("h")).agg(F.count("*").alias("n"))
    seen = F.coalesce(F.sum("n"), F.lit(0))
    return counts.agg(seen.alias("total_seen"), F.count("*").alias("unique")).select(
        "total_seen", "unique", (F.col("total_seen") - F.col("unique")).alias("duplicates_found"), tx.ratio(F.col("total_seen") - F.col("unique"), F.col("total_seen")).alias("dedup_rate")
    )


def content_hashes(df: DataFrame, text_column: str = "text", normalize: bool = True) -> DataFrame:
    """Distinct hashes as `h`, for saving."""
    return df.select(tx.content_hash(F.col(text_column), normalize).alias("h")).distinct()


def save_hashes(hashes: DataFrame, path: str) -> None:
    """One hash a line, sorted within and across files."""
    hashes.select("h").sort("h").write.mode("overwrite").text(path)


def load_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("h")).where("h <> ''")


def without_seen(df: DataFrame, seen: DataFrame, text_column: str = "text", normalize: bool = True, order_key: str | None = None) -> DataFrame:
    """Rows whose hash is not in `seen` (column h).

    With a unique `order_key`, only (key, hash) meets `seen`, and rows are then taken by key.  For a set that lasts from
    build to build see operators.seen.
    """
    h = tx.content_hash(F.col(text_column), normalize).alias("_hash")
    known = seen.select(F.col("h").alias("_hash"))
    if order_key is None:
        return df.withColumn("_hash", h).join(known, "_hash", "left_anti").drop("_hash")
    new = df.select(F.col(order_key).alias("_key"), h).join(known, "_hash", "left_anti").select("_key")
    return df.join(new, F.col(order_key) == F.col("_key"), "left_semi")


#: 14 bands of 9 of 128 permutations: the least mean of false positives and negatives at similarity 0.7.
PERMUTATIONS, BANDS, BAND_ROWS, NGRAM = 128, 14, 9, 5


def best_bands(permutations: int, threshold: float, steps: int = 1000) -> tuple[int, int]:
    """Bands and rows that minimise the mean of both error areas of the banding curve."""
    s = (np.arange(steps) + 0.5) / steps
    best = (float("inf"), 1, 1)
    for bands in range(1, permutations + 1):
        for rows in range(1, permutations // bands + 1):
            chance = 1 - (1 - s**rows) ** bands
            best = min(best, ((chance[s < threshold].sum() + (1 - chance[s >= threshold]).sum()) / steps / 2, bands, rows))
    return best[1], best[2]


def minimum_hashes(grams: np.ndarray, factors: np.ndarray, offsets: np.ndarray, part: int = 256) -> np.ndarray:
    """32-bit minimum of each multiply-shift hash over the n-grams, in slices that stay in cache.

    The upper halves of the least products are the least upper halves, so only the minima are shifted.
    """
    least, room = np.full(len(factors), 2**64 - 1, dtype=np.uint64), np.empty((part, len(factors)), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(grams), part):
            found = room[: len(grams[k : k + part])]
            np.multiply(grams[k : k + part, None], factors, out=found)
            found += offsets
            np.minimum(least, found.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_hashes(rows: DataFrame, bands: int = BANDS, band_rows: int = BAND_ROWS, ngram: int = NGRAM, seed: int = 1) -> DataFrame:
    """key, bands array<long> from (key, body): MinHash bands of the character n-grams of normalized bodies; none for short ones."""
    schema = pa.schema([("key", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        n = bands * band_rows
        a, b = rng.integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**64, n, dtype=np.uint64)
        for batch in batches:
            out = []
            for item in batch.column(1):
                body = item.as_py()
                points = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
                if len(points) < ngram:
                    out.append([])
                    continue
                with np.errstate(over="ignore"):
                    gram = np.zeros(len(points) - ngram + 1, dtype=np.uint64)
                    for k in range(ngram):
                        gram = (gram + points[k : len(points) - ngram + 1 + k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                    gram = np.unique(gram ^ (gram >> np.uint64(29)))
                    labels = minimum_hashes(gram, a, b).reshape(bands, band_rows)
                out.append([xxhash.xxh3_64_intdigest(labels[k].tobytes(), seed=k) - 2**63 for k in range(bands)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], schema=schema)

    return rows.mapInArrow(run, "key long, bands array<long>")


def first_come(rows: Iterator[tuple[int, int, int]]) -> Iterator[int]:
    """Keys that share a band with an earlier key that stays, from (group, key, band) in order; bands of a group's stayers are held."""
    group = key = None
    taken: set[int] = set()
    mine: list[int] = []
    for g, k, band in rows:
        if (g, k) != (group, key):
            if mine and not taken.isdisjoint(mine):
                yield key
            else:
                taken.update(mine)
            if g != group:
                taken = set()
            group, key, mine = g, k, []
        mine.append(band)
    if mine and not taken.isdisjoint(mine):
        yield key


def near_duplicate_keys(df: DataFrame, order_key: str, text_column: str = "text", mode: str = "first", block: int = 100_000) -> DataFrame:
    """`key` of the rows that go as near duplicates, by shared MinHash bands; see keys_by_bands."""
    body = tx.normalized(F.coalesce(F.col(text_column), F.lit("")))
    return keys_by_bands(band_hashes(df.select(F.col(order_key).cast("long").alias("key"), body.alias("body"))), mode, block)


def keys_by_bands(bands: DataFrame, mode: str = "first", block: int = 100_000) -> DataFrame:
    """`key` of the rows that go, from (key, bands).

    Mode `first`: rows that share a band with an earlier row that stays, as first-come processing would find them.  Mode
    `components`: all rows but the first of those that chains of shared bands connect.

    Rows with a shared band point to the band's least key, and components of those edges part the work: rounds grow with
    the logarithm of the longest chain.  First-come order inside a component of up to `block` (row, band) pairs is settled
    by one task in one pass, many components a task; larger ones by settle_in_rounds.  No pairs of rows are made.
    """
    if mode not in ("first", "components"):
        raise ValueError(f"mode is first or components, not {mode}")
    members = cut(bands.select("key", F.explode("bands").alias("band")))
    # Bands with one member decide nothing.
    shared = members.groupBy("band").agg(F.count("*").alias("n"), F.min("key").alias("least")).where("n > 1").select("band", "least")
    open_rows = cut(members.join(shared, "band"))
    roots = components(open_rows.where("key <> least").select(F.col("key").alias("u"), F.col("least").alias("v")))
    if mode == "components":
        return roots.select(F.col("node").alias("key"))
    placed = open_rows.drop("least").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    placed = cut(placed)
    drop(open_rows, members)
    sizes = cut(placed.groupBy("root").agg(F.count("*").alias("n")))
    small = placed.join(sizes.where(F.col("n") <= block).select("root"), "root").repartition(tasks(bands.sparkSession), "root").sortWithinPartitions("root", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        for key in first_come(row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("root", "key", "band")), strict=True)):
            held.append(key)
            if len(held) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64())], names=["key"])
                held = []
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64())], names=["key"])

    gone = small.select("root", "key", "band").mapInArrow(run, "key long")
    large = sizes.where(F.col("n") > block).select("root")
    return gone if large.isEmpty() else gone.unionByName(settle_in_rounds(placed.join(large, "root").select("band", "key")))


def settle_in_rounds(open_rows: DataFrame) -> DataFrame:
    """`key` of the rows that go, from (band, key), in first-come order by rounds of aggregates.

    An undecided row stays once no earlier undecided row is left in any of its bands and none of them has a stayer before
    it; it goes as soon as one has.  Rounds are as many as the longest chain of rows that wait for each other: each settles
    at least the least open key, so they end without a limit.
    """
    open_rows, lost_rows = cut(open_rows), []
    while not open_rows.isEmpty():
        least = open_rows.groupBy("band").agg(F.min("key").alias("least"))
        firsts = cut(open_rows.join(least, "band").groupBy("key").agg(F.max(F.col("least") < F.col("key")).alias("waits")).where("not waits").select("key"))
        # The bands of the new stayers drop every other open row in them: those are later, or the stayer would wait.
        taken = open_rows.join(firsts, "key", "left_semi").select("band").distinct()
        lost = cut(open_rows.join(taken, "band", "left_semi").join(firsts, "key", "left_anti").select("key").distinct())
        lost_rows.append(lost)
        before, open_rows = open_rows, cut(open_rows.join(firsts.unionByName(lost), "key", "left_anti"))
        drop(before, firsts)
    return reduce(DataFrame.unionByName, lost_rows, open_rows.sparkSession.createDataFrame([], "key long"))


def near_duplicates_dropped(df: DataFrame, order_key: str, text_column: str = "text", mode: str = "first") -> DataFrame:
    return df.join(near_duplicate_keys(df, order_key, text_column, mode).select(F.col("key").alias("_key")), F.col(order_key) == F.col("_key"), "left_anti")


def deduplicated(df: DataFrame, order_key: str, text_column: str = "text", exact: bool = True, minhash: bool = False, rows: DataFrame | None = None, mode: str = "first") -> DataFrame:
    """Exact first, near duplicates among the survivors only; `rows` as in exact_duplicates_dropped, `mode` as in near_duplicate_keys."""
    if exact and minhash:
        # The survivors are read twice below; their keys are found once.
        keys = cut(exact_firsts(df, order_key, None, text_column).select(F.col(order_key).alias("_first")))
        rows = df if rows is None else rows
        df = rows.join(keys, F.col(order_key) == F.col("_first"), "left_semi")
    elif exact:
        df = exact_duplicates_dropped(df, order_key, text_column, rows=rows)
    return near_duplicates_dropped(df, order_key, text_column, mode) if minhash else df
