"""Near duplicates by shared bands: first-come order and components against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import dedup
from siltstone.operators.components import counted_components


def first_come(rows):
    taken, gone = set(), set()
    for key, bands in sorted(rows):
        if taken & set(bands):
            gone.add(key)
        else:
            taken |= set(bands)
    return gone


def by_components(rows):
    parent = {key: key for key, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    owner = {}
    for key, bands in sorted(rows):
        for band in bands:
            a, b = sorted((root(key), root(owner.setdefault(band, key))))
            parent[b] = a
    return {key for key, _ in rows if root(key) != key}


def table(spark, rows):
    return spark.createDataFrame(rows, "key long, bands array<long>").repartition(5)


def keys(df):
    return {r.key for r in df.collect()}


@pytest.mark.parametrize("block", [100_000, 12, 0])
def test_both_modes_against_brute_force(spark, block):
    """Components within and beyond the block, rows without bands, and a band that a third of the rows hold."""
    rng = random.Random(7)
    rows = [(k, rng.sample(range(400), rng.randint(0, 4))) for k in rng.sample(range(5000), 300)] + [(10_000 + k, [9_999, 500 + k]) for k in range(150)]
    assert keys(dedup.keys_by_bands(table(spark, rows), "first", block)) == first_come(rows)
    if block:
        assert keys(dedup.keys_by_bands(table(spark, rows), "components", block)) == by_components(rows)
    assert dedup.keys_by_bands(table(spark, []), "first", block).count() == 0
    with pytest.raises(ValueError):
        dedup.keys_by_bands(table(spark, rows), "last")


def test_a_chain_of_ten_thousand_rows(spark):
    """Each row shares a band with the next only, so first-come order waits from one end to the other; no round does."""
    n = 10_000
    rows = [(k, [k, k + 1]) for k in range(n)]
    assert keys(dedup.keys_by_bands(table(spark, rows), "first")) == {k for k in range(n) if k % 2}
    found, rounds = counted_components(spark.range(n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")))
    assert rounds <= 16 and found.where("root = 0").count() == n - 1 == found.count()


def test_minimum_hashes_shift_the_minima_only():
    """Minima of shifted products, over no, one, and many slices."""
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2**64, 126, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**64, 126, dtype=np.uint64)
    for n in (0, 1, 255, 256, 257, 1000):
        grams = rng.integers(0, 2**64, n, dtype=np.uint64)
        expected = ((grams[:, None] * a + b) >> np.uint64(32)).min(axis=0, initial=2**32 - 1)
        assert dedup.minimum_hashes(grams, a, b).tolist() == expected.tolist()


def test_modes_over_texts(spark):
    words = " ".join(f"w{k}" for k in range(400)).split()
    texts = [(k, " ".join(words[4 * k : 4 * k + 200])) for k in range(40)] + [(100, "quite another text " * 9), (101, None), (102, "")]
    docs = spark.createDataFrame(texts, "id long, text string")
    bands = [(r.key, list(r.bands)) for r in dedup.band_hashes(docs.select(F.col("id").alias("key"), F.coalesce("text", F.lit("")).alias("body"))).collect()]
    assert len(by_components(bands)) > len(first_come(bands)) > 0
    left = lambda mode: {r.id for r in dedup.near_duplicates_dropped(docs, "id", mode=mode).collect()}
    assert left("first") == {k for k, _ in texts} - first_come(bands)
    assert left("components") == {k for k, _ in texts} - by_components(bands)
