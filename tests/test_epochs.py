"""Shuffled batches as a stream: permutations, epochs, restarts and too few rows."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import shards
from siltstone.sources import epochs


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 1000])
def test_permutations(n):
    found = [epochs.permuted(np.arange(n), n, 7, e).tolist() for e in range(3)]
    assert all(sorted(x) == list(range(n)) for x in found)
    assert n < 64 or (found[0] != found[1] != found[2] and found[0] != list(range(n)))
    assert epochs.permuted(np.array([n - 1]), n, 7, 1).tolist() == found[1][-1:]


@pytest.fixture
def folder(spark, tmp_path):
    rows = spark.range(103).select(F.col("id").alias("seq_no"), F.array(F.col("id").cast("int"), F.lit(1)).alias("input_ids"), F.floor(F.col("id") / 40).cast("int").alias("shard_index"))
    shards.write_shards(rows, str(tmp_path / "rows"), "arrow")
    return tmp_path


def run(spark, folder, batches, **options):
    """Runs until so many batches have come out, then stops."""
    stream = epochs.epoch_batches(spark, str(folder / "rows"), str(folder / "progress.json"), 10, columns=["seq_no", "input_ids"], **options)
    query = stream.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "check")).start()
    until = time.time() + 60
    seen = lambda: spark.read.schema("epoch long, batch_no long").parquet(str(folder / "out")).distinct().count() if list((folder / "out").glob("*.parquet")) else 0
    while time.time() < until and seen() < batches and query.exception() is None:
        time.sleep(0.3)
    query.stop()
    assert query.exception() is None
    return seen()


def test_epochs_differ_and_restarts_repeat_none(spark, folder):
    assert run(spark, folder, 6, ahead=3, epochs=3) >= 6
    assert run(spark, folder, 30, ahead=3, epochs=3) == 30
    rows = spark.read.parquet(str(folder / "out")).collect()
    # Ten batches of ten an epoch; three of 103 rows are left out of each.
    assert len(rows) == 300 and all(r.input_ids == [r.seq_no, 1] and r.row_no == r.seq_no for r in rows)
    for epoch in range(3):
        held = [(r.batch_no, r.seq_no) for r in rows if r.epoch == epoch]
        order = epochs.permuted(np.arange(100), 103, 42, epoch).tolist()
        assert sorted(held) == sorted((k // 10, x) for k, x in enumerate(order)) and len({x for _, x in held}) == 100
    assert len({tuple(sorted(r.seq_no for r in rows if r.epoch == e and r.batch_no == 0)) for e in range(3)}) == 3


def test_a_trigger_takes_so_many_batches_at_most(folder):
    reader = epochs.EpochReader(str(folder / "rows"), ["seq_no", "row_no", "epoch", "batch_no"], 10, 1, 4, None, str(folder / "p.json"))
    first = reader.latestOffset()
    assert first == {"epoch": 0, "batch": 4} and len(reader.partitions(reader.initialOffset(), first)) == 4
    later = [reader.latestOffset() for _ in range(3)][-1]
    assert later == {"epoch": 1, "batch": 6}
    # A reader that starts again goes on after what was planned.
    again = epochs.EpochReader(str(folder / "rows"), ["seq_no"], 10, 1, 4, None, str(folder / "p.json"))
    assert again.latestOffset() == {"epoch": 0, "batch": 8}
    for size, ahead in ((104, 1), (0, 1), (10, 0)):
        with pytest.raises(ValueError):
            epochs.EpochReader(str(folder / "rows"), ["seq_no"], size, 1, ahead, None, str(folder / "p.json"))
