"""The streaming build: first by order, carried packing, the sink's batches and progress, restarts included."""

import datetime as dt
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siltstone.functions.tokens import BYTES
from siltstone.operators import dedup, packing
from siltstone.sources import arrow_ipc, loaders
from siltstone.streaming import progress, stateful

ZERO = dt.datetime(2024, 1, 1)
DOCS = "key long, text string, at timestamp"


def at(seconds):
    return ZERO + dt.timedelta(seconds=seconds)


def arrivals(rows, folder, files):
    """Parquet files that a stream takes one after another, by time of change."""
    Path(folder).mkdir(exist_ok=True)
    for k in range(files):
        yield rows[k * len(rows) // files : (k + 1) * len(rows) // files], f"{folder}/part-{time.time_ns()}-{k}.parquet"


def write(spark, rows, folder, files=4):
    import pandas as pd

    for part, name in arrivals(rows, folder, files):
        pd.DataFrame(part, columns=["key", "text", "at"]).astype({"at": "datetime64[us]"}).to_parquet(name, index=False)
        time.sleep(0.02)


def source(spark, folder):
    return spark.readStream.schema("key long, text string, at timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(str(folder)).withColumn("at", F.col("at").cast("timestamp"))


def run(rows, path, checkpoint, **options):
    query = rows.writeStream.format("arrow_shards").option("path", str(path)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    arrow_ipc.register(spark)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def copies(seed=1):
    """Copies of 30 texts in any order within 100 seconds of each other."""
    rng = random.Random(seed)
    rows = [(k, f"text number {k % 30} is repeated" if k % 30 else None, at(rng.uniform(0, 100))) for k in range(200)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_firsts_equal_the_batch_build_over_a_restart(spark, tmp_path, seed):
    rows = copies(seed)
    stream = lambda: stateful.firsts_by_order(source(spark, tmp_path / "in"), "key", "at", 200_000)
    write(spark, rows[:90], tmp_path / "in")
    run(stream(), tmp_path / "out", tmp_path / "check")
    assert loaders.read_shards(spark, str(tmp_path / "out")) is None
    # The query starts again from its checkpoint; rows far ahead in time let the wait of all others pass.
    write(spark, rows[90:], tmp_path / "in")
    write(spark, [(10**6, "the end", at(10_000))], tmp_path / "in", 1)
    run(stream(), tmp_path / "out", tmp_path / "check")
    docs = spark.createDataFrame(rows, DOCS)
    expected = {r.key for r in dedup.exact_firsts(docs, "key").collect()}
    found = loaders.read_shards(spark, str(tmp_path / "out")).collect()
    assert sorted(r.key for r in found) == sorted(expected) and len(expected) == 30
    assert all(r.text == dict((k, t) for k, t, _ in rows)[r.key] for r in found)
    # A copy that comes after its content has come out is dropped; one that is new is not.
    write(spark, [(-5, rows[0][1], at(10_100)), (7_000, "new", at(10_100)), (10**6 + 1, "the very end", at(30_000))], tmp_path / "in", 1)
    run(stream(), tmp_path / "out", tmp_path / "check")
    assert sorted({r.key for r in loaders.read_shards(spark, str(tmp_path / "out")).collect()} - expected) == [7_000, 10**6]


def test_forgotten_contents_count_as_new(spark, tmp_path):
    stream = lambda: stateful.firsts_by_order(source(spark, tmp_path / "in"), "key", "at", 1_000, forget_ms=5_000)
    for k, (text, second) in enumerate([("same", 0), ("clock", 3), ("clock two", 5), ("clock three", 20), ("same", 21), ("clock four", 60), ("clock five", 90)]):
        write(spark, [(k, text, at(second))], tmp_path / "in", 1)
    run(stream(), tmp_path / "out", tmp_path / "check")
    assert [r.key for r in loaders.read_shards(spark, str(tmp_path / "out")).orderBy("key").collect() if r.text == "same"] == [0, 4]


def texts(n=300):
    rng = random.Random(4)
    return [(k, rng.choice(["", "ab", "longer text ", "x" * 62]) * rng.randint(0, 3), at(k)) for k in range(n)]


def records(df, order="seq"):
    return [(r.seq, list(r.input_ids), list(r.labels), list(r.attention_mask), list(r.doc_starts)) for r in df.orderBy(order).collect()]


def test_carried_record_equals_one_stream_over_killed_batches(spark, tmp_path):
    rows = texts()
    expected = records(packing.packed_stream(spark.createDataFrame(rows, DOCS), BYTES, "key", 64))
    stream = lambda: stateful.packed(source(spark, tmp_path / "in"), BYTES, "key", 64)
    write(spark, rows[:170], tmp_path / "in")
    run(stream(), tmp_path / "out", tmp_path / "check")
    # Spark has not noted the last batch as done, though the sink has committed it: the batch is repeated.
    last = max((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    write(spark, rows[170:], tmp_path / "in")
    run(stream(), tmp_path / "out", tmp_path / "check")
    # What a killed task leaves is never read.
    left = next((tmp_path / "out").glob("stream-*.arrow"))
    (tmp_path / "out" / "stream-killed.arrow").write_bytes(left.read_bytes())
    found = records(loaders.read_shards(spark, str(tmp_path / "out")))
    # The last record is still open.
    assert found == expected[:-1] and len(found) > 30
    manifest = spark.read.json(str(tmp_path / "out" / "manifest")).collect()
    assert sum(r.num_sequences for r in manifest) == len(found) and sum(r.total_tokens_real for r in manifest) == sum(sum(r[3]) for r in found)


def test_open_records_come_out_when_their_lane_rests(spark, tmp_path):
    rows = texts(120)
    write(spark, rows, tmp_path / "in", 3)
    write(spark, [(10**6, "", at(100_000))], tmp_path / "in", 1)
    stream = stateful.packed(source(spark, tmp_path / "in"), BYTES, "key", 64, lanes=3, lane=F.when(F.col("key") < 10**6, F.col("key") % 3).otherwise(7), event_time="at", flush_ms=500_000)
    run(stream, tmp_path / "out", tmp_path / "check")
    found = loaders.read_shards(spark, str(tmp_path / "out"))
    for lane in range(3):
        docs = spark.createDataFrame([r for r in rows if r[0] % 3 == lane], DOCS)
        assert records(found.where(F.col("lane") == lane)) == records(packing.packed_stream(docs, BYTES, "key", 64))
    with pytest.raises(ValueError):
        stateful.packed(source(spark, tmp_path / "in"), BYTES, "key", 64, event_time="at")


def test_progress_is_a_table(spark, tmp_path):
    rows = [(k, "x" * k, at(k)) for k in range(1, 41)]
    write(spark, rows, tmp_path / "in", 4)
    listener = progress.Progress(str(tmp_path / "progress"), target_tokens=2 * sum(k for k, _, _ in rows))
    spark.streams.addListener(listener)
    try:
        run(progress.counted(source(spark, tmp_path / "in"), F.length("text")), tmp_path / "out", tmp_path / "check")
        until = time.time() + 20
        while time.time() < until and len(list((tmp_path / "progress").glob("*.json"))) < 4:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    found = progress.table(spark, str(tmp_path / "progress")).where("tokens > 0").orderBy("batch").collect()
    assert [r.tokens for r in found] == [sum(range(10 * b + 1, 10 * b + 11)) for b in range(4)]
    assert [r.total_tokens for r in found] == [sum(range(1, 10 * b + 11)) for b in range(4)] and found[-1].share == 0.5
    assert all(r.tokens_per_second > 0 and r.seconds_left > 0 for r in found)
