import ast
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import suffix_dedup as sd
from tests.llm import awkward


def brute(rows, length):
    """Covered spans by remembering every window; rows in the order of (doc_id, text hash)."""
    seen, out = set(), {}
    for key, raw in rows:
        covered = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            window = raw[k : k + length]
            if window in seen:
                covered[k : k + length] = b"\x01" * length
            else:
                seen.add(window)
        spans, k = [], 0
        while k < len(raw):
            end = k
            while end < len(raw) and covered[end]:
                end += 1
            if end > k:
                spans.append((k, end))
            k = end + 1
        out[key] = spans
    return out


def spans_of(docs, settings):
    def join(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([str(x) for x in sd.batch_spans(batch.column(2))], pa.string())], names=["doc", "row_hash", "spans"])

    found = sd.repeated_spans(docs, settings).mapInArrow(join, "doc long, row_hash long, spans string")
    return {(r.doc, r.row_hash): ast.literal_eval(r.spans) for r in found.collect()}


def check(spark, docs, settings):
    identified = sorted({(r.doc, r.row_hash, r.text) for r in sd.identified(docs).collect()})
    expected = brute([((d, h), t.encode()) for d, h, t in identified], settings.length)
    assert spans_of(docs, settings) == {k: v for k, v in expected.items() if v}


@pytest.mark.parametrize("split", [5, 2])
def test_equals_brute_force_on_awkward_rows(spark, split):
    check(spark, awkward.documents(spark), sd.Settings(split=split))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_on_short_windows(spark, seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randint(3, 25))) for _ in range(12)]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(50)] + ["a" * 90, "ab" * 60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    check(spark, docs, sd.Settings(length=20, gram=8))


def test_reaches_that_differ_by_one_byte_are_settled_by_growing_offsets(spark):
    """Copies of a passage with one byte changed at every place: each round's cores decide some of the windows."""
    rng = random.Random(7)
    passage = "".join(rng.choice("abcdef ") for _ in range(260))
    texts = [passage[:k] + "#" + passage[k + 1 :] for k in range(0, 260, 3)] + [passage[40:], passage[:-33]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    check(spark, docs, sd.Settings())
    check(spark, docs, sd.Settings(split=2))


def test_a_string_of_all_documents_is_settled_over_many_tasks(spark):
    """One passage everywhere, more tasks than the passage has chosen positions."""
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdef ") for _ in range(300))
    texts = ["".join(rng.choice("ghijkl ") for _ in range(40)) + passage for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 24)
    try:
        check(spark, docs, sd.Settings())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_spans_join_every_row(spark):
    docs = awkward.documents(spark)
    joined = sd.with_spans(docs, sd.repeated_spans(docs))
    assert joined.count() == docs.count() and joined.where(F.col("doc_id").isNull()).count() == 2
    assert sd.with_spans(awkward.empty(spark), sd.repeated_spans(awkward.empty(spark))).count() == 0


def test_parts_follow_the_order_of_split_points():
    rng = np.random.default_rng(3)
    keys = tuple(rng.integers(0, 4, 500) for _ in range(3))
    points = np.array(sorted(set(zip(*(rng.integers(0, 4, 20).tolist() for _ in range(3)), strict=True))))
    assert sd.part_of(keys, points).tolist() == [sum(tuple(p) <= row for p in points.tolist()) for row in zip(*(k.tolist() for k in keys), strict=True)]
    assert sd.part_of(keys, np.zeros((0, 3), dtype=np.int64)).tolist() == [0] * 500


def test_kept_bytes():
    spans = pa.array([[(5, 9), (0, 2), (8, 12), (2, 3)], None, [], [(0, 5), (1, 2), (7, 8)]], pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))
    assert sd.batch_spans(spans) == [[(0, 3), (5, 12)], [], [], [(0, 5), (7, 8)]]
    assert sd.batch_spans(spans.slice(3)) == [[(0, 5), (7, 8)]]
    assert sd.kept_bytes(b"0123456789", [(0, 3), (5, 7)]) == b"34789"
