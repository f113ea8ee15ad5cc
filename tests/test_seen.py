"""The lasting set of seen hashes, and inputs on which the rarely met rules fire."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import dedup, seen
from siltstone.plans import queries

SF = "/root/testdata/sf0.001"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)


@pytest.mark.parametrize("bits", [1 << 16, 8])
def test_increments_against_plain_sets(spark, tmp_path, bits):
    """With eight bits a bucket the filters let almost everything through, and the buckets decide."""
    rng = random.Random(1)
    known, gone = seen.SeenSet(str(tmp_path / "seen"), bits), set()
    docs = [f"text {rng.randrange(900)}" for _ in range(800)] + ["", None]
    assert seen.unseen_keys(table(spark, docs), known, "id").count() == len(docs)
    for _ in range(3):
        more = [f"text {rng.randrange(900)}" for _ in range(100)]
        known.add(dedup.content_hashes(table(spark, more)))
        gone |= {digest(t) for t in more}
        found = sorted(r.id for r in seen.unseen_keys(table(spark, docs), known, "id").collect())
        assert found == [k for k, t in enumerate(docs) if t is None or digest(t) not in gone]
    assert known.versions(spark) == [0, 1, 2] and {r.h for r in known.hashes(spark).collect()} == gone
    marks = {r.h: r.maybe for r in seen.marked(table(spark, [d for d in docs if d]).select(F.col("id").alias("key"), F.sha2("text", 256).alias("h")), known).collect()}
    assert all(marks[h] for h in gone & set(marks)) and (bits == 8 or sum(marks.values()) < 1.2 * len(gone & set(marks)))


def test_a_repeated_or_unfinished_version(spark, tmp_path):
    known = seen.SeenSet(str(tmp_path / "seen"), 1 << 10)
    known.add(dedup.content_hashes(table(spark, ["a"])))
    known.add(dedup.content_hashes(table(spark, ["b"])), version=1)
    # The run is repeated, with other rows: the version is replaced, filters and all.
    known.add(dedup.content_hashes(table(spark, ["c", "d"])), version=1)
    left = lambda: {r.id for r in seen.unseen_keys(table(spark, ["a", "b", "c", "d", "e"]), known, "id").collect()}
    assert left() == {1, 4} and known.versions(spark) == [0, 1]
    (tmp_path / "seen" / "filters" / "version=1" / "_SUCCESS").unlink()
    assert left() == {1, 2, 3, 4} and known.versions(spark) == [0]
    known.add(dedup.content_hashes(table(spark, [])), version=1)
    assert left() == {1, 2, 3, 4}
    with pytest.raises(ValueError):
        known.add(dedup.content_hashes(table(spark, ["x"])), version=0)
    with pytest.raises(ValueError):
        seen.SeenSet("x", 12)


def test_no_text_is_exchanged(spark, tmp_path):
    known = seen.SeenSet(str(tmp_path / "seen"))
    known.add(dedup.content_hashes(table(spark, ["a"])))
    plan = seen.unseen_keys(table(spark, ["a", "b"]).select("id", "text"), known, "id")._jdf.queryExecution().executedPlan().toString()
    parts = [line for line in plan.split("\n") if "Exchange" in line]
    assert parts and not any("text" in line for line in parts)


def test_queries_that_must_bite(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0 < queries.seen_set_anti(spark, SF).count() < docs
    assert queries.rejection_alerts(spark, SF).count() > 0


def test_rare_rules_fire(spark):
    met = {r.reason for kind in queries.RARE_REASONS for r in queries.QUERIES[f"filter_rare_{kind}"](spark, SF).select("reason").distinct().collect()}
    assert met >= {"too_large", "too_many_lines", "low_alphanumeric_ratio", "non_english_doc", "non_english_web", "non_english_math", "web_boilerplate", "math_ocr_artifact", "math_unmatched_env"}
