"""Shards closed by bytes, and the report counted on the way, against plain Python and separate aggregates."""

import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions.tokens import BYTES, Tokenizer
from siltstone.operators import filters, packing, report, shards
from siltstone.operators.packing import packing_stats, stream_sequences
from siltstone.plans import corpus, queries

SF = "/root/testdata/sf0.001"


def one_by_one(sizes, limit, most, state=(0, 0, 0)):
    shard, size, count = state
    out = []
    for n in sizes:
        out.append(shard)
        size, count = size + n, count + 1
        if size >= limit or count >= most:
            shard, size, count = shard + 1, 0, 0
    return out, (shard, size, count)


def test_cuts_of_runs_compose():
    rng = random.Random(2)
    for _ in range(600):
        limit, most, n = rng.choice([1, 5, 20]), rng.choice([1, 3, 100]), rng.randint(0, 25)
        sizes = [rng.choice([0, 1, 2, 7, 40]) for _ in range(n)]
        run = shards.ShardCuts(shards.np.array(sizes, dtype=shards.np.int64), limit, most).packed()
        for state in [(3, b, c) for b in range(limit) for c in range(min(most, 4))]:
            assert shards.shards_after(state, limit, most, *run) == one_by_one(sizes, limit, most, state)[1]


@pytest.mark.parametrize(("limit", "most"), [(1000, 50), (10**9, 7), (100, 10**6)])
def test_shards_over_ranges_equal_one_pass(spark, limit, most):
    rng = random.Random(4)
    sizes = [rng.choice([0, 1, 30, 99, 2500]) for _ in range(2000)]
    keys = sorted(rng.sample(range(10**6), len(sizes)))
    rows = spark.createDataFrame(list(zip(keys, sizes, strict=True)), "seq_no long, size_bytes long").repartition(6)
    found = shards.shards_by_bytes(rows, limit, most, first_shard=9).orderBy("seq_no").collect()
    assert [r.shard_index for r in found] == [9 + s for s in one_by_one(sizes, limit, most)[0]]
    assert found[0].shard_name == "shard_00009" and [r.size_bytes for r in found] == sizes
    assert shards.shards_by_bytes(rows.limit(0), limit, most).count() == 0


def test_report_equals_separate_aggregates(spark, tmp_path):
    docs, plan = queries.production_plan(spark, SF)
    counted = report.BuildReport()
    packed = corpus.packed_shards(corpus.curated(docs, plan, "doc_id", counted), plan, order_key="doc_id", report=counted)
    packed.write.parquet(str(tmp_path / "packed"))
    figures = counted.figures()
    reasons = filters.filter_stats(docs.select(corpus.source_reason(docs, plan.kinds).alias("reason"))).collect()
    outcome = {r.reason: r.n for r in reasons}
    assert {k.removeprefix("reason_"): v for k, v in figures["filter"].items() if k.startswith("reason_") and v} == {k: v for k, v in outcome.items() if k != "pass"}
    assert figures["filter"]["total_passed"] == outcome["pass"] and figures["filter"]["total_seen"] == sum(outcome.values())
    written = spark.read.parquet(str(tmp_path / "packed"))
    real = written.agg(F.sum("real_tokens"), F.sum(F.size("doc_starts")), F.count("*")).first()
    assert tuple(figures["packing"][k] for k in ("total_tokens_packed", "total_docs_packed", "total_sequences")) == tuple(real)
    with pytest.raises(ValueError):
        counted.unique(docs)
    counted.append(spark, str(tmp_path / "log"), "2024-01-01")
    counted.append(spark, str(tmp_path / "log"), "2024-01-02")
    assert [{k: v for k, v in x.items() if k != "created_at"} for x in report.read_log(spark, str(tmp_path / "log"))] == [figures, figures]


@pytest.mark.parametrize("fim_rate", [0.0, 0.7])
def test_built_shards_equal_packed_shards_of_curated_documents(spark, fim_rate):
    """The sizes come from the scan that filters; texts go through one exchange and are not sampled for ranges."""
    docs, plan = queries.production_plan(spark, SF)
    plan = dataclasses.replace(plan, fim_rate=fim_rate, code_sources=("src0", "src5"), length=700)
    rows = lambda df: [tuple(r) for r in df.orderBy("seq_no").collect()]
    built = corpus.built_shards(docs, plan, order_key="doc_id")
    expected = rows(corpus.packed_shards(corpus.curated(docs, plan, "doc_id"), plan, order_key="doc_id"))
    assert rows(built) == expected and len(expected) > 5
    moved = built._jdf.queryExecution().executedPlan().toString()
    assert moved.count("Exchange") == 1 + moved.count("BroadcastExchange") == 2 and "rangepartitioning" not in moved
    other = Tokenizer(BYTES.encode, eos=256, pad=257)
    assert rows(corpus.built_shards(docs, plan, other, "doc_id")) == expected
    counts = corpus.curated_keys(docs, plan, "doc_id", tokenizer=BYTES)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = packing.packed_stream(docs, BYTES, "doc_id", 700, fim_rate=fim_rate, code_sources=plan.code_sources, counts=counts, broadcast_numbers=0)
        assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    found = many.select(F.col("seq").alias("seq_no"), *(c for c in many.columns if c != "seq"))
    shared = built.select(*found.columns)
    assert rows(found)[: len(expected)] == rows(shared)


def test_packed_shards_query_moves_texts_once(spark):
    moved = queries.QUERIES["packed_shards"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert moved.count("Exchange") == 1 + moved.count("BroadcastExchange") and "SortMergeJoin" not in moved


def test_a_kind_is_one_branch_for_all_its_sources(spark):
    docs, plan = queries.production_plan(spark, SF)
    reason = corpus.source_reason(docs, plan.kinds)
    assert docs.select(reason.alias("r"))._jdf.queryExecution().optimizedPlan().toString().count("generated_file") == 1
    one_a_source = F.lit("unknown_source")
    for source, kind in plan.kinds.items():
        one_a_source = F.when(F.col("source") == source, filters.REASONS[kind](docs)).otherwise(one_a_source)
    assert docs.where(~reason.eqNullSafe(one_a_source)).count() == 0
    assert docs.limit(1).select(corpus.source_reason(docs, {}).alias("r")).first().r == "unknown_source"


def test_every_reason_is_named(spark):
    """Names in the report are those that the rules themselves give."""
    given = {n for names in filters.REASON_NAMES.values() for n in names}
    met = {r.reason for kind in queries.RARE_REASONS for r in queries.QUERIES[f"filter_rare_{kind}"](spark, SF).select("reason").distinct().collect()} - {None}
    assert met <= given and len(met) > 15


def test_packing_figures_of_nothing(spark):
    counted = report.BuildReport()
    empty = spark.createDataFrame([], "attention_mask array<tinyint>, doc_starts array<int>")
    counted.packed(empty).collect()
    assert counted.figures()["packing"] == {"total_sequences": 0, "total_docs_packed": 0, "total_tokens_packed": 0, "total_padding_tokens": 0, "padding_ratio": 0.0, "avg_docs_per_seq": 0.0}
    assigned = stream_sequences(spark.createDataFrame([(1, 5), (2, 4)], "k long, tokens long"), "k", 8).select(F.lit(0).alias("group"), "tokens", F.col("seq_no").alias("seq"))
    assert packing_stats(assigned, 8).first().total_sequences == 2
