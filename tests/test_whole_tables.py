"""Queries that take whole texts and whole tables: nothing past a prefix or outside a split is left out."""

import pytest

from siltstone.plans import queries as plans


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("whole"))
    rows = [(0, "\n".join("x" * (k % 7) for k in range(100))), (1, "one line"), (2, "\n".join("ab" for _ in range(17)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, "One  LINE")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    turns = [(7, k, "user", f"turn {k}") for k in range(8)] + [(8, 0, "user", "alone"), (9, 0, "user", "\n".join("ab" for _ in range(17)))]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.mark.parametrize("name", ["pad_labels", "padded_windows", "collate_batches"])
def test_records_hold_every_line(spark, tables, name):
    kept = [int(x) for r in plans.QUERIES[name](spark, tables).collect() for x in r.labels.split(",") if x != "-100"]
    assert sorted(kept) == sorted([k % 7 for k in range(100)] + [8] + [2] * 17)


def test_every_document_meets_the_seen_hashes(spark, tables):
    assert [r.doc_id for r in plans.QUERIES["seen_hash_anti"](spark, tables).collect()] == [0]


def test_every_turn_is_compared_with_the_next(spark, tables):
    rows = plans.QUERIES["compare_results"](spark, tables).collect()
    assert sorted((r.conv_id, r.turn, r.text_left, r.text_right) for r in rows) == [(7, k, f"turn {k}", f"turn {k + 1}") for k in range(7)]


def test_a_mix_grows_with_its_input(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in plans.estimated(spark, folder).collect()}
    sources, total = {r.source for r in docs.values()}, sum(r.tokens for r in docs.values())
    taken = plans.QUERIES["mix_quota"](spark, folder).collect()
    report = {r.source: r for r in plans.QUERIES["mixture_report"](spark, folder).collect()}
    assert {r.source for r in taken} == set(report) == sources and len(sources) > 5
    assert sum(r.tokens for r in taken) >= 0.75 * total - len(sources)
    assert min(r.completion for r in report.values()) < 1 < max(r.completion for r in report.values())
    drawn = plans.QUERIES["mix_replay"](spark, folder).collect()
    assert {docs[r.key].source for r in drawn} == sources and sum(docs[r.key].tokens for r in drawn) >= 0.75 * total - 2 * len(sources)
