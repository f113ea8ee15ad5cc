"""The driver's queries of this subpackage, and the pipeline's stages, each on its own input."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import queries
from tests.llm import awkward
from tests.llm.test_line_dedup import brute
from tests.llm.test_rest import jaccard_classes
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, SF)
    if name in queries.oracle_sql():
        assert_same(df, queries.oracle_sql()[name], SF)
    else:
        assert df.count() >= 200


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema, sizes = docs.dtypes, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.dtypes == schema
        if name == "line_dedup":
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
        if name == "near_join":
            assert docs.join(before, docs.columns, "left_anti").count() == 0
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] <= sizes[4] == sizes[5]
    assert corpus_pipeline.run(spark, SF).count() == sizes[5]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_awkward_and_empty_rows(spark, name):
    """Nulls in any column, empty and long texts, ties, repeated rows and further columns whose names operators use themselves."""
    stage, last = dict(corpus_pipeline.STAGES)[name], corpus_pipeline.STAGES[-1][0]
    docs = awkward.documents(spark)
    rows = stage(spark, docs, SF).collect()
    assert stage(spark, awkward.empty(spark), SF).count() == 0
    if name == last:
        assert len(rows) == len(awkward.rows())
        return
    given = [tuple(r) for r in docs.collect()]
    assert rows and [f.name for f in stage(spark, docs, SF).schema] == docs.columns
    # All columns but text and n_chars are handed on as they were.
    narrow = lambda r: (r[0], *r[2:4], *r[5:])
    assert {narrow(r) for r in rows} <= {narrow(r) for r in given}
    if name == "line_dedup":
        assert len(rows) == len(given)
        assert sorted((float("-inf") if r.doc_id is None else r.doc_id, r.text or "") for r in rows) == brute([r[:2] for r in given])
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows if r.n_chars != 1 and r.n_chars != 5)
    if name == "near_join":
        assert {r.doc_id for r in rows} == {c for _, c, _ in jaccard_classes([(r[0], r[1] or "") for r in given])} and len(rows) == len({(r.doc_id, r.text) for r in rows})
    if name == "source_mix":
        assert {(r.doc_id, r.text) for r in rows} == {(r[0], r[1]) for r in given}


def test_bpe_stage_equals_the_library(spark):
    """Also for copies side by side."""
    tokenizer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    docs = awkward.unique(spark)
    found = dict(corpus_pipeline.STAGES)["bpe"](spark, docs.unionByName(docs).sort("doc_id"), SF).collect()
    texts = dict(awkward.unique_rows())
    assert len(found) == 2 * len(texts)
    for r in found:
        ids = tokenizer.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_clean_documents_stay(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, "/root/testdata/sf0.01").select("doc_id")
    good = labels.where("quality = 1")
    assert good.join(kept, "doc_id").count() >= 0.98 * good.count()
