"""The corpus pipeline: stages over `documents`, each written as Parquet and reread as the next one's input.

A stage takes (spark, docs, sf_dir) and returns all that it keeps, whole, with the columns of `documents`; the last
returns the digests of the encoded documents.  Every stage takes nulls in any column, repeated rows, ties, an empty
table and further columns of any name, which it hands on.  The stages cannot be stated in SQL (a trained network, a seeded
permutation and a tokenizer are among them); tests hold each against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import bpe_tree, line_dedup, near_join, quality_model, source_mix
from siltstone.llm.common import staged

ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier, trained on `labels`, scores under 0.3; null texts are scored as empty ones."""
    pooler, network = quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_model.keep_good(docs, pooler, network, threshold=0.3)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines of 20 code points or more that three documents hold, but in the largest doc_id; n_chars follows the text, and null texts stay null."""
    return line_dedup.lines_dropped(docs, least_chars=20, least_docs=3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of word 5-gram similarity of 0.8 or more: the least doc_id, null last; null and empty texts are alike."""
    return near_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources until the source weights have 95 % of the greatest entropy; each document stays, and null is a source."""
    copies, _ = source_mix.plan(docs, source_mix.Target(entropy=0.95), seed=6)
    return source_mix.realise(copies, seed=6).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; copies that stand side by side are encoded once."""
    return bpe_tree.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_lines),
    ("near_join", drop_near_copies),
    ("source_mix", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage's result but the last is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, _ = staged(docs, f"pipeline-{name}")
    return docs
