"""The corpus build from loaded sources to packed shards, as one declarative plan a step."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.functions.tokens import BYTES, Tokenizer
from siltstone.operators import dedup, filters, mixture, packing, shards, windows
from siltstone.operators.report import BuildReport
from siltstone.operators.shared import cut


@dataclass(frozen=True)
class CorpusPlan:
    """kinds: source name -> filter kind.  group_rows: order keys of one packing group; without, all rows are one stream.  tokens: text -> its token count."""

    kinds: dict[str, str]
    proportions: dict[str, float]
    total_tokens: int
    length: int = 4096
    group_rows: int | None = None
    fim_rate: float = 0.0
    code_sources: tuple[str, ...] = ("code",)
    minhash: bool = False
    near_mode: str = "first"
    skip: int = 0
    limit: int | None = None
    shard_mb: int = 50
    first_shard: int = 0
    tokens: Callable[[Column], Column] = tx.token_estimate


def source_reason(docs: DataFrame, kinds: dict[str, str]) -> Column:
    """The first failing rule by the kind of a row's source; `unknown_source` for sources or kinds without a filter."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    # One branch a kind, however many sources it has.
    for kind in dict.fromkeys(kinds.values()):
        if kind in filters.REASONS:
            out = out.when(F.col("source").isin(*(s for s, k in kinds.items() if k == kind)), filters.REASONS[kind](docs))
    return out.otherwise(F.lit("unknown_source"))


def curated_keys(docs: DataFrame, plan: CorpusPlan, order_key: str = "order_key", report: BuildReport | None = None, tokenizer: Tokenizer | None = None) -> DataFrame:
    """order key, source, tokens of the rows that curated takes; filters and deduplication are counted into `report` on the way.

    With `tokenizer`, packed_tokens too, the tokens that packing counts, from the scan that filters.
    """
    if report is None:
        kept = docs.where(source_reason(docs, plan.kinds).isNull())
    else:
        kept = report.filtered(docs.select(order_key, "source", "text", source_reason(docs, plan.kinds).alias("reason"))).where("reason is null")
    # Filters and hashes run once; everything after them is narrow.
    sizes = {"tokens": plan.tokens(F.col("text"))}
    if tokenizer is not None:
        sizes["packed_tokens"] = packing.token_counts(tokenizer, packing.bodies(kept, order_key, "text", plan.fim_rate, plan.code_sources))
    firsts = dedup.exact_firsts(kept.withColumns(sizes), order_key, ["source", *sizes])
    narrow = cut(firsts if report is None else report.unique(firsts))
    if plan.minhash:
        survivors = docs.join(narrow.select(order_key), order_key, "left_semi")
        narrow = narrow.join(dedup.near_duplicate_keys(survivors, order_key, mode=plan.near_mode).select(F.col("key").alias(order_key)), order_key, "left_anti")
    if plan.skip or plan.limit is not None:
        narrow = windows.skip_and_limit(narrow, order_key, plan.skip, plan.limit)
    return mixture.mixed_keys(narrow, mixture.targets(docs.sparkSession, plan.proportions, plan.total_tokens), order_key)


def curated(docs: DataFrame, plan: CorpusPlan, order_key: str = "order_key", report: BuildReport | None = None) -> DataFrame:
    """Filtered by source, deduplicated over all sources, skipped and limited by source, mixed to the quotas; adds tokens.

    `order_key` is unique.  Full rows are read again for the keys taken only.
    """
    return docs.join(curated_keys(docs, plan, order_key, report).select(order_key, "tokens"), order_key)


def ordinal_ids(rows: DataFrame, order_key: str = "order_key") -> DataFrame:
    """Adds doc_key, `source:ordinal`: a row's place among its source's, from 0."""
    placed = windows.running_sum(rows.select("source", order_key, F.lit(1).alias("_one")), "_one", [order_key], "_place", ["source"])
    return rows.join(placed.select(order_key, F.concat_ws(":", "source", F.col("_place").cast("string")).alias("doc_key")), order_key)


def rejection_alerts(reasons: DataFrame, order_key: str = "order_key", limit: int = 5_000) -> DataFrame:
    """source, first_key, n: unbroken runs of `limit` rejected rows or more, from (source, order key, reason).

    Rows with the same number of passed rows before them belong to one run; runs are counted by an aggregate that
    combines before the shuffle.
    """
    marked = reasons.select("source", order_key, "reason", F.col("reason").isNull().cast("int").alias("_passed"))
    placed = windows.running_sum(marked, "_passed", [order_key], "_before", ["source"])
    runs = placed.where("reason is not null").groupBy("source", "_before").agg(F.min(order_key).alias("first_key"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= limit).select("source", "first_key", "n")


def packed_shards(docs: DataFrame, plan: CorpusPlan, tokenizer: Tokenizer = BYTES, order_key: str = "order_key", report: BuildReport | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Packed records of curated documents in the order of keys, with seq_no and shard_index, up to the target.

    With `counts`, order key and packed_tokens of the curated documents, `docs` are the loaded ones.
    """
    group = F.floor(F.col(order_key) / plan.group_rows) if plan.group_rows else None
    most = windows.sequences_to(plan.length, plan.total_tokens)
    packed = packing.packed_stream(docs, tokenizer, order_key, plan.length, fim_rate=plan.fim_rate, code_sources=plan.code_sources, most_records=most, group=group, counts=counts)
    kept = (packed if report is None else report.packed(packed)).withColumnRenamed("seq", "seq_no")
    kept = kept.withColumn("real_tokens", F.aggregate("attention_mask", F.lit(0), lambda a, m: a + m))
    return shards.shard_assignment(kept, shards.sequences_per_shard(plan.length, plan.shard_mb), plan.first_shard)


def built_shards(docs: DataFrame, plan: CorpusPlan, tokenizer: Tokenizer = BYTES, order_key: str = "order_key", report: BuildReport | None = None) -> DataFrame:
    """packed_shards of curated(docs).

    Where tokens are counted without being made, the scan that filters counts them: curated texts are neither joined nor
    moved for their sizes, and only texts of the records that are kept move at all.
    """
    if tokenizer is not BYTES:
        return packed_shards(curated(docs, plan, order_key, report), plan, tokenizer, order_key, report)
    counts = curated_keys(docs, plan, order_key, report, tokenizer).select(order_key, "packed_tokens")
    return packed_shards(docs, plan, tokenizer, order_key, report, counts)


def curated_report(docs: DataFrame) -> DataFrame:
    """The flagship: documents that pass the web filter, first of each content, by source with their token estimates.  One scan of the texts."""
    kept = docs.where(filters.web_reason(F.col("text")).isNull()).select("doc_id", "source", "text", tx.token_estimate(F.col("text")).alias("tokens"))
    first = dedup.exact_firsts(kept, "doc_id", ["source", "tokens"])
    return first.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
