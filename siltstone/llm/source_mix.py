"""Mixing sources to target weights, DataFrame functions only (operator 6).

Weights: a source with share p of all tokens gets weight p**a / sum of p**a.  At a = 1 the weights are the shares; as a
falls towards 0 they even out.  The exponent is bisected to the largest a whose entropy reaches the target, or to the
least a under which no source repeats more often than the limit allows.  A round evaluates a grid of exponents in one
aggregate over the table of sources, so a round cuts the bracket by the size of the grid.

Budget: by default the least number of tokens that gives every source at least one whole pass.  No document is then
lost, and small sources repeat.  With a budget of its own a source may get less than a pass.

Realisation: each pass over a source is a block permutation: documents are dealt into blocks by the top bits of a
hash of (seed, pass, document), blocks are passed in the order of those bits, and documents in a block in the order of
the rest.  A source takes whole passes, then documents of the last pass until the source's tokens are met; the document
that crosses the line is taken.  Where the line falls is found by levels: tokens are summed by block, the block that
holds the line is split into sub-blocks by the next bits, and so on.  No task ever sorts a source.

Defined cases: null text has no tokens, so it follows the order but moves no budget; null source is a source of its
own; rows alike in source, doc_id and text stand at one place in a permutation and are taken together.  A source
without tokens has weight 0 and, with whole passes only, one pass.  An empty table gives an empty result.  The
operator's own columns stand beside a struct `row` of all input columns, so that no names clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import cut, nested, whole_text

GRID, ROUNDS = 32, 6
#: Bits of a permutation's place by level: 63 in all.
LEVELS = (9, 9, 9, 9, 27)
#: Sources up to which their table may be broadcast; a row is under 200 bytes.
BROADCAST_SOURCES = 10_000


def word_tokens(text: Column) -> Column:
    """Token count: words between ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


@dataclass(frozen=True)
class Target:
    """Either an entropy as a share of ln(sources), or the most often that a source may repeat relative to the least repeated one."""

    entropy: float | None = None
    repetition: float | None = None

    def __post_init__(self) -> None:
        if (self.entropy is None) == (self.repetition is None):
            raise ValueError("state either a target entropy or a repetition limit")


def find_exponent(sources: DataFrame, target: Target) -> float:
    """Bisects a in [0, 1]; `sources` has mix_source and mix_tokens.  A round is one aggregate with a fixed number of results."""
    used = sources.where("mix_tokens > 0")
    n, total, least, most = used.agg(F.count("*"), F.sum("mix_tokens"), F.min("mix_tokens"), F.max("mix_tokens")).first()
    if not n or n == 1:
        return 1.0
    if target.repetition is not None:
        # Repeats of a source are p**(a-1) times a constant, so the extremes settle it: the ratio is (most/least)**(1-a).
        ratio = math.log(most / least)
        meets = lambda a: (1 - a) * ratio <= math.log(target.repetition)
        if meets(0.0):
            return 0.0
        low, high = 0.0, 1.0  # low fails, high meets
        for _ in range(ROUNDS * 5):
            middle = (low + high) / 2
            low, high = (low, middle) if meets(middle) else (middle, high)
        return high
    wanted = target.entropy * math.log(n)
    share = F.log(F.col("mix_tokens") / F.lit(float(total)))

    def entropies(grid: list[float]) -> list[float]:
        # Entropy of w = p**a / z is ln z - a * sum(w * ln p).
        row = used.agg(*(F.sum(F.exp(a * share)) for a in grid), *(F.sum(F.exp(a * share) * share) for a in grid)).first()
        z, s = row[: len(grid)], row[len(grid) :]
        return [math.log(z[k]) - a * s[k] / z[k] for k, a in enumerate(grid)]

    low, high = 0.0, 1.0
    if entropies([1.0])[0] >= wanted - 1e-12:
        return 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * k / GRID for k in range(1, GRID)]
        # Entropy falls as a grows: keep the last exponent that reaches the target and the first that does not.
        for a, h in zip(grid, entropies(grid), strict=True):
            if h >= wanted:
                low = a
            else:
                high = a
                break
    return low


def weights(sources: DataFrame, exponent: float) -> DataFrame:
    """mix_source, mix_tokens, mix_weight; the weights sum to 1."""
    total, z = sources.where("mix_tokens > 0").agg(F.sum("mix_tokens"), F.sum(F.exp(exponent * F.log("mix_tokens")))).first()
    weight = F.when(F.col("mix_tokens") > 0, F.exp(exponent * F.log("mix_tokens")) / F.lit(float(z or 1.0))).otherwise(F.lit(0.0))
    return sources.withColumn("mix_weight", weight)


def budgets(weighted: DataFrame, budget: int | None) -> DataFrame:
    """Adds mix_passes (whole passes) and mix_quota (tokens of the last, partial pass)."""
    if budget is None:
        need = weighted.where("mix_weight > 0").agg(F.max(F.col("mix_tokens") / F.col("mix_weight"))).first()[0]
        budget = math.ceil((need or 0) * (1 - 1e-12))
    # The rounding of a float product must not lose or add a pass.
    tokens = F.when(F.col("mix_weight") > 0, F.round(F.col("mix_weight") * F.lit(float(budget)))).otherwise(F.lit(0.0)).cast("long")
    passes = F.when(F.col("mix_tokens") > 0, F.floor(tokens / F.greatest(F.col("mix_tokens"), F.lit(1)))).otherwise(F.lit(1)).cast("long")
    return weighted.select("*", passes.alias("mix_passes"), F.when(F.col("mix_tokens") > 0, tokens - passes * F.col("mix_tokens")).otherwise(F.lit(0)).cast("long").alias("mix_quota"))


def place(seed: int, mix_pass: Column, doc: Column, text: Column) -> Column:
    """A document's place in a pass: 63 bits that do not depend on partitions."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), mix_pass.cast("long"), doc, text), 1)


def source_key(source: Column) -> Column:
    """Null and text told apart, without null."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def line_places(docs: DataFrame, quotas: DataFrame) -> DataFrame:
    """mix_source, mix_line: the last place that a source takes of its partial pass; sources without a quota have no row.

    `docs`: mix_source, mix_n, mix_place.  Each level sums tokens by (source, block), at most 512 blocks a source but
    at the last, whose blocks hold single places.
    """
    bits, left = 63, quotas.select("mix_source", F.col("mix_quota").alias("mix_left"), F.lit(0).cast("long").alias("mix_prefix"))
    rows = docs.select("mix_source", "mix_n", "mix_place")
    for width in LEVELS:
        inside = rows.join(left, "mix_source").where(F.shiftright("mix_place", bits) == F.col("mix_prefix")) if bits < 63 else rows.join(left, "mix_source")
        bits -= width
        sums = inside.groupBy("mix_source", F.shiftright("mix_place", bits).alias("mix_block")).agg(F.sum("mix_n").alias("mix_sum"), F.first("mix_left").alias("mix_left"))
        before = F.sum("mix_sum").over(Window.partitionBy("mix_source").orderBy("mix_block")) - F.col("mix_sum")
        found = sums.withColumn("mix_before", before).where((F.col("mix_before") < F.col("mix_left")) & (F.col("mix_before") + F.col("mix_sum") >= F.col("mix_left")))
        left = cut(found.select("mix_source", (F.col("mix_left") - F.col("mix_before")).alias("mix_left"), F.col("mix_block").alias("mix_prefix")))
    return left.select("mix_source", F.col("mix_prefix").alias("mix_line"))


def plan(docs: DataFrame, target: Target, budget: int | None = None, seed: int = 0, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> tuple[DataFrame, DataFrame]:
    """row (a struct of all columns of `docs`), mix_source, mix_n (tokens), mix_copies and the row's mix_id and mix_text, and the table of sources behind it.

    Sources are few; beyond BROADCAST_SOURCES their table is joined by shuffle, with AQE splitting hot sources.
    """
    text = whole_text(text_column)
    keys = [source_key(F.col(source_column)).alias("mix_source"), word_tokens(text).alias("mix_n"), F.col(id_column).alias("mix_id"), F.xxhash64(text).alias("mix_text")]
    rows = docs.select(nested(docs), *keys)
    narrow = cut(docs.select(*keys))
    sources = cut(narrow.groupBy("mix_source").agg(F.sum("mix_n").alias("mix_tokens")))
    small = sources.count() <= BROADCAST_SOURCES
    exponent = find_exponent(sources, target)
    table = cut(budgets(weights(sources, exponent), budget))
    table = F.broadcast(table) if small else table
    partial = table.where("mix_quota > 0").select("mix_source", "mix_quota", "mix_passes")
    last_pass = narrow.join(F.broadcast(partial) if small else partial, "mix_source")
    last_pass = last_pass.select("mix_source", "mix_n", place(seed, F.col("mix_passes"), F.col("mix_id"), F.col("mix_text")).alias("mix_place"))
    lines = line_places(last_pass, partial)
    table = table.join(lines, "mix_source", "left")
    joined = rows.join(F.broadcast(table) if small else table, "mix_source")
    here = place(seed, F.col("mix_passes"), F.col("mix_id"), F.col("mix_text"))
    extra = F.coalesce(here <= F.col("mix_line"), F.lit(False)).cast("long")
    copies = joined.select("row", "mix_source", "mix_n", "mix_id", "mix_text", "mix_weight", (F.col("mix_passes") + extra).alias("mix_copies"))
    return copies, table.withColumn("mix_exponent", F.lit(exponent))


def realise(copies: DataFrame, seed: int = 0) -> DataFrame:
    """One row per copy, with mix_pass and mix_place: ordering by them and the source gives the block permutations."""
    passes = copies.where("mix_copies > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mix_copies") - 1)).alias("mix_pass"))
    return passes.withColumn("mix_place", place(seed, F.col("mix_pass"), F.col("mix_id"), F.col("mix_text")))
