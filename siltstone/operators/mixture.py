"""Mixing sources to token quotas (O-47 to O-52)."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.operators.shared import cut
from siltstone.operators.windows import running_sum


def targets(spark: SparkSession, proportions: dict[str, float], total_tokens: int) -> DataFrame:
    """source, proportion, target: whole tokens, rounded down."""
    rows = [(s, float(p), int(p * total_tokens)) for s, p in proportions.items()]
    return spark.createDataFrame(rows, "source string, proportion double, target long")


def renormalized(table: DataFrame) -> DataFrame:
    """Proportions divided by their sum where that is over 0 and off 1 by more than 0.01."""
    total = F.sum("proportion").over(Window.partitionBy())
    return table.withColumn("proportion", F.when((total > 0) & (F.abs(total - 1) > 0.01), F.col("proportion") / total).otherwise(F.col("proportion")))


def trial_target(total_tokens: int, max_samples: int, n_sources: int) -> int:
    """Target of a trial run: 500 tokens a sample at most."""
    return min(total_tokens, max_samples * 500 * n_sources)


def mixed_keys(narrow: DataFrame, table: DataFrame, order_key: str) -> DataFrame:
    """source, order key and tokens of the rows taken, from a table of those three columns; further ones, which should be narrow, are handed on.

    First pass: each source takes rows in order until its target is met; the row that crosses it is taken.  Second pass:
    what exhausted sources fell short of is filled from the others' next rows, their first, second, ... in turn.  All
    sums are running sums over ranges: no task holds a whole source.
    """
    wanted = table.agg(F.coalesce(F.sum("target"), F.lit(0))).first()[0]
    rows = running_sum(narrow.join(table.select("source", "target"), "source"), "tokens", [order_key], "before", ["source"])
    rows = cut(rows)
    first, rest = rows.where("before < target"), rows.where("before >= target")
    missing = wanted - first.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    columns = ["source", order_key, "tokens"]
    columns += [c for c in narrow.columns if c not in columns]
    if missing <= 0:
        return first.select(*columns)
    # A source gives at most the rows that begin within the missing tokens of its first leftover row.
    start = rest.groupBy("source").agg(F.min("before").alias("_start"))
    near = rest.join(start, "source").where(F.col("before") - F.col("_start") < missing).select(*columns, F.lit(1).alias("_one"))
    turns = running_sum(near, "_one", [order_key], "_turn", ["source"])
    filled = running_sum(turns, "tokens", ["_turn", "source"], "_given").where(F.col("_given") < missing)
    return first.select(*columns).unionByName(filled.select(*columns))


def mix(docs: DataFrame, table: DataFrame, order_key: str) -> DataFrame:
    """Rows taken for the mixture.  `docs` has source, tokens and a unique order key; sources outside `table` are left out.

    Only (source, order key, tokens) is summed and sorted; a semi-join takes the full rows.
    """
    narrow = docs.select("source", order_key, "tokens")
    keys = mixed_keys(narrow, table, order_key)
    if set(docs.columns) == {"source", order_key, "tokens"}:
        return keys.select(*docs.columns)
    return docs.join(keys.select(F.col(order_key).alias("_key")), F.col(order_key) == F.col("_key"), "left_semi")


def draw_order(rows: list[tuple[str, int]], goals: dict[str, int], total: int, seed: int = 42) -> list[int]:
    """Positions of `rows` (source, tokens), in the order in which a seeded draw takes them.

    A draw picks a source under its goal with a chance in proportion to its deficit, (goal - taken) / goal; once no
    unexhausted source is under its goal, any of them alike.  Drawing ends at `total` tokens or when all are exhausted.
    """
    rng = random.Random(seed)
    waiting = {s: [k for k, (name, _) in enumerate(rows) if name == s][::-1] for s in goals}
    taken = dict.fromkeys(goals, 0)
    order: list[int] = []
    while sum(taken.values()) < total:
        live = [s for s in goals if waiting[s]]
        if not live:
            break
        under = {s: (goals[s] - taken[s]) / max(goals[s], 1) for s in live if taken[s] < goals[s]}
        source = rng.choices(list(under), list(under.values()))[0] if under else rng.choice(live)
        k = waiting[source].pop()
        taken[source] += rows[k][1]
        order.append(k)
    return order


def mix_replay(docs: DataFrame, proportions: dict[str, float], total_tokens: int, order_key: str, seed: int = 42) -> DataFrame:
    """key, draw: the rows a sequential seeded draw takes, in its order.

    Sequential by nature: one task holds (source, key, tokens) of all rows.  For parity checks on small inputs; `mix`
    is the operator for large ones.
    """
    goals = {s: int(p * total_tokens) for s, p in proportions.items()}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        order = draw_order(list(zip(pdf["source"], pdf["tokens"], strict=True)), goals, total_tokens, seed)
        return pd.DataFrame({"key": pdf["key"].to_numpy()[order], "draw": range(len(order))})

    narrow = docs.where(F.col("source").isin(*goals)).select("source", F.col(order_key).cast("long").alias("key"), "tokens", F.lit(0).alias("all"))
    return narrow.groupBy("all").applyInPandas(run, "key long, draw long")


def mixture_report(taken: DataFrame, table: DataFrame) -> DataFrame:
    """source, target_proportion, actual_proportion, target_tokens, actual_tokens, docs, completion; empty sources as 0."""
    by_source = taken.groupBy("source").agg(F.sum("tokens").alias("actual_tokens"), F.count("*").alias("docs"))
    joined = table.join(by_source, "source", "left")
    actual, docs = F.coalesce("actual_tokens", F.lit(0)), F.coalesce("docs", F.lit(0))
    total = F.sum(actual).over(Window.partitionBy())
    return joined.select("source", F.col("proportion").alias("target_proportion"), tx.ratio(actual, total).alias("actual_proportion"), F.col("target").alias("target_tokens"), actual.alias("actual_tokens"), docs.alias("docs"), tx.ratio(actual, F.col("target")).alias("completion"))
