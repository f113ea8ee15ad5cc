"""Aggregates and comparisons after the corpus is built (O-10, O-63, O-64, O-70)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as tx


def perplexity(rows: DataFrame) -> DataFrame:
    """total_loss, total_tokens, perplexity from (text, loss, tokens), where loss is a row's mean over its tokens.

    Rows with blank text or fewer than 2 tokens are left out; no token gives infinity.
    """
    used = rows.where((tx.strip(F.coalesce("text", F.lit(""))) != "") & (F.col("tokens") >= 2))
    total = used.agg(F.coalesce(F.sum(F.col("loss") * F.col("tokens")), F.lit(0.0)).alias("total_loss"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"))
    return total.withColumn("perplexity", F.when(F.col("total_tokens") > 0, F.exp(F.try_divide("total_loss", "total_tokens"))).otherwise(F.lit(float("inf"))))


def compared(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of both results with the same key, columns suffixed _left and _right; rows of the longer one alone are left out."""
    a = left.select(key, *(F.col(c).alias(f"{c}_left") for c in columns))
    b = right.select(key, *(F.col(c).alias(f"{c}_right") for c in columns))
    return a.join(b, key)


def length_profile(rows: DataFrame, candidates: tuple[str, ...] = ("text", "content", "code")) -> DataFrame:
    """column, n, min_length, max_length, avg_length of the first candidate column present."""
    name = next((c for c in candidates if c in rows.columns), None)
    if name is None:
        raise ValueError(f"none of {candidates} is a column")
    size = F.length(name)
    return rows.agg(F.lit(name).alias("column"), F.count("*").alias("n"), F.min(size).alias("min_length"), F.max(size).alias("max_length"), F.avg(size).alias("avg_length"))


def columns_of(rows: DataFrame) -> DataFrame:
    """position, column, type of a table's schema."""
    fields = [(k, f.name, f.dataType.simpleString()) for k, f in enumerate(rows.schema)]
    return rows.sparkSession.createDataFrame(fields, "position int, column string, type string")


def first_rows(rows: DataFrame, order_key: str, n: int = 10) -> DataFrame:
    """The first rows by a key, each as JSON; Spark keeps n rows a task, and sorts no table."""
    return rows.select(F.col(order_key).alias("key"), F.to_json(F.struct("*")).alias("row")).orderBy("key").limit(n)


def training_steps(total_tokens: int, length: int, batch: int, accumulation: int = 1, devices: int = 1) -> int:
    return math.ceil(total_tokens / (length * batch * accumulation * devices))


def newest(files: DataFrame, keep: int, by: Column | None = None) -> DataFrame:
    """The newest `keep` rows of (name, modified) per group."""
    order = Window.partitionBy(by if by is not None else F.lit(0)).orderBy(F.col("modified").desc(), F.col("name").desc())
    return files.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= keep).drop("_nth")
