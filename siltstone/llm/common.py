"""Helpers shared by the training-data operators.  Staged tables and checkpoints, `cut`, live as the library's do: with their scope."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.shared import cut, delete_path, drop, new_folder, shuffles_dropped, staged, work_folder

__all__ = ["ASCII_SPACE", "batch_of", "cut", "delete_path", "drop", "map_arrow", "nested", "new_folder", "shuffles_dropped", "splitmix", "staged", "task_count", "whole_text", "work_folder"]

#: Characters that separate words and are stripped from lines: space, \t, \n, \v, \f, \r.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def nested(docs: DataFrame) -> Column:
    """The whole row as one struct, so that its columns cannot clash with an operator's own beside it."""
    return F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")


def whole_text(column: str | Column = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def task_count(spark: SparkSession, least: int = 1) -> int:
    """Tasks for exchanges whose number the operator states itself: the session's setting, at least `least`."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), least)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow under one name, so that operators read alike."""
    return df.mapInArrow(function, schema)


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """One Arrow batch from Python or numpy columns in schema order."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def splitmix(x: np.ndarray | int) -> np.ndarray:
    """64-bit finaliser of the published SplitMix64 generator, on unsigned arrays."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
