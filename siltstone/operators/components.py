"""Connected components by alternating large and small stars, the published MapReduce scheme, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.shared import cut, drop, tasks


def _with_least(edges: DataFrame, own: bool, hot: bool) -> DataFrame:
    """Adds m, the least `v` among all rows of a `u` (or `u` itself, with `own`).

    With a `hot` node, rows are dealt by (u, salt): it is spread over all tasks, and only one row a salt of it meets in
    the aggregate and the join by u.
    """
    least = lambda c: F.least(F.min(c), F.col("u")) if own else F.min(c)
    if not hot:
        return edges.join(edges.groupBy("u").agg(least("v").alias("m")), "u")
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(max(tasks(edges.sparkSession), 8))))
    parts = salted.groupBy("u", "salt").agg(F.min("v").alias("part"))
    spread = parts.select("u", "salt").join(parts.groupBy("u").agg(least("part").alias("m")), "u")
    return salted.join(spread, ["u", "salt"]).drop("salt")


def _large_star(edges: DataFrame, hot: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, True, hot).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, hot: bool) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    rows = _with_least(down, False, hot)
    moved = rows.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(rows.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, hot_degree: int = 1_000) -> DataFrame:
    """node, root: see counted_components."""
    return counted_components(edges, hot_degree)[0]


def counted_components(edges: DataFrame, hot_degree: int = 1_000) -> tuple[DataFrame, int]:
    """node, root, and the number of rounds: one row per node of an edge (u, v), with the least node of its component; roots have no row.

    Rounds go on until nothing changes; their number grows with the logarithm of the longest path.  While a node has
    over `hot_degree` edges, its rows are salted, which takes more exchanges and gives the same result.
    """
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())

    def signs(e: DataFrame) -> tuple[int | None, int]:
        """A print of all edges, and the most edges of a node."""
        ends = e.select(F.explode(F.array("u", "v")).alias("node"), "u", "v")
        by_node = ends.groupBy("node").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v", "node")).alias("x"))
        x, most = by_node.agg(F.bit_xor("x"), F.max("n")).first()
        return x, most or 0

    before, (now, most), rounds = None, signs(edges), 0
    while most and now != before:
        rounds += 1
        hot = most > hot_degree
        longer, edges = edges, cut(_small_star(_large_star(edges, hot), hot))
        drop(longer)
        before, (now, most) = now, signs(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")), rounds
