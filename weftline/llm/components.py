"""Connected components of a graph given as a table of edges, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut


def _differ(before: DataFrame, now: DataFrame) -> bool:
    """Whether two tables of distinct edges hold other rows."""
    return before.count() != now.count() or now.join(before, ["a", "b"], "left_anti").limit(1).count() > 0


def connected(edges: DataFrame) -> DataFrame:
    """node, root: for every node that has an edge and is not itself the smallest of its component, that smallest one.

    edges: a, b (long).  Alternates hooking of larger and of smaller neighbours to
    the least one until nothing changes; a logarithmic number of turns."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    changed = True
    while changed:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        hooked = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        lowest = hooked.groupBy("a").agg(F.min("b").alias("m"))
        moved = hooked.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, edges = edges, cut(moved.union(lowest.toDF("a", "b")).distinct())
        changed = _differ(before, edges)
    return edges.toDF("node", "root")
