"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import answered, drop, saved


def _settled(edges: DataFrame) -> bool:
    """Whether every node is linked with nothing but the smallest node of its component."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e"))
    per = ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("least"))
    return per.where("up > 1 OR (up = 1 AND least = 0)").isEmpty()


def _with_least(edges: DataFrame, of: DataFrame) -> DataFrame:
    """The edges ``u, v`` with ``m``, the smallest neighbour that ``u`` has in ``of``."""
    least = of.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return answered(edges, least, ["u"], "n", ["m"])


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for each node of the edges ``a, b`` (longs); the component is its smallest node.

    Each step keeps the components and brings nodes nearer to their smallest one; at the end every
    node is linked with that alone. The edges of a hub are spread over many tasks. Steps are written
    to the shared folder, nothing is collected. Loops are ignored; an empty input gives
    no rows.
    """
    now = saved(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _settled(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = saved(_with_least(both.where("v > u"), both).select(F.col("v").alias("u"), F.least("u", "m").alias("v")), "edges")
        small = _with_least(large, large).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        new = saved(small.where("u != v").distinct(), "edges")
        drop(now, large)
        now = new
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
