"""Connected components by alternating large and small stars, each step a DataFrame job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.llm.common import remove, spread_join, stored_at


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Large: tie each node's greater neighbours to its least one; small: do so with the others."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n")).select("u", F.least("u", "least").alias("m"), "n")
    tied = spread_join(both, least, "u", "n", 2 * total)
    if large:
        return tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return tied.select(F.col("v").alias("a"), F.col("m").alias("b")).union(own).where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of an edge; root is the least node reachable.

    Edges with a null end and loops are left out; no edges: no rows. The number of rounds grows with the
    logarithm of the longest path; each round's edges are a table in the shared folder, removed after the next.
    """
    spark = edges.sparkSession
    at, path = stored_at(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    state = None
    while True:
        new = at.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 1_000_033)).first()
        if new == state or not new[0]:
            break
        state, old = new, path
        between, passing = stored_at(_star(at, True, new[0]))
        at, path = stored_at(_star(between, False, new[0]))
        remove(spark, old)
        remove(spark, passing)
    return at.select(F.col("a").alias("node"), F.col("b").alias("root")).union(at.select("b", "b")).distinct()
