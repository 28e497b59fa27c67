"""Connected components of a graph of edges, by star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.store import stored


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``node``, ``component``: the smallest node that each one reaches.

    Large-star and small-star steps alternate until every edge leads from a node with no other
    edge to the middle of its star; each halves the paths. A node with very many edges is a minimum
    (combined before the shuffle) and one side of an equi-join that adaptive execution may split.
    Every round is a written table. Nodes without an edge to another node are not returned.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        ends = now.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(now.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1").isEmpty():
            break
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small, "a")
        now = stored(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select("b", "b").distinct())
