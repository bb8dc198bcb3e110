"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, release


def components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, component) for each node that has an edge; component is its smallest reachable node.

    Every round replaces edges by stars round the smallest neighbour, so the number of rounds grows
    with the logarithm of the longest chain. Minima are combined before the shuffle, so a node with
    very many edges costs one row per task. Null ends and self-loops are dropped, repeated edges
    count once; no edges give no rows.
    """
    current = durable(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
        .distinct()
    )
    seen = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, both["u"] == low["k"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        joined = large.join(low, large["u"] == low["k"])
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v")))
        current = durable(small.distinct())
        state = current.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if state == seen:
            break
        seen = state
        release(edges.sparkSession)
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
