"""Connected components of an edge table, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Far above what halving distances can need.
MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node of its component.

    Alternates large-star and small-star steps: each node links its larger neighbours to the least node it knows, then
    its smaller ones, until nothing changes. Every step is a min-aggregate and a join, written to shared storage. The
    joins have plain tables on both sides, so that adaptive execution can split the rows of a node with many links; no
    component is ever gathered in one place. Self-loops are allowed; an empty table gives no rows.
    """
    pairs = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = pairs
    links = pairs.where(F.col("a") != F.col("b"))
    before = None
    for _ in range(MAX_ROUNDS):
        # large star: for every node v, connect neighbours above v to the least of v and its neighbours
        both = links.union(links.select(F.col("b"), F.col("a"))).toDF("v", "u")
        least = materialize(both.groupBy("v").agg(F.min("u").alias("m")).withColumn("m", F.least("v", "m")))
        large = both.where(F.col("u") > F.col("v")).join(least, "v").select(F.col("u").alias("a"), F.col("m").alias("b")).distinct()
        # small star: for every node v, connect v and its smaller neighbours to the least of them
        large = materialize(large)
        floor = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(floor, "a").select(F.col("b").alias("x"), "a", "m")
        links = small.where(F.col("x") != F.col("m")).select(F.col("x").alias("a"), F.col("m").alias("b")).union(floor.select("a", F.col("m").alias("b"))).distinct()
        links = materialize(links)
        # a star forest is reached when a round changes nothing
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    every = nodes.select(F.col("a").alias("node")).union(nodes.select("b")).distinct()
    return every.join(links.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
