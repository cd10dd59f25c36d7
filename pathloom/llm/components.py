"""Connected components of a link table, by alternating star contraction.

Large-star links every greater neighbour of a node to the node's least neighbour; small-star
links all smaller neighbours, and the node itself, to the least. Alternating, the links become
stars around each component's smallest node in a number of rounds that grows with the logarithm
of the table. Each round is two partial aggregates and two joins; nothing but a count and a
checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.shared import save_table


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in the links (a, b); component is its smallest node.

    Links may repeat and point either way; a link from a node to itself names the node. A null
    end drops the link. An empty table gives an empty result.
    """
    links = links.where("a is not null and b is not null")
    edges = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    before = None
    while True:
        edges = save_table(small_star(save_table(large_star(edges), "star-links")), "star-links")
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(xxhash64(b, a) as decimal(38)))")).first()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    nodes = links.select(F.explode(F.array("a", "b")).alias("node"))
    return nodes.distinct().join(stars, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # A table of its own, so that the join shuffles both sides and a hub's rows can be split.
    least = save_table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    least = save_table(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
