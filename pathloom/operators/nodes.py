"""The nodes of a trie, derived from its paths: every prefix, and the compressed trie.

A path of n bytes gives n + 1 rows, but counts, masks and least paths are partial aggregates,
so a node leaves each task once however many paths pass through it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions import bytemask, codec
from pathloom.operators.prefixes import prefixes_of


def node_table(paths: DataFrame, lengths: list[int] | None = None, first: int = 0) -> DataFrame:
    """One row per prefix of the table's paths.

    ``prefix``, ``depth``, ``n_values`` (at and below), ``is_value``, ``value`` (null if none),
    ``mask`` of the next bytes, ``child_count``, ``first_value`` and ``first_below`` (the least
    value path at or below, and strictly below). ``lengths`` limits the prefixes to those
    lengths; ``first`` leaves shorter ones out. An empty table has no nodes.
    """
    rows = prefixes_of(paths, lengths, first=first)
    own = F.octet_length("path") == F.col("depth")
    below = F.when(~own, F.col("path"))
    found = rows.groupBy("prefix", "depth").agg(
        F.count("*").alias("n_values"),
        F.bool_or(own).alias("is_value"),
        F.first(F.when(own, F.col("value")), ignorenulls=True).alias("value"),
        bytemask.collect(F.when(~own, codec.byte_at("path", F.col("depth")))).alias("mask"),
        F.min("path").alias("first_value"),
        F.min(below).alias("first_below"),
    )
    return found.withColumn("child_count", bytemask.count(F.col("mask")))


def compressed_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes at values, at branches, and the root if it is either; chains between them are left out.

    Adds ``parent`` (the nearest of these nodes above; null for the topmost) and ``jumped``, the
    bytes since then.
    """
    kept = nodes.where("is_value or child_count > 1")
    above = prefixes_of(kept.select(F.col("prefix").alias("path")), proper=True)
    known = kept.select("prefix")
    parents = above.join(known, "prefix").groupBy("path").agg(F.max("depth").alias("up"))
    joined = kept.join(parents.withColumnRenamed("path", "prefix"), "prefix", "left")
    return joined.withColumn("parent", F.when(F.col("up").isNotNull(), codec.head("prefix", F.col("up")))).withColumn("jumped", F.col("depth") - F.coalesce("up", F.lit(0))).drop("up")


def depth_histogram(nodes: DataFrame) -> DataFrame:
    """By depth: nodes, their children in all, on average and at most, and values."""
    return nodes.groupBy("depth").agg(
        F.count("*").alias("nodes"), F.sum("child_count").alias("children"), F.max("child_count").alias("most_children"),
        F.sum(F.col("is_value").cast("long")).alias("vals"),
    )


def run_length_histogram(nodes: DataFrame) -> DataFrame:
    """How often chains of single children have each length, from one compressed node to the next."""
    return compressed_nodes(nodes).where("jumped > 0").groupBy("jumped").agg(F.count("*").alias("n"))


def subtree_hashes(paths: DataFrame, lengths: list[int] | None = None) -> DataFrame:
    """(prefix, depth, n_values, hash): equal subtrees, values included, have equal hashes.

    The hash combines the suffixes' hashes regardless of order, so it is a partial aggregate.
    """
    rows = prefixes_of(paths, lengths)
    suffix = codec.tail("path", F.col("depth"))
    one, two = F.xxhash64(suffix, "value"), F.xxhash64("value", suffix, F.lit(1))
    sums = rows.groupBy("prefix", "depth").agg(F.count("*").alias("n_values"), F.bit_xor(one).alias("x"), F.sum(two.cast("decimal(38)")).alias("s"))
    return sums.select("prefix", "depth", "n_values", F.sha2(F.concat_ws("/", "n_values", "x", "s"), 256).alias("hash"))


def shared_subtrees(paths: DataFrame) -> DataFrame:
    """Subtrees that occur at several places: hash, n_values, places."""
    return subtree_hashes(paths).groupBy("hash", "n_values").agg(F.count("*").alias("places")).where("places > 1")
