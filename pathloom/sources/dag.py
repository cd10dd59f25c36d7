"""A trie as a graph of its distinct subtrees: equal subtrees are stored once.

The graph has the nodes of the compressed trie. The folder has ``nodes`` (hash, value, children as
the bytes down to each and its hash) and ``meta`` (the path and hash of the topmost node, numbers of
paths and of distinct subtrees). Reading follows the hashes down, one join per node on the longest
way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import codec
from pathloom.functions.policy import KEEP_LEFT_EQUAL, Policy
from pathloom.operators.frame import PathFrame
from pathloom.operators.nodes import compressed_nodes, node_table, subtree_hashes
from pathloom.shared import save_table


def distinct_subtrees(t: PathFrame) -> tuple[DataFrame, DataFrame]:
    """(hash, value, children): one row per distinct subtree; and (prefix, parent, hash) of all nodes."""
    hashes = subtree_hashes(t.df).select("prefix", "hash")
    kept = compressed_nodes(node_table(t.df)).select("prefix", "value", "parent")
    nodes = save_table(kept.join(hashes, "prefix"), "dag-nodes", free=False)
    kids = nodes.where("parent is not null").select(F.col("parent").alias("prefix"), F.struct(codec.tail("prefix", F.octet_length("parent")).alias("path"), "hash").alias("c"))
    children = kids.groupBy("prefix").agg(F.array_sort(F.collect_list("c")).alias("children"))
    joined = nodes.join(children, "prefix", "left")
    return joined.groupBy("hash").agg(F.first("value").alias("value"), F.first("children").alias("children")), nodes


def write_dag(t: PathFrame, folder: str, mode: str = "errorifexists") -> None:
    spark = t.df.sparkSession
    subtrees, nodes = distinct_subtrees(t)
    subtrees.write.mode(mode).parquet(f"{folder}/nodes")
    top = nodes.where("parent is null").select("prefix", "hash").first()  # one at most
    counts = (t.df.count(), spark.read.parquet(f"{folder}/nodes").count())
    row = [(None if top is None else top["prefix"], None if top is None else top["hash"], *counts)]
    spark.createDataFrame(row, "top binary, root string, paths long, subtrees long").coalesce(1).write.mode(mode).parquet(f"{folder}/meta")


def read_meta(spark: SparkSession, folder: str) -> dict:
    """``top``, ``root``, ``paths`` and ``subtrees`` of a stored graph."""
    return spark.read.parquet(f"{folder}/meta").first().asDict()


def read_dag(spark: SparkSession, folder: str, policy: Policy = KEEP_LEFT_EQUAL) -> PathFrame:
    nodes = spark.read.parquet(f"{folder}/nodes")
    front = spark.read.parquet(f"{folder}/meta").where("root is not null").select(F.col("top").alias("path"), F.col("root").alias("hash"))
    found = front.join(nodes, "hash").where("false").select("path", "value")
    while not front.isEmpty():
        level = save_table(front.join(nodes, "hash").select("path", "value", "children"), "dag-level", free=False)
        found = found.unionByName(level.where("value is not null").select("path", "value"))
        front = level.select("path", F.explode("children").alias("c")).select(F.concat("path", "c.path").alias("path"), F.col("c.hash").alias("hash"))
    return PathFrame(found, policy)
