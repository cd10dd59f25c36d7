"""Exclusive paths: which requests for reading and writing exclude one another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.prefixes import lengths_of, prefixes_of
from pathloom.shared import save_table


def conflicts(requests: DataFrame) -> DataFrame:
    """(a, b): ids of requests that exclude one another, a < b.

    ``requests`` has id, path and ``writes``. Two conflict if one path begins with the other, or
    they are equal, and at least one of them writes.
    """
    shorter = requests.select(F.col("id").alias("s_id"), F.col("path").alias("prefix"), F.col("writes").alias("s_writes"))
    longer = prefixes_of(requests, lengths_of(requests))
    pairs = longer.join(shorter, "prefix").where("id <> s_id and (writes or s_writes)")
    return pairs.select(F.least("id", "s_id").alias("a"), F.greatest("id", "s_id").alias("b")).distinct()


def path_status(probes: DataFrame, requests: DataFrame) -> DataFrame:
    """The probes (column ``path``) with ``status``: what could be requested there now.

    ``unavailable`` beside a writer, ``reading`` beside readers only, else ``available``.
    """
    held = save_table(requests.groupBy("path").agg(F.bool_or("writes").alias("writes")), "held", free=False)
    # Spark's estimates do not count what an explode adds, so all joins are merges: a broadcast could exceed the driver.
    above = prefixes_of(probes.select("path").distinct(), lengths_of(held)).join(held.select(F.col("path").alias("prefix"), "writes").hint("merge"), "prefix")
    # A prefix leaves each task once, however many requests are below it.
    below = prefixes_of(held, lengths_of(probes)).groupBy("prefix").agg(F.bool_or("writes").alias("writes"))
    either = above.select("path", "writes").unionByName(below.select(F.col("prefix").alias("path"), "writes"))
    found = either.groupBy("path").agg(F.bool_or("writes").alias("w"))
    status = F.when(F.col("w").isNull(), "available").when(F.col("w"), "unavailable").otherwise("reading")
    return probes.join(found.hint("merge"), "path", "left").withColumn("status", status).drop("w")
