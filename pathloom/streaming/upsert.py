"""A path table that micro-batches are joined into.

Paths are dealt over buckets by a hash. Each batch writes a version that has the buckets it
touches, with the rows they had before; a reader takes each bucket from the newest complete version
that has it. A batch that is retried writes its version anew, so nothing is applied twice, and
versions that no bucket needs any more are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.policy import KEEP_LEFT_EQUAL, Policy
from pathloom.operators import algebra
from pathloom.operators.frame import PathFrame
from pathloom.shared import delete_path

#: Buckets of a table; one is rewritten when a batch has a path in it. A table keeps the number it began with.
BUCKETS = 64


def bucket_of(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def _names(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """The numbers of the folders ``prefix`` + number below a folder."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(top)]
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix))


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The complete versions in a folder, ascending."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [v for v in _names(spark, folder, "v=") if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/v={v}/_SUCCESS"))]


def newest(spark: SparkSession, folder: str, before: int | None = None) -> dict[int, int]:
    """The newest version of each bucket, or the newest below ``before``."""
    found = {}
    for v in versions(spark, folder):
        if before is None or v < before:
            found |= dict.fromkeys(_names(spark, f"{folder}/v={v}", "bucket="), v)
    return found


def current(spark: SparkSession, folder: str, policy: Policy = KEEP_LEFT_EQUAL, before: int | None = None, buckets: list[int] | None = None) -> PathFrame | None:
    """The table, or its state before a version, or only some of its buckets; None if there is nothing."""
    found = newest(spark, folder, before)
    files = [f"{folder}/v={v}/bucket={b}" for b, v in found.items() if buckets is None or b in buckets]
    return PathFrame(spark.read.parquet(*files), policy) if files else None


def join_batches(stream: DataFrame, folder: str, checkpoint: str, policy: Policy = KEEP_LEFT_EQUAL, replace: bool = False, buckets: int = BUCKETS):
    """Start a query that joins a stream of (path, value, seq) into the table in ``folder``.

    Inside a batch the value with the greatest ``seq`` of a path counts. With ``replace`` it
    replaces the table's value, else the policy joins the two. The caller ends the query.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = PathFrame.bulk(batch, F.col("path"), F.col("value"), F.col("seq"), policy)
        touched = [r[0] for r in fresh.df.select(bucket_of(F.col("path"), buckets)).distinct().collect()]
        old = current(spark, folder, policy, before=number, buckets=touched)
        new = fresh if old is None else old.insert(fresh) if replace else algebra.join(old, fresh)
        new.df.withColumn("bucket", bucket_of(F.col("path"), buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/v={number}")
        # A retry of this batch reads what was there before it; nothing needs older versions.
        needed = set(newest(spark, folder, before=number).values()) | set(newest(spark, folder).values())
        for v in versions(spark, folder):
            if v not in needed:
                delete_path(spark, f"{folder}/v={v}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
