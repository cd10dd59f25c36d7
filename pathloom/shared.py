"""Tables kept in the folder that driver and executors share.

Long plans are cut by writing an intermediate result as Parquet below the folder the cluster
names in ``spark.checkpoint.dir`` and reading it back: an executor that is lost takes nothing
with it, because every file of a finished table is in shared storage.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this application.

    ``spark.checkpoint.dir`` decides. Where it is unset, which is meant for local sessions
    only, a temporary folder is made and removed when the process ends; on any other master
    an unset value is an error, since a local folder would not be visible to executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="pathloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/pathloom-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save_table(df: DataFrame, name: str, free: bool = True) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a frame that reads it.

    With ``free``, the JVM is then asked to collect garbage, so that Spark's cleaner drops the
    shuffle files of the finished job; a chain of jobs needs the disk of its largest one, not
    the sum of all. Loops over small tables leave that to the jobs after them.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    saved = spark.read.schema(df.schema).parquet(path)
    del df
    if free:
        release(spark)
    return saved


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files and broadcasts that no live plan refers to.

    What holds them is finalised first, so only a second collection frees them.
    """
    gc.collect()
    system = spark.sparkContext._jvm.System
    system.gc()
    system.runFinalization()
    time.sleep(0.1)
    system.gc()


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
