"""Path tables as Parquet: sorted by ranges of paths, so that a prefix reads few row groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import codec
from pathloom.functions.policy import KEEP_LEFT_EQUAL, Policy
from pathloom.operators.frame import PathFrame


def write_sorted(t: PathFrame, folder: str, files: int | None = None, mode: str = "errorifexists") -> None:
    """Ranges of paths, sorted in each file; minima and maxima then let a scan skip."""
    ranged = t.df.repartitionByRange(*([files] if files else []), "path").sortWithinPartitions("path")
    ranged.write.mode(mode).parquet(folder)


def read_sorted(spark: SparkSession, folder: str, policy: Policy = KEEP_LEFT_EQUAL) -> PathFrame:
    return PathFrame(spark.read.parquet(folder), policy)


def read_below(spark: SparkSession, folder: str, prefix: bytes, policy: Policy = KEEP_LEFT_EQUAL) -> PathFrame:
    """Only what begins with ``prefix``; the byte range reaches the scan."""
    return PathFrame(spark.read.parquet(folder).where(codec.starts_with(F.col("path"), prefix)), policy)


def read_range(spark: SparkSession, folder: str, low: bytes, high: bytes, policy: Policy = KEEP_LEFT_EQUAL) -> PathFrame:
    """Paths from ``low`` on, below ``high``."""
    return PathFrame(spark.read.parquet(folder).where((F.col("path") >= F.lit(low)) & (F.col("path") < F.lit(high))), policy)


def read_delimited(spark: SparkSession, file: str, key: str, value: Column, columns: str, sep: str = "\t", header: bool = False) -> PathFrame:
    """Delimited text with a given schema; paths are the UTF-8 bytes of a column, the last row of a path stays."""
    rows = spark.read.schema(columns).option("sep", sep).option("header", header).csv(file)
    numbered = rows.withColumn("_number", F.monotonically_increasing_id())
    return PathFrame.bulk(numbered, codec.text(F.col(key)), value, F.col("_number"))


def words(texts: DataFrame, text: Column, pattern: str = r"[^\p{L}\p{N}']+") -> PathFrame:
    """The distinct words of texts, in lower case, with their counts."""
    each = texts.select(F.explode(F.split(F.lower(text), pattern)).alias("w")).where("w <> ''")
    return PathFrame(each.groupBy("w").agg(F.count("*").alias("value")).select(codec.text(F.col("w")).alias("path"), "value"))


def sequences(lines: DataFrame, line: Column) -> DataFrame:
    """(name, numbers) of lines like ``A000001 ,1,2,3,``; comments begin with ``#``."""
    rows = lines.select(line.alias("line")).where(~F.col("line").startswith("#"))
    parts = F.filter(F.transform(F.split("line", ","), lambda s: F.trim(s)), lambda s: s != "")
    return rows.select(parts[0].alias("name"), F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: s.cast("long")).alias("numbers"))
