"""Input handling that all corpus operators share.

Every operator packs its input row in one struct column before it adds columns of its own, so
extra input columns may bear any name, even one that an operator uses for its results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words: blank, tab, line feed, vertical tab, form feed, return.
ASCII_SPACE = " \t\n\x0b\x0c\r"


#: Bytes of rows that go to a Python worker at once; a session that allows less keeps its own value.
BATCH_BYTES = 8 << 20


#: Tables of at most so many rows, of a few numbers and a short string each, are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 250_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """Ask for a broadcast if the table has few enough rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def bound_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by their bytes, so that long texts do not add up in a worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if now < 0 or now > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (all input columns), ``id`` (long) and ``text`` (null becomes empty)."""
    bound_batches(docs.sparkSession)
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def unpacked(docs: DataFrame, source: DataFrame) -> DataFrame:
    """The columns of ``source`` from the packed frame ``docs``."""
    return docs.select(*[F.col("row")[c].alias(c) for c in source.columns])


def fold(id_column: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id is in fold 0 as the empty text is."""
    return (F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts; one pass over the text column alone."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0


def partitions(docs: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
