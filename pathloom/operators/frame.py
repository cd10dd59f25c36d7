"""Path tables: a DataFrame of unique binary paths with a value each."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import codec
from pathloom.functions.policy import KEEP_LEFT_EQUAL, UNIT, Policy
from pathloom.shared import save_table


@dataclass(frozen=True)
class PathFrame:
    """``df`` has the columns ``path`` (binary, never null, unique) and ``value`` (never null).

    The empty path is legal and is the root. Operators return new frames and never change one.
    """

    df: DataFrame
    policy: Policy = KEEP_LEFT_EQUAL

    # ------------------------------------------------------------ constructors

    @staticmethod
    def of(df: DataFrame, path: Column, value: Column | None = None, policy: Policy | None = None, validate: bool = False) -> "PathFrame":
        """A frame from columns of a DataFrame whose paths are unique; ``validate`` checks that they are."""
        if value is None:
            found = PathFrame(df.select(path.alias("path"), F.lit(True).alias("value")), policy or UNIT)
        else:
            found = PathFrame(df.select(path.alias("path"), value.alias("value")), policy or KEEP_LEFT_EQUAL)
        if validate:
            bad = found.df.groupBy("path").agg(F.count("*").alias("n"), F.count("value").alias("v")).where("path is null or n > 1 or v < n")
            if not bad.isEmpty():
                raise ValueError("paths must be unique, and neither path nor value null")
        return found

    @staticmethod
    def bulk(df: DataFrame, path: Column, value: Column, seq: Column, policy: Policy = KEEP_LEFT_EQUAL) -> "PathFrame":
        """Load pairs of which paths may repeat: of a path, the value with the greatest ``seq`` stays."""
        rows = df.select(path.alias("path"), value.alias("value"), seq.alias("seq")).where("path is not null")
        return PathFrame(rows.groupBy("path").agg(F.max_by("value", "seq").alias("value")), policy)

    @staticmethod
    def empty(spark: SparkSession, value_type: str = "long", policy: Policy = KEEP_LEFT_EQUAL) -> "PathFrame":
        return PathFrame(spark.createDataFrame([], f"path binary, value {value_type}"), policy)

    @staticmethod
    def single(spark: SparkSession, path: bytes, value, value_type: str = "long", policy: Policy = KEEP_LEFT_EQUAL) -> "PathFrame":
        return PathFrame.from_items(spark, [(path, value)], value_type, policy)

    @staticmethod
    def from_items(spark: SparkSession, items: Iterable[tuple[bytes, object]], value_type: str = "long", policy: Policy = KEEP_LEFT_EQUAL) -> "PathFrame":
        """A frame of pairs held by the driver; of a path that repeats the last value stays."""
        rows = [(bytearray(k), v) for k, v in dict(items).items()]
        return PathFrame(spark.createDataFrame(rows, f"path binary, value {value_type}"), policy)

    @staticmethod
    def unit(spark: SparkSession, paths: Iterable[bytes]) -> "PathFrame":
        return PathFrame.from_items(spark, [(p, True) for p in paths], "boolean", UNIT)

    @staticmethod
    def range(spark: SparkSession, start: int, stop: int, step: int = 1, value: int = 0, width: int = 8, big_endian: bool = True) -> "PathFrame":
        """Integers as paths of fixed width, all with one value; a negative step counts down to above ``stop``."""
        encode = codec.be_int if big_endian else codec.le_int
        return PathFrame(spark.range(start, stop, step).select(encode(F.col("id"), width).alias("path"), F.lit(value).cast("long").alias("value")))

    def with_policy(self, policy: Policy) -> "PathFrame":
        return replace(self, policy=policy)

    def _with(self, df: DataFrame) -> "PathFrame":
        return replace(self, df=df.select("path", "value"))

    # ------------------------------------------------------------ point access

    def get(self, path: bytes):
        """The value at a path, or None."""
        row = self.df.where(F.col("path") == F.lit(path)).select("value").first()
        return None if row is None else row[0]

    def contains(self, path: bytes) -> bool:
        """Whether a value is at the path."""
        return not self.df.where(F.col("path") == F.lit(path)).isEmpty()

    def contains_path(self, prefix: bytes) -> bool:
        """Whether some path begins with ``prefix``; the root always exists."""
        return not prefix or not self.below(prefix).isEmpty()

    def get_many(self, keys: DataFrame) -> DataFrame:
        """The keys (column ``path``) with their values, null where there is none."""
        return keys.join(self.df, "path", "left")

    def contains_many(self, keys: DataFrame) -> DataFrame:
        """The keys (column ``path``) at which a value is."""
        return keys.join(self.df.select("path"), "path", "left_semi")

    def contains_path_many(self, keys: DataFrame) -> DataFrame:
        """The keys (column ``path``) that some path begins with: prefixes of the keys' lengths join them."""
        from pathloom.operators.prefixes import lengths_of, prefixes_of

        starts = prefixes_of(self.df, lengths_of(keys)).select(F.col("prefix").alias("path")).distinct()
        found = keys.where(F.octet_length("path") > 0).join(starts, "path", "left_semi")
        return found.unionByName(keys.where(F.octet_length("path") == 0))

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def val_count(self) -> int:
        """Values below the root; the root's own does not count."""
        return self.df.where(F.octet_length("path") > 0).count()

    def val_count_at(self, focus: bytes) -> int:
        """Values at and below the focus."""
        return self.below(focus).count()

    def below(self, focus: bytes) -> DataFrame:
        """Rows at and below the focus, with whole paths."""
        return self.df.where(codec.starts_with(F.col("path"), focus))

    def at(self, focus: bytes) -> "PathFrame":
        """The subtree at the focus, its paths counted from there."""
        return self._with(self.below(focus).withColumn("path", codec.tail("path", len(focus))))

    def ordered(self) -> DataFrame:
        """All rows by path, the root first."""
        return self.df.orderBy("path")

    def ranked(self) -> DataFrame:
        """All rows with ``place``, their number in the order of paths from 0.

        Ranges of paths are sorted apart; a row's place is the one in its range plus the rows of
        the ranges before, of which there are as many as partitions.
        """
        spark = self.df.sparkSession
        order = self.df.repartitionByRange("path").sortWithinPartitions("path")
        numbered = save_table(order.select("path", "value", F.monotonically_increasing_id().alias("place")), "ranked", free=False)
        shift, before = 0, []
        for part, n in sorted(numbered.groupBy(F.shiftright("place", 33)).count().collect()):
            before.append((part, shift - (part << 33)))
            shift += n
        table = spark.createDataFrame(before, "part long, shift long")
        return numbered.withColumn("part", F.shiftright("place", 33)).join(F.broadcast(table), "part").select("path", "value", (F.col("place") + F.col("shift")).alias("place"))

    # ------------------------------------------------------------ updates

    def insert(self, updates: "PathFrame") -> "PathFrame":
        """Upsert: an update's value replaces the one at its path."""
        tagged = self.df.withColumn("seq", F.lit(0)).unionByName(updates.df.withColumn("seq", F.lit(1)))
        return self._with(tagged.groupBy("path").agg(F.max_by("value", "seq").alias("value")))

    def replaced_by(self, updates: "PathFrame") -> DataFrame:
        """(path, old): the values that :meth:`insert` would replace; null where there was none."""
        return updates.df.select("path").join(self.df.withColumnRenamed("value", "old"), "path", "left")

    def remove(self, keys: DataFrame) -> "PathFrame":
        """Without the keys (column ``path``)."""
        return self._with(self.df.join(keys.select("path"), "path", "left_anti"))

    def get_or_insert(self, keys: DataFrame, default: Column) -> DataFrame:
        """(path, value) of the keys, with the default where there is no value."""
        return self.get_many(keys.select("path")).withColumn("value", F.coalesce("value", default))
