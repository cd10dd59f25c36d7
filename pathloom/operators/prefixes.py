"""Prefixes as rows: the machinery behind every operator that relates paths by their beginning.

A join on "begins with" would compare all pairs. Here a path is exploded into its prefixes, of
only those lengths that the other side has, and joins by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import codec
from pathloom.shared import save_table


def lengths_of(paths: DataFrame) -> list[int]:
    """The distinct path lengths; as many as the longest path has bytes at most."""
    return sorted(r[0] for r in paths.select(F.octet_length("path")).distinct().collect())


def length_range(path: Column | str, first: int = 0, proper: bool = False) -> Column:
    """The prefix lengths of a path from ``first`` on; its own only if not ``proper``."""
    last = F.octet_length(path) - (1 if proper else 0)
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))


def prefixes_of(df: DataFrame, lengths: list[int] | None = None, proper: bool = False, first: int = 0) -> DataFrame:
    """Every row once for each prefix of its path: ``prefix`` and ``depth`` beside its columns.

    ``lengths`` limits the prefixes to those lengths; ``proper`` leaves the whole path out.
    """
    if lengths is None:
        wanted = length_range("path", first, proper)
    else:
        size = F.octet_length("path")
        fits = (lambda n: n < size) if proper else (lambda n: n <= size)
        wanted = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), fits)
    return df.withColumn("depth", F.explode(wanted)).withColumn("prefix", codec.head("path", F.col("depth")))


def prefix_minimal(paths: DataFrame) -> DataFrame:
    """Rows whose path begins with no other path of the table.

    The result is free of prefixes: a path can begin with one of its members at most.
    """
    lengths = lengths_of(paths)
    longer = prefixes_of(paths.select("path"), lengths, proper=True)
    shadowed = longer.join(paths.select(F.col("path").alias("prefix")), "prefix", "left_semi").select("path").distinct()
    return paths.join(shadowed, "path", "left_anti")


def covered(rows: DataFrame, stems: DataFrame) -> DataFrame:
    """Rows whose path begins with some stem, itself included.

    Only minimal stems matter, and of those a path has one at most, so the join by equality
    yields each row once and needs no distinct. A stem table that is small is broadcast by
    Spark's own size check; a larger one is shuffled.
    """
    # Their lengths are asked for twice; saved, the stems are computed once.
    least = save_table(prefix_minimal(save_table(stems.select("path").distinct(), "stems", free=False)), "least-stems", free=False)
    lengths = lengths_of(least)
    if not lengths:
        return rows.where("false")
    exploded = prefixes_of(rows, lengths)
    found = exploded.join(least.select(F.col("path").alias("prefix")), "prefix", "left_semi")
    return found.select(*rows.columns)


def covered_by(rows: DataFrame, stems: list[bytes]) -> DataFrame:
    """The same for few stems that the driver holds: byte ranges, which reach the scan."""
    test = F.lit(False)
    for stem in stems:
        test = test | codec.starts_with(F.col("path"), stem)
    return rows.where(test)
