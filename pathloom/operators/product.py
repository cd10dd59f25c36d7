"""The Cartesian product of path tables: at a value of one factor the next factor goes on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions import codec
from pathloom.operators.frame import PathFrame
from pathloom.operators.prefixes import prefix_minimal


def product(factors: list[PathFrame]) -> DataFrame:
    """path, value, ``focus_factor`` (from 0), ``n_factors`` and ``splits`` (where each further factor begins).

    In every factor but the last, a value hides what is below it. A path that ends with a value
    of factor j carries that value; roots take no part. The result has as many rows as the
    factors' sizes multiply to: restrict the factors first, or use :func:`product_below`.
    """
    rooted = [f.df.where(F.octet_length("path") > 0) for f in factors]
    least = [prefix_minimal(df) if i < len(rooted) - 1 else df for i, df in enumerate(rooted)]
    parts, so_far = [], None
    for j, df in enumerate(least):
        own = df.select(F.col("path").alias("p"), F.col("value").alias("v"))
        if so_far is None:
            now = own.select(F.col("p").alias("path"), F.col("v").alias("value"), F.array().cast("array<int>").alias("splits"))
        else:
            # The product itself is asked for, so all combinations are rows of the result.
            crossed = so_far.crossJoin(own)
            now = crossed.select(F.concat("path", "p").alias("path"), F.col("v").alias("value"), F.array_append("splits", F.octet_length("path")).alias("splits"))
        parts.append(now.withColumn("focus_factor", F.lit(j)).withColumn("n_factors", F.lit(len(factors))))
        so_far = now
    return reduce(DataFrame.unionByName, parts)


def product_below(factors: list[PathFrame], prefix: bytes) -> DataFrame:
    """The product's paths that begin with ``prefix``; the first factor is filtered before it is multiplied."""
    first = factors[0]
    ahead = codec.starts_with(F.col("path"), prefix) | F.lit(prefix).substr(F.lit(1), F.octet_length("path")).eqNullSafe(F.col("path"))
    return product([first._with(first.df.where(ahead)), *factors[1:]]).where(codec.starts_with(F.col("path"), prefix))
