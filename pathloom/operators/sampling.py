"""Samples of tries, generators of test tries, and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.functions import bytemask, codec
from pathloom.operators.frame import PathFrame
from pathloom.operators.nodes import node_table
from pathloom.shared import save_table


def histogram(df: DataFrame, item: Column) -> DataFrame:
    """(item, n) by falling count."""
    return df.groupBy(item.alias("item")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item")


def _chance(seed: int, *of: str | Column) -> Column:
    return F.xxhash64(F.lit(seed), *of)


def fair_values(t: PathFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows, each value with the same chance; the same seed gives the same rows."""
    return t.df.orderBy(_chance(seed, "path")).limit(n)


def fair_paths(t: PathFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` existing prefixes (column ``path``), each with the same chance."""
    nodes = node_table(t.df).select(F.col("prefix").alias("path"))
    return nodes.orderBy(_chance(seed, "path")).limit(n)


def descents(t: PathFrame, n: int, depth: int, seed: int = 0, to_value: bool = True) -> DataFrame:
    """``n`` random walks from the root, at each node by a branch chosen with equal chance.

    (walk, path): a walk to a value ends at the first one below the root; else after ``depth``
    bytes or at a leaf.
    """
    nodes = save_table(node_table(t.df).select(F.col("prefix").alias("path"), "mask", "child_count", "is_value"), "walk-nodes", free=False)
    walks = t.df.sparkSession.range(n).select(F.col("id").alias("walk"), F.lit(b"").alias("path"), F.lit(False).alias("over"))
    for step in range(depth):
        seen = walks.join(nodes, "path")
        stop = F.col("over") | (F.col("child_count") == 0) | (F.lit(to_value and step > 0) & F.col("is_value"))
        place = F.pmod(_chance(seed, "walk", F.lit(step)), F.greatest("child_count", F.lit(1)))
        child = F.concat("path", codec.byte(bytemask.select(F.col("mask"), place)))
        walks = seen.select("walk", F.when(stop, F.col("path")).otherwise(child).alias("path"), stop.alias("over"))
    return walks.select("walk", "path")


def uniform_trie(spark: SparkSession, n: int, length: Column, byte_of, value: Column, seed: int = 0) -> PathFrame:
    """``n`` draws of random paths; ``length`` may use ``id``, ``byte_of(chance)`` maps a random long to a byte.

    Of draws with the same path the last stays.
    """
    rows = spark.range(n).withColumn("n", length)
    digits = F.transform(F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array().cast("array<int>")), lambda i: F.hex(codec.byte(byte_of(_chance(seed, F.col("id"), i)))))
    return PathFrame.bulk(rows, F.unhex(F.array_join(digits, "")), value, F.col("id"))


# ---------------------------------------------------------------- distributions
# A distribution is a function from a random long Column to a value Column.


def degenerate(value: Column):
    return lambda chance: value


def categorical(values: list, weights: list[int]):
    """One of the values, in proportion to its weight."""
    total, edge, out = sum(weights), 0, None

    def draw(chance: Column) -> Column:
        nonlocal edge, out
        edge, out = 0, None
        at = F.pmod(chance, F.lit(total))
        for v, w in zip(values, weights):
            edge += w
            out = F.when(at < edge, F.lit(v)) if out is None else out.when(at < edge, F.lit(v))
        return out

    return draw


def mapped(draw, f):
    return lambda chance: f(draw(chance))


def product2(a, b, combine):
    """Two independent draws combined."""
    return lambda chance: combine(a(F.xxhash64(chance, F.lit(1))), b(F.xxhash64(chance, F.lit(2))))


def choice2(a, b, share: float):
    """A draw from ``a`` with that chance, else from ``b``."""
    return lambda chance: F.when(F.pmod(chance, F.lit(1 << 30)) < int(share * (1 << 30)), a(F.xxhash64(chance, F.lit(1)))).otherwise(b(F.xxhash64(chance, F.lit(2))))


def dependent2(a, of_a):
    """A second draw whose distribution depends on the first."""
    return lambda chance: of_a(a(F.xxhash64(chance, F.lit(1))))(F.xxhash64(chance, F.lit(2)))


def repeated(draw, n: Column):
    """An array of ``n`` draws."""
    at = lambda: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return lambda chance: F.transform(at(), lambda i: draw(F.xxhash64(chance, i)))


#: Draws that one round makes for each row that is not decided yet.
ROUND = 16


def _rounds(df: DataFrame, chance: Column, first: Column, step) -> DataFrame:
    """Rows of ``df`` with ``state``, after rounds of ``step(state, chance)`` until none is left with ``state.over`` false.

    A round makes ROUND steps of the rows that are not over. Chances never repeat, so the rounds
    end with probability one if a step can end a row at all.
    """
    waiting, done, k = df.withColumn("chance", chance).withColumn("state", first), None, 0
    while True:
        numbers = F.sequence(F.lit(k * ROUND), F.lit(k * ROUND + ROUND - 1))
        stepped = waiting.withColumn("state", F.aggregate(numbers, F.col("state"), lambda s, i: F.when(s["over"], s).otherwise(step(s, F.xxhash64("chance", i)))))
        stepped = save_table(stepped, "draws", free=False)
        over = stepped.where("state.over")
        done = over if done is None else done.unionByName(over)
        waiting, k = stepped.where("not state.over"), k + 1
        if waiting.isEmpty():
            return done.drop("chance")


def concentrated(df: DataFrame, chance: Column, draw, start: Column, change, out, name: str) -> DataFrame:
    """Adds a column: draws change a state until there is an output.

    From ``start``, each draw x makes the state ``change(state, x)``; the first ``out(state, x)``
    that is not null, for the state before the draw, is the result.
    """
    probe = df.select(out(start, draw(chance)).alias("y")).schema["y"].dataType
    first = F.struct(start.alias("a"), F.lit(None).cast(probe).alias("y"), F.lit(False).alias("over"))

    def step(s: Column, c: Column) -> Column:
        x = draw(c)
        y = out(s["a"], x)
        return F.struct(change(s["a"], x).cast(kind).alias("a"), y.alias("y"), y.isNotNull().alias("over"))

    kind = df.select(start.alias("a")).schema["a"].dataType
    return _rounds(df, chance, first, step).withColumn(name, F.col("state.y")).drop("state")


def collected(df: DataFrame, chance: Column, draw, f, name: str) -> DataFrame:
    """Adds a column: the first ``f(draw)`` that is not null, however many draws that takes."""
    return concentrated(df, chance, draw, F.lit(0), lambda a, x: a, lambda a, x: f(x), name)


def filtered(df: DataFrame, chance: Column, draw, test, name: str) -> DataFrame:
    """Adds a column: the first draw that passes."""
    return collected(df, chance, draw, lambda x: F.when(test(x), x), name)


def until(df: DataFrame, chance: Column, draw, stop: Column, name: str) -> DataFrame:
    """Adds a column: the array of all draws up to the first that is ``stop``, without it."""
    kind = df.select(F.array(draw(chance)).alias("a")).schema["a"].dataType
    grow = lambda a, x: F.concat(a, F.array(x))
    return concentrated(df, chance, draw, F.array().cast(kind), grow, lambda a, x: F.when(x == stop, a), name)


def diluted(draw, start, items):
    """Arrays of results: a draw becomes a state by ``start``, and ``items(state)`` lists what it yields."""
    return lambda chance: items(start(draw(chance)))


def branches_by_weight(t: PathFrame, prefix: bytes) -> DataFrame:
    """(byte, n, share): how the values below a prefix spread over its branches."""
    below = t.below(prefix).where(F.octet_length("path") > len(prefix))
    counts = below.groupBy(codec.byte_at("path", len(prefix)).alias("byte")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # at most 256 rows
