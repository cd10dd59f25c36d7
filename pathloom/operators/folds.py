"""Folds of a trie from the leaves up, and unfolds from a seed down.

Three ways, from the cheapest: an aggregate over all prefixes at once (:func:`fold_prefixes`),
a loop over the levels of the compressed trie with a Column function (:func:`fold`), and Python
functions on whole subtrees (:func:`fold_python`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import codec
from pathloom.operators.frame import PathFrame
from pathloom.operators.nodes import compressed_nodes, node_table
from pathloom.operators.prefixes import lengths_of, prefixes_of
from pathloom.shared import new_path, save_table

#: (children, value, path) to the result of a node; children are an array of (byte, w) in byte order.
Algebra = Callable[[Column, Column, Column], Column]


def fold_prefixes(t: PathFrame, lengths: list[int] | None = None, **aggregates: Column) -> DataFrame:
    """(prefix, depth, ...): aggregates over all values at and below every prefix.

    The aggregates see ``path``, ``value`` and ``depth`` of the prefix.
    """
    return prefixes_of(t.df, lengths).groupBy("prefix", "depth").agg(*[c.alias(name) for name, c in aggregates.items()])


def fold(t: PathFrame, algebra: Algebra, w_type: str, steps: bool = False, jump: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """(prefix, w) of every node of the compressed trie.

    A node's result comes from its children's. With ``steps``, the algebra is also applied at
    every prefix of the chains between nodes, as if each byte were a node; else a child's byte
    is followed by the whole chain, over which ``jump(chain, w, path)`` carries the result up to
    ``path``, the parent and the child's byte. An empty table has the root alone, without
    children.

    Each round folds all nodes of one height, so there are as many rounds as branchings on the
    longest path. Nodes are stored by their height and results by their parent's, so a round
    reads what it needs and no more.
    """
    spark = t.df.sparkSession
    nodes = node_table(t.df)
    kind = f"array<struct<byte:int,w:{w_type}>>"
    none = F.array().cast(kind)
    levels = with_heights(compressed_nodes(nodes)).select("prefix", "depth", "value", "parent", "jumped", "height", "up")
    folder, out = new_path(spark, "fold-nodes"), new_path(spark, "fold-levels")
    levels.write.partitionBy("height").parquet(folder)
    kept = spark.read.schema(levels.schema).parquet(folder)
    highest = kept.agg(F.max("height")).first()[0]
    if highest is None:
        lone = spark.range(1).select(F.lit(b"").alias("prefix"))
        return lone.withColumn("w", algebra(none, F.lit(None), F.col("prefix")).cast(w_type))
    done = spark.read.schema(f"prefix binary, depth int, parent binary, byte int, w {w_type}, lifted {w_type}, up int")
    for height in range(highest + 1):
        ready = kept.where(F.col("height") == height)
        if height:
            arrived = done.parquet(out).where(F.col("up") == height).select(F.col("parent").alias("prefix"), F.struct("byte", F.col("lifted").alias("w")).alias("c"))
            ready = ready.join(arrived.groupBy("prefix").agg(F.array_sort(F.collect_list("c")).alias("children")), "prefix")
        else:
            ready = ready.withColumn("children", none)
        folded = ready.withColumn("w", algebra(F.col("children"), F.col("value"), F.col("prefix")).cast(w_type))
        start = F.col("depth") - F.col("jumped")
        byte = F.when(F.col("depth") > 0, codec.byte_at("prefix", start)).alias("byte")
        folded = folded.select("prefix", "depth", "parent", byte, "w", _lift(algebra, w_type, steps, jump).alias("lifted"), "up")
        folded.write.mode("append").partitionBy("up").parquet(out)
    found = done.parquet(out)
    result = found.select("prefix", "w")
    if steps:
        # A root that is neither value nor branch still gets the result of the chain below it.
        chain = found.where("parent is null and depth > 0").select(F.array(F.struct("byte", F.col("lifted").alias("w"))).alias("children"), F.lit(b"").alias("prefix"))
        result = result.unionByName(chain.select("prefix", algebra(F.col("children"), F.lit(None), F.col("prefix")).cast(w_type).alias("w")))
    return result


def with_heights(kept: DataFrame) -> DataFrame:
    """Compressed nodes with ``height``, the nodes on the longest way down, and ``up``, their parent's height (-1 for the topmost).

    A node's rank is the number of nodes above it; its height is the greatest rank below it less its own.
    """
    above = prefixes_of(kept.select(F.col("prefix").alias("path")), proper=True).join(kept.select("prefix"), "prefix").select("path", "prefix")
    rank = above.groupBy("path").agg(F.count("*").cast("int").alias("rank"))
    deepest = above.join(rank, "path").groupBy("prefix").agg(F.max("rank").alias("deepest"))
    own = kept.join(rank.withColumnRenamed("path", "prefix"), "prefix", "left").join(deepest, "prefix", "left")
    rank_or_0 = F.coalesce("rank", F.lit(0))
    own = save_table(own.withColumn("height", F.coalesce(F.col("deepest") - rank_or_0, F.lit(0))).drop("rank", "deepest"), "node-heights", free=False)
    ups = own.select(F.col("prefix").alias("parent"), F.col("height").alias("up"))
    return own.join(ups, "parent", "left").withColumn("up", F.coalesce("up", F.lit(-1)))


def _lift(algebra: Algebra, w_type: str, steps: bool, jump=None) -> Column:
    """A node's result carried up the chain to the byte below its parent."""
    start = F.col("depth") - F.col("jumped")
    if not steps:
        if jump is None:
            return F.col("w")
        chain = codec.tail("prefix", start + 1)
        return F.when(F.col("jumped") > 1, jump(chain, F.col("w"), codec.head("prefix", start + 1))).otherwise(F.col("w")).cast(w_type)
    lengths = F.when(F.col("jumped") > 1, F.sequence(F.col("depth") - 1, start + 1)).otherwise(F.array().cast("array<int>"))

    def up(w: Column, n: Column) -> Column:
        child = F.array(F.struct(codec.byte_at("prefix", n).alias("byte"), w.alias("w")))
        return algebra(child, F.lit(None), codec.head("prefix", n)).cast(w_type)

    return F.aggregate(lengths, F.col("w"), up)


def split_algebra(map_: Callable[[Column, Column], Column], collapse: Callable[[Column, Column, Column], Column], combine: Callable[[Column, Column], Column]) -> Algebra:
    """An algebra of three parts: a leaf's value, a value that meets the result below it, and children."""

    def whole(children: Column, value: Column, path: Column) -> Column:
        below = combine(children, path)
        return F.when(F.size(children) == 0, map_(value, path)).when(value.isNull(), below).otherwise(collapse(value, below, path))

    return whole


def totals(children: Column, start: Column | None = None) -> Column:
    """The sum of the children's results."""
    return F.aggregate(children, F.lit(0).cast("long") if start is None else start, lambda a, c: a + c["w"])


def content_hashes(t: PathFrame) -> DataFrame:
    """(prefix, hash) of every node of the compressed trie: equal subtrees, values included, have equal hashes wherever they are.

    A Merkle hash: a node hashes its value and, for each child, the bytes down to it and its hash.
    """

    def algebra(children: Column, value: Column, path: Column) -> Column:
        parts = F.transform(children, lambda c: F.concat(F.hex(codec.tail(c["w"]["path"], F.octet_length(path))), F.lit(":"), c["w"]["hash"]))
        own = F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.to_json(F.struct(value.alias("v")))))
        return F.struct(F.sha2(F.concat_ws("|", own, F.array_join(parts, ",")), 256).alias("hash"), path.alias("path"))

    return fold(t, algebra, "struct<hash:string,path:binary>").select("prefix", F.col("w.hash").alias("hash"))


def content_hash(t: PathFrame) -> str:
    """The hash of a whole table: tables with the same paths and values have the same, in any layout."""
    top = content_hashes(t).orderBy("prefix").first()
    return hashlib.sha256(f"{bytes(top['prefix']).hex()}|{top['hash']}".encode()).hexdigest()


#: Items that one task, or the driver at the end, folds with a Python function.
FOLD_ITEMS = 100_000


def fold_python(t: PathFrame, algebra: Callable, limit: int = FOLD_ITEMS):
    """Fold with any Python function ``algebra(mask, results, value, path)``; returns the root's result.

    ``mask`` lists the children's bytes. In each round, the largest subtrees of at most ``limit``
    items (over 256) are folded, each in one task that reads its sorted paths with a stack as deep
    as a path, and become one item; the last ``limit`` items are folded on the driver. Prefixes
    that many paths share are thus split until they are small. Results must pickle.
    """
    import pickle

    if limit <= 256:
        raise ValueError("a node can have 256 children and a value")
    items = t.df.select("path", "value", F.lit(None).cast("binary").alias("w"))
    kind = items.schema

    def one(table: pa.Table) -> pa.Table:
        head = table.column("head")[0].as_py()
        found = _fold_sorted(_items(table), algebra, len(head))
        row = {"path": [head], "value": [None], "w": [pickle.dumps(found)]}
        return pa.table({c: pa.array(v, table.schema.field(c).type) for c, v in row.items()})

    while items.count() > limit:
        heavy = prefixes_of(items.select("path")).groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") > limit)
        heavy = save_table(heavy.select("prefix"), "heavy-prefixes", free=False)
        cut = prefixes_of(items, lengths_of(heavy.withColumnRenamed("prefix", "path"))).join(heavy, "prefix").groupBy("path").agg(F.max("depth").alias("cut"))
        each = items.join(cut, "path")
        below = each.where(F.octet_length("path") > F.col("cut")).withColumn("head", codec.head("path", F.col("cut") + 1)).drop("cut")
        stay = each.where(F.octet_length("path") == F.col("cut")).drop("cut")
        items = save_table(below.groupBy("head").applyInArrow(one, kind).unionByName(stay), "folded-items", free=False)
    return _fold_sorted(_items(items.toArrow()), algebra, 0)


def _items(table: pa.Table) -> list[tuple]:
    """(path, value, result): a value, or the result of the whole subtree there."""
    import pickle

    rows = zip(*(table.column(c).to_pylist() for c in ("path", "value", "w")))
    return sorted(((p, v, None if w is None else (pickle.loads(w),)) for p, v, w in rows), key=lambda r: r[0])


def _fold_sorted(items: list[tuple], algebra: Callable, root: int):
    """Fold sorted items that share ``root`` bytes; each prefix on the way is a node."""
    if items and items[0][2] is not None and len(items[0][0]) == root:
        return items[0][2][0]
    stack: list[tuple[list, list, object]] = [([], [], None)]  # per depth from root: child bytes, results, value
    path = items[0][0][:root] if items else b""

    def close(to: int):
        while len(stack) > to:
            mask, results, value = stack.pop()
            w = algebra(mask, results, value, path[: root + len(stack)])
            if not stack:
                return w
            stack[-1][0].append(path[root + len(stack) - 1])
            stack[-1][1].append(w)

    for p, v, result in items:
        shared = next((i for i, (a, b) in enumerate(zip(path, p)) if a != b), min(len(path), len(p)))
        close(shared - root + 1)
        path = p if result is None else p[:-1]
        while len(stack) < len(path) - root + 1:
            stack.append(([], [], None))
        mask, results, value = stack[-1]
        if result is None:
            stack[-1] = (mask, results, v)
        else:
            mask.append(p[-1])
            results.append(result[0])
    return close(0)


# ---------------------------------------------------------------- unfolds


def unfold(seed: DataFrame, value: Column, children: Column, grafts: DataFrame | None = None) -> DataFrame:
    """Grow (path, value) from a seed of (path, state).

    For each position ``value`` gives its value, null for none, and ``children`` an array of
    (path, state) to go on with, both as expressions of ``path`` and ``state``. Child paths count
    from the position. Rounds end when no position is left. ``grafts`` (path, value) are whole
    subtrees to add at their places; where both have a path, the grown one stays.
    """
    grown, front = None, seed.select("path", "state")
    while True:
        front = save_table(front.select("path", "state", value.alias("value"), children.alias("children")), "unfold", free=False)
        if front.isEmpty():
            break
        rows = front.where("value is not null").select("path", "value")
        grown = rows if grown is None else grown.unionByName(rows)
        front = front.select("path", F.explode("children").alias("c")).select(F.concat("path", "c.path").alias("path"), F.col("c.state").alias("state"))
    if grown is None:
        grown = front.select("path", "value")
    if grafts is not None:
        grown = grown.unionByName(grafts.join(grown, "path", "left_anti"))
    return grown


class Builder:
    """The children that one step of a Python unfold asks for.

    ``push`` takes them in ascending order with different first bytes. ``tolerant_push`` takes
    any order; of children with the same path the last one stays. ``graft`` adds whole rows.
    """

    def __init__(self):
        self.children: dict[bytes, object] = {}
        self.grafts: list[tuple[bytes, object]] = []

    def __len__(self) -> int:
        return len(self.children)

    def mask(self) -> list[int]:
        return sorted({p[0] for p in self.children})

    def push(self, path: bytes, state) -> None:
        if not path:
            raise ValueError("a child needs a path")
        if self.children and path[0] <= max(p[0] for p in self.children):
            raise ValueError("children come in ascending order of their first bytes")
        self.children[path] = state

    def push_byte(self, b: int, state) -> None:
        self.push(bytes([b]), state)

    def set_child_mask(self, mask: list[int], states: list) -> None:
        """All children at once, one state for each byte of the mask."""
        if self.children:
            raise ValueError("there are children already")
        for b, s in zip(sorted(mask), states, strict=True):
            self.push_byte(b, s)

    def tolerant_push(self, path: bytes, state) -> None:
        if not path:
            raise ValueError("a child needs a path")
        self.children[path] = state

    def graft_at_byte(self, b: int, rows: list[tuple[bytes, object]]) -> None:
        self.grafts += [(bytes([b]) + p, v) for p, v in rows]


def unfold_python(spark: SparkSession, seeds: list[tuple[bytes, object]], step: Callable, value_type: str) -> DataFrame:
    """Grow (path, value) with ``step(state, builder, path)``, which returns a value or None.

    Each seed is grown in a task of its own, depth first; seeds must have distinct paths.
    """
    import pickle

    schema = f"path binary, value {value_type}"
    table = spark.createDataFrame([(bytearray(p), bytearray(pickle.dumps(s))) for p, s in seeds], "path binary, state binary")
    kind = spark.createDataFrame([], schema).toArrow().schema

    def run(batches):
        for batch in batches:
            for start, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                stack, rows = [(start, pickle.loads(blob))], []
                while stack:
                    path, state = stack.pop()
                    builder = Builder()
                    found = step(state, builder, path)
                    if found is not None:
                        rows.append((path, found))
                    stack += [(path + p, s) for p, s in builder.children.items()]
                    rows += [(path + p, v) for p, v in builder.grafts]
                cols = list(zip(*rows)) or [[], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind)], schema=kind)

    return table.repartition(max(1, len(seeds))).mapInArrow(run, schema)


# ---------------------------------------------------------------- ready-made folds


def leaf_count(t: PathFrame) -> int:
    """Paths that no other path continues."""
    return node_table(t.df).where("child_count = 0").count()


def longest_path(t: PathFrame) -> bytes | None:
    """The path with the most bytes; of equally long ones the least."""
    row = t.df.agg(F.min_by("path", F.struct((-F.octet_length("path")).alias("n"), "path"))).first()
    return None if row[0] is None else bytes(row[0])


def values_at_branches(t: PathFrame) -> DataFrame:
    """(prefix, value) of values at which the trie branches."""
    return node_table(t.df).where("is_value and child_count > 1").select("prefix", "value")


def digit_sum(t: PathFrame) -> int:
    """The sum of the digits, as characters, over all prefixes of the trie; each prefix counts its last byte."""
    last = codec.byte_at("prefix", F.octet_length("prefix") - 1) - 48
    return node_table(t.df, first=1).agg(F.coalesce(F.sum(last), F.lit(0))).first()[0]
