"""Navigation: moves of many positions at once, and a cursor for a single one.

The batch moves take positions (column ``path``; other columns stay) and answer with a join by
equality against the node table; no move compares positions with all paths.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import bytemask, codec
from pathloom.operators.frame import PathFrame
from pathloom.operators.nodes import compressed_nodes, node_table
from pathloom.operators.prefixes import lengths_of, prefixes_of


def _nodes(t: PathFrame, pos: DataFrame) -> DataFrame:
    return node_table(t.df, lengths_of(pos))


def look(t: PathFrame, pos: DataFrame) -> DataFrame:
    """Adds ``exists``, ``is_value``, ``value``, ``mask``, ``child_count`` and ``n_values`` at each position."""
    nodes = _nodes(t, pos).select(F.col("prefix").alias("path"), F.lit(True).alias("exists"), "is_value", "value", "mask", "child_count", "n_values")
    zero = {"exists": F.lit(False), "is_value": F.lit(False), "child_count": F.lit(0), "n_values": F.lit(0), "mask": bytemask.empty()}
    return pos.join(nodes, "path", "left").withColumns({c: F.coalesce(F.col(c), v) for c, v in zero.items()})


def move_to_path(t: PathFrame, pos: DataFrame, target: str) -> DataFrame:
    """Adds ``overlap``, the bytes that position and target share, and ``exists``, of the target."""
    keys = pos.select(F.col(target).alias("path")).distinct()
    found = t.contains_path_many(keys).select(F.col("path").alias(target), F.lit(True).alias("exists"))
    return pos.withColumn("overlap", codec.overlap(F.col("path"), F.col(target))).join(found, target, "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def descend_to(t: PathFrame, pos: DataFrame, key: Column) -> DataFrame:
    """Moves down by ``key`` even where nothing is: ``moved`` and ``exists``."""
    moved = pos.withColumn("moved", F.concat("path", key))
    found = t.contains_path_many(moved.select(F.col("moved").alias("path")).distinct()).select(F.col("path").alias("moved"), F.lit(True).alias("exists"))
    return moved.join(found, "moved", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def descend_to_existing(t: PathFrame, keys: DataFrame) -> DataFrame:
    """Adds ``n``, the bytes of each key (column ``path``) along which the trie exists."""
    mine = prefixes_of(keys.select("path").distinct(), first=1)
    longest = max(lengths_of(keys), default=0)
    theirs = prefixes_of(t.df.select("path"), list(range(1, longest + 1))).select("prefix").distinct()
    found = mine.join(theirs, "prefix", "left_semi").groupBy("path").agg(F.max("depth").alias("n"))
    return keys.join(found, "path", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def descend_to_value(t: PathFrame, keys: DataFrame) -> DataFrame:
    """Adds ``n``: the bytes down to the first value along each key, else to where the trie ends.

    A value at the start, the empty prefix, does not stop the descent.
    """
    mine = prefixes_of(keys.select("path").distinct(), first=1)
    values = t.df.select(F.col("path").alias("prefix"))
    first = mine.join(values, "prefix", "left_semi").groupBy("path").agg(F.min("depth").alias("v"))
    return descend_to_existing(t, keys).join(first, "path", "left").withColumn("n", F.coalesce("v", "n")).drop("v")


def descend_branch(t: PathFrame, pos: DataFrame, index: Column | int = 0) -> DataFrame:
    """Adds ``moved``: the child with that place in byte order; null if there is none."""
    place = index if isinstance(index, Column) else F.lit(index)
    child = bytemask.select(F.col("mask"), place)
    return look(t, pos).withColumn("moved", F.concat("path", codec.byte(child))).select(*pos.columns, "moved")


def descend_until(t: PathFrame, pos: DataFrame) -> DataFrame:
    """Adds ``moved``: along single children to the next value or branch; a branch or a leaf stays.

    Every stop covers the chain above it up to the stop before, which it shares with no other
    unless that is a branch. So each prefix has one stop at most, and positions join by equality.
    """
    stops = compressed_nodes(node_table(t.df)).select("prefix", "depth", "jumped", "parent", "child_count")
    single = stops.where("child_count = 1").select(F.col("prefix").alias("parent"), F.lit(True).alias("single"))
    starts = stops.join(single, "parent", "left").withColumn("low", F.col("depth") - F.col("jumped") + F.when(F.col("parent").isNull() | F.col("single"), 0).otherwise(1))
    chain = starts.where("low < depth").withColumn("n", F.explode(F.sequence("low", F.col("depth") - 1)))
    near = chain.select(codec.head("prefix", F.col("n")).alias("path"), F.col("prefix").alias("moved"))
    return pos.join(near, "path", "left").withColumn("moved", F.coalesce("moved", "path"))


def ascend(pos: DataFrame, n: int, root: int = 0) -> DataFrame:
    """Adds ``moved``, up to ``n`` bytes up but not above ``root`` bytes, and ``whole``: it was ``n``."""
    size = F.octet_length("path")
    return pos.withColumn("moved", codec.head("path", F.greatest(size - n, F.lit(root)))).withColumn("whole", size - n >= root)


def ascend_until(t: PathFrame, pos: DataFrame, branches_only: bool = False) -> DataFrame:
    """Adds ``moved``: the nearest node strictly above that is a branch or a value, else the root."""
    above = prefixes_of(pos.select("path").distinct(), proper=True)
    test = F.col("child_count") > 1 if branches_only else (F.col("child_count") > 1) | F.col("is_value")
    stops = node_table(t.df).where(test).select("prefix")
    found = above.join(stops, "prefix", "left_semi").groupBy("path").agg(F.max("depth").alias("d"))
    return pos.join(found, "path", "left").withColumn("moved", codec.head("path", F.coalesce("d", F.lit(0)))).drop("d")


def sibling(t: PathFrame, pos: DataFrame, forward: bool = True) -> DataFrame:
    """Adds ``moved``: the next or previous child byte of the same parent; null at the end or at the root."""
    up = pos.where(F.octet_length("path") > 0).withColumn("parent", codec.head("path", F.octet_length("path") - 1))
    nodes = _nodes(t, up.select(F.col("parent").alias("path"))).select(F.col("prefix").alias("parent"), "mask")
    step = bytemask.next_byte if forward else bytemask.previous_byte
    last = codec.byte_at("path", F.octet_length("path") - 1)
    moved = up.join(nodes, "parent", "left").withColumn("moved", F.concat("parent", codec.byte(step(F.col("mask"), last))))
    root = pos.where(F.octet_length("path") == 0).withColumn("moved", F.lit(None).cast("binary"))
    return moved.select(*pos.columns, "moved").unionByName(root)


def _turns(t: PathFrame, pos: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each position the deepest ancestor with a later branch, and that branch (``turn``)."""
    above = prefixes_of(pos.select("path").distinct(), proper=True)
    later = bytemask.next_byte(F.col("mask"), codec.byte_at("path", F.col("depth")))
    turns = above.join(nodes.select("prefix", "mask"), "prefix").withColumn("turn", F.concat("prefix", codec.byte(later))).where("turn is not null")
    return turns.groupBy("path").agg(F.max_by("turn", "depth").alias("turn"))


def next_step(t: PathFrame, pos: DataFrame) -> DataFrame:
    """Adds ``moved``: the next prefix in a walk over all of them; null after the last.

    That is the first child, else the next branch of the nearest ancestor that has one.
    """
    nodes = node_table(t.df)
    child = nodes.where("child_count > 0").select(F.col("prefix").alias("path"), F.concat("prefix", codec.byte(bytemask.first(F.col("mask")))).alias("child"))
    return pos.join(child, "path", "left").join(_turns(t, pos, nodes), "path", "left").withColumn("moved", F.coalesce("child", "turn")).select(*pos.columns, "moved")


def next_value(t: PathFrame, pos: DataFrame) -> DataFrame:
    """Adds ``moved``: the next path with a value in byte order; null after the last."""
    nodes = node_table(t.df)
    below = nodes.select(F.col("prefix").alias("path"), "first_below")
    first = nodes.select(F.col("prefix").alias("turn"), "first_value")
    turns = _turns(t, pos, nodes).join(first, "turn")
    return pos.join(below, "path", "left").join(turns, "path", "left").withColumn("moved", F.coalesce("first_below", "first_value")).select(*pos.columns, "moved")


def k_paths(t: PathFrame, k: int, focus: bytes = b"") -> DataFrame:
    """The existing paths of exactly ``k`` bytes below the focus (column ``path``); longer ones are cut."""
    size = len(focus) + k
    return t.below(focus).where(F.octet_length("path") >= size).select(codec.head("path", size).alias("path")).distinct()


@dataclass(frozen=True)
class Cursor:
    """A single position; each move runs a small query and returns a new cursor or None.

    ``root`` bytes of ``at`` are the fixed prefix that the cursor cannot leave.
    """

    frame: PathFrame
    at: bytes = b""
    root: int = 0

    @property
    def path(self) -> bytes:
        return self.at[self.root :]

    @property
    def origin_path(self) -> bytes:
        return self.at

    @property
    def root_prefix_path(self) -> bytes:
        return self.at[: self.root]

    def at_root(self) -> bool:
        return len(self.at) == self.root

    def reset(self) -> "Cursor":
        return self._to(self.at[: self.root])

    def fork(self) -> "Cursor":
        """A cursor whose root is here."""
        return replace(self, root=len(self.at))

    def make_map(self) -> PathFrame:
        return self.frame.at(self.at)

    def _to(self, at: bytes) -> "Cursor":
        return replace(self, at=at)

    def path_exists(self) -> bool:
        return self.frame.contains_path(self.at)

    def is_value(self) -> bool:
        return self.frame.contains(self.at)

    def value(self):
        return self.frame.get(self.at)

    def val_count(self) -> int:
        return self.frame.val_count_at(self.at)

    def branches(self) -> list[int]:
        """The bytes of the children."""
        below = self.frame.below(self.at).where(F.octet_length("path") > len(self.at))
        return sorted(r[0] for r in below.select(codec.byte_at("path", len(self.at))).distinct().collect())

    def child_count(self) -> int:
        return len(self.branches())

    def move_to_path(self, path: bytes) -> tuple["Cursor", int, bool]:
        """(cursor, bytes shared with the path before, whether the path exists)."""
        shared = next((i for i, (a, b) in enumerate(zip(self.path, path)) if a != b), min(len(self.path), len(path)))
        moved = self._to(self.root_prefix_path + path)
        return moved, shared, moved.path_exists()

    def descend_to(self, key: bytes) -> "Cursor":
        return self._to(self.at + key)

    def descend_to_byte(self, b: int) -> "Cursor":
        return self.descend_to(bytes([b]))

    def descend_to_existing(self, key: bytes) -> tuple["Cursor", int]:
        """Down along the key as far as the trie exists, and by how many bytes."""
        tried = self.frame.df.sparkSession.createDataFrame([(bytearray(key),)], "path binary")
        n = descend_to_existing(self.frame.at(self.at), tried).first()["n"]
        return self.descend_to(key[:n]), n

    def descend_to_value(self, key: bytes) -> tuple["Cursor", int]:
        tried = self.frame.df.sparkSession.createDataFrame([(bytearray(key),)], "path binary")
        n = descend_to_value(self.frame.at(self.at), tried).first()["n"]
        return self.descend_to(key[:n]), n

    def descend_indexed_branch(self, i: int) -> "Cursor | None":
        found = self.branches()
        return self.descend_to_byte(found[i]) if i < len(found) else None

    def descend_first_byte(self) -> "Cursor | None":
        return self.descend_indexed_branch(0)

    def descend_until(self) -> "Cursor | None":
        """Along single children to the next value or branch; None at a branch or a leaf."""
        if self.child_count() != 1:
            return None
        here = self
        while True:
            here = here.descend_first_byte()
            if here.is_value() or here.child_count() != 1:
                return here

    def ascend(self, n: int) -> tuple["Cursor", bool]:
        """Up by ``n`` bytes as far as the root; whether that was all of them."""
        up = min(n, len(self.path))
        return self._to(self.at[: len(self.at) - up]), up == n

    def ascend_byte(self) -> tuple["Cursor", bool]:
        return self.ascend(1)

    def ascend_until(self, branches_only: bool = False) -> "Cursor | None":
        """To the nearest branch or value above, or the root; None at the root."""
        if self.at_root():
            return None
        here = self.ascend(1)[0]
        while not here.at_root() and here.child_count() <= 1 and (branches_only or not here.is_value()):
            here = here.ascend(1)[0]
        return here

    def ascend_until_branch(self) -> "Cursor | None":
        return self.ascend_until(True)

    def _sibling(self, forward: bool) -> "Cursor | None":
        if self.at_root():
            return None
        up = self.ascend(1)[0]
        found = [b for b in up.branches() if (b > self.at[-1] if forward else b < self.at[-1])]
        return up.descend_to_byte(found[0] if forward else found[-1]) if found else None

    def to_next_sibling_byte(self) -> "Cursor | None":
        return self._sibling(True)

    def to_prev_sibling_byte(self) -> "Cursor | None":
        return self._sibling(False)

    def to_next_step(self) -> "Cursor | None":
        """The next prefix in a walk over all below the root."""
        found = self.descend_first_byte()
        here = self
        while found is None and not here.at_root():
            found = here.to_next_sibling_byte()
            here = here.ascend(1)[0]
        return found

    def to_next_val(self) -> "Cursor | None":
        """The next value in byte order below the root; the root's own is never one."""
        inside = self.frame.below(self.root_prefix_path)
        row = inside.where((F.col("path") > F.lit(self.at)) & (F.octet_length("path") > self.root)).agg(F.min("path")).first()
        return None if row[0] is None else self._to(bytes(row[0]))

    def descend_first_k_path(self, k: int) -> "Cursor | None":
        row = k_paths(self.frame, k, self.at).agg(F.min("path")).first()
        return None if row[0] is None else self._to(bytes(row[0]))

    def to_next_k_path(self, k: int) -> "Cursor | None":
        row = k_paths(self.frame, k, self.at[: len(self.at) - k]).where(F.col("path") > F.lit(self.at)).agg(F.min("path")).first()
        return None if row[0] is None else self._to(bytes(row[0]))
