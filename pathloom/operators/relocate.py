"""Operators on the subtree at a focus: cut, copy, merge, and move it.

Rows outside the focus are never touched. Each operator is a filter by byte range and a change
of paths; only merges need an exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import codec
from pathloom.operators import algebra
from pathloom.operators.frame import PathFrame
from pathloom.operators.prefixes import covered


def _outside(t: PathFrame, focus: bytes) -> DataFrame:
    return t.df.where(~codec.starts_with(F.col("path"), focus))


def _is(focus: bytes) -> Column:
    return F.col("path") == F.lit(focus)


def _strictly_below(t: PathFrame, focus: bytes) -> DataFrame:
    return t.below(focus).where(F.octet_length("path") > len(focus))


def _placed(df: DataFrame, focus: bytes) -> DataFrame:
    return df.select(F.concat(F.lit(focus), "path").alias("path"), "value")


def _keep(t: PathFrame, focus: bytes, *parts: DataFrame) -> PathFrame:
    out = _outside(t, focus)
    for p in parts:
        out = out.unionByName(p.select("path", "value"))
    return t._with(out)


def set_value(t: PathFrame, focus: bytes, value) -> PathFrame:
    """Upsert at the focus."""
    row = t.df.sparkSession.createDataFrame([(bytearray(focus), value)], t.df.schema)
    return t._with(t.df.where(~_is(focus)).unionByName(row))


def remove_value(t: PathFrame, focus: bytes) -> PathFrame:
    """Without the value at the focus; what is below stays."""
    return t._with(t.df.where(~_is(focus)))


def graft(t: PathFrame, focus: bytes, source: PathFrame, at: bytes = b"") -> PathFrame:
    """The subtree at the focus is replaced by the source's subtree at ``at``, its value included.

    A source without anything there leaves the focus empty.
    """
    return _keep(t, focus, _placed(source.at(at).df, focus))


def join_at(t: PathFrame, focus: bytes, source: PathFrame, at: bytes = b"", with_root: bool = False) -> PathFrame:
    """Union below the focus with the source's subtree; ``with_root`` includes the values at both."""
    mine, theirs = t.at(focus), t._with(source.at(at).df)
    if not with_root:
        theirs = t._with(theirs.df.where(F.octet_length("path") > 0))
    return _keep(t, focus, _placed(algebra.join(mine, theirs).df, focus))


def join_map(t: PathFrame, focus: bytes, source: PathFrame) -> PathFrame:
    """Union with a whole table, whose root joins the value at the focus."""
    return join_at(t, focus, source, with_root=True)


def join_into(t: PathFrame, focus: bytes, at: bytes) -> PathFrame:
    """Move what is below ``at`` in the same table to below the focus, merging; values at both stay.

    Neither may lie inside the other.
    """
    if focus.startswith(at) or at.startswith(focus):
        raise ValueError("one focus lies inside the other")
    rest = t._with(t.df.where(~(codec.starts_with(F.col("path"), at) & (F.octet_length("path") > len(at)))))
    return join_at(rest, focus, t, at)


def meet_at(t: PathFrame, focus: bytes, source: PathFrame, at: bytes = b"") -> PathFrame:
    """Intersection below the focus; the value at the focus stays."""
    mine = t._with(t.at(focus).df.where(F.octet_length("path") > 0))
    return _keep(t, focus, t.below(focus).where(_is(focus)), _placed(algebra.meet(mine, source.at(at)).df, focus))


def meet_two(t: PathFrame, focus: bytes, a: PathFrame, b: PathFrame) -> PathFrame:
    """The intersection of two tables below the focus; the value at the focus stays."""
    found = algebra.meet(a, b).df.where(F.octet_length("path") > 0)
    return _keep(t, focus, t.below(focus).where(_is(focus)), _placed(found, focus))


def subtract_at(t: PathFrame, focus: bytes, source: PathFrame, at: bytes = b"") -> PathFrame:
    """Difference below the focus; the value at the focus stays."""
    mine = t._with(t.at(focus).df.where(F.octet_length("path") > 0))
    return _keep(t, focus, t.below(focus).where(_is(focus)), _placed(algebra.subtract(mine, source.at(at)).df, focus))


def restrict_at(t: PathFrame, focus: bytes, source: PathFrame, at: bytes = b"") -> PathFrame:
    """Below the focus, only what begins with a path below the source's focus; its own value is no stem.

    The value at the focus stays.
    """
    mine = t.at(focus).df.where(F.octet_length("path") > 0)
    stems = source.at(at).df.where(F.octet_length("path") > 0)
    return _keep(t, focus, t.below(focus).where(_is(focus)), _placed(covered(mine, stems), focus))


def restricting(t: PathFrame, focus: bytes, source: PathFrame, at: bytes = b"") -> PathFrame:
    """Paths below the focus are stems: they are replaced by the source's rows that begin with one.

    Without stems, or without anything at the source, nothing changes.
    """
    stems = t.at(focus).df.where(F.octet_length("path") > 0)
    rows = source.at(at).df.where(F.octet_length("path") > 0)
    if stems.isEmpty() or rows.isEmpty():
        return t
    return _keep(t, focus, t.below(focus).where(_is(focus)), _placed(covered(rows, stems), focus))


def take_map(t: PathFrame, focus: bytes) -> tuple[PathFrame, PathFrame]:
    """(what is left, the subtree taken away), the value at the focus among it."""
    return t._with(_outside(t, focus)), t.at(focus)


def make_map(t: PathFrame, focus: bytes) -> PathFrame:
    """A copy of the subtree, with the value at the focus as its root."""
    return t.at(focus)


def remove_branches(t: PathFrame, focus: bytes) -> PathFrame:
    """Without all that is strictly below the focus."""
    return _keep(t, focus, t.below(focus).where(_is(focus)))


def keep_branches(t: PathFrame, focus: bytes, branches: list[int]) -> PathFrame:
    """Below the focus, only the branches whose first byte is listed; the value at the focus stays."""
    inside = t.below(focus).where(_is(focus) | codec.byte_at("path", len(focus)).isin(branches))
    return _keep(t, focus, inside)


def drop_head(t: PathFrame, focus: bytes, n: int) -> PathFrame:
    """Remove the first ``n`` bytes below the focus and merge what then coincides.

    Paths with ``n`` bytes or fewer below the focus are discarded; the value at the focus stays.
    Values that coincide merge in the order of their former paths, so the smallest one wins
    where the left value is kept. ``n`` 0 changes nothing.
    """
    if n == 0:
        return t
    cut = len(focus) + n
    long = t.below(focus).where(F.octet_length("path") > cut)
    moved = long.select(F.concat(F.lit(focus), codec.tail("path", cut)).alias("new"), "path", "value")
    merged = moved.groupBy("new").agg(t.policy.merge(F.col("value"), F.col("path")).alias("value")).withColumnRenamed("new", "path")
    return _keep(t, focus, t.below(focus).where(_is(focus)), merged)


def insert_prefix(t: PathFrame, focus: bytes, prefix: bytes) -> PathFrame:
    """Put a prefix before all that is below the focus; the value at the focus stays."""
    moved = _strictly_below(t, focus).select(F.concat(F.lit(focus + prefix), codec.tail("path", len(focus))).alias("path"), "value")
    return _keep(t, focus, t.below(focus).where(_is(focus)), moved)


def remove_prefix(t: PathFrame, focus: bytes, n: int, root: int = 0) -> tuple[PathFrame, bool]:
    """Move what is below the focus ``n`` bytes up, in place of everything below there.

    The cursor cannot leave its root of ``root`` bytes; the second result tells whether ``n``
    bytes were available.
    """
    up = min(n, len(focus) - root)
    new = focus[: len(focus) - up]
    moved = _strictly_below(t, focus).select(F.concat(F.lit(new), codec.tail("path", len(focus))).alias("path"), "value")
    return _keep(t, new, t.below(new).where(_is(new)), moved), up == n


def copy_branch(t: PathFrame, source: bytes, target: bytes, change=lambda v: v) -> PathFrame:
    """Add a copy of the subtree at ``source`` below ``target``, with changed values."""
    copied = t.at(source).df.select(F.concat(F.lit(target), "path").alias("path"), change(F.col("value")).alias("value"))
    return algebra.join(t, t._with(copied))
