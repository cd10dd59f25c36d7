"""Value policies: what the path algebra does with the values of a path that both sides have.

A policy gives Column expressions. A null result means that the path is dropped; values
themselves are never null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.functions import bytemask

Merge = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Policy:
    """``join``, ``meet`` and ``subtract`` of two values, and ``merge``, an aggregate of many.

    ``merge(value, order)`` joins all values of a group, in ascending ``order`` where that
    matters. ``subtract`` None: the values cannot be subtracted. ``unit``: values carry nothing.
    """

    name: str
    join: Merge
    meet: Merge
    subtract: Merge | None
    merge: Merge
    unit: bool = False
    keeps_left: bool = False


def _drop_if_equal(a: Column, b: Column) -> Column:
    return F.when(a != b, a)


def _or_drop(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def _map_join(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, y))


def _map_meet(a: Column, b: Column) -> Column:
    return _or_drop(F.map_filter(a, lambda k, x: F.map_contains_key(b, k)))


def _map_subtract(a: Column, b: Column) -> Column:
    both = F.map_zip_with(a, b, lambda k, x, y: F.when(y.isNull() | (x != y), x))
    return _or_drop(F.map_filter(both, lambda k, x: x.isNotNull()))


def _map_merge(value: Column, order: Column) -> Column:
    by_order = lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)  # noqa: E731  maps have no order
    ordered = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))), by_order)
    return F.aggregate(F.slice(ordered, 2, F.size(ordered)), ordered[0]["v"], lambda m, x: _map_join(m, x["v"]))


def _mask_or_drop(c: Column) -> Column:
    return F.when(~bytemask.is_empty(c), c)


def _mask_merge(value: Column, order: Column) -> Column:
    return F.struct(*[F.bit_or(value[f"w{i}"]).alias(f"w{i}") for i in range(4)])


#: No value: paths are there or not.
UNIT = Policy("unit", lambda a, b: a, lambda a, b: a, lambda a, b: F.lit(None).cast("boolean"), lambda v, o: F.first(v), unit=True, keeps_left=True)

#: The left value stays; it cannot be subtracted.
KEEP_LEFT = Policy("keep left", lambda a, b: a, lambda a, b: a, None, lambda v, o: F.min_by(v, o), keeps_left=True)

#: The left value stays; subtracting an equal value drops the path.
KEEP_LEFT_EQUAL = Policy("keep left, drop equal", lambda a, b: a, lambda a, b: a, _drop_if_equal, lambda v, o: F.min_by(v, o), keeps_left=True)

#: Or, and; subtracting an equal value drops the path.
BOOLEAN = Policy("boolean", lambda a, b: a | b, lambda a, b: a & b, _drop_if_equal, lambda v, o: F.bool_or(v))

#: Sets as sorted arrays; an empty one drops the path.
SET = Policy(
    "set", lambda a, b: F.array_sort(F.array_union(a, b)), lambda a, b: _or_drop(F.array_sort(F.array_intersect(a, b))),
    lambda a, b: _or_drop(F.array_sort(F.array_except(a, b))), lambda v, o: F.array_sort(F.array_distinct(F.flatten(F.collect_set(v)))),
)

#: Maps, key by key, with the left value of a key; an empty one drops the path.
MAP = Policy("map", _map_join, _map_meet, _map_subtract, _map_merge)

#: Byte masks; an empty one drops the path.
MASK = Policy("mask", bytemask.or_, lambda a, b: _mask_or_drop(bytemask.and_(a, b)), lambda a, b: _mask_or_drop(bytemask.andnot(a, b)), _mask_merge)

#: Totals, for counting merges.
SUM = Policy("sum", lambda a, b: a + b, F.least, None, lambda v, o: F.sum(v))


def custom(name: str, join: Merge, meet: Merge, merge: Merge, subtract: Merge | None = None) -> Policy:
    """A policy of one's own."""
    return Policy(name, join, meet, subtract, merge)
