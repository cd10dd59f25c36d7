"""Algebra of whole path tables, and the status of a result."""

from __future__ import annotations

import enum
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.frame import PathFrame
from pathloom.operators.prefixes import covered


def join(a: PathFrame, b: PathFrame) -> PathFrame:
    """Union: paths of either side; where both have one, the policy's join of the values."""
    return join_all([a, b]) if a.policy.keeps_left else a._with(_outer(a, b))


def _outer(a: PathFrame, b: PathFrame) -> DataFrame:
    both = a.df.withColumnRenamed("value", "l").join(b.df.withColumnRenamed("value", "r"), "path", "full_outer")
    left, right = F.col("l"), F.col("r")
    return both.withColumn("value", F.when(left.isNull(), right).when(right.isNull(), left).otherwise(a.policy.join(left, right)))


def join_all(frames: list[PathFrame]) -> PathFrame:
    """Union of many, from the left, in one aggregate instead of a chain of joins."""
    tagged = [f.df.withColumn("side", F.lit(i)) for i, f in enumerate(frames)]
    rows = reduce(DataFrame.unionByName, tagged)
    policy = frames[0].policy
    return frames[0]._with(rows.groupBy("path").agg(policy.merge(F.col("value"), F.col("side")).alias("value")))


def meet(a: PathFrame, b: PathFrame) -> PathFrame:
    """Intersection: paths of both sides, with the policy's meet of the values."""
    if a.policy.keeps_left:
        return a._with(a.df.join(b.df.select("path"), "path", "left_semi"))
    both = a.df.withColumnRenamed("value", "l").join(b.df.withColumnRenamed("value", "r"), "path")
    return a._with(both.withColumn("value", a.policy.meet(F.col("l"), F.col("r"))).where("value is not null"))


def subtract(a: PathFrame, b: PathFrame) -> PathFrame:
    """Difference: a path that both have stays as far as the policy leaves something of its value.

    Paths that merely begin with one of the other side stay.
    """
    if a.policy.subtract is None:
        raise TypeError(f"values of the policy {a.policy.name!r} cannot be subtracted")
    if a.policy.unit:
        return a._with(a.df.join(b.df, "path", "left_anti"))
    both = a.df.withColumnRenamed("value", "l").join(b.df.withColumnRenamed("value", "r"), "path", "left")
    left, right = F.col("l"), F.col("r")
    return a._with(both.withColumn("value", F.when(right.isNull(), left).otherwise(a.policy.subtract(left, right))).where("value is not null"))


def restrict(a: PathFrame, b: PathFrame) -> PathFrame:
    """Prefix semi-join: rows whose path begins with some path of the other side, whose values do not matter."""
    return a._with(covered(a.df, b.df))


# ---------------------------------------------------------------- outcomes


class Status(enum.Enum):
    """How a result relates to an operand: a new thing, the operand itself, or nothing."""

    ELEMENT = "element"
    IDENTITY = "identity"
    NONE = "none"

    def merge(self, other: "Status", self_left_none: bool = True, other_left_none: bool = True) -> "Status":
        """The status of two parts together.

        Two of a kind stay. Nothing beside an identity is an element if the part that is
        nothing had something to lose (its flag is false), else an identity.
        """
        if Status.ELEMENT in (self, other):
            return Status.ELEMENT
        if self == other:
            return self
        lost = not self_left_none if self is Status.NONE else not other_left_none
        return Status.ELEMENT if lost else Status.IDENTITY


#: Bits of an identity mask: the result equals the left operand, the right one.
LEFT, RIGHT = 1, 2


@dataclass(frozen=True)
class Outcome:
    """Nothing, an identity with some operands (``mask``), or a new element.

    Where a result is empty and equals an empty operand as well, it is nothing.
    """

    kind: Status
    mask: int = 0
    element: object = None

    @staticmethod
    def none() -> "Outcome":
        return Outcome(Status.NONE)

    @staticmethod
    def identity(mask: int) -> "Outcome":
        return Outcome(Status.IDENTITY, mask)

    @staticmethod
    def of(element) -> "Outcome":
        return Outcome(Status.ELEMENT, 0, element)

    @staticmethod
    def from_status(status: Status, element=None) -> "Outcome":
        return Outcome.identity(LEFT) if status is Status.IDENTITY else Outcome.of(element) if status is Status.ELEMENT else Outcome.none()

    def is_none(self) -> bool:
        return self.kind is Status.NONE

    def is_identity(self) -> bool:
        return self.kind is Status.IDENTITY

    def is_element(self) -> bool:
        return self.kind is Status.ELEMENT

    def identity_mask(self) -> int | None:
        return self.mask if self.is_identity() else None

    def inverted(self) -> "Outcome":
        """The outcome with the operands exchanged."""
        return Outcome.identity((self.mask & LEFT) << 1 | (self.mask & RIGHT) >> 1) if self.is_identity() else self

    def map(self, f) -> "Outcome":
        return Outcome.of(f(self.element)) if self.is_element() else self

    def status(self) -> Status:
        """For an update in place: an identity counts only if it is with the left operand."""
        return Status.ELEMENT if self.is_identity() and not self.mask & LEFT else self.kind

    def into_option(self, *operands):
        """The resulting thing, or None; an identity is the first operand whose bit is set."""
        if self.is_identity():
            return next(x for i, x in enumerate(operands) if self.mask >> i & 1)
        return self.element if self.is_element() else None

    def unwrap(self, *operands):
        found = self.into_option(*operands)
        if found is None:
            raise ValueError("there is no result")
        return found

    def unwrap_or(self, default, *operands):
        found = self.into_option(*operands)
        return default if found is None else found

    def flatten(self) -> "Outcome":
        """An element that is an outcome becomes that outcome."""
        return self.element if self.is_element() and isinstance(self.element, Outcome) else self

    def merge(self, other: "Outcome", mine, theirs, combine) -> "Outcome":
        """The outcome of two parts: identities keep the operands they share, else ``combine`` builds an element.

        ``mine`` and ``theirs`` are the operands of the two parts, None where a part has none.
        """
        if self.is_none() and other.is_none():
            return Outcome.none()
        mask = 0
        for i in range(max(len(mine), len(theirs))):
            fits = [o.mask >> i & 1 if o.is_identity() else o.is_none() and part[i] is None for o, part in ((self, mine), (other, theirs))]
            mask |= int(all(fits)) << i
        if mask:
            return Outcome.identity(mask)
        return Outcome.of(combine(self.into_option(*mine), other.into_option(*theirs)))


def status(result: PathFrame, before: PathFrame) -> Status:
    """Nothing if the result is empty, identity if it has the rows of ``before``, else element.

    Runs jobs; useful as the test that ends a fixpoint.
    """
    if result.df.isEmpty():
        return Status.NONE
    same = result.df.exceptAll(before.df).isEmpty() and before.df.exceptAll(result.df).isEmpty()
    return Status.IDENTITY if same else Status.ELEMENT


def outcome(result: PathFrame, left: PathFrame, right: PathFrame | None = None) -> Outcome:
    """The outcome of an operation on whole tables."""
    if result.df.isEmpty():
        return Outcome.none()
    mask = sum(bit for bit, side in ((LEFT, left), (RIGHT, right)) if side is not None and status(result, side) is Status.IDENTITY)
    return Outcome.identity(mask) if mask else Outcome.of(result)
