"""Sets of bytes as 256-bit masks: a struct of four longs ``w0`` to ``w3``, lowest bytes first."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_ALL = -1


def _mask(words) -> Column:
    return F.struct(*[w.cast("long").alias(f"w{i}") for i, w in enumerate(words)])


def empty() -> Column:
    return _mask([F.lit(0)] * 4)


def full() -> Column:
    return _mask([F.lit(_ALL)] * 4)


def of(items: Iterable[int]) -> Column:
    """The mask of bytes that the driver knows, as a constant."""
    words = [sum(1 << b - 64 * i for b in set(items) if b // 64 == i) for i in range(4)]
    return _mask([F.lit(w - (w >> 63 << 64)) for w in words])


def _in(b: Column, i: int) -> Column:
    """Whether byte ``b`` is in word ``i``."""
    return (b >= 64 * i) & (b < 64 * (i + 1))


def bit(b: Column) -> Column:
    """The mask of one byte."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int"))
    return _mask([F.when(_in(b, i), one).otherwise(F.lit(0)) for i in range(4)])


def of_bytes(items: Column) -> Column:
    """The mask of an array of bytes; repeats count once."""
    return F.aggregate(items, empty(), lambda m, b: or_(m, bit(b)))


def collect(b: Column) -> Column:
    """Aggregate: the mask of all bytes of a group."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int"))
    return _mask([F.coalesce(F.bit_or(F.when(_in(b, i), one)), F.lit(0)) for i in range(4)])


def test(mask: Column, b: Column) -> Column:
    """Whether a byte is in the mask."""
    word = F.lit(0).cast("long")
    for i in range(4):
        word = F.when(_in(b, i), mask[f"w{i}"]).otherwise(word)
    return F.call_function("shiftright", word, (b % 64).cast("int")).bitwiseAND(F.lit(1)) == 1


def bytes_of(mask: Column) -> Column:
    """The bytes in ascending order."""
    none = F.array().cast("array<int>")

    def of_word(i: int) -> Column:
        word = mask[f"w{i}"]
        set_ = F.filter(F.sequence(F.lit(64 * i), F.lit(64 * i + 63)), lambda b: F.call_function("shiftright", word, b - 64 * i).bitwiseAND(F.lit(1)) == 1)
        return F.when(word == 0, none).otherwise(set_)

    return F.concat(*[of_word(i) for i in range(4)])


def count(mask: Column) -> Column:
    return sum((F.bit_count(mask[f"w{i}"]) for i in range(1, 4)), F.bit_count(mask["w0"]))


def is_empty(mask: Column) -> Column:
    return count(mask) == 0


def _each(f: Callable, *masks: Column) -> Column:
    return _mask([f(*[m[f"w{i}"] for m in masks]) for i in range(4)])


def or_(a: Column, b: Column) -> Column:
    return _each(lambda x, y: x.bitwiseOR(y), a, b)


def and_(a: Column, b: Column) -> Column:
    return _each(lambda x, y: x.bitwiseAND(y), a, b)


def xor(a: Column, b: Column) -> Column:
    return _each(lambda x, y: x.bitwiseXOR(y), a, b)


def andnot(a: Column, b: Column) -> Column:
    return _each(lambda x, y: x.bitwiseAND(F.bitwise_not(y)), a, b)


def not_(a: Column) -> Column:
    return _each(F.bitwise_not, a)


def with_bit(mask: Column, b: Column) -> Column:
    return or_(mask, bit(b))


def without_bit(mask: Column, b: Column) -> Column:
    return andnot(mask, bit(b))


def _below(b: Column, i: int) -> Column:
    """Of word ``i``, the bits of the bytes below ``b``."""
    shift = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.least(b - 64 * i, F.lit(63)), F.lit(0)).cast("int"))
    some = F.when(b - 64 * i == 63, F.lit((1 << 63) - 1)).otherwise(shift - 1)
    return F.when(b >= 64 * (i + 1), F.lit(_ALL).cast("long")).when(b <= 64 * i, F.lit(0).cast("long")).otherwise(some)


def rank(mask: Column, b: Column) -> Column:
    """How many bytes of the mask are below ``b``."""
    return sum((F.bit_count(mask[f"w{i}"].bitwiseAND(_below(b, i))) for i in range(1, 4)), F.bit_count(mask["w0"].bitwiseAND(_below(b, 0))))


def _lowest(word: Column) -> Column:
    """The place of the lowest set bit."""
    only_sign = word == F.lit(-(1 << 63))
    return F.when(only_sign, F.lit(63)).otherwise(F.bit_count(F.bitwise_not(word).bitwiseAND(F.when(only_sign, F.lit(0).cast("long")).otherwise(word) - 1)))


def first(mask: Column) -> Column:
    """The least byte of the mask; null if it is empty."""
    return F.coalesce(*[F.when(mask[f"w{i}"] != 0, _lowest(mask[f"w{i}"]) + 64 * i) for i in range(4)])


def last(mask: Column) -> Column:
    """The greatest byte of the mask; null if it is empty."""
    return F.coalesce(*[F.when(mask[f"w{i}"] != 0, F.length(F.bin(mask[f"w{i}"])) - 1 + 64 * i) for i in (3, 2, 1, 0)])


def select(mask: Column, n: Column, forward: bool = True) -> Column:
    """The n-th byte (from 0) from the lowest, or from the highest; null beyond the end."""
    place = n if forward else count(mask) - 1 - n
    # Halving the range eight times finds the least b that has over n bytes at or below it.
    steps = F.array(*[F.lit(x) for x in (128, 64, 32, 16, 8, 4, 2, 1)])
    at = F.aggregate(steps, F.lit(0), lambda b, x: F.when(rank(mask, b + x) <= place, b + x).otherwise(b))
    return F.when((place >= 0) & (place < count(mask)), at)


def next_byte(mask: Column, b: Column) -> Column:
    """The least byte above ``b``; null if there is none."""
    return first(_mask([mask[f"w{i}"].bitwiseAND(F.bitwise_not(_below(b + 1, i))) for i in range(4)]))


def previous_byte(mask: Column, b: Column) -> Column:
    """The greatest byte below ``b``; null if there is none."""
    return last(_mask([mask[f"w{i}"].bitwiseAND(_below(b, i)) for i in range(4)]))
