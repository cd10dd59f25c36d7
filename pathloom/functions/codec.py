"""Path codecs as Column functions.

Paths are BINARY; Spark orders them by unsigned bytes, a prefix before what it begins.
Lengths and offsets are always bytes: strings are encoded before anything is cut from them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(c: Column | str) -> Column:
    """The UTF-8 bytes of a string."""
    return F.encode(c, "utf-8")


def joined(sep: str, *parts: Column | str) -> Column:
    """Strings with a separator between them, as UTF-8."""
    return F.encode(F.concat_ws(sep, *parts), "utf-8")


def be_int(c: Column, width: int = 8) -> Column:
    """The ``width`` low bytes of an integer, highest first."""
    return F.unhex(F.substring(F.lpad(F.hex(c.cast("long")), 16, "0"), 17 - 2 * width, 2 * width))


def le_int(c: Column, width: int = 8) -> Column:
    """The ``width`` low bytes of an integer, lowest first."""
    digits = F.lpad(F.hex(c.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(width)]))


def be_value(path: Column) -> Column:
    """The unsigned number that at most eight bytes spell, highest first."""
    return F.conv(F.hex(path), 16, -10).cast("long")


def prefix_key(c: Column) -> Column:
    """An integer's bytes, lowest first, without zero bytes at the end; zero is one byte."""
    return F.unhex(F.regexp_replace(F.hex(le_int(c)), "^((?:..)+?)(?:00)*$", "$1"))


def signed_bytes(c: Column) -> Column:
    """The shortest two's complement of an integer, highest byte first."""
    size = F.lit(8)
    for n in range(7, 0, -1):
        bound = 1 << (8 * n - 1)
        size = F.when((c >= -bound) & (c < bound), F.lit(n)).otherwise(size)
    return F.unhex(F.substring(F.lpad(F.hex(c.cast("long")), 16, "0"), 17 - 2 * size, 2 * size))


def framed(numbers: Column) -> Column:
    """Each integer of an array as a length byte and its signed bytes, one after another."""
    one = lambda n: F.concat(F.hex(be_int(F.octet_length(signed_bytes(n)), 1)), F.hex(signed_bytes(n)))
    return F.unhex(F.array_join(F.transform(numbers, one), ""))


def symbols(words: Column) -> Column:
    """Strings as ``:n:word`` one after another, n being the bytes of the word, and a last colon."""
    one = lambda w: F.concat(F.lit(":"), F.octet_length(w).cast("string"), F.lit(":"), w)
    return F.encode(F.concat(F.array_join(F.transform(words, one), ""), F.lit(":")), "utf-8")


def head(path: Column | str, n: Column | int) -> Column:
    """The first ``n`` bytes."""
    return F.substring(path, F.lit(1), n if isinstance(n, Column) else F.lit(n))


def tail(path: Column | str, n: Column | int) -> Column:
    """What follows the first ``n`` bytes."""
    start = n + 1 if isinstance(n, Column) else F.lit(n + 1)
    return F.substring(path, start, F.octet_length(path))


def byte_at(path: Column | str, i: Column | int) -> Column:
    """The byte at offset ``i`` as a number."""
    start = i + 1 if isinstance(i, Column) else F.lit(i + 1)
    return F.conv(F.hex(F.substring(path, start, F.lit(1))), 16, 10).cast("int")


def find(path: Column | str, part: bytes) -> Column:
    """Where ``part`` begins in the path, in bytes from 1; 0 if it is not there."""
    # As Latin-1 every byte is one character.
    return F.instr(F.decode(path, "iso-8859-1"), part.decode("iso-8859-1"))


def byte(c: Column) -> Column:
    """A number from 0 to 255 as one byte."""
    return be_int(c, 1)


def successor(prefix: bytes) -> bytes | None:
    """The least path above everything that begins with ``prefix``; None if there is none."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def starts_with(path: Column, prefix: bytes) -> Column:
    """Whether a path begins with ``prefix``, as a byte range: ranges reach the Parquet scan, ``startswith`` does not."""
    if not prefix:
        return F.lit(True)
    end = successor(prefix)
    return (path >= F.lit(prefix)) if end is None else (path >= F.lit(prefix)) & (path < F.lit(end))


def overlap(a: Column, b: Column) -> Column:
    """Bytes that two paths share at their beginning."""
    n = F.least(F.octet_length(a), F.octet_length(b))
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    same = lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))
    return F.aggregate(at, F.lit(0), lambda c, i: F.when((c == i - 1) & same(i), i).otherwise(c))
