"""A counting quotient filter over 64-bit fingerprints, built and merged in bulk.

A fingerprint of ``width`` bits is split in a quotient (its high bits), which names a run, and
a remainder, which is stored in that run in ascending order next to its count. As a filter
holds whole remainders, it can be listed again without loss, and filters of different sizes
merge by walking their sorted contents.

A serialised filter is a header (width, quotient bits, entries, entries counted above one), the
occupied bit of each quotient, the run-end bit of each entry, the remainders, one bit per entry
that tells whether its count is above one, and those counts.
"""

from __future__ import annotations

import struct

import numpy as np

_HEADER = struct.Struct("<BBqq")


def build(fingerprints: np.ndarray, width: int = 64) -> bytes:
    """The filter of all given fingerprints (unsigned, repeats counted)."""
    values, counts = np.unique(np.asarray(fingerprints, np.uint64), return_counts=True)
    return pack(values, counts, width)


def pack(values: np.ndarray, counts: np.ndarray, width: int = 64) -> bytes:
    """The filter of distinct ascending ``values`` with their counts."""
    n = len(values)
    quotient_bits = min(width, max(0, int(n - 1).bit_length()))
    remainder_bits = width - quotient_bits
    quotients = values >> np.uint64(remainder_bits) if remainder_bits < 64 else np.zeros(n, np.uint64)
    remainders = values & np.uint64((1 << remainder_bits) - 1)
    occupied = np.zeros(1 << quotient_bits, bool)
    occupied[quotients.astype(np.int64)] = True
    ends = np.ones(n, bool)
    ends[:-1] = quotients[1:] != quotients[:-1]
    many = counts > 1
    size = -(-remainder_bits // 8)
    stored = remainders.astype("<u8").view(np.uint8).reshape(n, 8)[:, :size]
    return b"".join((
        _HEADER.pack(width, quotient_bits, n, int(many.sum())),
        np.packbits(occupied).tobytes(),
        np.packbits(ends).tobytes(),
        stored.tobytes(),
        np.packbits(many).tobytes(),
        counts[many].astype("<u8").tobytes(),
    ))


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct fingerprints of a filter in ascending order, and their counts."""
    width, quotient_bits, n, n_many = _HEADER.unpack_from(blob)
    at = _HEADER.size

    def bits(count: int) -> np.ndarray:
        nonlocal at
        raw = np.frombuffer(blob, np.uint8, -(-count // 8), at)
        at += len(raw)
        return np.unpackbits(raw, count=count).astype(bool)

    occupied, ends = bits(1 << quotient_bits), bits(n)
    remainder_bits = width - quotient_bits
    size = -(-remainder_bits // 8)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :size] = np.frombuffer(blob, np.uint8, n * size, at).reshape(n, size)
    at += n * size
    many = bits(n)
    counts = np.ones(n, np.int64)
    counts[many] = np.frombuffer(blob, "<u8", n_many, at)
    # The k-th run belongs to the k-th occupied quotient.
    run = np.concatenate(([0], np.cumsum(ends)[:-1])) if n else np.zeros(0, np.int64)
    quotients = np.flatnonzero(occupied).astype(np.uint64)[run] if n else np.zeros(0, np.uint64)
    remainders = wide.view("<u8").reshape(n).astype(np.uint64)
    high = quotients << np.uint64(remainder_bits) if remainder_bits < 64 else np.zeros(n, np.uint64)
    return high | remainders, counts


def merge(blobs: list[bytes]) -> bytes:
    """The filter of everything that the given filters hold; counts add up."""
    width = _HEADER.unpack_from(blobs[0])[0] if blobs else 64
    return pack(*merged(blobs), width)


def merged(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The contents of the merged filter. Each part is sorted, so the stable sort merges runs."""
    parts = [unpack(b) for b in blobs]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    values, counts = np.concatenate([v for v, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    return values[first], np.add.reduceat(counts, np.flatnonzero(first)) if len(values) else counts
