"""Packing documents into training sequences: best fit, then swap-based local search."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.columns import packed
from pathloom.llm.tokens import END_ID, encoder
from pathloom.shared import save_table

#: Pieces that one task packs together; the waste of dividing them is about one sequence per group.
GROUP_PIECES = 20_000

#: The share of bins over the least possible number from which on a second start is tried.
LOOSE = 0.005


# ---------------------------------------------------------------- pieces


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of ``n`` ids; all but the first are full."""
    first = n - capacity * (-(-n // capacity) - 1)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """(id, piece, start, length, crc) of the packed ``docs``, whose ids end with END_ID."""
    fields = [("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())]

    def run(batches):
        encode = encoder(path).ids
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py()), END_ID], "<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    rows.append((i, k, s, n, zlib.crc32(ids[s : s + n])))
            cols = list(zip(*rows)) or [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], [n for n, _ in fields])

    return docs.select("id", "text").mapInArrow(run, "id long, piece int, start long, length long, crc long")


# ---------------------------------------------------------------- bins


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: by volume, and by items that cannot share one.

    For each k up to half the capacity: items over capacity - k stand alone, those over half
    too, and what items from k on do not fit beside the latter needs further sequences.
    """
    best = -(-int(lengths.sum()) // capacity)
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    volume = np.cumsum(count * np.arange(capacity + 1))
    number = np.cumsum(count)
    for k in range(1, capacity // 2 + 1):
        alone = number[capacity] - number[capacity - k]
        half = number[capacity - k] - number[capacity // 2]
        free = half * capacity - (volume[capacity - k] - volume[capacity // 2])
        rest = volume[capacity // 2] - volume[k - 1]
        best = max(best, int(alone + half + max(0, -(-(rest - free) // capacity))))
    return best


def best_fit(lengths: np.ndarray, capacity: int, order: np.ndarray | None = None) -> list[list[int]]:
    """Items, longest first or in the given order, each in the fullest bin that takes it; bins hold item numbers."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if some bin has room r
    for item in (np.argsort(-lengths, kind="stable") if order is None else order).tolist():
        n = int(lengths[item])
        fits = rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                rooms ^= 1 << r
            bins[b].append(item)
        else:
            b, r = len(bins), capacity
            bins.append([item])
        if r > n:
            room[r - n].append(b)
            rooms |= 1 << (r - n)
    return bins


class Search:
    """Local search over the bins that are not full.

    Each step takes content from one bin and gives it to a fuller one, or one that is fuller
    afterwards: it moves an item, exchanges one item for one, two for one or one for two. The sum
    of squared fills grows with every step, so the search ends; a bin that loses its last item is
    gone. The end is when no bin has such a step left, or when no packing can have fewer bins.
    """

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], capacity: int):
        self.length, self.bins, self.capacity = lengths.tolist(), bins, capacity
        self.gap = {b: g for b, items in enumerate(bins) if (g := capacity - sum(self.length[i] for i in items)) > 0}
        # Bins with an item of a length (0: all bins), and with two items of a total; the largest gap among them.
        self.holders: tuple[list[set[int]], list[set[int]]] = tuple([set() for _ in range(capacity + 1)] for _ in range(2))
        self.widest = tuple(np.full(capacity + 1, -1) for _ in range(2))
        self.stale: tuple[set[int], set[int]] = (set(range(capacity + 1)), set(range(capacity + 1)))
        for b in self.gap:
            for held, sizes in zip(self.holders, self._sizes(b)):
                for n in sizes:
                    held[n].add(b)

    def _sizes(self, b: int) -> tuple[set[int], set[int]]:
        """What a bin can give: lengths of single items or nothing, and totals of two."""
        some = sorted(self.length[i] for i in self.bins[b])
        single = sorted(set(some))
        double = {x + y for k, x in enumerate(single) for y in single[k + 1 :]} | {2 * x for x, y in zip(some, some[1:]) if x == y}
        return {0, *single}, double

    def _change(self, b: int, drop: list[int], add: list[int]) -> None:
        for held, stale, sizes in zip(self.holders, self.stale, self._sizes(b)):
            for n in sizes:
                held[n].discard(b)
            stale |= sizes
        for i in drop:
            self.bins[b].remove(i)
        self.bins[b] += add
        gap = self.capacity - sum(self.length[i] for i in self.bins[b])
        self.gap.pop(b, None)
        if gap and self.bins[b]:
            self.gap[b] = gap
            for held, stale, sizes in zip(self.holders, self.stale, self._sizes(b)):
                for n in sizes:
                    held[n].add(b)
                stale |= sizes

    def _able(self, kind: int, n: int, most: int) -> list[int]:
        """The sizes below ``n`` by at most ``most`` for which some bin that can give it has room for ``n`` instead."""
        low, widest = max(0, n - most), self.widest[kind]
        for x in [x for x in self.stale[kind] if low <= x < n]:
            widest[x] = max((self.gap[b] for b in self.holders[kind][x]), default=-1)
            self.stale[kind].discard(x)
        return (low + np.flatnonzero(widest[low:n] >= np.arange(n - low, 0, -1))).tolist()

    def improve(self, source: int) -> bool:
        """One step that takes from ``source``, if there is one."""
        fill = self.capacity - self.gap[source]
        most = max((g for b, g in self.gap.items() if b != source), default=0)
        of_length: dict[int, list[int]] = {}
        for i in self.bins[source]:
            of_length.setdefault(self.length[i], []).append(i)
        sizes = sorted(of_length, reverse=True)
        singles = [(of_length[n][0],) for n in sizes]
        pairs = [(of_length[x][0], of_length[y][0]) for k, x in enumerate(sizes) for y in sizes[k + 1 :]]
        pairs += [tuple(same[:2]) for same in of_length.values() if len(same) > 1]
        for given in singles + pairs:
            n = sum(self.length[i] for i in given)
            # x: what comes back. 0 is a move, which for two items is two moves at once.
            for kind in (0, 1) if len(given) == 1 else (0,):
                for x in self._able(kind, n, most):
                    for b in self.holders[kind][x]:
                        if b != source and self.gap[b] >= n - x and self.capacity - self.gap[b] + n - x > fill:
                            back = self._items_of(b, x, kind)
                            self._change(source, list(given), back)
                            self._change(b, back, list(given))
                            return True
        return False

    def _items_of(self, b: int, total: int, kind: int) -> list[int]:
        """An item of the length ``total``, or two of that total."""
        if not kind:
            return [next(i for i in self.bins[b] if self.length[i] == total)] if total else []
        seen: dict[int, int] = {}
        for i in self.bins[b]:
            if total - self.length[i] in seen:
                return [seen[total - self.length[i]], i]
            seen[self.length[i]] = i
        raise KeyError(total)

    def run(self, least: int) -> None:
        """Improve all bins from the emptiest on, again and again, until ``least`` are left or nothing helps."""
        used, moved = sum(1 for b in self.bins if b), True
        while moved and used > least:
            moved = False
            for source in sorted(self.gap, key=lambda b: (-self.gap[b], b)):
                while used > least and source in self.gap and self.improve(source):
                    moved = True
                    used -= not self.bins[source]


def searched(lengths: np.ndarray, bins: list[list[int]], capacity: int, least: int) -> list[list[int]]:
    """The bins after the search, without empty ones."""
    if len(bins) > least:
        Search(lengths, bins, capacity).run(least)
    return [b for b in bins if b]


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item; bins are numbered without gaps.

    The search starts from best fit with the longest items first. Where that leaves more than
    LOOSE of the least number of bins to spare, it also starts from best fit in the given order,
    whose mixed bins leave it more to exchange, and the better result stands.
    """
    least = lower_bound(lengths, capacity)
    bins = searched(lengths, best_fit(lengths, capacity), capacity, least)
    if len(bins) > least * (1 + LOOSE):
        bins = min(bins, searched(lengths, best_fit(lengths, capacity, np.arange(len(lengths))), capacity, least), key=len)
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for number, items in enumerate(bins):
        at = 0
        for i in items:
            where[i], offset[i] = number, at
            at += int(lengths[i])
    return where, offset


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise documents, cut the long ones and pack all pieces into sequences.

    Returns a row per piece: id, piece, start, length, crc (of its ids as little-endian unsigned
    32-bit numbers), sequence_id, offset.

    * a null text counts as empty and is the end id alone
    * a document of more than ``capacity`` ids is cut into full pieces; its first piece is what
      remains and may be shorter
    * repeated rows and ids, or null ids, are packed like any other; an empty table gives no rows

    Plan: one pass tokenises; only piece descriptions are kept. A full piece is a sequence by
    itself. The others are dealt round robin into groups of bounded size, which are packed
    independently; no group depends on the values of a key, so none can be hot.
    """
    table = save_table(pieces(packed(docs, id_col, text_col), path, capacity), "pieces")
    groups = max(1, -(-table.where(F.col("length") < capacity).count() // GROUP_PIECES))
    numbered = table.withColumn("number", F.monotonically_increasing_id())
    full = numbered.where(F.col("length") == capacity).select("id", "piece", "start", "length", "crc", (-1 - F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def run(group: pa.Table) -> pa.Table:
        where, offset = pack(group.column("length").to_numpy(), capacity)
        first = group.column("group")[0].as_py() << 32
        return group.drop_columns(["group"]).append_column("sequence_id", pa.array(where + first)).append_column("offset", pa.array(offset))

    open_pieces = numbered.where(F.col("length") < capacity).select("id", "piece", "start", "length", "crc", (F.xxhash64("number") % groups).alias("group"))
    open_pieces = open_pieces.withColumn("group", F.pmod("group", F.lit(groups)))
    filled = open_pieces.groupBy("group").applyInArrow(run, "id long, piece int, start long, length long, crc long, sequence_id long, offset long")
    return full.unionByName(filled)
