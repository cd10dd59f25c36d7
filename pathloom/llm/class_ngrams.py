"""Scoring texts with a Brown class-based bigram model.

Words are clustered by the exchange algorithm: a word moves to the class in which the
likelihood of the class bigrams grows most, until no move helps. The probability of a word
after another is then the transition between their classes times the word's share of its class,

    P(w | v) = mix * P(class w | class v) * P(w | class w) + (1 - mix) * unigram(w),

where 0.1 is added to the counts of a class's words and of one word it has not seen.

Every word that occurs LEAST times is clustered on its own. Any rarer word is clustered together
with the rare words that share its shape (a hash of its last bytes), so every word never seen has
a class too. The most frequent words and the shapes of all others, few enough for one dense table,
are exchanged first; then all items move in rounds over the saved counts of their neighbours,
against a shared class table. All counts are of the whole training corpus.
"""

from __future__ import annotations

import ctypes
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.columns import fold, packed, partitions, text_bytes
from pathloom.shared import save_table

#: Words that have items of their own in the first, dense exchange, and shapes of the others.
FREQUENT, SHAPES = 512, 512

#: Occurrences from which on a word is clustered on its own.
LEAST = 10

#: Last bytes of a word that make its shape.
SHAPE_BYTES = 3

#: Classes at least; the end has the last of these, and further ones follow it.
CLASSES = 48

#: The exchange of all items ends when rounds in which every item has had its turn raise the likelihood's logarithm by less than this part.
LEAST_GAIN = 1e-4
MIX = 0.85

#: The end of a text among the words; no word is empty.
END = b""

#: Bytes of words, or word pairs, that a task holds before it hands on their counts.
HELD_BYTES, HELD_PAIRS = 32 << 20, 2_000_000

#: UTF-8 bytes of text in a block whose distinct words are looked up together.
BLOCK_BYTES = 8 << 20

#: Blocks whose words, if one task looked all of them up, would be as many as it looks up in its part.
BLOCKS_A_PART = 4

#: Numbers in a matrix that a task makes to compare classes.
HELD_GAINS = 500_000

#: How many times a count a cell must be for the series of a gain.
SERIES = 8

#: How many times the smallest cell a count may be for the series to keep its digits.
STEEP = 100

#: Parts of the likelihood's logarithm that a move gains at least; less may be the error of the sums.
TIE = 1e-10

#: The exchange of one item after another ends when a round over all raises the likelihood's logarithm by less than this part.
SWEEP_GAIN = 1e-7

#: Parts of a block of items: a power of two.
PARTS = 4


def words_of(texts: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts one after another, with A-Z lower-cased, and how many each text has.

    Anything but ASCII white space belongs to a word.
    """
    texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    if not len(texts):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    # Without white space at its ends a text that is not empty splits in words alone.
    plain = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    some = pc.greater(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False)
    lists = pc.ascii_split_whitespace(plain if some.all() else plain.filter(pa.array(some)))
    counts = np.zeros(len(texts), np.int64)
    counts[some] = np.diff(lists.offsets.to_numpy())
    return lists.values, counts


def release_memory() -> None:
    """Give back what Arrow and the C library hold for later; a worker stays, and others need the room."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # there is none beside glibc
    if trim:
        trim(0)


def with_ends(ids: np.ndarray, counts: np.ndarray, end: int) -> np.ndarray:
    """The ids of the texts' words with the end before each text."""
    return np.insert(ids, np.cumsum(counts) - counts, end)


def shape_of(word: bytes) -> int:
    return zlib.crc32(word[-SHAPE_BYTES:]) % SHAPES


def places_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of an array of strings or binaries without nulls, and where each begins and how long it is."""
    large = pa.types.is_large_binary(words.type) or pa.types.is_large_string(words.type)
    _, offsets, data = words.buffers()
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = np.frombuffer(offsets, np.int64 if large else np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), edges[:-1], np.diff(edges)


def by_length(lengths: np.ndarray, longest: int):
    """(length, places of the words that have it) up to ``longest``, where all longer ones are with it."""
    capped = np.minimum(lengths, longest).astype(np.uint8)
    order = np.argsort(capped, kind="stable")
    edge = np.searchsorted(capped[order], np.arange(longest + 2))
    for k in range(longest + 1):
        if edge[k] < edge[k + 1]:
            yield k, order[edge[k] : edge[k + 1]]


def hashes_of(words: pa.Array) -> np.ndarray:
    """XXH64 of each word with Spark's seed; words of less than 32 bytes are hashed all at once, length by length."""
    from xxhash import xxh64_intdigest

    data, starts, lengths = places_of(words)
    raw = np.ascontiguousarray(data)
    eight, four = (np.ndarray(max(0, len(raw) - k + 1), f"<u{k}", raw, strides=(1,)) if len(raw) >= k else np.zeros(0, f"<u{k}") for k in (8, 4))
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, k: x << np.uint64(k) | x >> np.uint64(64 - k)
    found = np.empty(len(lengths), np.uint64)
    for length, those in by_length(lengths, 32):
        at = starts[those]
        if length == 32:
            found[those] = [xxh64_intdigest(raw[b : b + n], 42) for b, n in zip(at.tolist(), lengths[those].tolist())]
            continue
        h = np.full(len(at), p5 + np.uint64(42 + length))
        for k in range(0, length - 7, 8):
            h = turned(h ^ turned(eight[at + k] * p2, 31) * p1, 27) * p1 + p4
        if length & 4:
            h = turned(h ^ four[at + (length & ~7)].astype(np.uint64) * p1, 23) * p2 + p3
        for k in range(length & ~3, length):
            h = turned(h ^ raw[at + k].astype(np.uint64) * p5, 11) * p1
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
        found[those] = h ^ h >> np.uint64(32)
    return found


def shapes_of(words: pa.Array) -> np.ndarray:
    """:func:`shape_of` each word."""
    data, starts, lengths = places_of(words)
    found = np.empty(len(lengths), np.int64)
    for length, those in by_length(lengths, SHAPE_BYTES):
        crc = np.full(len(those), 0xFFFFFFFF, np.uint32)
        for k in range(length, 0, -1):
            crc = CRC[(crc ^ data[starts[those] + lengths[those] - k]) & 255] ^ crc >> 8
        found[those] = (crc ^ np.uint32(0xFFFFFFFF)) % SHAPES
    return found


def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


#: What a byte makes of a CRC-32.
CRC = crc_table()


class Items:
    """The item number of each word: its place among the ascending hashes of clustered words, else its shape's, then the end's.

    Workers get eight bytes a clustered word, not the words.
    """

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.base = hashes, len(hashes)
        self.end = self.base + SHAPES

    def of(self, words: list[bytes] | pa.Array) -> np.ndarray:
        """The items of words that are not the end."""
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.large_binary())
        h = hashes_of(words)
        at = np.searchsorted(self.hashes, h)
        other = np.flatnonzero(self.hashes[np.minimum(at, self.base - 1)] != h) if self.base else np.arange(len(words))
        at[other] = self.base + shapes_of(words.take(pa.array(other)))
        return at


# ---------------------------------------------------------------- counts


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, count) over the packed ``docs``, one end per document among them."""

    def total(held: list[pa.Array], texts: int) -> pa.Table:
        # All words at once: counts of parts would be hashed again to add them up.
        found = pa.chunked_array(held, held[0].type).value_counts()
        held.clear()
        end = pa.table({"word": pa.array([END], pa.large_binary()), "n": pa.array([texts], pa.int64())})
        return pa.concat_tables([pa.table({"word": found.field(0).cast(pa.large_binary()), "n": found.field(1)}), end])

    def run(batches):
        held, size, texts = [], 0, 0
        for batch in batches:
            words, counts = words_of(batch.column(0))
            held.append(words)
            size, texts = size + words.nbytes, texts + len(counts)
            del words
            if size > HELD_BYTES:
                yield from as_batches(total(held, texts))
                size = texts = 0
            release_memory()
        if texts:
            yield from as_batches(total(held, texts))
        release_memory()

    def as_batches(table):
        for part in table.cast(pa.schema([("word", pa.binary()), ("n", pa.int64())])).to_batches(100_000):
            if len(part):
                yield part

    local = docs.select("text").mapInArrow(run, "word binary, n long")
    return local.groupBy("word").agg(F.sum("n").alias("n"))


def packed_edges(edges: np.ndarray) -> bytes:
    """(item, neighbour, count) columns as bytes; four bytes a number where that is enough."""
    kind = "<u4" if not edges.size or edges.max() < 1 << 32 else "<u8"
    raw = edges.astype(kind).tobytes()
    return kind[2:].encode() + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def opened_edges(blob: bytes, columns: int = 3) -> np.ndarray:
    raw = pa.decompress(blob[9:], int.from_bytes(blob[1:9], "little"), "zstd", asbytes=True)
    return np.frombuffer(raw, "<u" + blob[:1].decode()).reshape(columns, -1)


def summed(item: np.ndarray, other: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Edges in order, each once with its total."""
    key = item.astype(np.int64) * size + other
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return np.stack((key[first] // size, key[first] % size, np.add.reduceat(n[order].astype(np.int64), first) if len(key) else n.astype(np.int64)))


def mixed(item: np.ndarray) -> np.ndarray:
    """A number that deals items over parts and turns."""
    return item.astype(np.int64) * 0x9E3779B1 >> 8


def neighbours(docs: DataFrame, held, tokens: int) -> DataFrame:
    """(part, right, left): the items of a part with their neighbours on either side, and how often they are.

    There are blocks of items, one for every HELD_PAIRS tokens, each in PARTS parts; all edges of an
    item are in one row. ``held`` is the broadcast array of hashes. Every text begins and ends
    with the end.
    """
    blocks = max(partitions(docs), -(-tokens // HELD_PAIRS))

    def run(batches):
        items = Items(held.value)
        size = items.end + 1
        kind = np.int32 if size < 1 << 31 else np.int64

        def numbers(texts):
            words, counts = words_of(texts)
            found = words.dictionary_encode()
            ids = items.of(found.dictionary).astype(kind)
            return with_ends(ids[found.indices.to_numpy()], counts, items.end)

        def out(held_ids):
            # The largest arrays of a worker: few at a time, and changed in place.
            ids = np.concatenate(held_ids)
            held_ids.clear()
            key = ids.astype(np.int64)
            key *= size
            key[:-1] += ids[1:]
            key[-1] += items.end
            del ids
            key.sort()
            new = np.ones(len(key), bool)
            np.not_equal(key[1:], key[:-1], out=new[1:])
            first = np.flatnonzero(new)
            n = np.diff(first, append=len(key)).astype(np.int32)
            key = key[first]
            del first
            a, b = (key // size).astype(kind), (key % size).astype(kind)
            del key
            rows = []
            for side, (item, other) in enumerate(((a, b), (b, a))):
                block = (item % blocks).astype(np.int32)
                order = np.argsort(block, kind="stable")
                block = block[order]
                first = np.flatnonzero(np.diff(block, prepend=-1))
                for k, some in zip(block[first].tolist(), np.split(order, first[1:])):
                    rows.append((k, side, packed_edges(np.stack((item[some], other[some], n[some])))))
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary()))], ["block", "side", "edges"])

        held_ids, held_now = [], 0
        for batch in batches:
            held_ids.append(numbers(batch.column(0)))
            held_now += len(held_ids[-1])
            if held_now > HELD_PAIRS:
                yield out(held_ids)
                held_now = 0
            release_memory()
        if held_now:
            yield out(held_ids)
        release_memory()

    def merge(table: pa.Table) -> pa.Table:
        release_memory()
        size = len(held.value) + SHAPES + 1
        sides, cols = table.column("side").to_numpy(), [[], []]
        for side in (0, 1):
            blobs = [b for b, s in zip(table.column("edges").to_pylist(), sides) if s == side]
            edges = summed(*np.concatenate([opened_edges(b) for b in blobs], axis=1), size)
            part = mixed(edges[0]) % PARTS
            cols[side] = [packed_edges(edges[:, part == k]) for k in range(PARTS)]
        return pa.table({"part": pa.array(range(PARTS), pa.int32()), "right": pa.array(cols[0], pa.binary()), "left": pa.array(cols[1], pa.binary())})

    dealt = docs.select("text").mapInArrow(run, "block int, side int, edges binary")
    return save_table(dealt.groupBy("block").applyInArrow(merge, "part int, right binary, left binary"), "word-neighbours")


def class_table(edges: DataFrame, owner: np.ndarray, classes: int) -> np.ndarray:
    """Counts of adjacent classes, or of whatever ``owner`` names for each item."""
    held = edges.sparkSession.sparkContext.broadcast(owner.astype(np.int32))

    def run(batches):
        table, owner = np.zeros(classes * classes), held.value
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                item, other, n = opened_edges(blob)
                table += np.bincount(owner[item] * np.int64(classes) + owner[other], n, classes * classes)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(table[at].astype(np.int64))], ["at", "n"])

    found = edges.select("right").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(classes * classes)
    table[found.column("at").to_numpy()] = found.column("n").to_numpy()
    held.destroy()
    return table.reshape(classes, classes)


# ---------------------------------------------------------------- clustering


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, owner: np.ndarray | None = None, movable: int | None = None) -> np.ndarray:
    """The class of each item; the last item, the end, has the class ``CLASSES - 1`` or the last one to itself.

    At the start the most frequent items have a class each, all others the last open one, unless
    ``owner`` gives the classes. In each round every item, or every one of the first ``movable``, is
    taken out of its class and put where the class bigram likelihood

        sum N(g,h) log N(g,h) - sum N(g,.) log N(g,.) - sum N(.,h) log N(.,h)

    is greatest; an item stays on a tie. Rounds end when one gains less than SWEEP_GAIN.
    """
    n = len(bigrams)
    b = bigrams.astype(float)
    count = b.sum(axis=0)
    order = [i for i in np.lexsort((np.arange(n), -count)).tolist() if i < (n - 1 if movable is None else movable) and count[i] + b[i].sum() > 0]
    closed = classes - 1 if owner is None else CLASSES - 1
    if owner is None:
        owner = np.zeros(n, int)
        owner[n - 1] = closed
        for place, i in enumerate(order):
            owner[i] = min(place, classes - 2)
    else:
        owner = owner.copy()
    member = np.eye(classes)[owner]
    table = member.T @ b @ member
    before, now = -math.inf, log_likelihood(table)
    while now - before > SWEEP_GAIN * abs(now):
        before = now
        for i in order:
            own = owner[i]
            loop = b[i, i]
            to = np.bincount(owner, b[i], classes)
            of = np.bincount(owner, b[:, i], classes)
            to[own] -= loop
            of[own] -= loop
            table[own] -= to
            table[:, own] -= of
            table[own, own] -= loop
            sent, got = to.sum() + loop, of.sum() + loop
            rows, cols = table.sum(axis=1), table.sum(axis=0)
            base = xlogx(table)
            gain_rows = xlogx(table + to[None, :]) - base
            gain_cols = xlogx(table + of[:, None]) - base
            diagonal = np.arange(classes)
            both = xlogx(table[diagonal, diagonal] + to + of + loop) - base[diagonal, diagonal]
            gain = gain_rows.sum(axis=1) - gain_rows[diagonal, diagonal] + gain_cols.sum(axis=0) - gain_cols[diagonal, diagonal] + both
            gain -= xlogx(rows + sent) - xlogx(rows) + xlogx(cols + got) - xlogx(cols)
            gain[closed] = -np.inf
            best = int(gain.argmax())
            new = best if gain[best] > gain[own] + TIE * abs(now) else own
            table[new] += to
            table[:, new] += of
            table[new, new] += loop
            owner[i] = new
        now = log_likelihood(table)
    return owner


def best_classes(table: np.ndarray, own: np.ndarray, to: np.ndarray, of: np.ndarray, loop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where :func:`exchange` would put each item alone, and what the likelihood's logarithm gains by it.

    ``own`` are the items' classes; ``to`` and ``of`` (items by classes) count their neighbours to
    the right and to the left by class, without ``loop``, the item next to itself.
    """
    n, classes = to.shape
    every = np.arange(n)
    gain = neighbour_gains(table.T, own, to, of) + neighbour_gains(table, own, of, to)

    def rise(cells: np.ndarray, left: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What counts (items by classes) add to the cells of the classes; the items' own are without ``left``."""
        found = xlogx(cells + counts) - xlogx(cells)
        rest = cells[own] - left
        found[every, own] = xlogx(rest + (counts[every, own] if counts.shape[1] > 1 else counts[:, 0])) - xlogx(rest)
        return found

    both = to + of + loop[:, None]
    gain += rise(table.diagonal(), both[every, own], both)
    for totals, size in ((table.sum(axis=1), to.sum(axis=1) + loop), (table.sum(axis=0), of.sum(axis=1) + loop)):
        gain -= rise(totals, size, size[:, None])
    gain[:, CLASSES - 1] = -np.inf
    best = gain.argmax(axis=1)
    best = np.where(gain[every, best] > gain[every, own] + TIE * abs(log_likelihood(table)), best, own)
    return best, gain[every, best] - gain[every, own]


def neighbour_gains(cells: np.ndarray, own: np.ndarray, counts: np.ndarray, others: np.ndarray) -> np.ndarray:
    """What each item (row) adds in each class (column) to the cells of its neighbours' classes, apart from the diagonal.

    ``cells[h, g]`` are the counts of class g beside class h. With a count a at h, a class gains
    f(c + a) - f(c) for f(x) = x log x and its cell c, which is the series

        a (1 + log c) + a^2 / 2c - a^3 / 6c^2 + ...

    Sums over h of its terms are products of matrices, and so are those of f(a) for empty cells.
    Other cells that are not SERIES times as large as the count get the exact difference instead,
    and so do the item's own class, whose cells are without it, and its own class among the
    neighbours.
    """
    n, classes = counts.shape
    every, apart = np.arange(n), ~np.eye(classes, dtype=bool)
    whose, h = np.nonzero(counts)
    x = counts[whose, h]
    # The item's own class, without the item.
    held, home_cells = xlogx(cells), cells[h, own[whose]]
    mine = h == own[whose]
    of_own = np.bincount(whose, np.where(mine, 0.0, held[h, own[whose]] - xlogx(np.where(mine, 0.0, home_cells - x))), n)
    # An item takes part in the series at h only for the classes with large cells: all others are put right one by one.
    item, h, a = whose[~mine], h[~mine], x[~mine]
    rest = counts.copy()
    rest[every, own] = 0
    usable = (cells > 0) & apart
    safe = np.where(usable, cells, 1.0)
    terms = [np.where(usable, 1 + np.log(safe), 0.0), *[np.where(usable, (-1.0) ** k / (k * (k - 1) * safe ** (k - 1)), 0.0) for k in range(2, 6)]]
    # The diagonal is in order among the empty cells, so it is left out with them.
    other = np.where(apart, cells, 0.0)
    order = np.argsort(other, axis=1, kind="stable")
    ascending = np.take_along_axis(other, order, axis=1)
    empty = (other == 0).sum(axis=1)
    few, steep = np.empty(len(a), np.int64), np.empty(len(a), bool)
    by_class = np.argsort(h.astype(np.int16 if classes < 1 << 15 else np.int64), kind="stable")
    edge = np.searchsorted(h[by_class], np.arange(classes + 1))
    for k in range(classes):
        at = by_class[edge[k] : edge[k + 1]]
        few[at] = np.searchsorted(ascending[k], SERIES * a[at])
        steep[at] = a[at] > STEEP * ascending[k, min(empty[k], classes - 1)]
    size = np.maximum(few - empty[h], 0)
    # Where most cells are small, or one is tiny, the series would only lose digits.
    whole = (size * 2 > classes) | (steep & (size > 0))
    rest[item[whole], h[whole]] = 0
    gain = xlogx(rest) @ ((cells == 0) & apart).astype(float)
    power = rest
    for term in terms:
        gain += power @ term
        power = power * rest
    flat = gain.reshape(-1)
    wholes = np.flatnonzero(whole)
    for at in range(0, len(wholes), step := max(1, HELD_GAINS // classes)):
        some = wholes[at : at + step]
        exact = np.where(apart[h[some]], xlogx(cells[h[some]] + a[some, None]) - held[h[some]], 0.0)
        flat += np.bincount((item[some, None] * classes + np.arange(classes)).ravel(), exact.ravel(), n * classes)
    # The exact difference less the series, for the other pairs with small cells.
    pairs = np.flatnonzero(~whole & (size > 0))
    size = size[pairs]
    ends = np.cumsum(size)
    first = h[pairs] * classes + empty[h[pairs]] - (ends - size)
    for at in range(0, len(pairs), step):
        some = slice(at, at + step)
        place = np.arange(ends[at] - size[at], ends[some][-1]) + np.repeat(first[some], size[some])
        c, x = ascending.take(place), np.repeat(a[pairs[some]], size[some])
        t = x / c
        exact = (c + x) * np.log1p(t) - x * (1 + t * (1 / 2 - t * (1 / 6 - t * (1 / 12 - t / 20))))
        flat += np.bincount(np.repeat(item[pairs[some]] * classes, size[some]) + order.take(place), exact, n * classes)
    gain[every, own] = of_own
    # Its own class among the neighbours, whose cells are without the other side's counts.
    home = np.flatnonzero(counts[every, own])
    x, c = counts[home, own[home]][:, None], cells[own[home]] - others[home]
    part = np.where(c < 0, 0.0, xlogx(np.maximum(c, 0) + x) - xlogx(np.maximum(c, 0)))
    part[np.arange(len(home)), own[home]] = 0
    gain[home] += part
    return gain


def moves(edges: DataFrame, owner: np.ndarray, table: np.ndarray, still: np.ndarray, turn: int, turns: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Items of a turn that a move alone would help, their new classes, and the sum of what each alone would gain.

    The items of ``still`` (ascending) do not move.
    """
    classes, held = len(table), edges.sparkSession.sparkContext.broadcast((owner.astype(np.int32), table, still))

    def run(batches):
        owner, table, still = held.value
        for batch in batches:
            for right, left in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sides = [opened_edges(right), opened_edges(left)]
                firsts = [np.flatnonzero(np.diff(x[0].astype(np.int64), prepend=-1)) for x in sides]
                items = np.union1d(*[x[0][first] for x, first in zip(sides, firsts)]).astype(np.int64)
                items = items[(mixed(items) % turns == turn) & ~np.isin(items, still)]
                if not len(items):
                    continue
                vectors = []
                for (item, other, n), first in zip(sides, firsts):
                    # Edges come in order of their items.
                    at = np.minimum(np.searchsorted(items, item[first]), len(items) - 1)
                    length = np.diff(np.append(first, len(item)))
                    place, mine = np.repeat(at, length), np.repeat(items[at] == item[first], length)
                    place, other, n, loops = place[mine], other[mine], n[mine], (item == other)[mine]
                    vectors.append(np.bincount(place[~loops] * classes + owner[other[~loops]], n[~loops], len(items) * classes).reshape(-1, classes))
                    loop = np.bincount(place[loops], n[loops], len(items))  # either side has them all
                own = owner[items].astype(np.int64)
                best, gain = best_classes(table, own, *vectors, loop)
                moved = best != own
                yield pa.RecordBatch.from_arrays([pa.array(items[moved], pa.int64()), pa.array(best[moved], pa.int64()), pa.array(gain[moved])], ["item", "class", "gain"])
        release_memory()

    mine = edges.where(F.col("part") % min(turns, PARTS) == turn % PARTS)
    found = mine.select("right", "left").mapInArrow(run, "item long, class long, gain double").toArrow()
    held.destroy()
    return found.column("item").to_numpy(), found.column("class").to_numpy(), float(found.column("gain").to_numpy().sum())


def log_likelihood(table: np.ndarray) -> float:
    return float(xlogx(table).sum() - xlogx(table.sum(axis=1)).sum() - xlogx(table.sum(axis=0)).sum())


def exchange_all(edges: DataFrame, owner: np.ndarray, classes: int, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all items, and the class table, after cycles of two kinds of moves; item ``len(owner) - 1`` is the end.

    The items of ``top``, the most frequent ones, which touch most others, move one after another,
    while the rest counts by its classes only and stays. Then the rest moves in turns, the items
    of a turn at the same time. Moves made together may hurt each other: a turn that lowers the
    likelihood is taken back, and turns get smaller, down to single items, whose moves help. The
    end is when a cycle gains less than LEAST_GAIN, or when the moves of a turn would gain no more
    than its share of that if none hurt another.
    """
    turns, still = 2, np.sort(np.append(top, len(owner) - 1))

    def dense(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The table of the frequent words and the classes, which has the class table in it, and its items' classes."""
        place = len(top) + owner
        place[top] = np.arange(len(top))
        return class_table(edges, place, len(top) + classes), np.concatenate((owner[top], np.arange(classes)))

    bigrams, first = dense(owner)
    while True:
        start = log_likelihood(merged(bigrams, first, classes))
        after = exchange(bigrams, classes, first, len(top))
        owner = owner.copy()
        owner[top] = after[: len(top)]
        table = merged(bigrams, after, classes)
        now = log_likelihood(table)
        turn, taken_back = 0, False
        while turn < turns and not taken_back:
            item, to, promised = moves(edges, owner, table, still, turn, turns)
            moved = owner.copy()
            moved[item] = to
            turn += 1
            if not len(item) and turn < turns:
                continue
            # The last table of a cycle serves the next one's exchange as well.
            found = dense(moved) if turn == turns else None
            fresh = merged(*found, classes) if found else class_table(edges, moved, classes)
            taken_back = len(item) and log_likelihood(fresh) <= now
            if taken_back and promised * turns > LEAST_GAIN * abs(now):
                turns *= 2
                bigrams, first = dense(owner)
            elif taken_back:
                return owner, table
            else:
                owner, table, now = moved, fresh, log_likelihood(fresh)
                bigrams, first = found or (bigrams, first)
        if not taken_back and now - start <= LEAST_GAIN * abs(now):
            return owner, table


def merged(bigrams: np.ndarray, owner: np.ndarray, classes: int) -> np.ndarray:
    """The class table of a table of items."""
    member = np.eye(classes)[owner]
    return member.T @ bigrams @ member


@dataclass
class ClassModel:
    """Transitions between classes, and class and corpus totals; its size depends on the classes alone."""

    transition: np.ndarray
    class_total: np.ndarray
    class_words: np.ndarray
    shape_class: np.ndarray
    tokens: int
    distinct: int
    ends: int

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.1) / (self.tokens + 0.1 * (self.distinct + 1))

    def emission(self, count: np.ndarray, cls: np.ndarray) -> np.ndarray:
        return (count + 0.1) / (self.class_total[cls] + 0.1 * (self.class_words[cls] + 1))


def fit(docs: DataFrame) -> tuple[ClassModel, DataFrame]:
    """The model of the packed training ``docs``, and the saved table (word, n, class) of all words."""
    spark = docs.sparkSession
    counts = save_table(word_counts(docs), "word-counts")
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    clustered = counts.where((F.col("word") != F.lit(END)) & (F.col("n") >= LEAST)).select(F.xxhash64("word").alias("h"), "n")
    table = clustered.toArrow()
    hashes, often = table.column("h").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(hashes)
    hashes, often = hashes[order], often[order]
    shapes = counts.where((F.col("word") != F.lit(END)) & (F.col("n") >= LEAST))
    shape = F.crc32(F.expr(f"substring(word, greatest(octet_length(word) - {SHAPE_BYTES - 1}, 1), {SHAPE_BYTES})")) % SHAPES
    shaped = shapes.select(F.xxhash64("word").alias("h"), shape.cast("int").alias("s")).toArrow()
    shape_of_item = np.zeros(len(hashes), np.int64)
    shape_of_item[np.searchsorted(hashes, shaped.column("h").to_numpy().view(np.uint64))] = shaped.column("s").to_numpy()

    held = spark.sparkContext.broadcast(hashes)
    edges = neighbours(docs, held, tokens)
    # A class for every word of the cube root of their number.
    classes = max(CLASSES, math.ceil(len(hashes) ** (1 / 3)))
    # The first exchange is of the most frequent words and of all shapes; other words go with their shape.
    top = np.lexsort((hashes, -often))[:FREQUENT]
    dense = np.concatenate((FREQUENT + shape_of_item, FREQUENT + np.arange(SHAPES), [FREQUENT + SHAPES]))
    dense[top] = np.arange(len(top))
    first = exchange(class_table(edges, dense, FREQUENT + SHAPES + 1), classes)
    if classes > CLASSES:  # the end has class CLASSES - 1
        first = np.where(first == classes - 1, CLASSES - 1, np.where(first == CLASSES - 1, classes - 1, first))
    owner, table = exchange_all(edges, first[dense], classes, top)

    total = table.sum(axis=0)
    overall = total / max(total.sum(), 1)
    transition = (table + overall[None, :]) / (table.sum(axis=1, keepdims=True) + 1)
    place = spark.sparkContext.broadcast(owner.astype(np.int32))

    def add_class(batches):
        items, owner = Items(held.value), place.value
        for batch in batches:
            words = batch.column(0)
            at = np.where(places_of(words)[2] == len(END), items.end, items.of(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(owner[at], pa.int32())], ["word", "n", "class"])

    vocabulary = save_table(counts.mapInArrow(add_class, "word binary, n long, class int"), "word-classes")
    words = np.zeros(classes)
    for r in vocabulary.groupBy("class").agg(F.count("*").alias("n")).collect():
        words[r["class"]] = r["n"]
    return ClassModel(transition, total, words, owner[len(hashes) : len(hashes) + SHAPES], tokens, distinct, ends), vocabulary


# ---------------------------------------------------------------- scores


def dealt(words: pa.Array, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of different words by their hashes (of equal ones by their bytes), and the part of each in that order."""
    h = hashes_of(words)
    order = np.argsort(h)
    if (h[order[1:]] == h[order[:-1]]).any():
        order = np.array(sorted(range(len(h)), key=lambda i: (h[i], words[i].cast(pa.large_binary()).as_py())))
    return order, ((h[order] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def packed_words(words: pa.Array) -> bytes:
    """The words as bytes: how many, their lengths, then all of them."""
    data, starts, lengths = places_of(words)
    some = data[starts[0] : starts[-1] + lengths[-1]] if len(words) else data
    return len(words).to_bytes(8, "little") + lengths.astype("<u4").tobytes() + some.tobytes()


def opened_words(blob: bytes) -> pa.Array:
    n = int.from_bytes(blob[:8], "little")
    edges = np.append(0, np.cumsum(np.frombuffer(blob, "<u4", n, 8), dtype=np.int64))
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(edges), pa.py_buffer(blob[8 + 4 * n :])])


def score(docs: DataFrame, model: ClassModel, vocabulary: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of the packed ``docs``.

    Documents are dealt into blocks of about ``block_bytes``. The distinct words of each block meet
    the table of word counts, so a word that is everywhere is looked up once per block, and the
    vocabulary, which grows with the corpus, is never sent to all tasks. The words of a block that
    belong to one part of the vocabulary travel in one row, and so do the counts on their way back.
    Each block is then scored next to the counts of its words.
    """
    blocks = max(partitions(docs), -(-text_bytes(docs) // block_bytes))
    # Fewer parts make longer rows, and a part has to fit in a task.
    parts = max(partitions(docs), -(-blocks // BLOCKS_A_PART))
    blocked = docs.select(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int").alias("block"), "id", "text")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def distinct_words(table: pa.Table) -> pa.Table:
        release_memory()
        found = words_of(table.column("text"))[0].unique()
        order, part = dealt(found, parts)
        first = np.flatnonzero(np.diff(part, prepend=-1))
        found = found.take(pa.array(order))
        packs = [packed_words(found[a:b]) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(part)])]
        block = pa.array(np.full(len(first), table.column("block")[0].as_py(), np.int32))
        return pa.table({"part": pa.array(part[first], pa.int32()), "block": block, "words": pa.array(packs, pa.binary())})

    def look_up(asked: pa.Table, listed: pa.Table) -> pa.Table:
        release_memory()
        words = [opened_words(x) for x in asked.column("words").to_pylist()]
        known = listed.column("word").combine_chunks().cast(pa.large_binary())
        at = pc.index_in(pa.concat_arrays(words) if words else pa.array([], pa.large_binary()), value_set=known).fill_null(len(known)).to_numpy()
        # A class is one more here, and none is for words that training lacks.
        both = np.stack((np.append(listed.column("n").to_numpy(), 0)[at], np.append(listed.column("class").to_numpy() + 1, 0)[at]))
        counts = [packed_edges(x) for x in np.split(both, np.cumsum([len(x) for x in words])[:-1], axis=1)] if words else []
        return pa.table({"block": asked.column("block"), "part": asked.column("part"), "counts": pa.array(counts, pa.binary())})

    def run(texts: pa.Table, counted: pa.Table) -> pa.Table:
        release_memory()
        m = held.value
        said, counts = words_of(texts.column("text"))
        found = said.dictionary_encode()
        listed, ids = found.dictionary, found.indices.to_numpy()
        del said, found
        blobs = counted.column("counts").to_pylist()
        rows = [opened_edges(blobs[i], 2).astype(np.int64) for i in np.argsort(counted.column("part").to_numpy()).tolist()]
        both = np.zeros((2, len(listed)), np.int64)
        both[:, dealt(listed, parts)[0]] = np.concatenate(rows, axis=1) if rows else both
        count = np.append(both[0].astype(float), float(m.ends))
        cls = np.append(both[1] - 1, CLASSES - 1)
        unseen = np.flatnonzero(cls < 0)  # in training
        cls[unseen] = m.shape_class[shapes_of(listed.take(pa.array(unseen)))]
        plain = m.unigram(count)
        share = m.emission(count, cls) * (MIX if m.tokens else 0.0)
        rest = plain * ((1 - MIX) if m.tokens else 1.0)
        # Every text's words with the end before and after it.
        before = with_ends(ids, counts, len(listed))
        at = np.append(before[1:], len(listed))
        p = m.transition[cls[before], cls[at]] * share[at] + rest[at]
        start = np.cumsum(counts + 1) - counts - 1
        sums = [np.add.reduceat(x, start) for x in ((count > 0).astype(np.int64)[at], np.log10(plain)[at], np.log10(p))]
        return pa.table({"id": texts.column("id"), "n_tokens": pa.array(counts + 1, pa.int64()), "n_known": pa.array(sums[0], pa.int64()), "base_score": pa.array(sums[1], pa.float64()), "score": pa.array(sums[2], pa.float64())})

    by_block = blocked.groupBy("block")
    asked = by_block.applyInArrow(distinct_words, "part int, block int, words binary")
    # As in dealt.
    part = F.shiftright(F.shiftrightunsigned(F.xxhash64("word"), 32) * F.lit(parts).cast("long"), 32).cast("int")
    listed = vocabulary.where(F.col("word") != F.lit(END)).select(part.alias("part"), "word", "n", "class")
    counted = asked.groupBy("part").cogroup(listed.groupBy("part")).applyInArrow(look_up, "block int, part int, counts binary")
    return by_block.cogroup(counted.groupBy("block")).applyInArrow(run, "id long, n_tokens long, n_known long, base_score double, score double")


def score_documents(docs: DataFrame, held_out_of: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the documents outside fold 0 of ``held_out_of``, score all of them.

    Returns id, held_out, n_tokens, n_known, train_tokens, base_score (log10, unigram with 0.1
    added to every count) and score (log10, the class model).

    * a null text counts as empty and is the end alone
    * without training documents the class model falls back to the unigram
    * repeated rows are scored each and all count in training; an empty table gives no rows;
      extra columns are ignored
    """
    base = packed(docs, id_col, text_col)
    held = fold(F.col("id"), held_out_of) == 0
    model, vocabulary = fit(base.where(~held).select("text"))
    scored = score(base.select("id", "text"), model, vocabulary)
    return scored.select("id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
