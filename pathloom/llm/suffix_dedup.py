"""Removal of byte strings that occur earlier in the corpus, by suffix sorting.

A byte goes if it lies in a string of WIDTH bytes that also starts earlier, in a document with
a smaller id or before in the same one. Rows that share an id, or have none, follow each other by
a hash of their texts, then by their texts. Every start position is judged, in four steps.

1. Winnowing gives each position an anchor: the gram of GRAM bytes with the least hash inside
   its string. Equal strings have equal anchors at equal distances, so only positions whose
   anchor occurs elsewhere can repeat. Positions with one anchor form a segment.
2. Anchors of each block of documents go to the bucket of their hash, once per block, and come
   back as single, uniform (every segment around the anchor has the same bytes) or mixed.
3. Segments of uniform anchors are units as they are. The positions in segments of mixed
   anchors are suffix-sorted in their block; strings equal over WIDTH bytes become one unit.
   Each block sends each unit once, with the smallest document that has it.
4. A bucket tells each block whether it holds a unit's first occurrence in the corpus. All
   other occurrences are marked, and the marked strings are cut out.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.columns import packed, partitions
from pathloom.llm.suffix_sort import sorted_classes
from pathloom.shared import save_table

#: Bytes of a string that counts as repeated.
WIDTH = 100

#: Positions whose anchor is chosen together, and the bytes of a gram: WIDTH = WINDOW + GRAM - 1.
WINDOW = 64
GRAM = WIDTH - WINDOW + 1

#: Bytes of text in a block, bytes that are winnowed at once (below 2**24), and bytes of text for which there is a bucket.
BLOCK_BYTES, PIECE, BUCKET_BYTES = 8 << 20, 1 << 17, 64 << 20

_LOW = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15
SINGLE, UNIFORM, MIXED = 0, 1, 2


# ---------------------------------------------------------------- segments


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position: powers of two first, then their sum."""
    values, power, size, done = _BYTE_HASH[data], _BASE, 1, 0
    total = np.zeros(len(data) - GRAM + 1, np.uint64)
    while True:
        if GRAM & size:
            total *= np.uint64(power)
            total += values[done : len(total) + done]
            done += size
        if size * 2 > GRAM:
            break
        left = values[:-size] * np.uint64(power)
        left += values[size:]
        values, power, size = left, power * power % (1 << 64), size * 2
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(29)
    return total


with np.errstate(over="ignore"):
    _BYTE_HASH = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(40))


@dataclass
class Segments:
    """Runs of positions with one anchor; offsets are in the block's buffer."""

    lo: np.ndarray
    hi: np.ndarray
    anchor: np.ndarray
    gram: np.ndarray


def segments(buffer: bytes, bounds: np.ndarray) -> Segments:
    """The segments of all documents; document k is ``buffer[bounds[k]:bounds[k + 1]]``."""
    data = np.frombuffer(buffer, np.uint8)
    found: list[tuple] = []
    begin, first = 0, 0
    n_docs = len(bounds) - 1
    while first < n_docs:
        # A piece ends with a document if it can; a longer document continues WIDTH - 1 bytes earlier.
        last = max(first + 1, int(np.searchsorted(bounds, begin + PIECE, "right")) - 1)
        end = int(bounds[last])
        if end - begin > PIECE + WIDTH:
            end = begin + PIECE
        found.append(piece_segments(data, bounds, begin, end))
        if end == bounds[last]:
            begin, first = end, last
        else:
            begin, first = end - WIDTH + 1, last - 1
    lo, hi, anchor, gram = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 4
    return Segments(lo, hi, anchor, gram.astype(np.uint64))


def piece_segments(data, bounds, begin, end):
    n = end - begin - WIDTH + 1  # start positions
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64)
    hashes = gram_hashes(data[begin:end])
    # The least of the high bits wins, then the leftmost: both depend on the string alone.
    least = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
    step = 1
    while step < WINDOW:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    anchor = (least & _LOW).astype(np.int64)
    inner = bounds[np.searchsorted(bounds, begin, "right") : np.searchsorted(bounds, end, "left")] - begin
    valid = np.ones(n, bool)
    for b in inner.tolist():
        valid[max(0, b - WIDTH + 1) : b] = False
    change = np.ones(n + 1, bool)
    change[1:n] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
    edge = np.flatnonzero(change)
    lo, hi = edge[:-1], edge[1:] - 1
    keep = valid[lo]
    lo, hi = lo[keep], hi[keep]
    # The least hashes crowd at the low end; mixed again, they spread over all buckets.
    gram = hashes[anchor[lo]] * np.uint64(0x94D049BB133111EB)
    gram = (gram ^ (gram >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return lo + begin, hi + begin, anchor[lo] + begin, gram ^ (gram >> np.uint64(32))


def contexts(buffer: bytes, s: Segments, which: np.ndarray) -> np.ndarray:
    """A 64-bit digest of all bytes that the strings of a segment cover, and of the anchor's place."""
    from xxhash import xxh3_64_intdigest as digest

    spans = zip(s.lo[which].tolist(), (s.hi[which] + WIDTH).tolist(), (s.anchor[which] - s.lo[which]).tolist())
    return np.fromiter((digest(buffer[a:b], d) for a, b, d in spans), np.uint64, len(which))


# ---------------------------------------------------------------- blocks and buckets


@dataclass
class Block:
    """A block's documents in order, joined; ``hashes`` order those of one id."""

    ids: np.ndarray
    nulls: np.ndarray
    hashes: np.ndarray
    buffer: bytes
    bounds: np.ndarray


def block_of(table: pa.Table) -> Block:
    from xxhash import xxh64_intdigest

    ids = table.column("id")
    texts = table.column("text").to_pylist()
    nulls = np.array([x is None for x in ids.to_pylist()], bool)
    numbers = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
    hashes = np.fromiter((xxh64_intdigest(t, 42) for t in texts), np.uint64, len(texts))
    order = sorted(range(len(texts)), key=lambda i: (bool(nulls[i]), int(numbers[i]), int(hashes[i]), texts[i]))
    joined = [texts[i] for i in order]
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in joined], dtype=np.int64)))
    return Block(numbers[order], nulls[order], hashes[order], b"".join(joined), bounds)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending with the keys, so that each bucket's part of sorted keys is one slice."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def slices(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys."""
    edges = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    return [(b, int(edges[b]), int(edges[b + 1])) for b in range(buckets) if edges[b] < edges[b + 1]]


MESSAGE = "bucket int, block int, kind int, n int, data binary"


def message_table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [[]] * 5
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.table({name: pa.array(c, t) for name, c, t in zip(("bucket", "block", "kind", "n", "data"), cols, kinds)})


def anchor_messages(block: Block, number: int, buckets: int) -> pa.Table:
    """For each bucket the block's distinct anchors: gram, digest of its bytes (0: several), repeated."""
    s = segments(block.buffer, block.bounds)
    digest = contexts(block.buffer, s, np.arange(len(s.lo)))
    grams, starts, order = grouped(s.gram)
    one, many = np.zeros(len(grams), np.uint64), np.zeros(len(grams), bool)
    if len(grams):
        low, high = np.minimum.reduceat(digest[order], starts), np.maximum.reduceat(digest[order], starts)
        one = np.where(low == high, low, np.uint64(0))
        many = np.diff(np.append(starts, len(order))) > 1
    return message_table([(b, number, 0, j - i, grams[i:j].tobytes() + one[i:j].tobytes() + np.packbits(many[i:j]).tobytes()) for b, i, j in slices(grams, buckets)])


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, starts, order): ``keys[order]`` ascends, equal keys in the given order."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    starts = np.flatnonzero(first)
    return ordered[starts], starts, order


def judge_anchors(table: pa.Table) -> pa.Table:
    """Single, uniform or mixed for each entry of each message, in the order of the message."""
    sizes, blobs = table.column("n").to_pylist(), table.column("data").to_pylist()
    gram = np.concatenate([np.frombuffer(b, np.uint64, n) for n, b in zip(sizes, blobs)])
    one = np.concatenate([np.frombuffer(b, np.uint64, n, 8 * n) for n, b in zip(sizes, blobs)])
    many = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8, -1, 16 * n), count=n).astype(bool) for n, b in zip(sizes, blobs)])
    _, starts, order = grouped(gram)
    count = np.diff(np.append(starts, len(order)))
    repeated = (count > 1) | np.logical_or.reduceat(many[order], starts)
    low, high = np.minimum.reduceat(one[order], starts), np.maximum.reduceat(one[order], starts)
    state = np.where(~repeated, SINGLE, np.where((low == high) & (low != 0), UNIFORM, MIXED)).astype(np.uint8)
    each = np.empty(len(gram), np.uint8)
    each[order] = np.repeat(state, count)
    return answers(table, each, sizes, 0, lambda part: zlib.compress(part.tobytes(), 1))


def answers(table: pa.Table, each: np.ndarray, sizes: list[int], kind: int, packed_as) -> pa.Table:
    rows, at = [], 0
    for bucket, block, n in zip(table.column("bucket").to_pylist(), table.column("block").to_pylist(), sizes):
        rows.append((bucket, block, kind, n, packed_as(each[at : at + n])))
        at += n
    return message_table(rows)


@dataclass
class Units:
    """What a block sends: keys in order, each with its first occurrence and the rest marked.

    A unit is the strings that start from ``lo`` to ``hi``; ``marked`` are (lo, hi) runs of
    positions that repeat something before them in the block itself.
    """

    key: np.ndarray  # 64 bits
    more: np.ndarray  # 32 bits more; 0 for segments
    lo: np.ndarray
    hi: np.ndarray
    marked: list[tuple[np.ndarray, np.ndarray]]


def units(block: Block, states: pa.Table, number: int) -> Units:
    from xxhash import xxh3_128_digest as digest

    s = segments(block.buffer, block.bounds)
    _, starts, order = grouped(s.gram)
    parts = sorted((b, zlib.decompress(d)) for b, k, d in zip(states.column("bucket").to_pylist(), states.column("kind").to_pylist(), states.column("data").to_pylist()) if k == 0)
    state = np.frombuffer(b"".join(d for _, d in parts), np.uint8)
    of_segment = np.empty(len(s.lo), np.uint8)
    of_segment[order] = np.repeat(state, np.diff(np.append(starts, len(order))))

    uniform = np.flatnonzero(of_segment == UNIFORM)
    keys, starts, order = grouped(s.gram[uniform])
    first = uniform[order[starts]]
    rest = np.setdiff1d(uniform, first, assume_unique=True)
    marked = [(s.lo[rest], s.hi[rest])]

    mixed = np.flatnonzero(of_segment == MIXED)
    # Segments with the same bytes around an anchor: all but the first repeat it as they are.
    alike = s.gram[mixed] * np.uint64(3) ^ contexts(block.buffer, s, mixed)
    _, starts, order = grouped(alike)
    chosen = np.sort(mixed[order[starts]])
    rest = np.setdiff1d(mixed, chosen, assume_unique=True)
    marked.append((s.lo[rest], s.hi[rest]))
    size = s.hi[chosen] - s.lo[chosen] + 1
    at = np.repeat(s.lo[chosen] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    order, starts = sorted_classes(block.buffer, at, WIDTH)
    heads, others = at[order[starts]], at[order[~starts]]
    marked.append((others, others))
    buffer = block.buffer
    raw = np.frombuffer(b"".join([digest(buffer[p : p + WIDTH]) for p in heads.tolist()]), "<u8").reshape(-1, 2)
    key = np.concatenate((keys, raw[:, 0].astype(np.uint64)))
    more = np.concatenate((np.zeros(len(keys), np.uint32), (raw[:, 1] | np.uint64(1)).astype(np.uint32)))
    order = np.lexsort((more, key))
    lo, hi = np.concatenate((s.lo[first], heads)), np.concatenate((s.hi[first], heads))
    return Units(key[order], more[order], lo[order], hi[order], marked)


def unit_messages(block: Block, states: pa.Table, number: int, buckets: int) -> pa.Table:
    u = units(block, states, number)
    doc = np.searchsorted(block.bounds, u.lo, "right") - 1
    rows = []
    for b, i, j in slices(u.key, buckets):
        used, place = np.unique(doc[i:j], return_inverse=True)
        blob = u.key[i:j].tobytes() + u.more[i:j].tobytes() + place.astype("<u4").tobytes() + block.ids[used].astype("<i8").tobytes() + block.hashes[used].tobytes()
        rows.append((b, number, 1, j - i, zlib.compress(blob, 1)))
    return message_table(rows)


def judge_units(table: pa.Table) -> pa.Table:
    """For each entry of each message whether its document is the smallest that has the unit.

    Rows with one id and one text are in one block, so two blocks never tie.
    """
    sizes, blobs = table.column("n").to_pylist(), [zlib.decompress(b) for b in table.column("data").to_pylist()]
    key = np.concatenate([np.frombuffer(b, np.uint64, n) for n, b in zip(sizes, blobs)])
    more = np.concatenate([np.frombuffer(b, np.uint32, n, 8 * n) for n, b in zip(sizes, blobs)])
    ids, hashes = (np.concatenate([np.frombuffer(b, kind, -1, 16 * n).reshape(2, -1)[side][np.frombuffer(b, "<u4", n, 12 * n)] for n, b in zip(sizes, blobs)]) for side, kind in enumerate(("<i8", "<u8")))
    order = np.lexsort((hashes, ids, more, key))
    first = np.ones(len(order), bool)
    k, m = key[order], more[order]
    first[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
    each = np.empty(len(order), bool)
    each[order] = first
    return answers(table, each, sizes, 1, lambda part: np.packbits(part).tobytes())


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def cut(block: Block, told: pa.Table, number: int) -> pa.Table:
    """Each document's removed spans and remaining bytes."""
    u = units(block, told, number)
    parts = sorted((b, n, d) for b, k, n, d in zip(*(told.column(c).to_pylist() for c in ("bucket", "kind", "n", "data"))) if k == 1)
    bits = [np.unpackbits(np.frombuffer(d, np.uint8), count=n).astype(bool) for _, n, d in parts]
    later = ~np.concatenate(bits) if bits else np.zeros(0, bool)
    runs = [*u.marked, (u.lo[later], u.hi[later])]
    depth = np.zeros(len(block.buffer) + 1, np.int32)
    for lo, hi in runs:
        np.add.at(depth, lo, 1)
        np.add.at(depth, hi + WIDTH, -1)
    gone = np.cumsum(depth[:-1]) > 0
    data = np.frombuffer(block.buffer, np.uint8)
    spans, kept = [], []
    for a, b in zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist()):
        part = np.concatenate(([False], gone[a:b], [False]))
        edge = np.flatnonzero(part[1:] != part[:-1])
        spans.append([{"start": x, "end": y} for x, y in zip(edge[0::2].tolist(), edge[1::2].tolist())])
        kept.append(data[a:b][~gone[a:b]].tobytes() if len(edge) else block.buffer[a:b])
    return pa.table({"id": pa.array(block.ids, pa.int64(), mask=block.nulls), "n_bytes": np.diff(block.bounds), "spans": pa.array(spans, SPANS), "kept": pa.array(kept, pa.binary())})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Cut every byte string of WIDTH bytes that starts earlier out of all documents.

    Returns id, n_bytes, spans (removed runs, as byte offsets) and kept (the remaining bytes,
    which may split a character).

    * a null text is empty; texts shorter than WIDTH are never touched
    * rows that repeat an id count as different documents, ordered by a hash of their texts;
      null ids come after all others
    * an empty table gives an empty result; extra columns are ignored

    Plan: documents are dealt into blocks by a hash of id and text, and one exchange of the texts
    serves three steps. Blocks and buckets exchange messages in which a string occurs once per
    block, however often the block has it. Neither the positions of all texts nor the texts of
    a group are ever gathered.
    """
    base = packed(docs, id_col, text_col).select("id", F.col("text").cast("binary").alias("text"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(docs), -(-total // BUCKET_BYTES))
    blocks = max(partitions(docs), -(-total // block_bytes))
    dealt = base.select(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int").alias("block"), "id", "text").groupBy("block")

    def number(table: pa.Table) -> int:
        return table.column("block")[0].as_py()

    def ask_anchors(table: pa.Table) -> pa.Table:
        return anchor_messages(block_of(table), number(table), buckets)

    def ask_units(table: pa.Table, told: pa.Table) -> pa.Table:
        return unit_messages(block_of(table), told, number(table), buckets)

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        return cut(block_of(table), told, number(table))

    anchors = save_table(dealt.applyInArrow(ask_anchors, MESSAGE).groupBy("bucket").applyInArrow(judge_anchors, MESSAGE), "anchors")
    sent = dealt.cogroup(anchors.groupBy("block")).applyInArrow(ask_units, MESSAGE)
    told = sent.groupBy("bucket").applyInArrow(judge_units, MESSAGE)
    return dealt.cogroup(anchors.unionByName(told).groupBy("block")).applyInArrow(finish, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
