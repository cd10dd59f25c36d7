"""SimHash near-duplicate detection with a self-join of binary tries.

Two documents whose fingerprints differ in few bits are linked. The fingerprints of all
documents make a binary trie; the trie is joined with itself by walking pairs of nodes, adding up
the bits in which their prefixes differ, and leaving a pair as soon as the budget is exceeded.

:func:`simhash_groups` links 64-bit fingerprints within a budget of bits. :func:`similar_groups`
links documents whose shingle sets have a Jaccard similarity of a threshold or more; at 0.8 some
seventh of all bits differ, more than one trie join can afford, so it repeats the join over short
keys cut from a long fingerprint, takes pairs whose whole fingerprints are near enough as
candidates, and confirms each by its sets of shingles. Texts of few shingles, where SimHashes say
little, get their candidates from an exact prefix filter instead.
"""

from __future__ import annotations


import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.columns import packed, small
from pathloom.llm.components import connected_components
from pathloom.shared import save_table

#: Bits of a fingerprint.
BITS = 64

#: Fingerprints below a node of the trie at which the tries are cut into units of work.
NODE_SIZE = 16_384

#: Long fingerprints that a unit joins; where a bucket has more than twice as many, its parts are paired.
UNIT_ROWS = 262_144

#: Nodes of the cut trie at most; beyond NODE_SIZE times this, nodes grow instead.
MAX_NODES = 4_096

#: Leaf pairs of two nodes from which on they are compared outright.
BRUTE = 64

#: Node pairs that a task expands, leaf pairs that it compares, and pairs that it holds before it keeps a forest of them, at once.
CHUNK, LEAVES, HELD_PAIRS = 50_000, 250_000, 2_000_000


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 with seed 42 of every word shingle, repeats included.

    A-Z are lower-cased; words are runs of anything but ASCII white space. Fewer words than
    ``size`` make one shingle, none make an empty array.
    """
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [s - 1 for s in starts[size:]] + [len(joined)]
    return np.fromiter((xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts, ends)), np.uint64, len(ends))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes."""
    n, ones = len(hashes), np.zeros(BITS, np.int64)
    for at in range(0, n, 8192):
        part = hashes[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """(id, fp) of the packed ``docs``; fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            found = np.fromiter((fingerprint(shingle_hashes(t.as_py(), size)) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return docs.select("id", "text").mapInArrow(run, "id long, fp long")


# ---------------------------------------------------------------- the trie join


class Trie:
    """The binary trie over distinct ascending fingerprints.

    A node is the range of fingerprints that share a prefix; its children part at the number
    of ones that the next bit has in the range.
    """

    def __init__(self, values: np.ndarray):
        self.values = values
        self.ones: dict[int, np.ndarray] = {}

    def middle(self, depth: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Where the ones begin at ``depth`` in each node."""
        if depth not in self.ones:
            bit = (self.values >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            self.ones[depth] = np.concatenate((np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32)))
        ones = self.ones[depth]
        return hi - (ones[hi] - ones[lo])


def union_roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i] for all i; roots are the smallest members."""
    while len(a):
        ra, rb = roots(parent, a), roots(parent, b)
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def spanning(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join the sets like :func:`union_roots`; of the pairs, those that are enough for it."""
    used = [(a[:0], b[:0])]
    while len(a):
        ra, rb = roots(parent, a), roots(parent, b)
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        high, first = np.unique(np.maximum(ra, rb), return_index=True)
        parent[high] = np.minimum(ra, rb)[first]
        used.append((a[first], b[first]))
    return tuple(np.concatenate(x) for x in zip(*used))


def roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    r = parent[x]
    while True:
        up = parent[r]
        if np.array_equal(up, r):
            return r
        r = up


@dataclass
class Budget:
    """How many bits of a key may differ.

    Keys are the highest ``depth`` bits of a number. ``total`` bits may differ, of them
    ``upper`` in the upper half of the key.
    """

    depth: int
    total: int
    upper: int

    def halves(self) -> list["Budget"]:
        """Two budgets, for the keys as they are and with their halves exchanged.

        If at most ``total`` bits differ, at most half of them are in one half of the key, or
        less than half are in the other; a small budget at the top keeps the walk narrow.
        """
        return [Budget(self.depth, self.total, u) for u in (self.total // 2, (self.total + 1) // 2 - 1) if u >= 0]


def join_tries(left: np.ndarray, right: np.ndarray | None, budget: Budget, confirm=None, parent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (x, y) between ascending keys within the budget; indices count ``left``, then ``right``.

    ``right`` None joins ``left`` with itself. The two tries are walked together from pair to
    pair of nodes; a pair carries the bits by which its prefixes differ and is dropped when they
    exceed the budget. ``confirm(x, y)``, if given, decides on each pair of leaves, and ``parent``
    tells which belong together from the start (each its set's smallest member). Rather than
    every link, the result has the edges of a spanning forest: pairs of nodes whose leaves are
    linked already are dropped too, which is why the walk is made with growing budgets.
    """
    values = left if right is None else np.concatenate((left, right))
    n, shift = len(left), 0 if right is None else len(left)
    a, b = Trie(left), Trie(left if right is None else right)
    parent = np.arange(len(values)) if parent is None else parent.copy()
    for limit in [x for x in (1, 2) if x < budget.total] + [budget.total]:
        label = roots(parent, np.arange(len(values)))
        changes = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
        stack = [(0, *(np.array([x], np.int32) for x in (0, n, 0, len(b.values))), np.zeros(1, np.int8))]
        while stack:
            depth, alo, ahi, blo, bhi, err = stack.pop()
            # Drop pairs of nodes whose leaves all belong together already.
            one = (changes[ahi - 1] == changes[alo]) & (changes[bhi - 1 + shift] == changes[blo + shift]) & (label[alo] == label[blo + shift])
            done = ~one if depth >= budget.depth else ~one & ((ahi - alo).astype(np.int64) * (bhi - blo) <= BRUTE)
            if done.any():
                for x, y in leaf_pairs(values, shift, alo[done], ahi[done], blo[done], bhi[done], limit, budget):
                    if confirm is not None and len(x):
                        same = roots(parent, x) == roots(parent, y)
                        x, y = x[~same], y[~same]
                        good = confirm(x, y)
                        x, y = x[good], y[good]
                    union_roots(parent, x, y)
            go = ~one & ~done
            if not go.any():
                continue
            alo, ahi, blo, bhi, err = alo[go], ahi[go], blo[go], bhi[go], err[go]
            am, bm = a.middle(depth, alo, ahi), b.middle(depth, blo, bhi)
            self_pair = (alo == blo) & (ahi == bhi) if right is None else np.zeros(len(alo), bool)
            kids = [
                (alo, am, blo, bm, err),
                (am, ahi, bm, bhi, err),
                (alo, am, bm, bhi, err + 1),
                tuple(x[~self_pair] for x in (am, ahi, blo, bm, err + 1)),
            ]
            alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*kids))
            # Down to half the depth, all differing bits are in the upper half.
            most = min(limit, budget.upper) if depth < budget.depth // 2 else limit
            live = (alo < ahi) & (blo < bhi) & (err <= most)
            alo, ahi, blo, bhi, err = alo[live], ahi[live], blo[live], bhi[live], err[live]
            for at in range(0, len(alo), CHUNK):
                stack.append((depth + 1, *(x[at : at + CHUNK] for x in (alo, ahi, blo, bhi, err))))
    root = roots(parent, np.arange(len(values)))
    linked = np.flatnonzero(root != np.arange(len(values)))
    return linked, root[linked]


def leaf_pairs(values, shift, alo, ahi, blo, bhi, limit, budget):
    """Indices of leaves within the limit, for small node pairs, a bounded number at a time."""
    wide = (bhi - blo).astype(np.int64)
    count = (ahi - alo) * wide
    ends = np.cumsum(count)
    at = 0
    while at < len(count):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + LEAVES)))
        of = np.repeat(np.arange(at, to), count[at:to])
        k = np.arange(len(of)) - np.repeat(ends[at:to] - count[at:to] - base, count[at:to])
        x, y = alo[of] + k // wide[of], blo[of] + k % wide[of] + shift
        differ = values[x] ^ values[y]
        upper = np.bitwise_count(differ >> np.uint64(BITS - budget.depth // 2))
        near = (np.bitwise_count(differ) <= limit) & (upper <= budget.upper) & (x != y)
        yield x[near], y[near]
        at = to


# ---------------------------------------------------------------- distribution


def bit_order(table: DataFrame, depth: int) -> list[int]:
    """The ``depth`` most balanced bits (0 lowest), dealt over the two halves of a key.

    Any order keeps Hamming distances; this one makes the upper levels of the trie split well.
    """
    sums = table.agg(F.count("*").alias("n"), *[F.sum(F.getbit("fp", F.lit(i))).alias(f"b{i}") for i in range(BITS)]).first()
    n = sums["n"] or 1
    ranked = sorted(range(BITS), key=lambda i: (abs(2 * (sums[f"b{i}"] or 0) - n), i))[:depth]
    return ranked[0::2] + ranked[1::2]


def reordered(values: np.ndarray, order: list[int]) -> np.ndarray:
    """Fingerprints whose bits, from the highest on, are those of ``order``."""
    out = np.zeros(len(values), np.uint64)
    for to, bit in enumerate(order):
        out |= ((values >> np.uint64(bit)) & np.uint64(1)) << np.uint64(BITS - 1 - to)
    return out


def frontier(table: DataFrame, order: list[int], n: int, node_size: int) -> list[tuple[int, int]]:
    """Nodes (depth, prefix) that cut the trie into parts of at most about ``node_size`` leaves.

    Counts of prefixes come from a distributed aggregate, eight levels at a time and only
    below nodes that are still too large; the driver sees prefix counts, never fingerprints.
    """
    cap = max(node_size, n // MAX_NODES)
    done, open_nodes, depth = [], [(0, 0)], 0
    while open_nodes and depth < len(order):
        to = min(depth + 8, len(order))
        key = sum_bits(order[:to])
        parents = [p for _, p in open_nodes]
        rows = table.select(key.alias("p"))
        if depth:
            rows = rows.where(F.shiftrightunsigned("p", to - depth).isin(parents))
        counts = {r["p"]: r["n"] for r in rows.groupBy("p").agg(F.count("*").alias("n")).collect()}
        level = dict(counts)
        sums = {to: level}
        for d in range(to - 1, depth - 1, -1):
            up: dict[int, int] = {}
            for p, c in sums[d + 1].items():
                up[(p & (1 << BITS) - 1) >> 1] = up.get((p & (1 << BITS) - 1) >> 1, 0) + c
            sums[d] = up
        fresh, open_nodes = open_nodes, []
        while fresh:
            d, p = fresh.pop()
            c = sums[d].get(p, 0)
            if not c:
                continue
            if c <= cap:
                done.append((d, p))
            elif d == to:
                open_nodes.append((d, p))
            else:
                fresh += [(d + 1, 2 * p), (d + 1, 2 * p + 1)]
        depth = to
    return sorted(done + open_nodes)


def sum_bits(order: list[int]):
    """A column with the given bits of ``fp`` as one number, the first highest."""
    n = len(order)
    parts = [F.shiftleft(F.getbit("fp", F.lit(b)).cast("long"), n - 1 - i) for i, b in enumerate(order)]
    total = parts[0]
    for p in parts[1:]:
        total = total.bitwiseOR(p)
    return total


def node_pairs(nodes: list[tuple[int, int]], budget: Budget) -> list[tuple[int, int]]:
    """Pairs (i, j), i <= j, of nodes whose prefixes differ in few enough bits to hold a link."""
    depth, prefix = np.array([d for d, _ in nodes], np.int64), np.array([p & (1 << BITS) - 1 for _, p in nodes], np.uint64)
    found = []
    for i in range(len(nodes)):
        shared = np.minimum(depth[i], depth[i:])
        x = (prefix[i] >> (depth[i] - shared).astype(np.uint64)) ^ (prefix[i:] >> (depth[i:] - shared).astype(np.uint64))
        # Of a node below the upper half, only the upper bits fall under their own budget.
        upper = x >> np.maximum(shared - budget.depth // 2, 0).astype(np.uint64)
        near = (np.bitwise_count(upper) <= budget.upper) & (np.bitwise_count(x) <= budget.total)
        found += [(i, i + int(j)) for j in np.flatnonzero(near)]
    return found


def trie_links(table: DataFrame, n: int, depth: int, total: int, node_size: int = NODE_SIZE) -> DataFrame:
    """(a, b) edges between ``id`` that span every group linked within ``total`` bits of the key.

    ``table`` has ``n`` rows of ``id`` (long) and ``fp`` (long; its ``depth`` most balanced bits are
    the key).
    """
    order = bit_order(table, depth)
    half, links = depth // 2, None
    for k, budget in enumerate(Budget(depth, total, total).halves()):
        turn = order if k == 0 else order[half:] + order[:half]
        part = rotation_links(table, turn, n, budget, node_size)
        links = part if links is None else links.unionByName(part)
    return links.distinct()


def rotation_links(table: DataFrame, order: list[int], n: int, budget: Budget, node_size: int) -> DataFrame:
    nodes = frontier(table, order, n, node_size)
    pairs = node_pairs(nodes, budget)
    starts = np.array([(p & (1 << BITS) - 1) << (BITS - d) if d else 0 for d, p in nodes], np.uint64)
    by_start = np.argsort(starts, kind="stable")
    starts = starts[by_start]
    units_of: dict[int, list[tuple[int, int]]] = {}
    for unit, (i, j) in enumerate(pairs):
        units_of.setdefault(i, []).append((unit, 0))
        if i != j:
            units_of.setdefault(j, []).append((unit, 1))

    def deal(batches):
        """Each task sends the fingerprints of a node to the units that need them."""
        held = [b for b in batches if len(b)]
        if not held:
            return
        part = pa.Table.from_batches(held)
        ids = part.column("id").to_numpy()
        keys = reordered(part.column("fp").to_numpy().view(np.uint64), order)
        at = np.searchsorted(starts, keys, side="right") - 1
        by_node = np.argsort(at, kind="stable")
        edges = np.searchsorted(at[by_node], np.arange(len(starts) + 1))
        for k, node in enumerate(by_start):
            mine = by_node[edges[k] : edges[k + 1]]
            if len(mine):
                rows = units_of.get(int(node), [])
                blob = keys[mine].tobytes() + ids[mine].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([u for u, _ in rows], pa.int32()), pa.array([s for _, s in rows], pa.int32()), pa.array([len(mine)] * len(rows), pa.int32()), pa.array([blob] * len(rows), pa.binary())],
                    ["unit", "side", "n", "data"],
                )

    def match(unit: pa.Table) -> pa.Table:
        i, j = pairs[unit.column("unit")[0].as_py()]
        sides = [opened(unit, side) for side in ((0,) if i == j else (0, 1))]
        if any(s is None for s in sides):
            return pa.table({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        ids = np.concatenate([s[1] for s in sides])
        x, y = join_tries(sides[0][0], sides[1][0] if i != j else None, budget)
        return pa.table({"a": ids[x], "b": ids[y]})

    return table.select("id", "fp").mapInArrow(deal, "unit int, side int, n int, data binary").groupBy("unit").applyInArrow(match, "a long, b long")


def opened(unit: pa.Table, side: int):
    """(keys, ids) of one side of a unit, by ascending keys."""
    found = []
    for s, n, blob in zip(*(unit.column(c).to_pylist() for c in ("side", "n", "data"))):
        if s == side:
            found.append((np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, np.int64, n, 8 * n)))
    if not found:
        return None
    keys, ids = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(keys, kind="stable")
    return keys[order], ids[order]


# ---------------------------------------------------------------- long fingerprints


def joined(sigs: pa.ChunkedArray) -> np.ndarray:
    """Equally long binary values as rows of 64-bit words."""
    blobs = sigs.to_pylist()
    return np.frombuffer(b"".join(blobs), np.uint64).reshape(len(blobs), -1)


def buckets_of(sigs: np.ndarray, exact: int) -> np.ndarray:
    """For each fingerprint and word the bucket: the word's number, and ``exact`` bits of its lower half."""
    low = (sigs & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - exact)
    return (np.arange(sigs.shape[1], dtype=np.int64) << exact) + low.astype(np.int64)


def unit_pairs(sides: list[np.ndarray], sure: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the pairs of a unit. Rows are a node, the words to compare, and the word with the key.

    It takes pairs within ``sure`` bits as they come, and of the others the nearest first: of a
    group around one text, the links to that text rather than those between its copies.
    """
    rows, n_left = np.concatenate(sides), len(sides[0])
    nodes, sigs = rows[:, 0].view(np.int64), rows[:, 1:-1]
    upper, sets = rows[:, -1] >> np.uint64(32), np.arange(len(rows))
    found, none = [(nodes[:0], nodes[:0])], np.zeros(0, np.int64)
    for k, budget in enumerate(Budget(32, KEY_BUDGET, KEY_BUDGET).halves() if len(nodes) else []):
        turned = upper if k == 0 else (upper << np.uint64(16) | upper >> np.uint64(16)) & np.uint64(0xFFFFFFFF)
        keys = turned << np.uint64(32)
        order = np.concatenate((np.argsort(keys[:n_left], kind="stable"), n_left + np.argsort(keys[n_left:], kind="stable")))
        right = keys[order[n_left:]] if len(sides) > 1 else None
        for limit in (sure, most):
            _, first, place = np.unique(sets[order], return_index=True, return_inverse=True)
            held = [none, none]

            def confirm(x, y):
                x, y = order[x], order[y]
                near = np.bitwise_count(sigs[x] ^ sigs[y]).sum(axis=1, dtype=np.int64) <= limit
                if limit == sure:
                    x, y = spanning(sets, x[near], y[near])
                    found.append((nodes[x], nodes[y]))
                    return near
                held[0], held[1] = np.append(held[0], x[near]), np.append(held[1], y[near])
                if len(held[0]) > HELD_PAIRS:
                    held[:] = nearest_first(sets.copy(), *held, sigs)
                return np.zeros(len(near), bool)

            join_tries(keys[order[:n_left]], right, budget, confirm, first[place])
            if len(held[0]):
                x, y = nearest_first(sets, *held, sigs)
                found.append((nodes[x], nodes[y]))
            sets = roots(sets, np.arange(len(sets)))
    return tuple(np.concatenate(x) for x in zip(*found))


def nearest_first(sets: np.ndarray, x: np.ndarray, y: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join the sets like :func:`spanning`, by pairs in order of their distance."""
    bits = np.concatenate([np.bitwise_count(sigs[x[at : at + LEAVES]] ^ sigs[y[at : at + LEAVES]]).sum(axis=1, dtype=np.int64) for at in range(0, len(x), LEAVES)])
    order = np.argsort(bits, kind="stable")
    return spanning(sets, x[order], y[order])


def part_of(nodes: np.ndarray, parts: int) -> np.ndarray:
    return (nodes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts


def key_links(table: DataFrame, words: int, exact: int, sure: int, most: int) -> DataFrame:
    """(a, b), a < b: pairs of ``node`` whose ``sig`` differ in at most ``most`` bits.

    A pair is found where one of the words of their fingerprints agrees in ``exact`` bits of the
    lower half and within KEY_BUDGET in the upper half, which is the key of the trie join. The
    pairs of a unit are a spanning forest of those, in which near ones come first; what is within
    ``sure`` bits needs no order.

    Units are the buckets; one of over twice UNIT_ROWS is dealt into parts, and pairs of parts are
    units of their own.
    """

    def sizes(batches):
        for batch in batches:
            if len(batch):
                found, n = np.unique(buckets_of(joined(batch.column(0)), exact), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["bucket", "n"])

    counts = table.select("sig").mapInArrow(sizes, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    split = {r["bucket"]: -(-r["n"] // UNIT_ROWS) for r in counts.where(F.col("n") > 2 * UNIT_ROWS).collect()}

    def deal(batches):
        held = [b for b in batches if len(b)]
        if not held:
            return
        part = pa.Table.from_batches(held)
        sigs = joined(part.column("sig"))
        rows = np.concatenate((part.column("node").to_numpy().view(np.uint64)[:, None], sigs[:, :COMPARED], sigs[:, :1]), axis=1)
        buckets = buckets_of(sigs, exact)
        out = []
        for word in range(sigs.shape[1]):
            rows[:, -1] = sigs[:, word]
            order = np.argsort(buckets[:, word], kind="stable")
            first = np.flatnonzero(np.diff(buckets[order, word], prepend=-1))
            for mine in np.split(order, first[1:]):
                bucket = int(buckets[mine[0], word])
                parts = split.get(bucket, 1)
                own = part_of(rows[mine, 0], parts)
                for k in range(parts):
                    data = rows[mine[own == k]].tobytes() if parts > 1 else rows[mine].tobytes()
                    if data:
                        out += [(bucket, min(k, j), max(k, j), int(k > j), data) for j in range(parts)]
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["bucket", "i", "j", "side", "data"])
                out = []

    def match(unit: pa.Table) -> pa.Table:
        i, j = (unit.column(c)[0].as_py() for c in ("i", "j"))
        blobs = list(zip(unit.column("side").to_pylist(), unit.column("data").to_pylist()))
        sides = [np.frombuffer(b"".join(d for k, d in blobs if k == side), np.uint64).reshape(-1, min(words, COMPARED) + 2) for side in range(1 + (i != j))]
        a, b = unit_pairs(sides, sure, most)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    dealt = table.select("node", "sig").mapInArrow(deal, "bucket long, i int, j int, side int, data binary")
    return dealt.groupBy("bucket", "i", "j").applyInArrow(match, "a long, b long").distinct()


# ---------------------------------------------------------------- operators


def simhash_groups(docs: DataFrame, size: int = 4, budget: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint and near-duplicate component.

    Returns id, fp (signed long) and component_id, the smallest id that can be reached through
    links of at most ``budget`` differing bits, its own included.

    * a null text counts as empty; documents without words have fingerprint zero and link alike
    * a null id can be a member of a component but names one only if it has no other member
    * rows that repeat stay rows; an empty table gives an empty result; extra columns are ignored

    Plan: one pass over the texts; equal fingerprints meet in a partial aggregate, so only
    distinct ones enter the trie join, whose work is dealt by pairs of trie nodes that are
    split until they are small; links are spanning forests, components come from alternating
    star contraction, and the labels join the documents' fingerprints (adaptive execution
    splits a fingerprint that many documents share).
    """
    prints = save_table(fingerprints(packed(docs, id_col, text_col), size), "fingerprints")
    table = save_table(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    n = table.count()
    links = save_table(trie_links(table.select(F.col("fp").alias("id"), "fp", F.lit(b"").alias("sig")), n, BITS, budget), "simhash-links")
    groups = connected_components(links).select(F.col("node").alias("fp"), "component")
    linked = table.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    # A table of its own, so that the join shuffles both sides and a large component can be split.
    linked = save_table(linked, "linked-fingerprints")
    least = save_table(linked.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    labels = save_table(linked.join(least, "component").select("fp", "component_id"), "fingerprint-labels")
    return prints.join(labels, "fp").select("id", "fp", "component_id")


#: Words of two long fingerprints that are compared; further ones only serve as keys.
COMPARED = 12

#: How many bits of a key, 32 bits of a long fingerprint, may differ, and the recall at the threshold that sets the number of keys.
KEY_BUDGET, KEY_RECALL = 4, 0.999

#: Standard deviations of the estimated distance by which the whole fingerprint of a candidate may exceed the threshold's.
SLACK = 4.0

#: Distinct shingles up to which candidates come from the prefix filter, not from SimHashes.
FEW = 64

#: Texts of a cluster that a task compares with each other; where there are over twice as many, its parts are paired.
CLUSTER_ROWS = 10_000

#: Rows of the prefix filter that are compared together.
PREFIX_ROWS = 20_000


def differing(similarity: float) -> float:
    """The share of bits in which SimHashes of sets with a Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def keys_needed(n: int, similarity: float) -> tuple[int, int]:
    """(bits that agree, number of words) for ``n`` fingerprints.

    A bit more that has to agree for every doubling beyond UNIT_ROWS holds the buckets' size; more
    bits need more words for the same recall.
    """
    exact = max(0, math.ceil(math.log2(max(n, 1) / UNIT_ROWS)))
    p = differing(similarity)
    hit = (1 - p) ** exact * sum(math.comb(32, k) * p**k * (1 - p) ** (32 - k) for k in range(KEY_BUDGET + 1))
    return min(exact, 32), math.ceil(math.log(1 - KEY_RECALL) / math.log(1 - hit))


def shingle_set(text: str, size: int) -> tuple[np.ndarray, bytes]:
    """The distinct shingle hashes, ascending, and a digest of them."""
    found = np.unique(shingle_hashes(text, size))
    return found, hashlib.sha256(found.astype("<u8").tobytes()).digest()[:16]


def long_fingerprints(docs: DataFrame, size: int, words: int, few: int) -> DataFrame:
    """(id, digest, n, sig, few) of the packed ``docs``, over distinct shingles.

    ``sig``, the SimHash of ``words`` times 64 bits, is there from FEW + 1 shingles on and ``few``,
    the shingles' hashes, up to ``few`` shingles. The first word of a SimHash uses the hashes,
    each further one a remix of them.
    """
    kinds = [("id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("sig", pa.binary()), ("few", pa.binary())]

    def run(batches):
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                found, digest = shingle_set(t.as_py(), size)
                n = len(found)
                rows.append((i, digest, n, long_fingerprint(found, words) if n > FEW else None, found.astype("<u8").tobytes() if n <= few else None))
            cols = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds)], [k for k, _ in kinds])

    return docs.select("id", "text").mapInArrow(run, "id long, digest binary, n long, sig binary, few binary")


def long_fingerprint(hashes: np.ndarray, words: int) -> bytes:
    out = []
    for w in range(words):
        x = hashes + np.uint64(w * 0x9E3779B97F4A7C15 % (1 << 64))
        if w:
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
        out.append(fingerprint(x))
    return np.array(out, "<u8").tobytes()


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sets, not both empty, is ``similarity`` or more."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) >= similarity


def compared(links: DataFrame, table: DataFrame, base: DataFrame, size: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``links`` (a, b) with ``good``, whether their shingle sets are similar enough, and those sets (node, hashes).

    ``table`` (node, least, digest) tells the nodes' texts in ``base``: one of id ``least`` whose
    set has the digest. Only the texts of linked nodes are read again.
    """

    def sets(batches):
        for batch in batches:
            nodes, found = [], []
            for node, digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                hashes, own = shingle_set(text.as_py(), size)
                if own == digest:
                    nodes.append(node)
                    found.append(hashes.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.binary())], ["node", "hashes"])

    def compare(batches):
        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            good = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) for x, y in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], ["a", "b", "good"])

    wanted = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(table.select("node", "least", "digest"), "node")
    wanted = save_table(wanted, "linked-nodes", free=False)
    # Behind its count the list of ids is broadcast, and texts stay where they are.
    texts = small(wanted, wanted.count()).join(base.select("id", "text"), F.col("id") == F.col("least")).select("node", "digest", "text")
    known = save_table(texts.mapInArrow(sets, "node long, hashes binary").dropDuplicates(["node"]), "shingle-sets")
    both = links.join(known.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(known.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    return save_table(both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, good boolean"), "compared-links"), known


def cluster_links(tree: DataFrame, known: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between sets that ``known`` links leave apart, which join all similar ones.

    Every candidate pair is in one component of the candidates' forest ``tree``, a cluster. Where
    a cluster has nodes of several components of ``sets`` (node, component), its nodes' shingle sets
    (``known``) meet in a task, which counts what they have in common with each other and hands
    on links alone. A cluster of over twice CLUSTER_ROWS nodes is dealt into parts, and pairs of
    parts meet.
    """
    clusters = save_table(connected_components(tree).select("node", F.col("component").alias("cluster")), "clusters")
    marked = clusters.join(sets, "node", "left").select("node", "cluster", F.coalesce("component", "node").alias("comp"))
    marked = save_table(marked, "clusters")
    several = save_table(marked.groupBy("cluster").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).where("low < high"), "open-clusters")
    open_ = marked.join(several.select("cluster", F.greatest(F.lit(1), F.ceil(F.col("n") / CLUSTER_ROWS) * (F.col("n") > 2 * CLUSTER_ROWS).cast("int")).cast("int").alias("parts")), "cluster")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = open_.join(known, "node").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "node", "comp", "hashes")

    def match(unit: pa.Table) -> pa.Table:
        two = unit.column("i")[0].as_py() != unit.column("j")[0].as_py()
        second = unit.column("second").to_numpy() if two else np.zeros(len(unit), bool)
        a, b = alike([np.frombuffer(h, np.uint64) for h in unit.column("hashes").to_pylist()], unit.column("comp").to_numpy(), second, two, similarity)
        nodes = unit.column("node").to_numpy()
        return pa.table({"a": nodes[a], "b": nodes[b]})

    return dealt.groupBy("cluster", "i", "j").applyInArrow(match, "a long, b long")


def alike(sets: list[np.ndarray], comp: np.ndarray, second: np.ndarray, two: bool, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of similar sets that join all components of similar sets, given those of ``comp``.

    With ``two``, sets that are ``second`` are compared with the others, else all with each other.
    """
    size = np.array([len(x) for x in sets], np.int64)
    # For each shingle the sets that have it.
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    holder = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(shingle, kind="stable")
    holders, begin = holder[order], np.searchsorted(shingle[order], np.arange(shingle.max(initial=-1) + 2))
    label, a, b = np.unique(comp, return_inverse=True)[1], [], []
    ends = np.cumsum(size)
    for x in np.flatnonzero(~second).tolist():
        mine = shingle[ends[x] - size[x] : ends[x]]
        length = begin[mine + 1] - begin[mine]
        at = np.repeat(begin[mine] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        common = np.bincount(holders[at], minlength=len(sets))
        near = (common >= similarity * (size + size[x] - common)) & (label != label[x])
        near &= second if two else np.arange(len(sets)) > x
        for y in np.flatnonzero(near).tolist():
            if label[y] != label[x]:
                a.append(x)
                b.append(y)
                label[label == label[y]] = label[x]
    return np.array(a, np.int64), np.array(b, np.int64)


def few_links(table: DataFrame, similarity: float) -> DataFrame:
    """(a, b) edges that span all groups of similar sets among ``table`` (node, n, few).

    Two sets of that similarity share one of the first n - ceil(similarity * n) + 1 members of
    each, in any order of the members; rare ones come first. Sets that share such a member meet,
    and are compared outright unless they are linked already.
    """
    spell = F.expr("transform(sequence(0, cast(n as int) - 1), i -> substring(few, 8 * i + 1, 8))")
    each = table.select("node", "n", F.explode(spell).alias("shingle"))
    often = save_table(each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"), "shared-shingles")
    ranked = each.join(often, "shingle").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("shared"))
    # Members that no other set has are the rarest and fill the first places.
    places = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1 - (F.col("n") - F.size("shared"))
    first = ranked.where(places > 0).select("node", F.explode(F.slice("shared", F.lit(1), places.cast("int"))["shingle"]).alias("shingle"))
    first = save_table(first, "prefixes")
    meet = first.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1").select("shingle")
    rows = save_table(first.join(meet, "shingle"), "meeting-prefixes")
    blocks = max(1, -(-rows.count() // PREFIX_ROWS))
    block = F.pmod(F.xxhash64("shingle"), F.lit(blocks)).alias("block")

    def match(part: pa.Table) -> pa.Table:
        nodes, place = np.unique(part.column("node").to_numpy(), return_inverse=True)
        sets = [b""] * len(nodes)
        for i, blob in zip(place.tolist(), part.column("few").to_pylist()):
            sets[i] = blob
        sets = [np.frombuffer(b, np.uint64) for b in sets]
        _, key = np.unique(np.frombuffer(b"".join(part.column("shingle").to_pylist()), np.uint64), return_inverse=True)
        order = np.argsort(key, kind="stable")
        parent, a, b = np.arange(len(nodes)), [], []
        for members in np.split(place[order], np.flatnonzero(np.diff(key[order])) + 1):
            left = np.unique(members)
            while len(left) > 1:
                # Walk the group of one member; what it reaches is compared no more.
                queue, left = [int(left[0])], left[1:]
                while queue and len(left):
                    x = queue.pop()
                    near = roots(parent, left) == roots(parent, np.array([x]))
                    fresh = left[~near]
                    lengths = np.array([len(sets[y]) for y in fresh], np.int64)
                    if len(fresh):
                        hit = np.isin(np.concatenate([sets[y] for y in fresh]), sets[x])
                        common = np.bincount(np.repeat(np.arange(len(fresh)), lengths)[hit], minlength=len(fresh))
                        good = common / (lengths + len(sets[x]) - common) >= similarity
                        a += [nodes[x]] * int(good.sum())
                        b += nodes[fresh[good]].tolist()
                        union_roots(parent, np.full(int(good.sum()), x), fresh[good])
                        near[np.flatnonzero(~near)[good]] = True
                    queue += left[near].tolist()
                    left = left[~near]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    sent = rows.join(table.select("node", "few"), "node").select(block, "shingle", "node", "few")
    return sent.groupBy("block").applyInArrow(match, "a long, b long").distinct()


def similar_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) of every document that shares its component with another id.

    Documents are linked if the Jaccard similarity of their sets of distinct ``size``-word
    shingles is ``similarity`` or more; component_id is the smallest id reachable.

    * a null text counts as empty; documents without words are linked with each other
    * rows with one id are one document here; null ids take no part
    * an empty table gives an empty result; extra columns are ignored

    Accuracy: every link is confirmed by the shingles' 64-bit hashes, so none is below the
    threshold. Where one set has at most FEW members no link is lost. Between larger ones, some
    key brings a pair at the threshold together with a chance of KEY_RECALL, a closer pair with a
    greater one, and the whole fingerprint may exceed the threshold's distance by SLACK deviations.

    The pairs of texts of many shingles come in two turns. The first takes a spanning forest of the
    candidates of each unit, by their nearest pairs, so a group of copies costs a link for each, not
    for each pair. The second compares all texts of a connected cluster of candidates that the
    links confirmed so far leave apart, in a task that has their shingle sets.
    """
    base = packed(docs, id_col, text_col).where("id is not null")
    exact, words = keys_needed(base.count(), similarity)
    few = math.floor(FEW / similarity + 1e-9)
    prints = save_table(long_fingerprints(base, size, words, few), "long-fingerprints")
    # Equal sets are one node.
    table = prints.groupBy("digest").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("few").alias("few"))
    table = save_table(table.withColumn("node", F.monotonically_increasing_id()), "distinct-shingle-sets")
    long = table.where("sig is not null").select("node", "sig")
    p = differing(similarity)
    bits = BITS * min(words, COMPARED)
    sure, most = (math.floor(bits * p + d * math.sqrt(bits * p * (1 - p))) for d in (-SLACK, SLACK))
    tree = save_table(key_links(long, words, exact, sure, most), "candidates")
    checked, known = compared(tree, table, base, size, similarity)
    few_known = few_links(table.where(F.col("n").between(1, few)).select("node", "n", "few"), similarity)
    links = save_table(checked.where("good").select("a", "b").unionByName(few_known), "similar-links")
    links = links.unionByName(save_table(cluster_links(tree, known, connected_components(links), similarity), "similar-links"))
    least = table.select("node", "least")
    named = links.join(least.toDF("a", "x"), "a").join(least.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = prints.join(table.select("digest", "least"), "digest").where("id != least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    groups = connected_components(save_table(named.unionByName(same).where("a != b").distinct(), "all-similar-links"))
    return groups.select(F.col("node").alias("id"), F.col("component").alias("component_id"))
