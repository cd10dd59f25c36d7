"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

A document is contaminated by an item if some passage of it is within an edit distance of the
item, counted in words. Windows of exactly the item's length slide over the document. The CGK
embedding walks along a window by random bits: at each step it writes the current word and, by
a random bit of step and word, goes on or stays. Two sequences that differ in few edits are
written with few differences, as the walks meet again after an edit. Samples of the written
positions are hash keys; windows and items that agree in any of the tables are candidates, and
a dynamic program decides.

Only windows that share enough runs of words with items of their length are embedded: by the
q-gram lemma no other window can be within the distance, so none that counts is lost.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from pathloom.llm.columns import packed

#: Edits allowed per word of an item.
EDIT_RATE = 0.2

#: Items with fewer words must be found unchanged.
SHORT_ITEM = 8

#: Items that one pass over the documents looks for; more items make more passes, one after the other in the same tasks.
ITEM_BLOCK = 5_000

#: Random strings of the embedding, and positions that a hash key samples.
WALKS, SAMPLED = 4, 2

#: Share of equal positions that a pair at the allowed distance is reckoned to have, and the recall that the number of tables aims at.
AGREEMENT, RECALL = 0.45, 0.995

#: Words of texts that a task scans at once, and words of windows, or cells of a comparison, that it holds.
CHUNK_WORDS, CHUNK_CELLS = 500_000, 1_000_000

_PUNCTUATION = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Words with A-Z lower-cased; ASCII characters that are no letters or digits separate."""
    return text.encode().lower().translate(_PUNCTUATION).split()


def allowed(n: int) -> int:
    """Edits that an item of ``n`` words may differ by."""
    return 0 if n < SHORT_ITEM else math.floor(EDIT_RATE * n + 1e-9)


def run_length(n: int) -> int:
    """Words in the runs that are counted: at most 3, and few enough that some must be shared."""
    return min(3, max(1, n // (allowed(n) + 1)))


def shared_runs(n: int) -> int:
    """Runs that a window within the allowed distance must share with an item of ``n`` words."""
    q = run_length(n)
    return n - q + 1 - allowed(n) * q


def coins(walk: int, step: int, words: np.ndarray) -> np.ndarray:
    """The random bit of a walk, a step and each word; all item lengths share them."""
    x = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((walk << 40 | step) * 0xD6E8FEB86659FD93 % (1 << 64))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(63)).astype(np.int64)


def tables() -> int:
    """Hash tables needed for the recall."""
    return math.ceil(math.log(1 - RECALL) / math.log(1 - AGREEMENT**SAMPLED))


@dataclass
class Group:
    """The items of one length, with their hash keys."""

    n: int
    number: np.ndarray  # of the items in the index
    words: np.ndarray  # items by words
    sampled: np.ndarray  # tables by sampled steps; table t uses walk t % WALKS
    reads: list[dict[int, list[int]]]  # by walk: the tables that sample each step
    keys: list[np.ndarray]  # sorted, by table
    order: list[np.ndarray]


class Index:
    """Items as word numbers, their runs, and an LSH index for each item length."""

    def __init__(self, items: list[tuple[int, str]], seed: int = 7):
        texts = [(i, words_of(t or "")) for i, t in items]
        texts = [(i, w) for i, w in texts if w]
        self.ids = [i for i, _ in texts]
        self.number: dict[bytes, int] = {}
        for _, words in texts:
            for w in words:
                self.number.setdefault(w, len(self.number) + 1)
        self.base = len(self.number) + 2  # 0: any other word; base - 1: past the end
        coded = [np.array([self.number[w] for w in words], np.int64) for _, words in texts]
        lengths = sorted({len(c) for c in coded})
        self.longest = max(lengths, default=0)
        rng = np.random.default_rng(seed)
        self.groups = [self._group(n, [(k, c) for k, c in enumerate(coded) if len(c) == n], rng) for n in lengths]
        # For each run length: the sorted codes, and which groups each belongs to.
        self.runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for q in {run_length(n) for n in lengths}:
            found: dict[int, set[int]] = {}
            for g, group in enumerate(self.groups):
                if run_length(group.n) == q:
                    for row in group.words:
                        for code in self.codes(row, q).tolist():
                            found.setdefault(code, set()).add(g)
            codes = np.array(sorted(found), np.int64)
            member = np.zeros((len(codes), len(self.groups)), bool)
            for row, code in enumerate(codes.tolist()):
                member[row, list(found[code])] = True
            self.runs[q] = codes, member

    def codes(self, words: np.ndarray, q: int) -> np.ndarray:
        """One number for each run of q words; -1 if it has a word that no item has."""
        n = len(words) - q + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        code, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(q):
            code = code * self.base + words[k : k + n]
            known &= words[k : k + n] > 0
        return np.where(known, code, -1)

    def _group(self, n, members, rng) -> Group:
        sampled = rng.integers(0, 2 * n, (tables(), SAMPLED))
        reads: list[dict[int, list[int]]] = [{} for _ in range(WALKS)]
        for t, chosen in enumerate(sampled.tolist()):
            for step in chosen:
                reads[t % WALKS].setdefault(step, []).append(t)
        group = Group(n, np.array([k for k, _ in members]), np.array([c for _, c in members]), sampled, reads, [], [])
        for keys in self.keys(group, group.words):
            order = np.argsort(keys, kind="stable")
            group.keys.append(keys[order])
            group.order.append(order)
        return group

    def keys(self, group: Group, windows: np.ndarray) -> list[np.ndarray]:
        """The hash key of each window in each table."""
        found: list = [np.zeros(len(windows), np.int64) for _ in group.sampled]
        rows = np.arange(len(windows))
        ended = np.column_stack((windows, np.full(len(windows), self.base - 1)))
        for walk in range(WALKS):
            reads = group.reads[walk]
            at = np.zeros(len(windows), np.int64)
            for step in range(max(reads, default=-1) + 1):
                word = ended[rows, at]
                for t in reads.get(step, ()):
                    found[t] = found[t] * self.base + word
                at = np.minimum(at + coins(walk, step, word), group.n)
        return found

    def candidates(self, group: Group, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item of the group) pairs that agree in some table."""
        found = []
        for t, keys in enumerate(self.keys(group, windows)):
            lo, hi = np.searchsorted(group.keys[t], keys, "left"), np.searchsorted(group.keys[t], keys, "right")
            n = hi - lo
            of = np.repeat(np.arange(len(keys)), n)
            k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            found.append(of * len(group.words) + group.order[t][k])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(group.words), pairs % len(group.words)

    def scan(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(item number, edits, position) of passages within the allowed distance.

        ``words`` holds texts one after another with at least 2 * longest zeros around each.
        """
        found = []
        for q, (codes, member) in self.runs.items():
            mine = self.codes(words, q)
            at = np.flatnonzero(mine >= 0)
            place = np.minimum(np.searchsorted(codes, mine[at]), len(codes) - 1)
            hit = codes[place] == mine[at]
            at, place = at[hit], place[hit]
            for g in np.flatnonzero(member[np.unique(place)].any(axis=0)).tolist():
                found += self._scan_group(self.groups[g], q, words, at[member[place, g]])
        return found

    def _scan_group(self, group: Group, q: int, words: np.ndarray, at: np.ndarray):
        e, need = allowed(group.n), shared_runs(group.n)
        span = group.n + e - q + 1
        if len(at) < need:
            return
        # A start p has enough runs if the need-th run from some run on begins before p + span.
        lo, hi = at[need - 1 :] - span + 1, at[: len(at) - need + 1]
        some = lo <= hi
        lo, hi = lo[some], hi[some]
        if not len(lo):
            return
        size = hi - lo + 1
        starts = np.unique(np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum()))
        step = max(1, CHUNK_CELLS // group.n)
        pairs = []
        for k in range(0, len(starts), step):
            part = starts[k : k + step]
            window, item = self.candidates(group, words[part[:, None] + np.arange(group.n)])
            pairs.append((part[window], item))
        p, i = (np.concatenate(x) for x in zip(*pairs))
        # Candidates of an item that overlap are compared as one stretch of text, up to twice the item's length.
        order = np.lexsort((p, i))
        p, i = p[order], i[order]
        low, high, item = [], [], []
        for a, q in zip(p.tolist(), i.tolist()):
            if item and item[-1] == q and a - low[-1] <= group.n:
                high[-1] = a
            else:
                low.append(a)
                high.append(a)
                item.append(q)
        low, high, item = np.array(low), np.array(high), np.array(item)
        for at in range(0, len(low), step):
            lo, hi, it = low[at : at + step], high[at : at + step], item[at : at + step]
            width = int((hi - lo).max()) + group.n + 2 * e
            place = lo[:, None] - e + np.arange(width)
            # Beyond the last candidate's reach, and beyond the texts, there are no words.
            inside = (place < (hi + group.n + e)[:, None]) & (place < len(words))
            text = np.where(inside, words[np.minimum(place, len(words) - 1)], 0)
            edits, end = passage_distance(group.words[it], text)
            good = np.flatnonzero(edits <= e)
            begin = passage_start(group.words[it[good]], text[good], end[good])
            for j, b in zip(good.tolist(), begin.tolist()):
                yield int(group.number[it[j]]), int(edits[j]), int(lo[j]) - e + b


def edit_columns(items: np.ndarray, texts: np.ndarray, anchored: bool):
    """After each word of the text in its row, the least edits from the item to what ends there.

    That is any passage or, if ``anchored``, the whole text so far.
    """
    n = items.shape[1]
    ramp = np.arange(n + 1, dtype=np.int64)
    column = np.broadcast_to(ramp, (len(items), n + 1)).copy()
    yield column[:, n]
    for j in range(texts.shape[1]):
        new = np.empty_like(column)
        new[:, 0] = j + 1 if anchored else 0
        new[:, 1:] = np.minimum(column[:, :-1] + (items != texts[:, j : j + 1]), column[:, 1:] + 1)
        column = np.minimum.accumulate(new - ramp, axis=1) + ramp
        yield column[:, n]


def passage_distance(items: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits from each item to any passage of the text in its row, and where the first such passage ends."""
    best, end = np.full(len(items), items.shape[1] + 1), np.zeros(len(items), np.int64)
    for j, edits in enumerate(edit_columns(items, texts, False)):
        better = edits < best
        best[better], end[better] = edits[better], j
    return best, end


def passage_start(items: np.ndarray, texts: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where the shortest of the nearest passages begins that ends at ``end``."""
    if not len(items):
        return end
    most = min(int(end.max()), 2 * items.shape[1] + 1)
    place = end[:, None] - 1 - np.arange(most)
    back = np.where(place >= 0, np.take_along_axis(texts, np.maximum(place, 0), axis=1), 0)
    best, size = np.full(len(items), items.shape[1] + most + 2), np.zeros(len(items), np.int64)
    for j, edits in enumerate(edit_columns(items[:, ::-1], back, True)):
        better = edits < best
        best[better], size[better] = edits[better], j
    return end - size


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Find benchmark items in documents.

    Returns ``row`` (the input row) and ``matches``, an array of (item_id, edits, start): for
    each item of which some passage of the document is within the allowed distance, the least
    edits and the first word of the passage that has them.

    The distance is counted in words: EDIT_RATE times the item's words, rounded down, and none for
    items of fewer than SHORT_ITEM words, of which an edit would leave too little to tell.

    * a null document or item text counts as empty; an item without words is never found
    * items that repeat are each found; a document is judged by its text alone
    * without items no document has matches; an empty table gives no rows

    Plan: one pass without a shuffle. Items are a stated query set against all rows: they are
    read in blocks of a bounded number, each of which makes its index and another step of the
    same tasks.
    """
    base = packed(docs, id_col, text_col)
    entry = StructType([StructField("item_id", LongType()), StructField("edits", IntegerType()), StructField("start", LongType())])
    schema = StructType([StructField("row", base.schema["row"].dataType), StructField("text", base.schema["text"].dataType), StructField("matches", ArrayType(entry))])
    found = base.select("row", "text", F.array().cast(ArrayType(entry)).alias("matches"))
    block: list[tuple[int, str]] = []
    listed = items.select(F.col(item_id_col).cast("long"), F.col(item_text_col).cast("string")).toLocalIterator()
    for row in listed:
        block.append((row[0], row[1]))
        if len(block) == ITEM_BLOCK:
            found, block = search(found, block, schema), []
    if block:
        found = search(found, block, schema)
    return found.select("row", "matches")


_latest: list = []


def index_of(items: list[tuple[int, str]]) -> Index:
    """The index of ``items``; a worker keeps the last one for its next tasks."""
    if not _latest or _latest[0] != items:
        _latest[:] = [items, Index(items)]
    return _latest[1]


def search(docs: DataFrame, items: list[tuple[int, str]], schema: StructType) -> DataFrame:
    """Add the matches of one block of items."""
    held = docs.sparkSession.sparkContext.broadcast(sorted(items, key=lambda i: (i[0] is None, i[0] or 0, i[1] or "")))

    def run(batches):
        index = index_of(held.value)
        pad = np.zeros(2 * index.longest + 2, np.int64)
        for batch in batches:
            out = [list(m) for m in batch.column(2).to_pylist()]
            parts, starts, size, first = [pad], [], len(pad), 0

            def flush():
                best: dict[tuple[int, int], tuple[int, int]] = {}
                for item, edits, at in index.scan(np.concatenate(parts)):
                    doc = int(np.searchsorted(bounds, at, "right")) - 1
                    key = (doc, item)
                    best[key] = min(best.get(key, (1 << 30, 0)), (edits, at - starts[doc]))
                for (doc, item), (edits, at) in sorted(best.items()):
                    out[first + doc].append({"item_id": index.ids[item], "edits": edits, "start": at})

            texts = batch.column(1)
            for k in range(len(texts)):
                words = words_of(texts[k].as_py())
                starts.append(size)
                parts += [np.fromiter(map(index.number.get, words, repeat(0)), np.int64, len(words)), pad]
                size += len(words) + len(pad)
                if size > CHUNK_WORDS or k + 1 == len(texts):
                    bounds = np.array(starts) - len(pad) // 2
                    flush()
                    parts, starts, size, first = [pad], [], len(pad), k + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array(out, batch.schema.field(2).type)], ["row", "text", "matches"])

    return docs.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """The documents, with their own columns, in which no item is found."""
    clean = matches(docs, items, **names).where(F.size("matches") == 0)
    return clean.select(*[F.col("row")[c].alias(c) for c in docs.columns])
