import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathloom.llm import class_ngrams as c
from pathloom.llm.columns import packed


def test_base_scores_against_brute_force(edge, edge_rows, none):
    found = c.score_documents(edge).collect()
    words = lambda t: (t or "").encode().lower().split()
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    counts = Counter()
    for i, text, *_ in edge_rows:
        if not out(i):
            counts.update(words(text))
            counts[b""] += 1
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, text, *_ in edge_rows:
        w = words(text) + [b""]
        want.append((str(i), out(i), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    got = sorted(((str(r["id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in found))
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)
    assert all(r["score"] < 0 for r in found)
    assert c.score_documents(none).count() == 0


def test_model_scores_and_beats_the_unigram(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = c.score_documents(docs).where("held_out")
    base, model = found.agg(F.sum("base_score"), F.sum("score")).first()
    assert model > base
    assert 10 ** ((base - model) / found.agg(F.sum("n_tokens")).first()[0]) < 0.75  # of the unigram's perplexity
    # The score of one document, step by step.
    base_docs = packed(docs)
    m, vocabulary = c.fit(base_docs.where(F.crc32(F.col("id").cast("string").cast("binary")) % 10 != 0).select("text"))
    one = docs.where("length(text) < 300").orderBy("doc_id").first()
    words = one["text"].encode().lower().split() + [c.END]
    known = {bytes(r["word"]): (r["n"], r["class"]) for r in vocabulary.where(F.col("word").isin(words)).collect()}
    before, total = c.CLASSES - 1, 0.0
    for w in words:
        k, cls = known.get(w, (0, m.shape_class[c.shape_of(w)]))
        p = c.MIX * m.transition[before, cls] * (k + 0.1) / (m.class_total[cls] + 0.1 * (m.class_words[cls] + 1)) + (1 - c.MIX) * float(m.unigram(np.array(k)))
        total += math.log10(p)
        before = cls
    got = c.score_documents(docs).where(F.col("id") == one["doc_id"]).first()["score"]
    assert math.isclose(got, total, rel_tol=1e-9)


def test_neighbours(spark):
    docs = spark.createDataFrame([("a b a",), ("",), ("a zz",)], "text string")
    hashes = np.sort(np.array([xxhash.xxh64_intdigest(w, 42) for w in (b"a", b"b")], np.uint64))
    edges = c.neighbours(docs, spark.sparkContext.broadcast(hashes), 8)
    items = c.Items(hashes)
    x, y, zz, end = (*map(int, items.of([b"a", b"b", b"zz"])), items.end)
    want = {(end, x): 2, (x, y): 1, (y, x): 1, (x, end): 1, (end, end): 1, (x, zz): 1, (zz, end): 1}
    rows = edges.collect()
    sides = [{(int(e), int(o)): int(n) for r in rows for e, o, n in c.opened_edges(r[side]).T} for side in ("right", "left")]
    assert sides[0] == want and sides[1] == {(q, p): n for (p, q), n in want.items()}
    assert all((c.mixed(c.opened_edges(r["right"])[0]) % c.PARTS == r["part"]).all() for r in rows)
    table = c.class_table(edges, np.arange(end + 1), end + 1)
    assert {tuple(map(int, at)): int(table[tuple(at)]) for at in np.argwhere(table)} == want


@given(st.lists(st.text(alphabet="aZ é\t\n\x0b\x0c\r\x1c\u00a0\u2003") | st.text(), max_size=8))
def test_words(texts):
    words, counts = c.words_of(pa.array(texts, pa.string()))
    want = [t.encode().lower().split() for t in texts]
    assert [w.encode() for w in words.to_pylist()] == [w for x in want for w in x] and counts.tolist() == [len(x) for x in want]
    # A part of an array, and an array in parts.
    words, counts = c.words_of(pa.array(texts, pa.string())[1:])
    assert [w.encode() for w in words.to_pylist()] == [w for x in want[1:] for w in x] and counts.tolist() == [len(x) for x in want[1:]]
    words, counts = c.words_of(pa.chunked_array([pa.array(texts, pa.string())[:2], pa.array(texts, pa.string())[2:]]))
    assert [w.encode() for w in words.to_pylist()] == [w for x in want for w in x] and counts.tolist() == [len(x) for x in want]


def likelihood(bigrams, owner, classes):
    m = np.eye(classes)[owner]
    t = m.T @ bigrams @ m
    return c.xlogx(t).sum() - c.xlogx(t.sum(axis=1)).sum() - c.xlogx(t.sum(axis=0)).sum()


def test_exchange_ends_where_no_move_helps():
    rng, n = np.random.default_rng(3), 13
    b = np.zeros((n, n), np.int64)
    for _ in range(6000):  # words of one third are followed by words of the next
        x = rng.integers(0, 12)
        b[x, (x // 4 + 1) % 3 * 4 + min(rng.integers(0, 4, 2))] += 1
    b[12, 0] = b[5, 12] = 50
    owner = c.exchange(b, classes=4)
    reached = likelihood(b, owner, 4)
    assert owner[12] == 3 and 3 not in owner[:12]
    assert reached >= likelihood(b, np.array([i % 3 for i in range(12)] + [3]), 4)
    for i in range(12):
        for k in range(3):
            moved = owner.copy()
            moved[i] = k
            assert likelihood(b, moved, 4) <= reached + 1e-6


def test_words_beyond_the_most_frequent_move_on_their_own(spark):
    """1,200 words with one ending, of two kinds of context."""
    text = lambda i: " ".join(f"left {'a' if k % 2 else 'b'}{k}zzz {'one' if k % 2 else 'two'}" for k in range(i, 1200, 4))
    docs = packed(spark.createDataFrame([(i, text(i % 4)) for i in range(48)], "doc_id long, text string"))
    _, vocabulary = c.fit(docs.select("text"))
    of = {bytes(r["word"]).decode(): r["class"] for r in vocabulary.collect()}
    kinds = [{k for w, k in of.items() if w.startswith(x) and w.endswith("zzz")} for x in "ab"]
    assert len(of) == 1204 and not kinds[0] & kinds[1]


@pytest.mark.parametrize("high", [9, 4000])
def test_best_classes_are_those_of_all_moves(monkeypatch, high):
    monkeypatch.setattr(c, "HELD_GAINS", 5000)
    rng, classes = np.random.default_rng(2), c.CLASSES + 2
    b = np.int64(high ** rng.random((120, 120))) * (rng.random((120, 120)) < 0.6)
    b[60:] *= 40  # cells are large beside the counts of most items
    owner = rng.integers(0, classes, 120)
    m = np.eye(classes)[owner]
    table = m.T @ b @ m
    alone = b - np.diag(b.diagonal())
    found, gain = c.best_classes(table, owner, (alone @ m), (alone.T @ m), b.diagonal().astype(float))
    for i in range(60):
        value = []
        for k in range(classes):
            moved = owner.copy()
            moved[i] = k
            value.append(-np.inf if k == c.CLASSES - 1 else likelihood(b, moved, classes))
        assert math.isclose(value[found[i]], max(value), abs_tol=2e-5)
        assert owner[i] == c.CLASSES - 1 or math.isclose(gain[i], value[found[i]] - value[owner[i]], rel_tol=1e-5, abs_tol=1e-4)


def test_neighbours_hold_little(monkeypatch):
    # What a worker holds while it counts neighbours decides whether two of them fit beside an executor.
    steps, rnd = [], random.Random(4)

    class Frame:
        def select(self, *_):
            return self

        groupBy = select

        def mapInArrow(self, step, _):
            steps.append(step)
            return self

        applyInArrow = mapInArrow

    class Held:
        value = np.sort(np.array([xxhash.xxh64_intdigest(b"w%d" % i, 42) for i in range(300)], np.uint64))

    monkeypatch.setattr(c, "save_table", lambda df, _: df)
    monkeypatch.setattr(c, "partitions", lambda _: 3)
    texts = [" ".join(f"w{min(int(rnd.expovariate(0.01)), 400)}" for _ in range(1000)) for _ in range(400)]
    batches = [pa.record_batch([pa.array(texts[i : i + 100])], ["text"]) for i in range(0, 400, 100)] + [pa.record_batch([pa.array([], pa.string())], ["text"])]
    c.neighbours(Frame(), Held(), 400_000)
    tracemalloc.start()
    found = list(steps[0](batches))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * 400_400
    items, want = c.Items(Held.value), Counter()
    for text in texts:
        ids = [items.end, *items.of([w.encode() for w in text.split()]).tolist(), items.end]
        want.update(zip(ids, ids[1:]))
    for side in (0, 1):
        got = Counter()
        for batch in found:
            for r in batch.to_pylist():
                if r["side"] == side:
                    for item, other, n in c.opened_edges(r["edges"]).T.tolist():
                        assert item % 3 == r["block"]
                        got[(item, other) if side == 0 else (other, item)] += n
        assert got == want


def test_words_are_hashed_all_at_once(monkeypatch):
    """A call for each word took a third of the time of counting neighbours."""
    rnd = random.Random(5)
    words = [rnd.randbytes(n) for n in [*range(1, 70), *range(1, 40)]]
    want = [xxhash.xxh64_intdigest(w, 42) for w in words]
    hashes = np.sort(np.array(want[::2], np.uint64))
    called = []
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda w, seed, of=xxhash.xxh64_intdigest: called.append(len(w)) or of(w, seed))
    items = c.Items(hashes).of(words)
    assert all(n >= 32 for n in called)
    assert items[::2].tolist() == np.searchsorted(hashes, np.array(want[::2], np.uint64)).tolist()
    assert items[1::2].tolist() == [len(hashes) + c.shape_of(w) for w in words[1::2]]
    for kind in (pa.binary(), pa.large_binary()):
        part = pa.array([b"", *words, b""], kind)[3:]
        assert c.hashes_of(part).tolist() == [*want[2:], xxhash.xxh64_intdigest(b"", 42)]
        assert c.shapes_of(part).tolist() == [c.shape_of(w) for w in [*words[2:], b""]]


def test_gains_keep_their_digits():
    """A count far above one small cell among large ones."""
    classes = c.CLASSES + 2
    cells = np.full((classes, classes), 1e8)
    cells[3, 7] = 1
    counts = np.zeros((1, classes))
    counts[0, 3], own = 1e6, np.array([5])
    found = c.neighbour_gains(cells, own, counts, np.zeros_like(counts))[0]
    for g in set(range(classes)) - {3, 5}:
        cell = cells[3, g]
        assert math.isclose(found[g], float(c.xlogx(cell + 1e6) - c.xlogx(cell)), rel_tol=1e-6)


def test_words_travel_together(monkeypatch):
    words = pa.array(["é", "b", "", "c" * 40, "a"])
    assert c.opened_words(c.packed_words(words[1:])).to_pylist() == [b"b", b"", b"c" * 40, b"a"]
    assert c.opened_words(c.packed_words(words[:0])).to_pylist() == []
    order, part = c.dealt(words, 3)
    assert sorted(order.tolist()) == [0, 1, 2, 3, 4] and (np.diff(part) >= 0).all() and part.max() < 3
    # Words of one hash have one order too.
    monkeypatch.setattr(c, "hashes_of", lambda words: np.full(len(words), 9, np.uint64))
    assert c.dealt(words, 3)[0].tolist() == [2, 4, 1, 3, 0]
