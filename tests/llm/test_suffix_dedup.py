import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom.llm import suffix_dedup as s
from pathloom.llm import suffix_sort as x


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=140, max_size=600) | st.lists(st.sampled_from([b"ab", b"abcabcabc" * 5, b"\x00", b"zz" * 30]), min_size=20, max_size=60).map(b"".join), st.integers(0, 1000))
def test_sorted_classes(buffer, seed):
    if len(buffer) <= 100:
        return
    at = np.array(sorted(random.Random(seed).sample(range(len(buffer) - 99), min(80, len(buffer) - 99))), np.int64)
    order, first = x.sorted_classes(buffer, at, 100)
    text = [buffer[p : p + 100] for p in at.tolist()]
    want = sorted(range(len(at)), key=lambda i: (text[i], i))
    assert order.tolist() == want
    assert first.tolist() == [k == 0 or text[want[k]] != text[want[k - 1]] for k in range(len(want))]


def brute(rows):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode(), 42))):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - s.WIDTH + 1):
            piece = b[p : p + s.WIDTH]
            if piece in seen:
                gone[p : p + s.WIDTH] = True
            seen.add(piece)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
        out.setdefault(i, []).append((len(b), [tuple(e) for e in edge.reshape(-1, 2).tolist()], np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def check(spark, rows, df=None, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3) if df is None else df
    got = {}
    for r in s.remove_repeats(df, **more).collect():
        got.setdefault(r["id"], []).append((r["n_bytes"], [(e["start"], e["end"]) for e in r["spans"]], bytes(r["kept"])))
    want = brute(rows)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_documents(spark, sample):
    rows = [(r["doc_id"], r["text"]) for r in sample.select("doc_id", "text").collect()]
    check(spark, rows)


def test_hard_texts(spark):
    rnd = random.Random(5)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(150))
    rows = [(i, "".join(rnd.choice("xyz") for _ in range(rnd.randrange(120))) + passage[: rnd.randrange(95, 151)] + "".join(rnd.choice("uvw") for _ in range(60))) for i in range(60)]
    rows += [(100, "a" * 1000), (101, "ab" * 400), (102, "a" * 99), (103, "a" * 100), (104, None), (105, ""), (None, passage), (7, passage), (7, passage), (106, "é" * 300), (107, "é" * 49 + "x" + "é" * 60)]
    rows += [(200, passage * 3), (201, "q" + passage * 2)]
    check(spark, rows)
    check(spark, rows, block_bytes=2000)


def test_ids_that_repeat_or_lack(spark):
    """Many rows without an id, or with one id, in several blocks."""
    rnd = random.Random(8)
    passages = ["".join(rnd.choice("abcdefgh ") for _ in range(130)) for _ in range(6)]
    rows = [(i, " ".join(rnd.sample(passages, 2)) + str(rnd.random())) for i in [None] * 30 + [4] * 20 + list(range(10))]
    check(spark, rows, block_bytes=1500)


def test_shallow_sort_alone():
    rnd = np.random.default_rng(3)
    data = rnd.integers(97, 99, 4000).astype(np.uint8)
    at = rnd.permutation(3900)[:2500]
    order, first = x.shallow_sort(data, at, 16)
    text = [data[p : p + 16].tobytes() for p in at.tolist()]
    want = sorted(range(len(at)), key=lambda i: (text[i], i))
    assert order.tolist() == want and first.tolist() == [k == 0 or text[want[k]] != text[want[k - 1]] for k in range(len(want))]
    assert [len(r) for r in x.shallow_sort(data, at[:0], 16)] == [0, 0]


def test_long_text_spans_pieces(spark, monkeypatch):
    rnd = random.Random(9)
    text = "".join(rnd.choice("abcdefghijklmnop ") for _ in range(200_000))
    check(spark, [(1, text), (2, text[150_000:150_300] + "!" + text[1000:1120])])


def test_edges(edge, edge_rows, none, spark):
    check(spark, [(r[0], r[1]) for r in edge_rows if r[0] not in (7, 8)], edge.where("doc_id is null or doc_id not in (7, 8)"))
    # The two very long texts are equal, and nothing in them repeats.
    long = {r["id"]: r for r in s.remove_repeats(edge.where("doc_id in (7, 8)")).collect()}
    size = long[7]["n_bytes"]
    assert size > 200_000 and long[7]["spans"] == [] and [tuple(e) for e in long[8]["spans"]] == [(0, size)] and long[8]["kept"] == b""
    assert s.remove_repeats(none).count() == 0
