import random

import numpy as np

from pathloom.llm import decontamination as d


def distance(item, text):
    """Least edits from the item to any passage of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_passage_distance():
    rnd = random.Random(1)
    items = np.array([[rnd.randrange(5) for _ in range(9)] for _ in range(50)])
    texts = np.array([[rnd.randrange(5) for _ in range(14)] for _ in range(50)])
    best, _ = d.passage_distance(items, texts)
    assert best.tolist() == [distance(a, b) for a, b in zip(items.tolist(), texts.tolist())]


def edited(words, n, rnd):
    words = list(words)
    for _ in range(n):
        k, p = rnd.randrange(3), rnd.randrange(len(words))
        if k == 0:
            words[p] = f"new{rnd.randrange(99)}"
        elif k == 1:
            words.insert(p, f"more{rnd.randrange(99)}")
        else:
            del words[p]
    return words


def test_recall_and_precision(spark):
    rnd = random.Random(4)
    vocabulary = [f"word{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(15, 60)))) for i in range(60)]
    filler = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    docs, leaks = [], {}
    for i, text in items:
        words = text.split()
        for share in (0, 0.05, 0.1, 0.2):
            n = len(docs)
            docs.append((n, " ".join(filler(rnd.randrange(80)) + edited(words, int(share * len(words)), rnd) + filler(rnd.randrange(80)))))
            leaks[n] = i
    docs += [(n, " ".join(filler(150))) for n in range(len(docs), len(docs) + 100)]
    found = d.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    hit = {r["row"]["doc_id"]: {m["item_id"]: m["edits"] for m in r["matches"]} for r in found}
    missed = [n for n, i in leaks.items() if i not in hit[n]]
    assert len(missed) <= 2, missed
    texts = dict(docs)
    for n, seen in hit.items():
        for i, edits in seen.items():
            item = d.words_of(items[i][1])
            assert edits == distance(item, d.words_of(texts[n])) <= d.allowed(len(item))
    assert not any(hit[n] for n in hit if n not in leaks)


def test_starts():
    rnd = random.Random(2)
    for _ in range(60):
        item = [rnd.randrange(1, 6) for _ in range(8)]
        text = [rnd.randrange(1, 6) for _ in range(20)]
        (best,), (end,) = d.passage_distance(np.array([item]), np.array([text]))
        (begin,) = d.passage_start(np.array([item]), np.array([text]), np.array([end]))
        passage = text[begin:end]
        whole = list(d.edit_columns(np.array([item]), np.array([passage]).reshape(1, -1), True))[-1][0]
        assert whole == best == distance(item, text)


def test_long_items(spark):
    """Items of 5,000 words, one copied with edits, one not; the passage is found at its place."""
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [[rnd.choice(vocabulary) for _ in range(n)] for n in (5000, 5000, 900)]
    before = [rnd.choice(vocabulary) for _ in range(300)]
    docs = [(0, before + edited(items[0], 200, rnd) + before), (1, before + items[2]), (2, before * 3)]
    found = d.matches(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")).collect()
    hit = {r["row"]["doc_id"]: [tuple(m) for m in r["matches"]] for r in found}
    assert hit[1] == [(2, 0, 300)] and hit[2] == []
    [(item, edits, start)] = hit[0]
    assert item == 0 and 150 < edits <= 200 and abs(start - 300) <= 3


def test_edges(spark, edge, edge_rows, none):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (1, "the quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "x"), (None, "runs away from the BIG, bad wolf in the dark"), (5, "?!")], "item_id long, text string")
    found = d.matches(edge, items).collect()
    assert len(found) == len(edge_rows)
    for r in found:
        ids = sorted(map(str, (m["item_id"] for m in r["matches"])))
        text = r["row"]["text"] or ""
        assert ids == (["1", "1", "None"] if text.startswith("the quick") else ["4"] if text == "x" else [])
    clean = d.decontaminate(edge, items)
    assert clean.columns == edge.columns and clean.count() == sum(not (r[1] or "").startswith("the quick") and r[1] != "x" for r in edge_rows)
    assert d.matches(none, items).count() == 0
    assert d.matches(edge, items.limit(0)).where("size(matches) > 0").count() == 0


def test_many_items_make_blocks(spark, monkeypatch):
    monkeypatch.setattr(d, "ITEM_BLOCK", 2)
    items = spark.createDataFrame([(i, f"alpha{i} beta gamma delta{i} epsilon zeta eta theta") for i in range(5)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"x y alpha{i} beta gamma delta{i} epsilon zeta eta theta z") for i in range(5)], "doc_id long, text string")
    assert {(r["row"]["doc_id"], min(r["matches"], key=lambda m: m["edits"])["item_id"]) for r in d.matches(docs, items).collect()} == {(i, i) for i in range(5)}
