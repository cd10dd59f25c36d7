import numpy as np
import pytest
import xxhash

from pathloom.llm import simhash as s
from pathloom.llm.components import connected_components


def components(pairs, n):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


def family(seed, groups, size, flips):
    rng, out = np.random.default_rng(seed), []
    for base in rng.integers(0, 2**63, groups, dtype=np.uint64):
        for _ in range(size):
            x = int(base)
            for k in rng.integers(0, 64, rng.integers(0, flips + 1)):
                x ^= 1 << int(k)
            out.append(x)
    return np.unique(np.array(out, np.uint64))


def test_trie_join_finds_all_links():
    values = family(1, 150, 8, 4)
    near = np.argwhere(np.bitwise_count(values[:, None] ^ values[None, :]) <= 4).tolist()
    pairs = []
    for k, budget in enumerate(s.Budget(64, 4, 4).halves()):
        turned = values if k == 0 else (values << np.uint64(32)) | (values >> np.uint64(32))
        order = np.argsort(turned)
        x, y = s.join_tries(turned[order], None, budget)
        pairs += list(zip(order[x], order[y]))
    assert components(pairs, len(values)) == components(near, len(values))


def test_two_sides_and_equal_keys():
    left, right = np.array([0, 8, 8], np.uint64), np.array([9, 2**40], np.uint64)
    x, y = s.join_tries(left, right, s.Budget(64, 1, 0))
    assert components(zip(x.tolist(), y.tolist()), 5) == [0, 0, 0, 0, 4] or {tuple(p) for p in zip(x.tolist(), y.tolist())} >= {(3, 1)}


def fingerprint(text, size):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_groups_match_brute_force(sample):
    found = {r["id"]: r for r in s.simhash_groups(sample).collect()}
    rows = sample.select("doc_id", "text").collect()
    prints = [fingerprint(r["text"], 4) for r in rows]
    assert [p & (1 << 64) - 1 for p in (found[r["doc_id"]]["fp"] for r in rows)] == prints
    x = np.array(prints, np.uint64)
    label = components(np.argwhere(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4).tolist(), len(rows))
    least = {}
    for c, r in zip(label, rows):
        least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    assert [found[r["doc_id"]]["component_id"] for r in rows] == [least[c] for c in label]


def test_edges(edge, edge_rows, none):
    found = s.simhash_groups(edge).collect()
    assert len(found) == len(edge_rows)
    by = {(r["id"], r["fp"] & (1 << 64) - 1) for r in found}
    assert by == {(r[0], fingerprint(r[1], 4)) for r in edge_rows}
    assert {r["component_id"] for r in found if r["fp"] == 0} == {4}
    assert s.simhash_groups(none).count() == 0


def test_similar_groups(spark, none):
    base = [f"w{i}" for i in range(300)]
    other = [f"v{i}" for i in range(300)]
    near = base[:150] + ["changed"] + base[151:]
    rows = [(3, " ".join(base)), (5, " ".join(near)), (9, " ".join(other)), (9, " ".join(other)), (11, None), (12, ""), (None, " ".join(base))]
    found = s.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["id"], r["component_id"]) for r in found} == {(3, 3), (5, 3), (11, 11), (12, 11)}
    assert s.similar_groups(none).count() == 0


def test_key_plan():
    assert s.keys_needed(1000, 0.8) == s.keys_needed(s.UNIT_ROWS, 0.8)
    exact, n = s.keys_needed(10**10, 0.8)
    assert 2**exact * s.UNIT_ROWS >= 10**10 and n > s.keys_needed(1000, 0.8)[1]


@pytest.mark.parametrize("unit_rows", [12])
def test_many_buckets_and_large_ones(spark, monkeypatch, unit_rows):
    """Groups of near copies and a large one, with few fingerprints to a unit."""
    monkeypatch.setattr(s, "UNIT_ROWS", unit_rows)
    monkeypatch.setattr(s, "CLUSTER_ROWS", 9)
    rng, rows = np.random.default_rng(5), []
    for k in range(90):
        base = [f"g{k}w{i}" for i in range(200)]
        for c in range(60 if k == 7 else 2):
            words = list(base)
            for at in rng.choice(200, int(rng.integers(1, 3)), replace=False):
                words[at] = f"x{rng.integers(10**6)}"
            rows.append((100 * k + c, " ".join(words)))
    found = s.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["id"], r["component_id"]) for r in found} == jaccard_components(rows, 5, 0.8)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 200), (None, 3)]
    found = dict((r["node"], r["component"]) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {i: 0 for i in range(41)} | {100: 90, 90: 90, 95: 90, 200: 200}


def test_cut_tries_find_the_same_groups(spark):
    """Many small nodes, some deeper than the first eight levels, against all pairs."""
    values = np.unique(np.concatenate((family(5, 120, 6, 4), (family(6, 1, 300, 5) & np.uint64(2**40 - 1)) | np.uint64(7 << 50))))
    near = np.argwhere(np.bitwise_count(values[:, None] ^ values[None, :]) <= 4).tolist()
    signed = [int(v) for v in values.view(np.int64)]
    table = spark.createDataFrame([(v, v, bytearray()) for v in signed], "id long, fp long, sig binary")
    links = s.trie_links(table, len(signed), 64, 4, node_size=16).collect()
    place = {v: i for i, v in enumerate(signed)}
    assert components([(place[r["a"]], place[r["b"]]) for r in links], len(signed)) == components(near, len(signed))


def jaccard_components(rows, size, similarity):
    """The groups that all pairs of documents give, by their shingles' sets."""
    sets = []
    for _, text in rows:
        words = text.encode().lower().split()
        sets.append({b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))})
    near = [(i, j) for i, x in enumerate(sets) for j in range(i) if len(x & sets[j]) >= similarity * len(x | sets[j]) - 1e-9]
    label, least = components(near, len(rows)), {}
    for c, (i, _) in zip(label, rows):
        least[c] = min(least.get(c, i), i)
    found = {(i, least[c]) for c, (i, _) in zip(label, rows)}
    shared = {c for _, c in found if sum(d == c for _, d in found) > 1}
    return {(i, c) for i, c in found if c in shared}


def test_similar_groups_are_those_of_all_pairs(spark):
    """Pairs on both sides of the threshold, of few and of many shingles, and a chain."""
    rng, rows = np.random.default_rng(8), []
    for k in range(240):
        n = int(rng.choice([6, 9, 14, 30, 66, 80, 120, 300]))
        base = [f"g{k}w{i}" for i in range(n)]
        rows.append((10 * k, " ".join(base)))
        # One changed word in the middle changes five shingles; the last words change one each.
        for c in range(2):
            tail = int(n * rng.uniform(0.04, 0.22))
            rows.append((10 * k + c + 1, " ".join(base[: n - tail] + [f"g{k}c{c}x{i}" for i in range(tail)])))
    found = s.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = jaccard_components(rows, 5, 0.8)
    assert 100 < len(want) < 700
    assert {(r["id"], r["component_id"]) for r in found} == want


def test_alike_against_all_pairs():
    rng = np.random.default_rng(6)
    for two in (False, True):
        base = np.unique(rng.integers(0, 10**9, 60).astype(np.uint64))
        sets = [np.unique(np.concatenate((base[rng.random(len(base)) < 0.93], rng.integers(0, 10**9, rng.integers(0, 12)).astype(np.uint64)))) for _ in range(40)]
        comp, second = rng.integers(0, 30, 40), (np.arange(40) % 2 == 1) if two else np.zeros(40, bool)
        a, b = s.alike(sets, comp, second, two, 0.8)

        def joined_by(pairs):
            label = comp.copy()
            for x, y in pairs:
                label[label == label[y]] = label[x]
            return {frozenset(np.flatnonzero(label == k).tolist()) for k in set(label.tolist())}

        every = [(x, y) for x in range(40) for y in range(40) if x < y and (not two or second[x] != second[y]) and s.similar(sets[x], sets[y], 0.8)]
        assert joined_by(zip(a, b)) == joined_by(every) and len(a) <= 39
        assert all(s.similar(sets[x], sets[y], 0.8) for x, y in zip(a, b))
