"""Whole-table algebra and subtree operators against a plain dict model."""

import random

import pytest
from pyspark.sql import functions as F

from pathloom.functions import policy as P
from pathloom.operators import algebra as g
from pathloom.operators import relocate as r
from pathloom.operators.frame import PathFrame
from pathloom.operators.prefixes import prefix_minimal


def frame(spark, items, kind="long", policy=P.KEEP_LEFT_EQUAL):
    return PathFrame.from_items(spark, items.items() if isinstance(items, dict) else items, kind, policy)


def back(t):
    rows = t.df.collect()
    found = {bytes(x["path"]): x["value"] for x in rows}
    assert len(found) == len(rows), "paths must stay unique"
    return found


def unit(spark, paths):
    return PathFrame.unit(spark, [p.encode() for p in paths])


def random_trie(seed, n=40):
    rnd = random.Random(seed)
    return {bytes(rnd.choice(b"ab\xff") for _ in range(rnd.randrange(0, 6))): rnd.randrange(4) for _ in range(n)}


@pytest.fixture(scope="module", params=[1, 2])
def pair(request, spark):
    a, b = random_trie(request.param), random_trie(request.param + 50, 25)
    return a, b, frame(spark, a), frame(spark, b)


def covered(a, stems):
    return {k: v for k, v in a.items() if any(k.startswith(q) for q in stems)}


def test_model(pair, spark):
    a, b, A, B = pair
    assert back(g.join(A, B)) == b | a
    assert back(g.meet(A, B)) == {k: v for k, v in a.items() if k in b}
    assert back(g.subtract(A, B)) == {k: v for k, v in a.items() if b.get(k) != v}
    assert back(g.restrict(A, B)) == covered(a, b)
    assert back(g.join_all([A, B, A])) == b | a
    stems = {k: v for k, v in b.items() if k}
    assert back(g.restrict(A, frame(spark, stems))) == covered(a, stems)
    assert {bytes(x["path"]) for x in prefix_minimal(B.df).collect()} == {k for k in b if not any(k != q and k.startswith(q) for q in b)}


def test_laws(pair, spark):
    a, b, A, B = pair
    assert back(g.join(A, A)) == a == back(g.meet(A, A)) and back(g.subtract(A, A)) == {}
    assert back(g.restrict(A, frame(spark, {b"": 0}))) == a
    once = g.restrict(A, B)
    assert back(g.restrict(once, B)) == back(once)
    assert back(r.drop_head(r.insert_prefix(A, b"", b"xyz"), b"", 3)) == a


@pytest.mark.parametrize("focus", [b"", b"a", b"ab", b"\xff", b"zz"])
def test_subtrees(pair, focus):
    a, b, A, B = pair
    n = len(focus)
    out = {k: v for k, v in a.items() if not k.startswith(focus)}
    at = {k: v for k, v in a.items() if k == focus}
    sub = {k[n:]: v for k, v in a.items() if k.startswith(focus)}
    low, theirs = {k: v for k, v in sub.items() if k}, {k: v for k, v in b.items() if k}
    put = lambda d: {focus + k: v for k, v in d.items()}
    assert back(r.graft(A, focus, B)) == out | put(b)
    assert back(r.join_at(A, focus, B)) == out | at | put(theirs | low)
    assert back(r.join_map(A, focus, B)) == out | put(b | sub)
    assert back(r.meet_at(A, focus, B)) == out | at | put({k: v for k, v in low.items() if k in b})
    assert back(r.subtract_at(A, focus, B)) == out | at | put({k: v for k, v in low.items() if b.get(k) != v})
    assert back(r.restrict_at(A, focus, B)) == out | at | put(covered(low, theirs))
    left, taken = r.take_map(A, focus)
    assert (back(left), back(taken)) == (out, sub)
    assert back(r.remove_branches(A, focus)) == out | at
    assert back(r.keep_branches(A, focus, [ord("a")])) == out | at | put({k: v for k, v in low.items() if k[0] == ord("a")})
    assert back(r.insert_prefix(A, focus, b"-")) == out | at | {focus + b"-" + k: v for k, v in low.items()}
    for m in (1, 2):
        dropped = {}
        for k in sorted(low):
            if len(k) > m:
                dropped.setdefault(k[m:], low[k])
        assert back(r.drop_head(A, focus, m)) == out | at | put(dropped)
    assert back(r.drop_head(A, focus, 0)) == a


def test_remove_prefix(spark):
    t = frame(spark, {b"123:Bob.Fido": 1, b"123:Jim.Felix": 2, b"123:Pam.Bandit": 3, b"9": 4})
    moved, whole = r.remove_prefix(t, b"123:Pam.", 4)
    assert back(moved) == {b"123:Bandit": 3, b"9": 4} and whole
    moved, whole = r.remove_prefix(t, b"123:Jim.", 99, root=4)
    assert back(moved) == {b"123:Felix": 2, b"9": 4} and not whole


def test_join_into(spark):
    t = frame(spark, {b"a:x": 1, b"a:y": 2, b"b:x": 9, b"b:z": 8, b"b:": 7})
    assert back(r.join_into(t, b"a:", b"b:")) == {b"a:x": 1, b"a:y": 2, b"a:z": 8, b"b:": 7}
    with pytest.raises(ValueError):
        r.join_into(t, b"a", b"a:")


def test_restricting(spark):
    t = frame(spark, {b"s/al": 0, b"s/q": 0, b"s": 5, b"k": 6})
    source = frame(spark, {b"alligator": 1, b"all": 2, b"bee": 3})
    assert back(r.restricting(t, b"s/", source)) == {b"s": 5, b"k": 6, b"s/alligator": 1, b"s/all": 2}
    assert back(r.restricting(t, b"none", source)) == back(t)


def test_known_cases(spark):
    words = "alligator allegedly albatross albino".split()
    assert set(back(g.restrict(unit(spark, words), unit(spark, ["all"])))) == {b"alligator", b"allegedly"}
    acts = "a acting activated activation activities acute adaptation adapter".split()
    assert len(back(g.restrict(unit(spark, acts), unit(spark, ["act"])))) == 4 and len(back(g.restrict(unit(spark, acts), unit(spark, ["a"])))) == 8
    kept = g.subtract(unit(spark, ["hello", "hello world", "hell no we won't go"]), unit(spark, ["hello"]))
    assert set(back(kept)) == {b"hello world", b"hell no we won't go"}
    values = g.subtract(frame(spark, {b"0": 0, b"1": 1, b"2": 2}), frame(spark, {b"1": 1, b"3": 3}))
    assert back(values) == {b"0": 0, b"2": 2}
    # Values that differ survive where the left one is kept.
    assert back(g.subtract(frame(spark, {b"x": 1}), frame(spark, {b"x": 2}))) == {b"x": 1}
    long, short = bytes(48), b"\x00" * 6 + b"\x01"
    assert len(back(r.drop_head(frame(spark, {long: 1, short: 2}), b"\x00", 3))) == 2
    assert len(back(r.drop_head(frame(spark, {long: 1, short: 2}), b"\x00", 27))) == 1


def test_root_values(spark):
    a, b = PathFrame.unit(spark, [b"", b"AA"]), PathFrame.unit(spark, [b"BB"])
    c, d = PathFrame.unit(spark, [b"AA"]), PathFrame.unit(spark, [b""])
    assert set(back(g.join(a, b))) == {b"", b"AA", b"BB"} and set(back(g.meet(a, b))) == set()
    assert set(back(g.meet(a, d))) == {b""} and set(back(g.subtract(a, d))) == {b"AA"} and set(back(g.subtract(a, c))) == {b""}
    assert set(back(g.restrict(a, c))) == {b"AA"} and set(back(g.restrict(a, d))) == {b"", b"AA"}
    assert a.val_count() == 1 and a.val_count_at(b"") == 2 and not a.is_empty() and g.meet(a, b).is_empty()


def test_policies(spark):
    t = lambda d, kind, p: frame(spark, d, kind, p)
    a, b = t({b"x": True, b"y": False, b"z": False}, "boolean", P.BOOLEAN), t({b"x": False, b"y": False}, "boolean", P.BOOLEAN)
    assert back(g.join(a, b)) == {b"x": True, b"y": False, b"z": False} and back(g.meet(a, b)) == {b"x": False, b"y": False}
    assert back(g.subtract(a, b)) == {b"x": True, b"z": False}
    a, b = t({b"x": [1, 2], b"y": [3]}, "array<long>", P.SET), t({b"x": [2, 5], b"y": [3]}, "array<long>", P.SET)
    assert back(g.join(a, b)) == {b"x": [1, 2, 5], b"y": [3]} and back(g.meet(a, b)) == {b"x": [2], b"y": [3]} and back(g.subtract(a, b)) == {b"x": [1]}
    assert back(g.join_all([a, b, a])) == {b"x": [1, 2, 5], b"y": [3]}
    a, b = t({b"x": {1: 10, 2: 20}}, "map<long,long>", P.MAP), t({b"x": {2: 99, 3: 30}, b"w": {1: 1}}, "map<long,long>", P.MAP)
    assert back(g.join(a, b)) == {b"x": {1: 10, 2: 20, 3: 30}, b"w": {1: 1}} == back(g.join_all([a, b]))
    assert back(g.meet(a, b)) == {b"x": {2: 20}} and back(g.subtract(a, b)) == {b"x": {1: 10, 2: 20}} and back(g.subtract(a, a)) == {}
    a = t({b"x": (3, 0, 0, -1)}, "struct<w0:long,w1:long,w2:long,w3:long>", P.MASK)
    b = t({b"x": (2, 0, 0, -1)}, "struct<w0:long,w1:long,w2:long,w3:long>", P.MASK)
    assert tuple(back(g.subtract(a, b))[b"x"]) == (1, 0, 0, 0) and tuple(back(g.join(a, b))[b"x"]) == (3, 0, 0, -1) and back(g.subtract(b, a)) == {}
    with pytest.raises(TypeError):
        g.subtract(a.with_policy(P.KEEP_LEFT), b)


def test_status_and_outcomes(spark):
    a = frame(spark, {b"12345": 1, b"1a": 2})
    assert g.status(g.meet(a, a), a) is g.Status.IDENTITY and g.status(g.subtract(a, a), a) is g.Status.NONE
    assert g.status(g.meet(a, frame(spark, {b"12345": 1})), a) is g.Status.ELEMENT
    assert g.outcome(g.join(a, a), a, a) == g.Outcome.identity(g.LEFT | g.RIGHT)
    N, I, E = g.Status.NONE, g.Status.IDENTITY, g.Status.ELEMENT
    assert [N.merge(N), N.merge(I), I.merge(N), I.merge(N, True, False), N.merge(I, False), E.merge(N), I.merge(I)] == [N, I, I, E, E, E, I]
    o = g.Outcome
    assert o.identity(1).inverted() == o.identity(2) and o.identity(2).status() is E and o.identity(3).into_option("l", "r") == "l"
    assert o.none().unwrap_or(5) == 5 and o.of(o.none()).flatten() == o.none() and o.of(2).map(lambda x: x + 1).unwrap() == 3
    assert o.identity(3).merge(o.identity(1), ["a", "b"], ["c", "d"], None) == o.identity(1)
    assert o.identity(1).merge(o.identity(2), ["a", "b"], ["c", "d"], lambda x, y: x + y).unwrap() == "ad"
    assert o.none().merge(o.identity(1), [None, None], ["c", "d"], None) == o.identity(1)
    assert o.none().merge(o.identity(1), ["a", None], ["c", "d"], lambda x, y: (x, y)).unwrap() == (None, "c")
    with pytest.raises(ValueError):
        o.none().unwrap()


def test_updates_and_points(spark):
    t = frame(spark, [(b"k", 1), (b"k", 2), (b"kk", 3)])
    assert back(t) == {b"k": 2, b"kk": 3} and t.get(b"k") == 2 and t.get(b"none") is None
    assert t.contains(b"kk") and not t.contains(b"") and t.contains_path(b"") and not t.contains_path(b"kkk")
    u = t.insert(frame(spark, {b"k": 9, b"new": 5}))
    assert back(u) == {b"k": 9, b"kk": 3, b"new": 5}
    assert back(u.remove(spark.createDataFrame([(bytearray(b"k"),)], "path binary"))) == {b"kk": 3, b"new": 5}
    assert back(PathFrame.empty(spark)) == {} and PathFrame.empty(spark).is_empty()
    assert back(r.set_value(r.remove_value(t, b"k"), b"", 7)) == {b"": 7, b"kk": 3}
    with pytest.raises(ValueError):
        PathFrame.of(spark.createDataFrame([(bytearray(b"x"), 1)] * 2, "p binary, v long"), F.col("p"), F.col("v"), validate=True)


def test_ranges(spark):
    assert [int.from_bytes(k) for k in sorted(back(PathFrame.range(spark, 0, 300, 7)))] == list(range(0, 300, 7))
    assert sorted(int.from_bytes(k) for k in back(PathFrame.range(spark, 50, 10, -9, width=2))) == sorted(range(50, 10, -9))
    assert set(back(PathFrame.range(spark, 0, 3, width=2, big_endian=False))) == {b"\0\0", b"\1\0", b"\2\0"}


def test_plans(spark, tmp_path):
    """A prefix reaches the scan as a range, and a restriction is a join by equality."""
    from pathloom.sources import tables

    t = frame(spark, {f"k{i:04d}".encode(): i for i in range(500)})
    tables.write_sorted(t, f"{tmp_path}/t", files=2)
    scan = tables.read_below(spark, f"{tmp_path}/t", b"k01")
    plan = scan.df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(path" in plan and len(back(scan)) == 100
    joined = g.restrict(t, frame(spark, {b"k00": 0, b"k01": 0})).df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in joined and "Cartesian" not in joined
