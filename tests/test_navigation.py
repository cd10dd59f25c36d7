"""Nodes, cursors, products, folds, conflicts and samples."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from pathloom.functions import bytemask, codec
from pathloom.operators import conflicts, cursor, folds, nodes, product, sampling
from pathloom.operators.frame import PathFrame

WORDS = "arrow bow cannon roman romane romanus romulus rubens ruber rubicon rubicundus rom'i".split()


@pytest.fixture(scope="module")
def words(spark):
    return PathFrame.from_items(spark, [(w.encode(), i) for i, w in enumerate(WORDS)])


def table(spark, paths):
    return spark.createDataFrame([(bytearray(p),) for p in paths], "path binary")


def moves(df, col="moved"):
    return {bytes(r["path"]): (None if r[col] is None else bytes(r[col]) if not isinstance(r[col], int) else r[col]) for r in df.collect()}


class Model:
    """A trie as a dict, for comparison."""

    def __init__(self, values):
        self.values = values
        self.prefixes = sorted({v[:i] for v in values for i in range(len(v) + 1)})

    def kids(self, p):
        return sorted({q[len(p)] for q in self.prefixes if len(q) == len(p) + 1 and q.startswith(p)})

    def stop(self, p):
        return p in self.values or len(self.kids(p)) > 1


@pytest.fixture(scope="module")
def trie(spark):
    rnd = random.Random(8)
    values = {bytes(rnd.choice(b"ab\xff") for _ in range(rnd.randrange(1, 7))): i for i in range(25)}
    return Model(values), PathFrame.from_items(spark, values.items())


def test_batch_moves(trie, spark):
    m, t = trie
    pos = table(spark, m.prefixes)
    kids = {p: m.kids(p) for p in m.prefixes}
    assert moves(cursor.descend_branch(t, pos)) == {p: p + bytes([k[0]]) if (k := kids[p]) else None for p in m.prefixes}
    assert moves(cursor.descend_branch(t, pos, 1)) == {p: p + bytes([k[1]]) if len(k := kids[p]) > 1 else None for p in m.prefixes}
    after = lambda seq, p: next((q for q in seq if q > p), None)
    assert moves(cursor.next_step(t, pos)) == {p: after(m.prefixes, p) for p in m.prefixes}
    assert moves(cursor.next_value(t, pos)) == {p: after(sorted(m.values), p) for p in m.prefixes}

    def sibling(p, forward):
        near = [q for q in m.prefixes if p and len(q) == len(p) and q[:-1] == p[:-1] and (q > p if forward else q < p)]
        return (min(near) if forward else max(near)) if near else None

    assert moves(cursor.sibling(t, pos)) == {p: sibling(p, True) for p in m.prefixes}
    assert moves(cursor.sibling(t, pos, False)) == {p: sibling(p, False) for p in m.prefixes}
    up = lambda p, f: next((p[:i] for i in range(len(p) - 1, 0, -1) if f(p[:i])), b"")
    assert moves(cursor.ascend_until(t, pos)) == {p: up(p, m.stop) for p in m.prefixes}
    assert moves(cursor.ascend_until(t, pos, True)) == {p: up(p, lambda q: len(kids[q]) > 1) for p in m.prefixes}

    def until(p):
        while len(kids[p]) == 1:
            p += bytes(kids[p])
            if m.stop(p):
                break
        return p

    assert moves(cursor.descend_until(t, pos)) == {p: until(p) for p in m.prefixes}
    keys = table(spark, [p + x for p in m.prefixes for x in (b"", b"z", b"abab")])
    exist = lambda k: max(i for i in range(len(k) + 1) if k[:i] in m.prefixes)
    assert moves(cursor.descend_to_existing(t, keys), "n") == {k: exist(k) for k in moves(keys, "path")}
    assert moves(cursor.descend_to_value(t, keys), "n") == {k: next((i for i in range(1, len(k) + 1) if k[:i] in m.values), exist(k)) for k in moves(keys, "path")}
    seen = {bytes(r["path"]): r for r in cursor.look(t, keys).collect()}
    for k, r in seen.items():
        assert (r["exists"], r["is_value"], r["child_count"]) == (k in m.prefixes, k in m.values, len(m.kids(k)))


def test_cursor(words):
    c = cursor.Cursor(words)
    assert c.child_count() == 4 and not c.is_value() and c.at_root() and c.val_count() == 12
    r = c.descend_first_byte().to_prev_sibling_byte()
    assert r is None
    r = c.descend_to(b"r")
    assert r.path_exists() and r.branches() == [ord("o"), ord("u")] and r.descend_until() is None
    rom = r.descend_to_byte(ord("o")).descend_until()
    assert rom.path == b"rom" and rom.branches() == sorted(b"'au")
    assert rom.descend_indexed_branch(1).descend_until().path == b"roman" and rom.descend_indexed_branch(9) is None
    deep, n = rom.descend_to_existing(b"ulz")
    assert (deep.path, n) == (b"romul", 2) and deep.ascend_until().path == b"rom" and deep.ascend_until_branch().path == b"rom"
    assert rom.descend_to_value(b"anus")[0].path == b"roman" and rom.descend_to(b"an").descend_to_value(b"us")[1] == 2
    assert deep.ascend(99) == (c, False) and deep.ascend_byte()[0].path == b"romu"
    moved, shared, exists = rom.move_to_path(b"rub")
    assert (moved.path, shared, exists) == (b"rub", 1, True)
    walk, seen = c, []
    while (walk := walk.to_next_val()) is not None:
        seen.append(walk.path.decode())
    assert seen == sorted(WORDS)
    sub = rom.fork()
    assert (sub.path, sub.root_prefix_path, sub.origin_path) == (b"", b"rom", b"rom") and sub.to_next_val().path == b"'i"
    assert sub.to_next_step().origin_path == b"rom'" and sub.make_map().val_count() == 5 and sub.reset().at_root()


def test_k_paths(spark):
    t = PathFrame.unit(spark, [p.encode() for p in (":5:above:", ":6:erroni", ":5:error:", ":5:hello:", ":5:mucky:", ":5:roger:", ":5:zebra:x", ":5:zeb")])
    found = sorted(bytes(r["path"]).decode() for r in cursor.k_paths(t, 6, b":5:").collect())
    assert found == [":5:above:", ":5:error:", ":5:hello:", ":5:mucky:", ":5:roger:", ":5:zebra:"]
    c = cursor.Cursor(t, b":5:", 0).descend_first_k_path(6)
    assert c.path == b":5:above:" and c.to_next_k_path(6).path == b":5:error:"


def test_products(spark):
    of = lambda *p: PathFrame.from_items(spark, [(x.encode(), i) for i, x in enumerate(p)])
    two = product.product([of("AAa", "AAb", "AAc"), of("DDd", "EEe", "FFf")])
    found = {bytes(r["path"]): (r["focus_factor"], list(r["splits"])) for r in two.collect()}
    assert found[b"AAa"] == (0, []) and found[b"AAaDDd"] == (1, [3]) and len(found) == 12
    three = product.product([of("abcdefghijklmnopqrstuvwxyz", "arrow", "x"), of("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "a", "bow"), of("foo", "pho")])
    assert three.where("focus_factor = 2").count() == 18 and three.where("focus_factor < 2").count() == 12
    shadow = product.product([of("abcdefghijklmnopqrstuvwxyz", "arrow", "x", "arr"), of("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "a", "bow", "bo"), of("foo", "pho", "f")])
    assert {bytes(r["path"]) for r in shadow.where("startswith(path, cast('abcdefghijklmnopqrstuvwxyzbo' as binary))").collect()} == {b"abcdefghijklmnopqrstuvwxyzbo" + x for x in (b"", b"f", b"foo", b"pho")}
    below = product.product_below([of("ab", "ac"), of("x", "y")], b"acx")
    assert [bytes(r["path"]) for r in below.collect()] == [b"acx"]


def test_folds(words, spark):
    assert folds.leaf_count(words) == 11 and folds.longest_path(words) == b"rubicundus"
    assert [r["value"] for r in folds.values_at_branches(words).collect()] == [3]
    leaves = folds.fold(words, lambda k, v, p: F.when(F.size(k) == 0, F.lit(1).cast("long")).otherwise(folds.totals(k)), "long")
    assert {bytes(r["prefix"]): r["w"] for r in leaves.collect()}[b""] == 11
    parts = folds.split_algebra(lambda v, p: v, lambda v, w, p: v + w, lambda k, p: folds.totals(k))
    assert {bytes(r["prefix"]): r["w"] for r in folds.fold(words, parts, "long").collect()}[b""] == sum(range(12))
    count = folds.fold(words, lambda k, v, p: folds.totals(k, F.lit(1).cast("long")), "long", steps=True)
    prefixes = {w[:i] for w in WORDS for i in range(len(w) + 1)}
    assert {bytes(r["prefix"]): r["w"] for r in count.collect()}[b""] == len(prefixes)
    assert folds.fold_python(words, lambda mask, results, v, p: 1 + sum(results)) == len(prefixes)
    assert folds.fold_python(words, lambda mask, results, v, p: max([len(p), *results])) == 10
    tree = {f"{i:04d}"[::-1] * (1 + i % 2): i for i in range(1500)}
    many = PathFrame.from_items(spark, [(k.encode(), v) for k, v in tree.items()])

    def spelled(mask, results, v, p):
        return f"{v}({','.join(f'{b}{r}' for b, r in zip(mask, results))})"

    # In rounds of at most 300 items a task, and all at once.
    assert folds.fold_python(many, spelled, 300) == folds.fold_python(many, spelled)
    assert folds.fold_python(PathFrame.empty(spark), spelled) == "None()"
    up = lambda chain, w, path: w + 100 * F.octet_length(chain)
    jumped = folds.fold(PathFrame.from_items(spark, [(b"abc", 5), (b"ade", 6), (b"xyz", 7)]), folds.split_algebra(lambda v, p: v, lambda v, w, p: v + w, lambda k, p: folds.totals(k)), "long", jump=up)
    assert {bytes(r["prefix"]): r["w"] for r in jumped.collect()} == {b"abc": 5, b"ade": 6, b"xyz": 7, b"a": 211, b"": 211 + 207}
    lone = folds.fold(PathFrame.empty(spark), lambda k, v, p: F.size(k).cast("long"), "long").collect()
    assert [(bytes(r["prefix"]), r["w"]) for r in lone] == [(b"", 0)]


def test_chain_above_the_first_node(spark):
    t = PathFrame.from_items(spark, [(b"abc", 5)])
    depth = folds.fold(t, lambda k, v, p: F.aggregate(k, F.lit(0).cast("long"), lambda a, c: c["w"] + 1), "long", steps=True)
    assert {bytes(r["prefix"]): r["w"] for r in depth.collect()} == {b"abc": 0, b"": 3}


def test_digit_sums(spark):
    for keys, want in ((["1"], 1), (["123"], 6), (["1", "12", "123"], 6), (["12", "13"], 6)):
        assert folds.digit_sum(PathFrame.unit(spark, [k.encode() for k in keys])) == want


def test_content_hash(words, spark):
    other = PathFrame.from_items(spark, [(w.encode(), i) for i, w in reversed(list(enumerate(WORDS)))])
    changed = PathFrame.from_items(spark, [(w.encode(), i + (w == "bow")) for i, w in enumerate(WORDS)])
    assert folds.content_hash(words) == folds.content_hash(other) != folds.content_hash(changed)


def test_shared_subtrees(spark):
    t = PathFrame.from_items(spark, [(b"a/x", 1), (b"a/y", 2), (b"b/x", 1), (b"b/y", 2), (b"c", 1)])
    assert max((r["n_values"], r["places"]) for r in nodes.shared_subtrees(t.df).collect()) == (2, 2)


def test_unfold(spark):
    seed = spark.range(1).select(F.lit(b"").alias("path"), F.lit(3).cast("long").alias("state"))
    kids = F.filter(F.array(*[F.struct(F.lit(x).alias("path"), (F.col("state") - 1).alias("state")) for x in (b"a", b"b")]), lambda c: c["state"] >= 0)
    grown = folds.unfold(seed, F.when(F.col("state") == 0, F.lit(1)), kids, spark.createDataFrame([(bytearray(b"aaa"), 9), (bytearray(b"q"), 9)], "path binary, value int"))
    assert {bytes(r["path"]): r["value"] for r in grown.collect()} == {bytes([x, y, z]): 1 for x in b"ab" for y in b"ab" for z in b"ab"} | {b"q": 9}

    def step(state, builder, path):
        if state:
            builder.push(b"0", state - 1)
            builder.push(b"11", state - 1)
            builder.graft_at_byte(ord("z"), [(b"!", state)])
        return None if state else len(path)

    rows = {bytes(r["path"]): r["value"] for r in folds.unfold_python(spark, [(b"s", 2), (b"t", 0)], step, "long").collect()}
    assert rows == {b"sz!": 2, b"s0z!": 1, b"s11z!": 1, b"s00": 3, b"s011": 4, b"s110": 4, b"s1111": 5, b"t": 1}


def test_builder():
    b = folds.Builder()
    b.push(b"a", 1)
    b.push_byte(ord("c"), 2)
    with pytest.raises(ValueError):
        b.push(b"b", 3)
    b.tolerant_push(b"b", 3)
    b.tolerant_push(b"b", 4)
    assert len(b) == 3 and b.mask() == list(b"abc") and b.children[b"b"] == 4
    with pytest.raises(ValueError):
        b.set_child_mask([1], [1])
    c = folds.Builder()
    c.set_child_mask([2, 1], ["x", "y"])
    assert c.children == {b"\1": "x", b"\2": "y"}


def test_conflicts(spark):
    rows = [(1, b"a", False), (2, b"a/b", False), (3, b"a/b/c", True), (4, b"z", True), (5, b"z", False), (6, b"zz", False), (7, b"", False)]
    requests = spark.createDataFrame([(i, bytearray(p), w) for i, p, w in rows], "id long, path binary, writes boolean")
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and (a[1].startswith(b[1]) or b[1].startswith(a[1])) and (a[2] or b[2])}
    assert {(r["a"], r["b"]) for r in conflicts.conflicts(requests).collect()} == want
    found = {bytes(r["path"]): r["status"] for r in conflicts.path_status(table(spark, [b"a", b"a/x", b"z!", b"q", b"a/b/c/d"]), requests.where("id <> 7")).collect()}
    assert found == {b"a": "unavailable", b"a/x": "reading", b"z!": "unavailable", b"q": "available", b"a/b/c/d": "unavailable"}


def test_path_status_at_size(spark):
    # Exploded prefixes are many more than Spark expects: no join may gather them in the driver, small as their tables look.
    rows = [(b"a" * i + b"/" * (i % 3), i % 7 == 0) for i in range(1, 60)] + [(b"a" * 10, False), (b"b", False)]
    requests = spark.createDataFrame([(i, bytearray(p), w) for i, (p, w) in enumerate(rows)], "id long, path binary, writes boolean")
    probes = [b"", b"a", b"a" * 5, b"a" * 5, b"a" * 59, b"a" * 80, b"a//", b"a/", b"bb", b"b", b"c"]
    found = conflicts.path_status(spark.createDataFrame([(bytearray(p),) for p in probes], "path binary"), requests)
    near = {p: [w for r, w in rows if r.startswith(p) or p.startswith(r)] for p in probes}
    want = [(p, "unavailable" if any(near[p]) else "reading" if near[p] else "available") for p in probes]
    assert sorted((bytes(r["path"]), r["status"]) for r in found.collect()) == sorted(want)
    assert "Broadcast" not in found._jdf.queryExecution().toString()


def test_masks(spark):
    rnd, rows = random.Random(2), []
    for i in range(12):
        rows.append((i, rnd.sample(range(256), rnd.randrange(0, 9)), rnd.sample(range(256), 5), rnd.randrange(256)))
    rows += [(90, [0, 63, 64, 127, 128, 191, 192, 255], [0, 255], 64), (91, [], [], 0)]
    df = spark.createDataFrame(rows, "id int, x array<int>, y array<int>, b int").select("*", bytemask.of_bytes(F.col("x")).alias("m"), bytemask.of_bytes(F.col("y")).alias("n"))
    m, n, b = F.col("m"), F.col("n"), F.col("b")
    s = bytemask.bytes_of
    found = df.select("id", s(m), bytemask.count(m), bytemask.rank(m, b), bytemask.next_byte(m, b), bytemask.previous_byte(m, b), bytemask.select(m, F.lit(0)), bytemask.select(m, F.lit(1), False),
                      s(bytemask.or_(m, n)), s(bytemask.and_(m, n)), s(bytemask.xor(m, n)), s(bytemask.andnot(m, n)), bytemask.count(bytemask.not_(m)), bytemask.test(m, b), s(bytemask.with_bit(m, b)), s(bytemask.without_bit(m, b)))
    for r, (i, x, y, k) in zip(found.orderBy("id").collect(), sorted(rows)):
        a, c = set(x), set(y)
        o = sorted(a)
        assert list(r) == [i, o, len(a), sum(v < k for v in a), min((v for v in a if v > k), default=None), max((v for v in a if v < k), default=None), o[0] if o else None, o[-2] if len(o) > 1 else None,
                           sorted(a | c), sorted(a & c), sorted(a ^ c), sorted(a - c), 256 - len(a), k in a, sorted(a | {k}), sorted(a - {k})]
    assert df.select(bytemask.is_empty(bytemask.empty()), bytemask.count(bytemask.full())).first() == (True, 256)


def test_codecs(spark):
    numbers = [0, 1, 127, 128, 255, 256, -1, -128, -129, 2**40, -(2**63), 2**63 - 1]
    df = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", codec.be_int(F.col("n")).alias("be"), codec.le_int(F.col("n")).alias("le"), codec.signed_bytes(F.col("n")).alias("s"), codec.prefix_key(F.col("n")).alias("k"), codec.framed(F.array("n", F.lit(5).cast("long"))).alias("f"))
    for r in df.collect():
        n = r["n"]
        size = next(k for k in range(1, 9) if -(1 << 8 * k - 1) <= n < 1 << 8 * k - 1)
        assert bytes(r["be"]) == n.to_bytes(8, "big", signed=True) and bytes(r["le"]) == n.to_bytes(8, "little", signed=True)
        assert bytes(r["s"]) == n.to_bytes(size, "big", signed=True) and bytes(r["f"]) == bytes([size]) + bytes(r["s"]) + b"\x01\x05"
        assert bytes(r["k"]) == (n.to_bytes(8, "little", signed=True).rstrip(b"\0") or b"\0")
    row = spark.range(1).select(codec.symbols(F.array(F.lit("é"), F.lit("ab"))), codec.overlap(F.lit(b"abc"), F.lit(b"abd")), codec.overlap(F.lit(b""), F.lit(b"a")), codec.be_value(F.lit(b"\x01\x00"))).first()
    assert bytes(row[0]).decode() == ":2:é:2:ab:" and list(row)[1:] == [2, 0, 256]
    assert codec.successor(b"a\xff") == b"b" and codec.successor(b"\xff\xff") is None and codec.successor(b"ab") == b"ac"
    top = PathFrame.unit(spark, [b"\xff", b"\xff\xffz", b"\xfe"])
    assert top.below(b"\xff").count() == 2


def test_samples(words, spark):
    assert sampling.fair_values(words, 5, 3).count() == 5 and sampling.fair_values(words, 5, 3).collect() == sampling.fair_values(words, 5, 3).collect()
    assert sampling.fair_paths(words, 4).count() == 4
    ends = {bytes(r["path"]).decode() for r in sampling.descents(words, 20, 12).collect()}
    assert ends <= set(WORDS)
    trie = sampling.uniform_trie(spark, 30, F.lit(3), lambda c: F.pmod(c, F.lit(2)) + 97, F.col("id"), 1)
    assert {bytes(r["path"]) for r in trie.df.collect()} <= {bytes([x, y, z]) for x in b"ab" for y in b"ab" for z in b"ab"}
    draw = sampling.mapped(sampling.categorical(["x", "y"], [1, 3]), F.upper)
    counts = {r["item"]: r["n"] for r in sampling.histogram(spark.range(4000), draw(F.xxhash64("id"))).collect()}
    assert set(counts) == {"X", "Y"} and 2600 < counts["Y"] < 3400
    one = sampling.choice2(sampling.degenerate(F.lit(1)), sampling.degenerate(F.lit(2)), 1.0)
    many = sampling.repeated(sampling.dependent2(one, lambda v: sampling.degenerate(v + 1)), F.lit(3))
    pair = sampling.product2(one, one, lambda a, b: a + b)
    row = spark.range(1).select(many(F.xxhash64("id")), pair(F.xxhash64("id"))).first()
    assert list(row) == [[2, 2, 2], 2]
    assert {r["byte"]: r["n"] for r in sampling.branches_by_weight(words, b"rom").collect()} == {ord("'"): 1, ord("a"): 3, ord("u"): 1}


def test_unbounded_draws(spark):
    ids, chance, rare = spark.range(200), F.xxhash64("id"), sampling.categorical([1, 2], [1, 60])
    found = {r["id"]: r["x"] for r in sampling.filtered(ids, chance, rare, lambda v: v == 1, "x").collect()}
    assert found == {i: 1 for i in range(200)}
    assert {r["x"] for r in sampling.collected(ids, chance, rare, lambda v: F.when(v == 1, v + 6), "x").collect()} == {7}
    ended = [r["x"] for r in sampling.until(ids, chance, rare, F.lit(1), "x").collect()]
    assert len(ended) == 200 and all(set(x) <= {2} for x in ended) and max(map(len, ended)) > 64 and 30 < sum(map(len, ended)) / 200 < 120
    # Draws of 2 add up until the sum passes 9.
    sums = sampling.concentrated(ids, chance, sampling.degenerate(F.lit(2)), F.lit(0), lambda a, x: a + x, lambda a, x: F.when(a + x > 9, a + x), "x")
    assert {r["x"] for r in sums.collect()} == {10}
    split = sampling.diluted(sampling.degenerate(F.lit("a,b")), lambda x: F.split(x, ","), lambda a: a)
    assert spark.range(1).select(split(chance)).first()[0] == ["a", "b"]


def spark_hash(seed, path):
    """Spark's xxhash64 of an int and a binary."""
    first = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
    n = xxhash.xxh64_intdigest(path, first)
    return n - (1 << 64) if n >> 63 else n


def test_samples_by_hand(words):
    rows = sorted((spark_hash(3, w.encode()), w) for w in WORDS)
    assert {bytes(r["path"]).decode() for r in sampling.fair_values(words, 5, 3).collect()} == {w for _, w in rows[:5]}
    every = sorted({w[:i].encode() for w in WORDS for i in range(len(w) + 1)}, key=lambda p: spark_hash(0, p))
    assert {bytes(r["path"]) for r in sampling.fair_paths(words, 7).collect()} == set(every[:7])


def test_histograms(words):
    found = nodes.node_table(words.df)
    by = {r["depth"]: (r["nodes"], r["vals"]) for r in nodes.depth_histogram(found).collect()}
    assert by[0] == (1, 0) and by[1] == (4, 0) and by[10] == (1, 1)
    runs = {r["jumped"]: r["n"] for r in nodes.run_length_histogram(found).collect()}
    assert sum(k * n for k, n in runs.items()) == found.count() - 1
