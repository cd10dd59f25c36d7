import hashlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathloom.llm import quotient_filter as q
from pathloom.llm.exact_dedup import exact_dedup


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 40), max_size=200), st.lists(st.integers(0, 60), max_size=80))
def test_filters_merge_without_loss(a, b):
    blobs = [q.build(np.array(x, np.uint64)) for x in (a, b)]
    values, counts = q.unpack(q.merge(blobs))
    want = defaultdict(int)
    for x in a + b:
        want[x] += 1
    assert dict(zip(values.tolist(), counts.tolist())) == dict(want)
    assert values.tolist() == sorted(want)


def test_narrow_filter():
    values = np.array([0, 1, 5, 7], np.uint64)
    assert q.unpack(q.build(np.repeat(values, 3), 3))[0].tolist() == values.tolist()


def brute(rows):
    """keep, size and digest by (id, text); rows that repeat share them."""
    strip = str.maketrans("", "", " \t\n\x0b\x0c\r")
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(strip)].append(r)
    out = {}
    for norm, found in groups.items():
        best = min(found, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        for r in found:
            out[(r[0], r[1])] = (best[0], len(found), hashlib.sha256(norm.encode()).hexdigest())
    return out


def test_edges(edge, edge_rows):
    found = exact_dedup(edge).collect()
    want = brute(edge_rows)
    assert len(found) == len(edge_rows)
    for r in found:
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) == want[(r["row"]["doc_id"], r["row"]["text"])]
    kept = [r["text_sha256"] for r in found if r["kept"]]
    assert len(kept) == len(set(kept)) == len({v[2] for v in want.values()})
    assert {r["row"]["doc_id"] for r in found if r["kept"]} >= {3, 7, 10, 11, 12}


def test_repeated_winner_is_kept_once(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "ab"), (2, "a b")]
    found = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["kept"] for r in found) == 1 and all(r["keep_id"] == 1 and r["group_size"] == 4 for r in found)


def test_clashing_fingerprints_are_told_apart_by_bytes(edge, edge_rows):
    """One fingerprint for all texts, or for two texts only."""
    for clash in (lambda norm: F.lit(7).cast("long"), lambda norm: F.when(F.length(norm) < 15, 7).otherwise(F.xxhash64(norm)).cast("long")):
        found = exact_dedup(edge, fingerprint=clash).collect()
        want = brute(edge_rows)
        assert sorted(str((r["row"]["doc_id"], r["row"]["text"], r["keep_id"], r["group_size"], r["text_sha256"])) for r in found) == sorted(str((x[0], x[1], *want[x[0], x[1]])) for x in edge_rows)
        kept = [r["text_sha256"] for r in found if r["kept"]]
        assert len(kept) == len(set(kept)) == len({v[2] for v in want.values()})


def test_null_ids_with_one_text(spark):
    rows = [(None, "same", i) for i in range(40)] + [(3, "other", 0)]
    found = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, fp int").repartition(4)).collect()
    assert sum(r["kept"] for r in found) == 2 and {(r["keep_id"], r["group_size"]) for r in found} == {(None, 40), (3, 1)}
    assert sorted(r["row"]["fp"] for r in found) == sorted(r[2] for r in rows)


def test_empty(none):
    assert exact_dedup(none).count() == 0
