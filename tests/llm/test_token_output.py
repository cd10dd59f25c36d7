import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import token_output as t
from pathloom.llm.tokens import END_ID, Encoder, default_path
from pathloom.shared import new_path


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(n):
    p = t.Permutation(n, "key")
    slots = p.slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and p.numbers(slots).tolist() == list(range(n))
    if n >= 64:
        assert slots.tolist() != t.Permutation(n, "other").slots(np.arange(n)).tolist() != list(range(n))


def test_round_trip_and_resume(spark, edge, edge_rows):
    out = new_path(spark, "order")
    total = t.write_training_order(edge, default_path(), out, sequence=32, shard_records=50)
    rows = t.read_training_order(spark, out, sequence=32, shard_records=50).collect()
    assert sorted(r["slot"] for r in rows) == list(range(total))
    encoder, want = Encoder(default_path()), []
    for i, text, *_ in edge_rows:
        ids = encoder.ids(text or "") + [END_ID]
        want += [(str(i), k, tuple(ids[a : a + 32])) for k, a in enumerate(range(0, len(ids), 32))]
    assert sorted((str(r["id"]), r["piece"], tuple(np.frombuffer(r["ids"], "<u2").tolist())) for r in rows) == sorted(want)
    later = t.read_training_order(spark, out, start=120, sequence=32, shard_records=50).collect()
    assert sorted(map(str, later)) == sorted(str(r) for r in rows if r["slot"] >= 120)
    sizes = {r["path"]: r["length"] for r in spark.read.format("binaryFile").load(out).select("path", "length").collect()}
    assert len(sizes) == -(-total // 50) and sum(sizes.values()) == total * t.stride(32)
    assert sorted(sizes.values())[-2:] == [50 * t.stride(32)] * 2


def test_slots_are_those_of_the_permutation(spark, edge):
    """Turned back, the slots of a document's pieces are numbers that follow each other."""
    out = new_path(spark, "order")
    total = t.write_training_order(edge, default_path(), out, key="k", sequence=16, shard_records=40)
    rows = sorted(t.read_training_order(spark, out, sequence=16, shard_records=40).where("id in (10, 7)").collect(), key=lambda r: (r["id"], r["piece"]))
    numbers = t.Permutation(total, "k").numbers(np.array([r["slot"] for r in rows]))
    for i in (7, 10):
        mine = [int(n) for n, r in zip(numbers, rows) if r["id"] == i]
        assert len(mine) > 1 and mine == list(range(mine[0], mine[0] + len(mine)))


def test_shards_are_dealt_by_ranges(spark):
    placed = spark.range(1000).select(F.lit(b"r").alias("record"), F.col("id").alias("slot"))
    dealt = t.dealt_shards(placed, 100, 2, 8)
    assert dealt.rdd.getNumPartitions() == 6
    parts = dealt.select("slot", F.spark_partition_id().alias("p")).collect()
    assert sorted(r["slot"] for r in parts) == list(range(200, 800))
    shards = {}
    for r in parts:
        shards.setdefault(r["p"], []).append(r["slot"])
    assert shards == {p: list(range(200 + 100 * p, 300 + 100 * p)) for p in range(6)}


def test_wide_ids():
    ids = np.array([1, 70_000, 2], "<u4")
    raw = b"??" + t.packed_record(5, 3, ids)
    assert t.unpacked_record(raw, 2, 4) == (5, 3, 3, ids.tobytes()) and t.stride(8, 4) - t.stride(8) == 16
    assert t.id_width(default_path()) == 2


def test_empty(spark, none):
    assert t.write_training_order(none, default_path(), new_path(spark, "order")) == 0
