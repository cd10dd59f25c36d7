"""Files, subtree graphs and micro-batches: what is written is read again."""

import zlib

import pytest
from pyspark.sql import functions as F

from pathloom import catalog
from pathloom.functions.policy import SUM
from pathloom.operators.frame import PathFrame
from pathloom.shared import delete_path, new_path, save_table, shared_dir
from pathloom.sources import dag, path_files, tables
from pathloom.streaming import upsert


def back(t):
    return {bytes(r["path"]): r["value"] for r in t.df.collect()}


PATHS = [b"", b"\0", b"a\nb", b"ab", bytes(range(256)), "é".encode() * 200]


def test_stream_format():
    [(blob, stats)] = path_files.deflated(iter([b"ab", b""]))
    assert zlib.decompress(blob) == b"\x02\0\0\0ab\0\0\0\0" and stats == path_files.Stats(len(blob), 10, 2)
    assert list(path_files.inflated(blob + b"\ntrailing")) == [b"ab", b""]
    with pytest.raises((ValueError, zlib.error)):
        list(path_files.inflated(blob[:-3]))


def test_long_streams(monkeypatch):
    monkeypatch.setattr(path_files, "CHUNK", 7)
    paths = [bytes([i % 251]) * (i % 40) for i in range(500)]
    streams = list(path_files.deflated(iter(paths), 1000))
    assert len(streams) > 5 and [p for blob, _ in streams for p in path_files.inflated(blob)] == paths
    assert sum(s.path_count for _, s in streams) == 500


def test_path_files(spark, tmp_path):
    t = PathFrame.from_items(spark, [(p, i) for i, p in enumerate(PATHS)])
    stats = path_files.write_paths(t, f"{tmp_path}/p", files=3)
    assert stats.path_count == len(PATHS) and stats.bytes_in == sum(len(p) + 4 for p in PATHS)
    assert set(back(path_files.read_paths(spark, f"{tmp_path}/p"))) == set(PATHS)
    host = PathFrame.from_items(spark, [(b"k/x", 1), (b"k", 2), (b"m", 3)])
    put = path_files.load_at(host, b"k", f"{tmp_path}/p", F.lit(7).cast("long"))
    assert back(put) == {b"k" + p: 7 for p in PATHS} | {b"m": 3}
    both = path_files.load_at(host, b"k", f"{tmp_path}/p", F.lit(7).cast("long"), mode="merge")
    assert back(both) == {b"k" + p: 7 for p in PATHS} | {b"k/x": 1, b"k": 2, b"m": 3}
    path_files.write_paths(t, f"{tmp_path}/small", files=2, values=f"{tmp_path}/values", stream_bytes=5)
    assert sum(1 for f in (tmp_path / "small").iterdir() if f.suffix == ".txt") >= len(PATHS) - 2
    assert back(path_files.read_paths(spark, f"{tmp_path}/small", values=f"{tmp_path}/values")) == back(t)
    none = path_files.write_paths(PathFrame.empty(spark), f"{tmp_path}/none")
    assert none.path_count == 0 and back(path_files.read_paths(spark, f"{tmp_path}/none")) == {}


def test_graph(spark, tmp_path):
    items = {b"a/x": 1, b"a/y": 2, b"b/x": 1, b"b/y": 2, b"": 9, b"a": 3}
    t = PathFrame.from_items(spark, items.items())
    dag.write_dag(t, f"{tmp_path}/g")
    assert back(dag.read_dag(spark, f"{tmp_path}/g")) == items
    stored = spark.read.parquet(f"{tmp_path}/g/nodes").count()
    assert stored < len({k[:i] for k in items for i in range(len(k) + 1)})
    dag.write_dag(PathFrame.empty(spark), f"{tmp_path}/e")
    assert back(dag.read_dag(spark, f"{tmp_path}/e")) == {}
    meta = dag.read_meta(spark, f"{tmp_path}/g")
    # The two subtrees x, y are one; with them the root, b/ and the leaves.
    assert meta["paths"] == 6 and meta["subtrees"] == stored and bytes(meta["top"]) == b""
    chain = PathFrame.from_items(spark, [(b"abc/long", 1)])
    dag.write_dag(chain, f"{tmp_path}/c")
    assert back(dag.read_dag(spark, f"{tmp_path}/c")) == {b"abc/long": 1} and dag.read_meta(spark, f"{tmp_path}/c")["subtrees"] == 1


def test_sorted_tables(spark, tmp_path):
    t = PathFrame.from_items(spark, [(f"{i:03d}".encode(), i) for i in range(100)])
    tables.write_sorted(t, f"{tmp_path}/t", files=4)
    assert back(tables.read_sorted(spark, f"{tmp_path}/t")) == back(t)
    assert sorted(back(tables.read_below(spark, f"{tmp_path}/t", b"01")).values()) == list(range(10, 20))
    assert sorted(back(tables.read_range(spark, f"{tmp_path}/t", b"01", b"013")).values()) == [10, 11, 12]
    assert {bytes(r["path"]): r["place"] for r in t.ranked().collect()} == back(t)


def test_text_sources(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("1\tParis\n2\tRome\n3\tParis\n")
    t = tables.read_delimited(spark, str(tmp_path / "c.tsv"), "name", F.col("id"), "id long, name string")
    assert back(t) == {b"Paris": 3, b"Rome": 2}
    lines = spark.createDataFrame([("# head",), ("A000001 ,0,1,-2,",), ("A000002 ,",)], "l string")
    assert {r["name"]: list(r["numbers"]) for r in tables.sequences(lines, F.col("l")).collect()} == {"A000001": [0, 1, -2], "A000002": []}
    assert back(tables.words(spark.createDataFrame([("To be, or not to be",)], "t string"), F.col("t"))) == {b"to": 2, b"be": 2, b"or": 1, b"not": 1}


def test_micro_batches(spark, tmp_path):
    schema, source = "path binary, value long, seq long", f"{tmp_path}/in"
    for rows in ([(b"a", 1, 1), (b"a", 2, 2), (b"b", 5, 1)], [(b"a", 10, 3), (b"c", 1, 4)]):
        spark.createDataFrame([(bytearray(p), v, s) for p, v, s in rows], schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        upsert.join_batches(stream, f"{tmp_path}/t", f"{tmp_path}/c", SUM).awaitTermination(120)
    assert back(upsert.current(spark, f"{tmp_path}/t")) == {b"a": 12, b"b": 5, b"c": 1} and len(upsert.versions(spark, f"{tmp_path}/t")) == 2
    assert back(upsert.current(spark, f"{tmp_path}/t", before=1)) == {b"a": 2, b"b": 5}
    # The second version has the buckets of its own paths only.
    assert len(list((tmp_path / "t" / "v=1").glob("bucket=*"))) <= 2
    for k in range(3):
        spark.createDataFrame([(bytearray(b"a"), 1, 9 + k), (bytearray(b"b"), 1, 9 + k), (bytearray(b"c"), 1, 9 + k)], schema).write.mode("append").parquet(source)
        upsert.join_batches(spark.readStream.schema(schema).parquet(source), f"{tmp_path}/t", f"{tmp_path}/c", SUM).awaitTermination(120)
    assert back(upsert.current(spark, f"{tmp_path}/t")) == {b"a": 15, b"b": 8, b"c": 4} and upsert.versions(spark, f"{tmp_path}/t") == [3, 4]


def test_shared_tables(spark):
    assert new_path(spark, "x") != new_path(spark, "x") and new_path(spark, "x").startswith(shared_dir(spark))
    df = save_table(spark.range(5).withColumn("s", F.lit("x")), "t")
    assert df.count() == 5 and df.columns == ["id", "s"]
    path = new_path(spark, "gone")
    spark.range(1).write.parquet(path)
    delete_path(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_repeated_urls(spark, tmp_path):
    # Pages repeat an url: files and queries keep every record, a path table one of each path.
    urls = ["http://a/x", "http://a/x", "http://b/", "http://a/x"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    found = [bytes.fromhex(r["hex"]).decode() for r in catalog.QUERIES["paths_roundtrip"](spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(urls)
    # Below a subtree as well, whose other paths stay.
    for name, cols in {"region": [(0, "ASIA"), (1, "EUROPE")], "nation": [(0, 0, "INDIA"), (1, 1, "FRANCE")], "customer": [(1, 0, "m", "c1"), (2, 1, "m", "c2")]}.items():
        schema = {"region": "r_regionkey long, r_name string", "nation": "n_nationkey long, n_regionkey long, n_name string", "customer": "c_custkey long, c_nationkey long, c_mktsegment string, c_name string"}[name]
        spark.createDataFrame(cols, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found = [(bytes.fromhex(r["hex"]).decode(), r["value"]) for r in catalog.QUERIES["paths_load_at"](spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted([("ASIA/" + u, len(u)) for u in urls] + [("EUROPE/FRANCE/m/c2", 2)])
    path_files.write_paths(PathFrame.from_items(spark, [(b"a", 1)]), f"{tmp_path}/p")
    with pytest.raises(ValueError):
        path_files.load_at(PathFrame.empty(spark), b"k", f"{tmp_path}/p", mode="merge", repeats=True)
