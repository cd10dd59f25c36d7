import __spark_entry__
import corpus_pipeline as c
from pathloom.llm.queries import ORACLE_SQL, QUERIES
from pathloom.shared import save_table


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries()) and set(ORACLE_SQL) <= set(QUERIES)


def test_stages_on_planted_cases(spark, tmp_path):
    words = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'en' and length(text) between 800 and 3000").orderBy("doc_id").limit(40).collect()
    rows = [(i, r["text"], "en", "s", r["n_chars"]) for i, r in enumerate(words)]
    item = " ".join(f"secret{i} passage{i}" for i in range(12))
    base = rows[0][1].split()
    near = " ".join(base[:40] + ["altered"] + base[41:])
    rows += [(100, rows[3][1] + "\n", "en", "s", 1), (101, near, "en", "s", 1), (102, rows[5][1] + " " + item, "en", "s", 1), (103, "Совершенно другой язык без единой знакомой буквы", None, "s", 1), (104, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = {}
    for name, stage in c.STAGES[:-1]:
        before = docs.columns
        docs = save_table(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == before
        ids[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert not ids["language ID"] & {103, 104} and ids["language ID"] >= set(range(40)) | {100, 101, 102}
    assert 100 in ids["exact dedup"] and 3 not in ids["exact dedup"]
    assert 101 not in ids["near dedup"] and 0 in ids["near dedup"]
    assert 102 not in ids["decontamination"]
    packed = c.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == ids["decontamination"]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id long, component_id long, matches int"


def through(spark, rows, items, path):
    """The ids that each stage keeps, and the columns and rows of packing."""
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    for _, stage in c.STAGES[:-1]:
        found = save_table(stage(spark, docs, str(path)), "stage")
        assert found.columns == docs.columns
        docs = found
        kept.append(sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect()))
    return kept, c.STAGES[-1][1](spark, docs, str(path))


def test_empty_table(spark, tmp_path):
    kept, packed = through(spark, [], [(1, "some benchmark item with more than eight words in it")], tmp_path)
    assert kept == [[]] * 4 and packed.count() == 0 and packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_null_and_repeated_rows(spark, tmp_path):
    extra = ("r", 1, 2, 3)
    long = " ".join(f"word{i} and more of the same kind here" for i in range(4000))
    text = "this is a plain english text with quite a few words that a language model can tell from noise number {}"
    rows = [(i, text.format(" ".join(chr(97 + (i * k) % 26) * 3 for k in range(1, 9))), "en", "s", 1, *extra) for i in range(1, 31)]
    rows += [(None, None, None, None, None, None, None, None, None), (40, None, "en", "s", 1, *extra), (41, "", "en", "s", 1, *extra), (42, " \n", None, None, 0, *extra), (43, "?!", "en", "s", 1, *extra)]
    rows += [(50, long, "en", "s", 1, *extra), (50, long, "en", "s", 1, *extra), (None, long + " end", "en", "s", 1, *extra), (51, None, None, None, None, None, None, None, None)]
    kept, packed = through(spark, rows, [(1, None), (None, ""), (2, "words that no document has in this order at all")], tmp_path)
    assert not {"40", "41", "42", "43", "51"} & set(kept[0]) and {"50", "None"} <= set(kept[0])
    assert kept[1].count("50") == 1 and kept[1].count("None") == 1
    # A row without an id takes no part in near dedup.
    assert "50" in kept[2] and "None" in kept[2] and kept[3] == kept[2]
    assert sorted({str(r["doc_id"]) for r in packed.collect()}) == sorted(set(kept[3]))
