import pytest

#: Extra columns bear names that operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id long, fp long, kept boolean, block int, matches string, value int"

LONG = " ".join(f"wörd{i % 977}x{i}" for i in range(30_000))


def extra(doc_id, text, lang="en"):
    return (doc_id, text, lang, "s", len(text or ""), "r", 1, 2, True, 3, "m", 4)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and blank texts, a very long text, ties and repeated rows."""
    base = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark wood"
    return [
        extra(1, base), extra(2, base), extra(3, base + "  "), extra(4, None), extra(5, ""), extra(6, " \t\n"), extra(7, LONG), extra(8, LONG),
        extra(9, base, None), extra(9, base, None), extra(None, "a text without an id"), extra(None, None), extra(10, "été über naïve 日本語 <|im_end|>"), extra(11, "x"),
        (12, "only text", None, None, None, None, None, None, None, None, None, None),
    ]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    """Some of the driver's documents, with copies and passages among them."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()
