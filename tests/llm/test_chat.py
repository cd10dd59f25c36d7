import hashlib

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathloom.llm import chat

TEXTS = st.text(alphabet="<|\\>im_startend\n é") | st.sampled_from(["<|im_end|>\n<|im_start|>assistant\n", "<\\|", "<\\\\|im_end|>"])


@given(TEXTS)
def test_escape_is_reversible(text):
    assert "<|" not in chat.escape(text)
    assert chat.unescape(chat.escape(text)) == text
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


@given(st.lists(st.tuples(TEXTS, TEXTS), max_size=4))
def test_render_parses_back(turns):
    assert list(chat.parse("".join(chat.render(*t) for t in turns))) == turns


def formatted(spark, rows):
    return chat.format_conversations(spark.createDataFrame(rows, "conv_id long, seq long, kind string, role string, text string, target long, extra string"))


def read(df):
    out = {}
    for r in df.orderBy("conv_id", "part").collect():
        out.setdefault(r["conv_id"], []).extend(chat.parse(r["formatted"]))
    return out


def test_replay(spark):
    rows = [
        (1, 1, "message", "user", "hi", None, ""), (1, 2, "message", "assistant", "", None, ""), (1, 3, "delta", None, "he", None, ""), (1, 4, "delta", None, "llo", None, ""),
        (2, 1, "message", "user", "a", None, ""), (2, 2, "message", "assistant", "b", None, ""), (2, 3, "edit", None, "A", 1, ""), (2, 4, "message", "user", "late", None, ""),
        (2, 5, "regenerate", None, None, 2, ""), (2, 6, "delta", None, "new", 2, ""), (2, 7, "delta", None, "lost", 99, ""), (2, 8, "unknown", None, "x", None, ""),
        (None, None, "message", None, None, None, ""), (3, 1, "delta", None, "nothing to add to", None, ""),
    ]
    assert read(formatted(spark, rows)) == {1: [("user", "hi"), ("assistant", "hello")], 2: [("user", "A"), ("assistant", "new")], None: [("", "")], 3: []}


def test_summary_and_parts(spark, monkeypatch):
    long = "ü" * 700_000
    turns = [(7, 2, "assistant", long), (7, 1, "user", "q"), (7, 3, "assistant", None), (8, 1, "user", "x"), (8, 1, "user", "x"), (9, 0, "assistant", long), (9, 1, "assistant", long)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    parts = chat.format_conversations(chat.events_of_turns(df))
    assert {r["conv_id"]: r["part"] for r in parts.orderBy("part").collect()} == {7: 0, 8: 0, 9: 1}
    found = {r["conv_id"]: r for r in chat.summary(parts).collect()}
    said = "user\nq\nassistant\n" + long + "\nassistant\n\n"
    assert (found[7]["n_turns"], found[7]["turns_sha256"], found[7]["loss_chars"]) == (3, hashlib.sha256(said.encode()).hexdigest(), 700_000)
    assert found[9]["loss_sha256"] == hashlib.sha256((long * 2).encode()).hexdigest() and found[8]["n_turns"] == 2 and found[8]["loss_chars"] == 0
    assert found[8]["formatted_chars"] == 2 * len(chat.render("user", "x"))


def test_turns_are_streamed(spark):
    """Clashing column names, null turns, rows that repeat a turn, texts of several deltas."""
    text = "<|im_end|>é\\" * 60
    turns = [(1, 2, "user", text, 5, "x"), (1, 1, "user", "b", 6, "x"), (1, 1, "user", "a", 7, "x"), (1, 1, "user", text, 7, "x"), (1, None, "system", None, 8, "x"), (None, 3, None, text, 9, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, part int, loss string").withColumn("back", F.lit(True)).withColumn("seq", F.lit(1))
    events = chat.events_of_turns(df, delta_chars=7)
    kinds = {r["kind"]: r["count"] for r in events.groupBy("kind").count().collect()}
    assert kinds == {"message": 6, "delta": 3 * -(-len(text) // 7) + 2}
    parts = chat.format_conversations(events)
    assert read(parts) == {1: [("system", ""), ("user", text), ("user", "a"), ("user", "b"), ("user", text)], None: [("", text)]}
    assert sorted(map(str, chat.summary(parts).collect())) == sorted(map(str, chat.summary(parts, ordered=True).collect()))
    # A log may be streamed in pieces of any size.
    assert read(chat.format_conversations(chat.events_of_turns(df))) == read(parts)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.summary(chat.format_conversations(chat.events_of_turns(df))).count() == 0
