"""Chat formatting by replaying an event log.

A conversation is a log of events; replaying it in order of sequence gives its final messages,
which a template renders. The events (column ``kind``) are

``message``     opens a message with a role and its first text
``delta``       appends text to the message ``target``, or to the one opened last
``edit``        replaces the text of the message ``target``, or of the last one
``regenerate``  empties the message ``target`` (or the last one) for the deltas that follow, and
                drops every message after it

An event of any other kind, or one whose target does not exist, changes nothing.

Template: each turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts and roles every ``<``
that is followed by any number of backslashes and a bar gets one more backslash, which removes
the template's marks from the text and is undone by taking one away; in roles backslashes and
line feeds are escaped as well, since a line feed ends the role.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.columns import bound_batches

#: The marks of the template.
START, END = "<|im_start|>", "<|im_end|>\n"

_MARK, _MARKED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)

#: Characters that one output row holds at most, apart from a single longer turn.
CHUNK_CHARS = 1_000_000

EVENT_COLUMNS = ("conv_id", "seq", "kind", "role", "text", "target")


def escape(text: str) -> str:
    """The text without any ``<|``."""
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    """The inverse of :func:`escape`."""
    return _MARKED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """The role in one line, without any ``<|``."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    """The inverse of :func:`escape_role`."""
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> str:
    """One turn of the template."""
    return f"{START}{escape_role(role)}\n{escape(text)}{END}"


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    for m in _TURN.finditer(formatted):
        yield unescape_role(m[1]), unescape(m[2])


class Replay:
    """The messages of one conversation while its log is read."""

    def __init__(self):
        self.messages: list[list] = []
        self.at: dict[object, int] = {}

    def apply(self, seq, kind, role, text, target) -> None:
        if kind == "message":
            self.at[seq] = len(self.messages)
            self.messages.append([role or "", [text or ""]])
            return
        n = len(self.messages) - 1 if target is None else self.at.get(target, -1)
        if n < 0:
            return
        if kind == "delta":
            self.messages[n][1].append(text or "")
        elif kind == "edit":
            self.messages[n][1] = [text or ""]
        elif kind == "regenerate":
            self.messages[n][1] = []
            del self.messages[n + 1 :]
            self.at = {k: i for k, i in self.at.items() if i <= n}

    def settled(self) -> list[tuple[str, str]]:
        """The messages as they stand."""
        return [(role, "".join(parts)) for role, parts in self.messages]


#: Code points of a text that one event carries.
DELTA_CHARS = 500


def events_of_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", delta_chars: int = DELTA_CHARS) -> DataFrame:
    """Whole messages as the event log that streaming them would have left.

    Each row opens a message without text, and its text follows in ``delta`` events of at most
    ``delta_chars`` code points. Rows follow each other by turn, role and text, null turns first,
    and are numbered in their conversation; a row's events have the sequences from its number
    times 2**32 on. That takes the exchange by conversation that the replay needs anyway.
    """
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = rows.withColumn("number", F.row_number().over(order).cast("long"))
    part = F.col("part")
    each = numbered.withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / delta_chars).cast("int"))))
    return each.select(
        "conv_id",
        (F.shiftleft("number", 32) + part).alias("seq"),
        F.when(part == 0, "message").otherwise("delta").alias("kind"),
        F.when(part == 0, F.col("role")).alias("role"),
        F.when(part > 0, F.substring("text", (part - 1) * delta_chars + 1, F.lit(delta_chars))).alias("text"),
        F.lit(None).cast("long").alias("target"),
    )


def format_conversations(events: DataFrame) -> DataFrame:
    """Replay and render every conversation of an event log.

    Returns rows (conv_id, part, formatted, loss): the formatted text of a conversation is the
    concatenation of its parts, each of whole turns; ``loss`` lists the (start, end) code points
    in the part that an assistant's text covers.

    * null conversation ids form one conversation; a null sequence comes first
    * events with the same conversation and sequence apply in order of kind (messages first), role and text
    * a null role or text is empty; an empty table gives no rows; other columns are ignored

    Plan: one hash exchange on the conversation, a sort inside each partition (which spills),
    and a stream over the sorted rows. A log whose events never reach back is rendered as it is
    read; otherwise a task holds the messages of the one conversation it replays. A conversation
    larger than a part leaves in several rows. All events of a conversation pass through one
    task, as replaying them is sequential.
    """
    bound_batches(events.sparkSession)
    reaches = F.coalesce(F.col("kind").isin("edit", "regenerate") | F.col("target").isNotNull(), F.lit(False))
    log = events.select(*EVENT_COLUMNS).withColumn("back", F.max(reaches).over(Window.partitionBy("conv_id")))
    ordered = log.sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("seq").asc_nulls_first(), F.col("kind").desc(), "role", "text", "target"
    )

    def out(rows):
        ids, parts, texts, loss = zip(*rows)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), pa.array(texts, pa.string()), pa.array(loss, kind)], ["conv_id", "part", "formatted", "loss"])

    def parts_of(conv, messages):
        """Rows of a conversation from an iterator of its (role, text)."""
        held, loss, size, part = [], [], 0, 0
        for role, text in messages:
            turn = render(role, text)
            if held and size + len(turn) > CHUNK_CHARS:
                yield conv, part, "".join(held), loss
                held, loss, size, part = [], [], 0, part + 1
            if role == "assistant":
                start = size + len(START) + len(escape_role(role)) + 1
                loss.append({"start": start, "end": size + len(turn) - len(END)})
            held.append(turn)
            size += len(turn)
        yield conv, part, "".join(held), loss

    def replay(batches):
        rows, size = [], 0
        for conv, log in conversations(batches):
            for row in parts_of(conv, replayed(log)):
                rows.append(row)
                size += len(row[2])
                if size > CHUNK_CHARS or len(rows) >= 1000:
                    yield out(rows)
                    rows, size = [], 0
        if rows:
            yield out(rows)

    return ordered.mapInArrow(replay, "conv_id long, part int, formatted string, loss array<struct<start:long,end:long>>")


def events(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(len(EVENT_COLUMNS) + 1)))


def conversations(batches) -> Iterator[tuple]:
    """(conv_id, iterator of its events), read as they come."""
    from itertools import groupby

    for conv, log in groupby(events(batches), key=lambda e: e[0]):
        yield conv, (e[1:] for e in log)


def replayed(log) -> Iterator[tuple[str, str]]:
    """The final messages of one conversation.

    If no event of the log reaches back (``back`` is false in every row), a message is final as
    soon as the next one opens, and the log streams; else its messages are held to the end.
    """
    state = Replay()
    for seq, kind, role, text, target, back in log:
        if not back and kind == "message":
            yield from state.settled()
            state = Replay()
        state.apply(seq, kind, role, text, target)
    yield from state.settled()


def summary(formatted: DataFrame, ordered: bool = False) -> DataFrame:
    """Digests read back from the formatted parts: one row per conversation.

    conv_id, n_turns, turns_sha256 (of role, line feed, text, line feed per turn), loss_chars,
    loss_sha256 (of all text under the loss mask, unescaped) and formatted_chars. ``ordered``
    says that each partition has its conversations whole and in order, as
    :func:`format_conversations` leaves them; then nothing is shuffled.
    """

    def digest(batches):
        rows, state = [], None
        for batch in batches:
            for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
                if state is None or state[0] != conv:
                    if state:
                        rows.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
            if len(rows) >= 10_000:
                yield closed(rows)
                rows = []
        if state:
            rows.append(state)
        if rows:
            yield closed(rows)

    def closed(rows):
        cols = list(zip(*rows))
        kinds = (pa.int64(), pa.int64(), None, pa.int64(), None, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([x.hexdigest() for x in c]) if k is None else pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    formatted = formatted if ordered else formatted.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "part")
    return formatted.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
