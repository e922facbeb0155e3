"""Chat formatting by event-sourced reconstruction.

Events of a conversation, in order of sequence (and step within one), fold into final messages; messages render through a
template into one segment each, whose concatenation is the formatted conversation. Events (column `op`; null: message):

    message     a new message
    delta       appends its text to the message that started at `target`, or to the last one
    edit        replaces that message's text
    regenerate  drops that message and all after it, and starts a new message

`message_log` turns a table of finished messages into such a log, as a chat server would have written it: texts streamed in
deltas, some edited, some answers regenerated.

The template is `<turn role="ROLE">TEXT</turn>` and a line feed. Inside a text a backslash is doubled and `<turn` and
`</turn` get a backslash before them; in a role also a quotation mark does. A reader undoes that, so the formatted text
gives back the very messages.

Conversations are dealt by their id and sorted by sequence; a first pass over the sorted events gives each its message and
holds the starts of the open messages, numbers only. Events are then sorted by message (Spark's sort spills), and a second
pass folds one message at a time, so no conversation's texts are ever held together. Digests stream too.

Defined cases: a null text or role is empty; a null conv_id is a conversation of its own; a null sequence comes first;
ties of a sequence go by role, then text; repeated events repeat; a delta, edit or regenerate without its message starts
one; an empty table gives no row; further columns are ignored; ids of any type and size stay as they are.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.llm.common import trimmed

TURN = re.compile(r'<turn role="((?:[^"\\]++|\\.)*+)">((?:[^\\<]++|\\.|<(?!/?turn))*+)</turn>\n', re.S)
ESCAPED = re.compile(r"\\(.)", re.S)
def _escape(text: Column, quote: bool = False) -> Column:
    out = F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), "<(/?turn)", r"\\<$1")
    return F.replace(out, F.lit('"'), F.lit('\\"')) if quote else out


def _dealt(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def message_log(messages: DataFrame, conv: str = "conv_id", seq: str = "turn") -> DataFrame:
    """Events (conv_id, seq, step, op, target, role, text) of finished messages, dealt and sorted for fold(..., dealt=True).

    Every text starts with its first third and streams the rest in two deltas. By a hash of conversation, sequence and text, a
    third of the messages is first streamed backwards and then edited, and a third of the answers is regenerated.
    """
    rows = messages.select(F.col(conv).alias("conv_id"), F.col(seq).cast("long").alias("seq"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    event = lambda op, text: F.struct(F.lit(op).alias("op"), text.alias("text"))
    text = F.col("text")
    third = F.ceil(F.length(text) / 3).cast("int")
    parts = [F.substring(text, F.lit(1) + third * i, third) for i in range(3)]
    streamed = [event("delta", p) for p in parts[1:]]
    kind = F.pmod(F.xxhash64("conv_id", "seq", "text"), F.lit(3))
    edited = F.array(event("message", parts[0]), event("delta", F.reverse(text)), event("edit", parts[0]), *streamed)
    again = F.array(event("message", F.reverse(text)), event("delta", text), event("regenerate", parts[0]), *streamed)
    once = F.array(event("message", parts[0]), *streamed)
    events = F.when(kind == 0, edited).when((kind == 1) & (F.col("role") == "assistant"), again).otherwise(once)
    log = _dealt(rows, "seq", "role", "text").select("conv_id", "seq", "role", F.posexplode(events).alias("step", "e"))
    return log.select("conv_id", "seq", "step", F.col("e.op").alias("op"), F.lit(None).cast("long").alias("target"), "role", F.col("e.text").alias("text"))


def fold(events: DataFrame, conv: str = "conv_id", seq: str = "turn", dealt: bool = False) -> DataFrame:
    """Final messages (conv_id, message, role, text), sorted within partitions; all of a conversation in one partition.

    dealt: the rows are message_log()'s, in its order.
    """
    column = lambda name, kind: F.col(name).cast(kind) if name in events.columns else F.lit(None).cast(kind)
    rows = events.select(
        F.col("conv_id" if dealt else conv).alias("conv_id"), F.col("seq" if dealt else seq).cast("long").alias("seq"), column("step", "int").alias("step"),
        F.lower(F.coalesce(column("op", "string"), F.lit("message"))).alias("op"), column("target", "long").alias("target"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    kind = rows.schema["conv_id"].dataType
    said, arrow = kind.simpleString(), to_arrow_type(kind)
    if not dealt:
        rows = _dealt(rows, "seq", "step", "role", "text")

    def place(batches):
        """Each event with the number of its message, and a row for each message that an event drops."""
        current, starts, open_, made, at = None, [], [], 0, 0  # sequences and numbers of the open messages
        for batch in batches:
            out = []
            for i, (c, s, op, t) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("conv_id", "seq", "op", "target")))):
                if current is None or current[0] != c:
                    current, starts, open_, made, at = (c,), [], [], 0, 0
                k = len(open_) - 1
                if t is not None:
                    k = next((j for j in range(len(starts) - 1, -1, -1) if starts[j] == t), -1)
                if op not in ("delta", "edit") or k < 0:
                    if op == "regenerate" and k >= 0:
                        out += [(i, n, at, "drop") for n in open_[k:]]
                        del open_[k:], starts[k:]
                    open_.append(made)
                    starts.append(s)
                    out.append((i, made, at, "message"))
                    made += 1
                else:
                    out.append((i, open_[k], at, op))
                at += 1
            index, number, order, ops = (list(x) for x in zip(*out)) if out else ([], [], [], [])
            of = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id").take(of), pa.array(number, pa.int64()), pa.array(order, pa.int64()), pa.array(ops, pa.string()), batch.column("role").take(of), batch.column("text").take(of)],
                names=["conv_id", "message", "at", "op", "role", "text"],
            )

    placed = rows.mapInArrow(trimmed(place), f"conv_id {said}, message long, at long, op string, role string, text string").sortWithinPartitions("conv_id", "message", "at")

    def join(batches):
        """One row for each message that isn't dropped."""
        current, parts, last, n_of = None, None, None, 0  # (conversation, message, role), its text so far (None: dropped)

        def message():
            nonlocal last, n_of
            n_of = n_of + 1 if last == current[:1] else 0
            last = current[:1]
            return current[0], n_of, current[2], "".join(parts)

        for batch in batches:
            out = []
            for c, n, op, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "message", "op", "role", "text"))):
                if current is None or current[:2] != (c, n):
                    if parts is not None:
                        out.append(message())
                    current, parts = (c, n, role), []
                if op == "drop":
                    parts = None
                elif parts is not None:
                    if op == "edit":
                        parts = []
                    parts.append(text)
            yield told(out)
        if parts is not None:
            yield told([message()])

    def told(out):
        c, n, role, text = zip(*out) if out else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, arrow), pa.array(n, pa.int64()), pa.array(role, pa.string()), pa.array(text, pa.string())], names=["conv_id", "message", "role", "text"])

    return placed.mapInArrow(trimmed(join), f"conv_id {said}, message long, role string, text string")


def render(messages: DataFrame) -> DataFrame:
    """messages with segment, and loss_start and loss_end: the code points of it under the loss mask (none: both 0)."""
    head = F.concat(F.lit('<turn role="'), _escape(F.col("role"), quote=True), F.lit('">'))
    body = _escape(F.col("text"))
    loss = F.col("role") == "assistant"
    return messages.select(
        "conv_id",
        "message",
        F.concat(head, body, F.lit("</turn>\n")).alias("segment"),
        F.when(loss, F.length(head)).otherwise(0).cast("long").alias("loss_start"),
        F.when(loss, F.length(head) + F.length(body)).otherwise(0).cast("long").alias("loss_end"),
    )


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((ESCAPED.sub(r"\1", m[1]), ESCAPED.sub(r"\1", m[2])))
        at = m.end()
    return out


def digests(segments: DataFrame) -> DataFrame:
    """Per conversation what its formatted text says when read back; streams over render()'s partitions."""
    kind = segments.schema["conv_id"].dataType
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        current, rest, state = None, "", None

        def row():
            if rest:
                raise ValueError("a formatted conversation ends within a turn")
            n, turns, chars, loss, total = state
            return (current[0], n, turns.hexdigest(), chars, loss.hexdigest(), total)

        def told(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names=names)

        for batch in batches:
            out = []
            for c, segment, a, b in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "segment", "loss_start", "loss_end"))):
                if current is None or current[0] != c:
                    if current is not None:
                        out.append(row())
                    current, rest, state = (c,), "", [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if b > a:
                    text = ESCAPED.sub(r"\1", segment[a:b])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(segment)
                rest += segment
                while m := TURN.match(rest):
                    role, text = (ESCAPED.sub(r"\1", x) for x in m.groups())
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    rest = rest[m.end() :]
            yield told(out)
        if current is not None:
            yield told([row()])

    schema = [T.StructField("conv_id", kind)] + [T.StructField(n, T.StringType() if "sha" in n else T.LongType()) for n in names[1:]]
    return segments.mapInArrow(trimmed(run), T.StructType(schema))
