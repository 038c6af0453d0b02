"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are its context, and its text
alone is trainable. Turns after the last reply close the conversation as an example without a target,
so that nothing is lost. Contexts of one conversation are prefixes of each other, hence ``segments``
keeps each formatted turn once: example e is the run of rows with ``example <= e``, its target the row
with ``example = e`` and a loss span. This stays as small as its input however many turns a
conversation has. ``expand`` writes the contexts out, for trainers that want one text per example, and
``read_examples`` reads them back.

A turn is ``<|im_start|>role``, a line break, its text, ``<|im_end|>`` and a line break. Control strings
inside roles and texts get a backslash after their first character, one more if they had some; taking
one away again restores them. Line breaks and backslashes of a role are escaped as well.

Turns are ordered by turn, then role and text, nulls first; a conversation is streamed through one
task in that order and never gathered. Null roles and texts are empty, rows without conv_id form one
conversation, repeated rows are turns of their own, roles other than ``assistant`` are context, other
columns are ignored, and an empty table has no segments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, TARGET = "<|im_start|>", "<|im_end|>", "assistant"
#: Control strings: a first character out of ``HEADS``, which stands nowhere else in them, and one of ``TAILS``.
HEADS = r"[<\[]"
TAILS = r"s>|/s>|INST\]|/INST\]|\|im_start\|>|\|im_end\|>|\|endoftext\|>"
ROWS_AT_ONCE, CHARS_AT_ONCE = 256, 1 << 22

_control = re.compile(rf"({HEADS})(\\*)({TAILS})")
_escaped = re.compile(rf"({HEADS})\\(\\*)({TAILS})")
_role_escaped = re.compile(r"\\([\\n])")

SEGMENTS = "conv_id long, position long, example long, start long, text string, loss_start long, loss_end long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    """The text without control strings."""
    return _control.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1\2\3", text)


def format_turn(role: str, text: str) -> tuple[str, int]:
    """A formatted turn and the place where its text begins."""
    head = f"{OPEN}{escape(role.replace('\\', '\\\\').replace('\n', '\\n'))}\n"
    return f"{head}{escape(text)}{CLOSE}\n", len(head)


def parse_turn(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    role, _, rest = piece[len(OPEN) :].partition("\n")
    role = _role_escaped.sub(lambda m: "\n" if m[1] == "n" else "\\", unescape(role))
    return role, unescape(rest[: -len(CLOSE) - 1])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Row by row; few rows at a time become Python strings."""
    for batch in batches:
        for low in range(0, len(batch), ROWS_AT_ONCE):
            yield from batch.slice(low, ROWS_AT_ONCE).to_pylist()


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    kept: list[tuple] = []
    chars = 0
    for row in rows:
        kept.append(row)
        chars += sum(len(x) for x in row if isinstance(x, str))
        if len(kept) == ROWS_AT_ONCE or chars >= CHARS_AT_ONCE:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), schema.types)], schema.names)
            kept, chars = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), schema.types)], schema.names)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        own, seen = None, False
        for row in _rows(batches):
            if not seen or row["conv_id"] != own:
                own, seen, position, example, start = row["conv_id"], True, 0, 1, 0
            piece, at = format_turn(row["role"] or "", row["text"] or "")
            position += 1
            target = row["role"] == TARGET
            span = (start + at, start + len(piece) - len(CLOSE) - 1) if target else (None, None)
            yield own, position, example, start, piece, *span
            example += target
            start += len(piece)

    yield from _batches(rows(), _arrow(SEGMENTS))


def segments(conversations: DataFrame) -> DataFrame:
    """Formatted turns with the example they first belong to; partitions hold whole conversations in order.

    ``start`` counts the code points of the conversation before the turn; ``loss_start`` and ``loss_end``
    are the span of a reply in the whole text of its example, null for turns that are context only.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    return turns.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_formatted, SEGMENTS)


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        own, example, text = None, 0, ""
        for row in _rows(batches):
            if row["position"] == 1:
                if text and not done:
                    yield own, example, text, None, None
                own, text = row["conv_id"], ""
            text += row["text"]
            example, done = row["example"], row["loss_start"] is not None
            if done:
                yield own, example, text, row["loss_start"], row["loss_end"]
        if text and not done:
            yield own, example, text, None, None

    yield from _batches(rows(), _arrow("conv_id long, example long, text string, loss_start long, loss_end long"))


def expand(formatted: DataFrame) -> DataFrame:
    """One row per example with its context written out. A row is as long as what it holds, so a
    conversation of n turns takes the square of n; ``formatted`` is what ``segments`` returned, or its
    rows dealt by conv_id and sorted by conv_id and position."""
    return formatted.mapInArrow(_expanded, "conv_id long, example long, text string, loss_start long, loss_end long")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        n = 0
        for row in _rows(batches):
            if row["position"] == 1:
                if n:
                    yield own, n, turns.hexdigest(), loss_chars, loss.hexdigest(), total + open_chars
                own, n, turns, loss_chars, loss, total = row["conv_id"], 0, sha256(), 0, sha256(), 0
            piece, start = row["text"], row["start"]
            role, text = parse_turn(piece)
            turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            n, open_chars = n + 1, start + len(piece)
            if row["loss_start"] is not None:
                reply = unescape(piece[row["loss_start"] - start : row["loss_end"] - start])
                loss.update(reply.encode("utf-8", "surrogatepass"))
                loss_chars, total, open_chars = loss_chars + len(reply), total + open_chars, 0
        if n:
            yield own, n, turns.hexdigest(), loss_chars, loss.hexdigest(), total + open_chars

    yield from _batches(rows(), _arrow(DIGESTS))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its formatted turns alone: number and digest of its turns, length and
    digest of all text under loss spans, and the code points of its examples with contexts written out."""
    return formatted.mapInArrow(_read_back, DIGESTS)


def _turns(text: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of an example; ``OPEN`` stands nowhere but where a turn begins."""
    at = 0
    while at < len(text):
        end = text.find(OPEN, at + 1)
        end = len(text) if end < 0 else end
        yield parse_turn(text[at:end])
        at = end


def _read_examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def digest(own: int | None, text: str, loss_chars: int, loss: str, total: int) -> tuple:
        n, turns = 0, sha256()
        for n, (role, said) in enumerate(_turns(text), 1):
            turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
        return own, n, turns.hexdigest(), loss_chars, loss, total

    def rows() -> Iterator[tuple]:
        text = None
        for row in _rows(batches):
            if row["example"] == 1:
                if text is not None:
                    yield digest(own, text, loss_chars, loss.hexdigest(), total)
                own, loss_chars, loss, total = row["conv_id"], 0, sha256(), 0
            text = row["text"]
            total += len(text)
            if row["loss_start"] is not None:
                reply = unescape(text[row["loss_start"] : row["loss_end"]])
                loss.update(reply.encode("utf-8", "surrogatepass"))
                loss_chars += len(reply)
        if text is not None:
            yield digest(own, text, loss_chars, loss.hexdigest(), total)

    yield from _batches(rows(), _arrow(DIGESTS))


def read_examples(formatted: DataFrame) -> DataFrame:
    """``read_back`` from the examples with their contexts written out: turns come from the last example of a
    conversation, which holds them all, replies from the loss span of each, lengths from every text.

    ``expand`` runs in the same task, so that its texts, the square of a conversation, stay where they are
    made; a task holds a few of them at a time."""
    return formatted.mapInArrow(lambda batches: _read_examples(_expanded(batches)), DIGESTS)
