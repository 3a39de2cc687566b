"""Chat formatting with compiled templates, and the reader that takes the text apart again.

A conversation is all rows of a ``conv_id``, ordered by turn (nulls first), then role, then text.
Rows are dealt by conversation, sorted inside the partition and rendered in a stream, one message
in memory at a time, so a conversation of any length needs no more room than its longest message.

Reversible escape: inside texts and roles ``\\`` becomes ``\\\\`` and ``<|`` becomes ``\\<|``, so a
control string never appears in escaped text, and :func:`unescape` gives the original back.

Defined results: null text or role is the empty string; a null ``conv_id`` is a conversation of its
own; repeated rows are turns of their own; an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.common import shuffle_width
from surveyspark.llm.template import ChatTemplate

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
TEMPLATE = (
    "{% for m in messages %}"
    "{{ '<|' + 'turn|>' }}{{ m.role | escape }}<|text|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}<|end|>\n"
    "{% endfor %}"
)
SCAN = re.compile(r"\\.|<\|(?:turn|text|end)\|>", re.S)
ESCAPED = re.compile(r"\\(.)", re.S)
PIECES = "conv_id long, piece_no long, piece string, marks array<struct<start:long,end:long>>, last boolean"
DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "\\<|")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


FILTERS = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


def ordered_turns(df: DataFrame) -> DataFrame:
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
                     F.coalesce("text", F.lit("")).alias("text"))
    return (rows.repartition(shuffle_width(df.sparkSession), "conv_id")
            .sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text"))


def _rows(batches, *names: str):
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def _batched(rows, schema: pa.Schema, limit: int = 1 << 22):
    """Arrow batches of about ``limit`` characters."""
    held, size = [], 0
    for row, weight in rows:
        held.append(row)
        size += weight + 64
        if size >= limit:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


PIECE_ARROW = pa.schema([("conv_id", pa.int64()), ("piece_no", pa.int64()), ("piece", pa.string()),
                         ("marks", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                         ("last", pa.bool_())])
DIGEST_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                          ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def render(df: DataFrame, source: str = TEMPLATE) -> DataFrame:
    """One row per message: its piece of the formatted text; a conversation is its pieces in order."""
    ChatTemplate(source, FILTERS)  # a bad template fails here, not in a task

    def run(batches):
        template = ChatTemplate(source, FILTERS)

        def pieces():
            held = None
            index = 0
            for conv, role, text in _rows(batches, "conv_id", "role", "text"):
                if held is not None:
                    last = held[0] != conv
                    yield emit(held, index, last)
                    index = 0 if last else index
                held, index = (conv, role, text), index + 1
            if held is not None:
                yield emit(held, index, True)

        def emit(held, index, last):
            piece, marks = template.piece({"role": held[1], "text": held[2]}, index, last)
            return {"conv_id": held[0], "piece_no": index, "piece": piece, "last": last,
                    "marks": [{"start": a, "end": b} for a, b in marks]}, len(piece)

        yield from _batched(pieces(), PIECE_ARROW)

    return ordered_turns(df).mapInArrow(run, PIECES)


class Reader:
    """Takes formatted text apart again; holds one unfinished turn at most."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.state, self.role, self.open = "between", "", []

    def feed(self, piece: str, marks) -> None:
        self.chars += len(piece)
        for m in marks:
            text = unescape(piece[m["start"]:m["end"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        at = 0
        for found in SCAN.finditer(piece):
            token = found[0]
            if token[0] == "\\":
                continue
            self.open.append(piece[at:found.start()])
            at = found.end()
            value = unescape("".join(self.open))
            self.open = []
            if token == TURN and self.state == "between":
                self.state = "role"
            elif token == TEXT and self.state == "role":
                self.role, self.state = value, "text"
            elif token == END and self.state == "text":
                self.turns.update(f"{self.role}\n{value}\n".encode())
                self.n_turns, self.state = self.n_turns + 1, "between"
            else:
                raise ValueError(f"{token} where {self.state} was open")
        self.open.append(piece[at:])

    def digest(self, conv) -> dict:
        if self.state != "between":
            raise ValueError("the formatted text ends inside a turn")
        return {"conv_id": conv, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(),
                "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of each conversation, read from the pieces of :func:`render` in their order."""

    def run(batches):
        def digests():
            reader = Reader()
            for conv, piece, marks, last in _rows(batches, "conv_id", "piece", "marks", "last"):
                reader.feed(piece, marks)
                if last:
                    yield reader.digest(conv), 200
                    reader = Reader()
        yield from _batched(digests(), DIGEST_ARROW)

    return pieces.mapInArrow(run, DIGESTS)


def conversations(pieces: DataFrame) -> DataFrame:
    """Whole formatted texts, one row per conversation (for conversations that fit a row)."""
    listed = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("piece_no", "piece"))).alias("p"))
    return listed.select("conv_id", F.array_join(F.col("p.piece"), "").alias("formatted"))
