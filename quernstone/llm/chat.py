"""Chat formatting: conversations rendered by a compiled template, with spans of what a model is trained to produce."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .templates import BEGIN, END, Template, unescape_control, unescape_line

#: Turns between control strings, which the texts inside can't contain.
CHATML = """{%- for message in messages -%}
<|im_start|>{{ message.role | escape_line }}{{ '\\n' }}
{%- if message.role == 'assistant' -%}
{% generation %}{{ message.content | escape_control }}{% endgeneration %}
{%- else -%}
{{ message.content | escape_control }}
{%- endif -%}
<|im_end|>{{ '\\n' }}
{%- endfor -%}"""

#: Code points of formatted text in one output row; a longer conversation goes on in the next.
PART_CHARS = 1 << 18

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
PARTS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("part", T.LongType()), T.StructField("start", T.LongType()),
    T.StructField("formatted", T.StringType()), T.StructField("loss_spans", T.ArrayType(SPAN)), T.StructField("last", T.BooleanType()),
])
_PART_TYPES = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("start", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("last", pa.bool_())])


def _parts(conv_id: int | None, pieces: Iterable, limit: int) -> Iterator[dict]:
    """Rows of at most about limit code points; spans are code points from the row's start and are cut where a row ends."""
    held: list[str] = []
    size, before, number, spans, opened = 0, 0, 0, [], None

    def row(last: bool) -> dict:
        marks = spans + ([{"start": opened, "end": size}] if opened is not None and opened < size else [])
        return {"conv_id": conv_id, "part": number, "start": before, "formatted": "".join(held), "loss_spans": marks, "last": last}

    for piece in pieces:
        if piece is BEGIN:
            opened = size
        elif piece is END:
            spans.append({"start": opened, "end": size})
            opened = None
        else:
            for i in range(0, len(piece), limit):
                if size >= limit:
                    yield row(False)
                    held, before, size, number, spans, opened = [], before + size, 0, number + 1, [], None if opened is None else 0
                held.append(piece[i : i + limit])
                size += len(held[-1])
    yield row(True)


def _batched(rows: Iterable[dict], schema: pa.Schema, chars: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + len(row.get("formatted") or "")
        if size >= chars:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def format_conversations(df: DataFrame, template: str = CHATML, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """Every conversation rendered whole: rows (conv_id, part, start, formatted, loss_spans, last).

    A conversation's messages are its rows by turn; rows of the same turn come by role, then text, repeated rows all stay, null
    turns come first. Null texts and roles are empty; rows with a null conv_id are one conversation. Other columns don't matter.
    An empty table gives no rows. A conversation is one task's work, which bounds its speed but not its size: conversations stream through their task turn by turn: a row has about part_chars code points,
    start is the code points before it, last marks the end, so even a conversation with most of the rows is never held whole.
    Parts of a conversation follow each other in their partition.
    """
    Template(template)  # a bad template fails here
    chosen = df.select(*(F.col(f"`{c}`").cast(kind).alias(n) for n, c, kind in (("conv_id", conv_id, "long"), ("turn", turn, "long"), ("role", role, "string"), ("text", text, "string"))))
    ordered = chosen.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template)
        rows = (x for b in batches for i in range(0, b.num_rows, 256) for x in zip(*(c.to_pylist() for c in b.slice(i, 256).columns), strict=True))

        def formatted() -> Iterator[dict]:
            for key, turns in groupby(rows, key=lambda x: x[0]):
                messages = ({"role": r or "", "content": t or ""} for _, _, r, t in turns)
                yield from _parts(key, compiled.render(messages), part_chars)

        yield from _batched(formatted(), _PART_TYPES)

    return ordered.mapInArrow(run, PARTS)


DIGESTS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
    T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
])
_DIGEST_TYPES = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


class _Unescaper:
    """unescape_control over a text that comes in parts: what may be an unfinished escape waits for the next part."""

    def __init__(self) -> None:
        self.tail = ""

    def feed(self, text: str, end: bool = False) -> str:
        text = self.tail + text
        keep = len(text)
        if not end:
            bare = text.rstrip("\\")
            keep = len(bare) - 1 if bare.endswith("<") else len(text)
        self.tail = text[keep:]
        return unescape_control(text[:keep])


class ChatReader:
    """Reads a conversation in the CHATML template back from its parts."""

    START, END = "<|im_start|>", "<|im_end|>\n"

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.buffer, self.state = "", "outside"
        self.content, self.masked = _Unescaper(), _Unescaper()

    def _learn(self, text: str, end: bool) -> None:
        got = self.masked.feed(text, end)
        self.loss_chars += len(got)
        self.loss.update(got.encode())

    def feed(self, formatted: str, spans: list[dict]) -> None:
        self.chars += len(formatted)
        if not spans or spans[0]["start"]:  # what the part before ended with wasn't gone on with
            self._learn("", True)
        for s in spans:
            self._learn(formatted[s["start"] : s["end"]], s["end"] < len(formatted))
        self.buffer += formatted
        while True:
            if self.state == "outside":
                if len(self.buffer) < len(self.START):
                    return
                if not self.buffer.startswith(self.START):
                    raise ValueError("a turn doesn't start with its control string")
                self.buffer, self.state = self.buffer[len(self.START) :], "role"
            elif self.state == "role":
                role, found, rest = self.buffer.partition("\n")
                if not found:
                    return
                self.turns.update(f"{unescape_line(role)}\n".encode())
                self.buffer, self.state = rest, "content"
            else:
                content, found, rest = self.buffer.partition(self.END)
                if not found:  # all but what may be the start of the control string is content
                    keep = len(self.buffer) - len(self.END) + 1
                    if keep > 0:
                        self.turns.update(self.content.feed(self.buffer[:keep]).encode())
                        self.buffer = self.buffer[keep:]
                    return
                self.turns.update(self.content.feed(content, True).encode() + b"\n")
                self.n_turns += 1
                self.buffer, self.state = rest, "outside"

    def result(self, conv_id: int | None) -> dict:
        if self.state != "outside" or self.buffer:
            raise ValueError("the conversation doesn't end with a whole turn")
        self._learn("", True)
        return {"conv_id": conv_id, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


def read_back(parts: DataFrame, in_order: bool = True) -> DataFrame:
    """Digests of each formatted conversation in the CHATML template, read from its parts.

    in_order: the parts follow each other in their partition, as format_conversations gives them. From a stored table, say False: then
    they are dealt by conv_id and sorted. Parts that don't follow each other are an error, as are missing ones. An empty table gives no rows.
    """
    chosen = parts.select(*PARTS.names)
    if not in_order:
        chosen = chosen.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[dict]:
            reader, expected = ChatReader(), (None, 0)
            for b in batches:
                for i in range(b.num_rows):
                    row = b.slice(i, 1).to_pylist()[0]
                    if row["part"] != expected[1] or row["part"] and row["conv_id"] != expected[0]:
                        raise ValueError(f"part {row['part']} of conversation {row['conv_id']} doesn't follow the part before it")
                    reader.feed(row["formatted"], row["loss_spans"])
                    expected = (row["conv_id"], row["part"] + 1)
                    if row["last"]:
                        yield reader.result(row["conv_id"])
                        reader, expected = ChatReader(), (None, 0)
            if expected[1]:
                raise ValueError(f"conversation {expected[0]} has no last part")

        yield from _batched(results(), _DIGEST_TYPES, 1 << 18)

    return chosen.mapInArrow(run, DIGESTS)
