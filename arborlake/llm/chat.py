"""Chat formatting with typed content parts.

A message's content is a list of parts: text, image, audio or document. A visitor with one method for each
type flattens the parts in order: text is escaped, every other part becomes a numbered placeholder, with a
record of its reference and the number of tokens that it will expand to. A message is then
``<|turn|>role\\n`` text ``<|end|>\\n``; a conversation starts with ``<|chat|>``. The loss mask covers the text of
the assistant's messages and nothing else.

Escaping is reversible: a backslash is put behind the ``<`` of anything in a role or text that could be read as a
control string, however many backslashes stand there already; unescaping takes one away.

Cases: a null text, part list or role is empty; a part of unknown type is refused. Turns are ordered by
number, then role and text, so repeated turns are kept and have one order; null turns come first. Rows
with a null ``conv_id`` form one conversation with a null id. An empty table gives an empty result. Other columns
are ignored. A conversation streams through one task turn by turn, so its length is not bounded by memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHAT, TURN, END = "<|chat|>", "<|turn|>", "<|end|>"
TEXT, IMAGE, AUDIO, DOCUMENT = "text", "image", "audio", "document"
LOSS_ROLE = "assistant"

#: What a text could hold that reads as a control string, with the backslashes of earlier escapes.
_CONTROL = re.compile(r"<(\\*\|(?:chat|turn|end|image:\d+|audio:\d+|document:\d+)\|>)")
_ESCAPED = re.compile(r"<\\(\\*\|(?:chat|turn|end|image:\d+|audio:\d+|document:\d+)\|>)")
_SEGMENT = re.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.DOTALL)

PARTS_TYPE = "array<struct<type: string, text: string, ref: string, tokens: int>>"


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1", text)


def escape_role(role: str) -> str:
    """A role stands on one line."""
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


@dataclass
class Flattener:
    """Visits the parts of one message. ``counts`` numbers the placeholders of a message by type."""

    out: list[str] = field(default_factory=list)
    attachments: list[tuple[str, int, str | None, int]] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)

    def visit(self, part: dict) -> None:
        handler = getattr(self, f"visit_{part.get('type')}", None)
        if handler is None:
            raise ValueError(f"a part has type {part.get('type')!r}")
        handler(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        self._attach(IMAGE, part)

    def visit_audio(self, part: dict) -> None:
        self._attach(AUDIO, part)

    def visit_document(self, part: dict) -> None:
        self._attach(DOCUMENT, part)

    def _attach(self, kind: str, part: dict) -> None:
        n = self.counts.get(kind, 0)
        self.counts[kind] = n + 1
        self.attachments.append((kind, n, part.get("ref"), part.get("tokens") or 0))
        self.out.append(None)  # a place that no text can take
        self.out.append(f"<|{kind}:{n}|>")

    def content(self) -> str:
        """Neighbouring texts are escaped together: a control string cannot be put together from two of them."""
        pieces, texts = [], []
        parts = iter(self.out)
        for part in parts:
            if part is None:
                pieces.append(escape("".join(texts)))
                texts = []
                pieces.append(next(parts))
            else:
                texts.append(part)
        return "".join([*pieces, escape("".join(texts))])


def format_turn(role: str | None, parts: list[dict] | None) -> tuple[str, list[tuple[str, int, str | None, int]]]:
    """A message as it stands in the output, and its attachments: (type, number, reference, expanded tokens)."""
    flat = Flattener()
    for part in parts or []:
        flat.visit(part)
    return f"{TURN}{escape_role(role or '')}\n{flat.content()}{END}\n", flat.attachments


def read_turn(segment: str) -> tuple[str, str]:
    """Role and text of a formatted message."""
    found = _SEGMENT.fullmatch(segment)
    if not found:
        raise ValueError("not a formatted message")
    return unescape_role(found[1]), unescape(found[2])


def read_chat(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every message of a formatted conversation."""
    if not formatted.startswith(CHAT):
        raise ValueError("not a formatted conversation")
    turns, at = [], len(CHAT)
    while at < len(formatted):
        found = _SEGMENT.match(formatted, at)
        if not found:
            raise ValueError(f"no message at {at}")
        turns.append((unescape_role(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def text_parts(text: Column) -> Column:
    """A plain text as a part list."""
    nothing = F.lit(None)
    part = F.struct(F.lit(TEXT).alias("type"), text.alias("text"), nothing.cast("string").alias("ref"), nothing.cast("int").alias("tokens"))
    return F.array(part).cast(PARTS_TYPE)


SEGMENT_FIELDS = "formatted string, loss_start int, loss_end int, attachments array<struct<type: string, number: int, ref: string, tokens: int>>"


def turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """Each message formatted: conv_id, turn, formatted, loss_start and loss_end (code points in it, equal where
    nothing is learnt), attachments, expanded_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("type", pa.string()), ("number", pa.int32()), ("ref", pa.string()), ("tokens", pa.int32())]))
        for batch in batches:
            texts, starts, ends, attached, expanded = [], [], [], [], []
            for who, content in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                segment, found = format_turn(who, content)
                start = segment.index("\n") + 1
                texts.append(segment)
                starts.append(start)
                ends.append(len(segment) - len(END) - 1 if who == LOSS_ROLE else start)
                attached.append([dict(zip(("type", "number", "ref", "tokens"), a)) for a in found])
                expanded.append(sum(a[3] for a in found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(attached, kind), pa.array(expanded, pa.int64())],
                ["conv_id", "turn", "formatted", "loss_start", "loss_end", "attachments", "expanded_tokens"],
            )

    source = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(parts).cast(PARTS_TYPE).alias("parts"))
    kinds = [source.schema[n].dataType.simpleString() for n in ("conv_id", "turn")]
    return source.mapInArrow(run, f"conv_id {kinds[0]}, turn {kinds[1]}, {SEGMENT_FIELDS}, expanded_tokens long")


class _Conversation:
    """What is read back from the messages of one conversation, one at a time."""

    def __init__(self, key):
        self.key, self.turns, self.loss_chars, self.chars, self.expanded = key, 0, 0, len(CHAT), 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, start: int, end: int, expanded: int) -> None:
        role, text = read_turn(segment)
        self.turns += 1
        self.chars += len(segment)
        self.expanded += expanded
        self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        masked = unescape(segment[start:end])
        self.loss_chars += len(masked)
        self.loss.update(masked.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.key, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.expanded


def digests(formatted: DataFrame) -> DataFrame:
    """Read formatted messages back, conversation by conversation: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, expanded_tokens."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "expanded_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Conversation | None = None
        kinds = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            kinds[0] = batch.schema.field(0).type
            ended = []
            for key, segment, start, end, expanded in zip(*(c.to_pylist() for c in batch.columns)):
                if current is None or current.key != key:
                    if current is not None:
                        ended.append(current.row())
                    current = _Conversation(key)
                current.add(segment, start, end, expanded)
            if ended:
                yield packed(ended)
        if current is not None:
            yield packed([current.row()])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end", "expanded_tokens").mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, expanded_tokens long"
    )
