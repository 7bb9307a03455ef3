"""Chat formatting from event logs.

A log holds events of conversations: ``message`` sets the text of a message,
``delta`` appends to it, ``edit`` replaces it, ``regenerate`` empties it for the
deltas that follow. Events are dealt by conversation, sorted by message and sequence,
and folded as they stream by, so a worker holds one message at a time, however long
its conversation is; digests are fed as messages close.

The template writes ``<|im_start|>role``, a line break, the text and ``<|im_end|>``
with a line break. In texts a backslash goes between ``<`` and ``|``, and one more
where there are some already, so no text contains a control string and reading back
takes one away. In roles line breaks and backslashes are escaped as well.

A null text or role counts as empty. A null conversation is a conversation. Turns
are ordered by turn, null first, then role and text, so ties and repeated rows give
turns of their own in a fixed order. Empty logs give empty results; other columns
do not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"

_OPEN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    plain = unescape(role)
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], plain)


def render(role: str, text: str) -> tuple[str, list[tuple[int, int]]]:
    """A formatted turn and the spans of it that the loss covers."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    spans = [(len(head), len(head) + len(body))] if role == TRAINED_ROLE else []
    return f"{head}{body}{END}\n", spans


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a formatted text."""
    for turn in _TURN.finditer(formatted):
        yield unescape_role(turn[1]), unescape(turn[2])


def as_events(conversations: DataFrame) -> DataFrame:
    """The event log of finished conversations: one ``message`` event per row."""
    c = F.col
    return conversations.select(
        "conv_id",
        c("turn").cast("long").alias("message"),
        F.lit(0).cast("long").alias("seq"),
        F.lit("message").alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def dealt(events: DataFrame) -> DataFrame:
    """Events by conversation, messages in order, events of a message in sequence."""
    order = ["conv_id", "message", "seq", "role", "kind", "text"]
    # keys go to the workers as strings, which keep nulls and large numbers as they are
    return (
        events.select("conv_id", "message", "seq", "kind", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions(*order)
        .select(
            F.col("conv_id").cast("string").alias("conv_id"),
            F.col("message").cast("string").alias("message"),
            "kind",
            "role",
            "text",
        )
    )


@dataclass
class Message:
    """A message while its events are folded."""

    conv: object
    number: object
    role: str
    parts: list[str] = field(default_factory=list)

    def apply(self, kind: str, role: str, text: str) -> None:
        if kind == "delta":
            self.parts.append(text)
        elif kind == "regenerate":
            self.parts.clear()
        else:
            self.parts[:] = [text]
        self.role = role or self.role

    @property
    def text(self) -> str:
        return "".join(self.parts)


def fold(batches: Iterable[pd.DataFrame]) -> Iterator[Message]:
    """Messages of a sorted log, each when its last event has been read.

    A ``message`` event always opens a message, so two of them with one number are
    two turns; the other kinds go on with the message of their number.
    """
    current: Message | None = None
    for batch in batches:
        for conv, number, kind, role, text in zip(
            batch["conv_id"], batch["message"], batch["kind"], batch["role"], batch["text"]
        ):
            role, text = role or "", text or ""
            goes_on = (
                current is not None
                and kind != "message"
                and (current.conv, current.number) == (conv, number)
            )
            if not goes_on:
                if current is not None:
                    yield current
                current = Message(conv, number, role)
            current.apply(kind, role, text)
    if current is not None:
        yield current


def format_messages(events: DataFrame) -> DataFrame:
    """conv_id, turn number, formatted text and loss spans (offsets in it) of every turn."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for message in fold(batches):
            text, spans = render(message.role, message.text)
            rows.append((message.conv, message.number, text, [list(s) for s in spans]))
            held += len(text)
            if held > 1 << 22:
                yield pd.DataFrame(rows, columns=["conv_id", "turn", "formatted", "loss_spans"])
                rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "formatted", "loss_spans"])

    rows = dealt(events).mapInPandas(
        run, "conv_id string, turn string, formatted string, loss_spans array<array<int>>"
    )
    return rows.withColumn("conv_id", F.col("conv_id").cast(_kind(events))).withColumn(
        "turn", F.col("turn").cast("long")
    )


def _kind(events: DataFrame):
    return events.schema["conv_id"].dataType


@dataclass
class Digest:
    """What is read back from the formatted turns of one conversation."""

    conv: object
    n_turns: int = 0
    loss_chars: int = 0
    formatted_chars: int = 0

    def __post_init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, spans: list[tuple[int, int]]) -> None:
        self.formatted_chars += len(formatted)
        for role, text in read_back(formatted):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        for start, end in spans:
            trained = unescape(formatted[start:end])
            self.loss_chars += len(trained)
            self.loss.update(trained.encode())

    def row(self) -> tuple:
        return (
            self.conv,
            self.n_turns,
            self.turns.hexdigest(),
            self.loss_chars,
            self.loss.hexdigest(),
            self.formatted_chars,
        )


DIGEST = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def digests(events: DataFrame) -> DataFrame:
    """Per conversation: counts and digests of what is read back from its formatted turns."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        current: Digest | None = None
        for message in fold(batches):
            if current is None or current.conv != message.conv:
                if current is not None:
                    rows.append(current.row())
                if len(rows) >= 4096:
                    yield pd.DataFrame(rows, columns=DIGEST)
                    rows = []
                current = Digest(message.conv)
            current.add(*render(message.role, message.text))
        if current is not None:
            rows.append(current.row())
        yield pd.DataFrame(rows, columns=DIGEST)

    rows = dealt(events).mapInPandas(
        run,
        "conv_id string, n_turns long, turns_sha256 string, loss_chars long, "
        "loss_sha256 string, formatted_chars long",
    )
    return rows.withColumn("conv_id", F.col("conv_id").cast(_kind(events)))
