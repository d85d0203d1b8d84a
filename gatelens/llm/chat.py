"""Chat formatting: a finite-state machine over roles checks the turn order while turns become text segments.

Conversations are dealt by id and sorted by turn inside their partitions; one pass over the sorted rows keeps only the
machine's state and the current turn, so a conversation of any length needs bounded memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.llm.common import slices


@dataclass(frozen=True)
class ChatTemplate:
    """A turn is open.format(name of the role) + escaped text + close. A backslash is put before every backslash and
    every control string inside a text, so that reading back is exact. Texts of ``loss_roles`` are under the loss."""

    open: str = "### {name}: "
    close: str = "</turn>\n"
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss_roles: frozenset[str] = frozenset({"assistant"})
    # which roles may follow a state; the states are "start" and the role of the turn before
    follows: dict[str, frozenset[str]] = field(default_factory=lambda: {
        "start": frozenset({"system", "user"}), "system": frozenset({"user"}),
        "user": frozenset({"assistant"}), "assistant": frozenset({"user"})})
    ends: frozenset[str] = frozenset({"assistant"})
    other: str = "role="       # prefix of the name of a role that is not in ``names``

    def controls(self) -> list[str]:
        return [self.open.split("{name}")[0], self.close.rstrip("\n")]

    def escape(self, text: str) -> str:
        return re.sub("|".join(["\\\\", *map(re.escape, self.controls())]), lambda m: "\\" + m[0], text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def name(self, role: str) -> str:
        return self.names.get(role) or self.other + self.escape(role).replace(":", "\\:")

    def role(self, name: str) -> str:
        known = {v: k for k, v in self.names.items()}
        if name in known:
            return known[name]
        return self.unescape(name.removeprefix(self.other))

    def turn_pattern(self) -> re.Pattern:
        before, after = map(re.escape, self.open.split("{name}"))
        close = re.escape(self.close)
        stop = re.escape(self.close[0])
        inner = rf"(?:[^\\{stop}]++|\\.|{stop}(?!{re.escape(self.close.rstrip(chr(10))[1:])}))*+"
        return re.compile(rf"{before}((?:[^\\:]++|\\.)*+){after}({inner}){close}", re.S)


_SEGMENTS = "conv_id long, n long, part int, text string, loss boolean, ordered boolean"


def _format(template: ChatTemplate):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, n, first = None, "start", 0, True
        for b in slices(batches, 1024):
            rows = []
            for c, role, text in zip(*(b.column(i).to_pylist() for i in (0, 2, 3))):
                if first or c != conv:
                    conv, state, n, first = c, "start", 0, False
                role, text = role or "", text or ""
                ordered = role in template.follows.get(state, ())
                rows += [(c, n, 0, template.open.format(name=template.name(role)), False, ordered),
                         (c, n, 1, template.escape(text), role in template.loss_roles, ordered),
                         (c, n, 2, template.close, False, ordered)]
                state, n = role, n + 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*rows)) or [()] * 6, kinds)],
                                             names=["conv_id", "n", "part", "text", "loss", "ordered"])
    return run


def format_chats(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Text segments (conv_id, n, part, text, loss, ordered) of ``turns(conv_id, turn, role, text)``.

    Joined by n and part, the texts of a conversation are its formatted text; ``loss`` marks the segments under the
    loss, ``ordered`` whether the machine allows the turn after the one before. A null text or role is the empty
    string; an unknown role is formatted under its own name and never allowed. Turns are ordered by (turn, role,
    text), nulls first; repeated rows are turns of their own. Null conversation ids form one conversation. Rows come
    out in order within a partition, whole conversations together. Only the four named columns are read.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text") \
        .mapInArrow(_format(template), _SEGMENTS)


class _Reader:
    """Reads one formatted conversation back, segment by segment; holds at most one turn of text."""

    def __init__(self, template: ChatTemplate, pattern: re.Pattern):
        self.template, self.pattern = template, pattern
        self.buffer, self.turns, self.chars, self.loss_chars, self.state, self.ordered = [], 0, 0, 0, "start", True
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, text: str, loss: bool) -> None:
        self.buffer.append(text)
        self.chars += len(text)
        if loss:
            plain = self.template.unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        if text.endswith(self.template.close) and (m := self.pattern.fullmatch("".join(self.buffer))):
            role, plain = self.template.role(m[1]), self.template.unescape(m[2])
            self.all.update(f"{role}\n{plain}\n".encode())
            self.ordered &= role in self.template.follows.get(self.state, ())
            self.turns, self.buffer, self.state = self.turns + 1, [], role

    def row(self, conv) -> tuple:
        if self.buffer:
            raise ValueError(f"conversation {conv}: the formatted text does not end with a turn")
        return (conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars,
                self.ordered and self.state in self.template.ends)


def read_back(segments: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Parse formatted conversations: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    well_ordered). ``segments`` may come in any order."""
    schema = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
              "formatted_chars long, well_ordered boolean")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, conv, reader = template.turn_pattern(), None, None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*rows)) or [()] * 7, kinds)], names=names)

        for b in slices(batches, 4096):
            rows = []
            for c, text, loss in zip(*(b.column(i).to_pylist() for i in (0, 3, 4))):
                if reader is None or c != conv:
                    if reader is not None:
                        rows.append(reader.row(conv))
                    conv, reader = c, _Reader(template, pattern)
                reader.feed(text, loss)
            yield batch(rows)
        if reader is not None:
            yield batch([reader.row(conv)])
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "n", "part") \
        .select("conv_id", "n", "part", "text", "loss").mapInArrow(run, schema)
