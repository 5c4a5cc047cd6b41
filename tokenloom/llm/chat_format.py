"""Chat formatting by a finite-state machine over roles.

A declarative template names the roles, which role may follow which, the marks around a turn and the
roles that are trained on. Turns run through the machine in order, as a stream over sorted
partitions: each gives three text segments, opening mark and role, text, closing mark, and the text
carries the loss flag. Control strings inside texts are escaped, reversibly, so only the template can
put a mark into the output; the reader finds the turns from the marks alone.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm.common import ship_package

START = "start"


@dataclass(frozen=True)
class Template:
    """``follows`` maps a state, ``START`` or the last role, to the roles that may come; ``final``
    are the roles a whole conversation ends with."""

    opening: str = "<|im_start|>"
    after_role: str = "\n"
    closing: str = "<|im_end|>"
    after_turn: str = "\n"
    follows: Mapping[str, tuple[str, ...]] = field(
        default_factory=lambda: {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    final: tuple[str, ...] = ("assistant",)
    trained: tuple[str, ...] = ("assistant",)


#: Escapes: a backslash doubles, the bar of ``<|`` and a role's line end get one before them.
def escape(text: str) -> str:
    """A text without the start of any control string."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL) if "\\" in text else text


def format_chat(
    turns: DataFrame, template: Template = Template(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Segments: ``conv_id``, ``turn_no`` from 0, ``segment`` 0 to 2, ``text``, ``loss``, ``allowed``.

    Rows of a conversation come by turn, nulls first, and rows that share a turn by role and text.
    ``allowed`` says whether the machine took the turn; after a turn it refused, it goes on from that
    turn's role, and nothing is left out. Null texts and roles count as empty; an empty or unknown
    role is never allowed. Null conversation ids form one conversation. Repeated rows are turns of
    their own. Other columns are not read; an empty table gives no segments.
    """
    ship_package(turns.sparkSession)
    rows = turns.select(*[F.col(c).alias(n) for c, n in ((conv_id, "conv_id"), (turn, "turn"), (role, "role"), (text, "text"))])
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kinds = (T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType(), T.BooleanType())
    fields = [rows.schema["conv_id"], *map(T.StructField, ("turn_no", "segment", "text", "loss", "allowed"), kinds)]
    return ordered.select("conv_id", "role", "text").mapInArrow(functools.partial(_format, template), T.StructType(fields))


def _format(template: Template, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, state, number = object(), START, 0
    for batch in batches:
        out = []
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if conv != current:
                current, state, number = conv, START, 0
            role, text = role or "", text or ""
            allowed = role in template.follows.get(state, ())
            state = role
            out.append((conv, number, 0, template.opening + escape_role(role) + template.after_role, False, allowed))
            out.append((conv, number, 1, escape(text), role in template.trained, allowed))
            out.append((conv, number, 2, template.closing + template.after_turn, False, allowed))
            number += 1
        schema = [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]
        columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, schema)]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn_no", "segment", "text", "loss", "allowed"])


def read_chat(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """One row for each conversation, read back from its segments' text and loss flags alone:
    ``conv_id``, ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars``,
    ``order_error`` (the first turn the machine refused, null if none) and ``complete``.

    A task holds one turn at a time, however long its conversation is. Text that is no whole turn
    raises an error.
    """
    ship_package(segments.sparkSession)
    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no", "segment")
    kinds = (T.LongType(), T.StringType(), T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.BooleanType())
    names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "order_error", "complete")
    schema = T.StructType([segments.schema["conv_id"], *map(T.StructField, names, kinds)])
    return ordered.select("conv_id", "text", "loss", "allowed").mapInArrow(functools.partial(_read, template), schema)


class _Reader:
    """Turns of one conversation from its formatted text, which comes in parts."""

    def __init__(self, template: Template):
        self.template, self.turns, self.masked = template, hashlib.sha256(), hashlib.sha256()
        self.count = self.loss_chars = self.chars = 0
        self.waiting, self.marked, self.role, self.error = "", "", None, None

    def feed(self, text: str, loss: bool, allowed: bool) -> None:
        if not allowed and self.error is None:
            self.error = self.count
        self.chars += len(text)
        self.waiting += text
        self.marked += text if loss else ""
        mark = self.template.closing + self.template.after_turn
        while (end := self.waiting.find(mark)) >= 0:
            self._turn(self.waiting[:end])
            self.waiting = self.waiting[end + len(mark) :]

    def _turn(self, text: str) -> None:
        opening, after = self.template.opening, self.template.after_role
        cut = text.find(after)
        if not text.startswith(opening) or cut < 0:
            raise ValueError("formatted text that is not a turn")
        self.role = unescape(text[len(opening) : cut])
        self.turns.update(f"{self.role}\n{unescape(text[cut + len(after) :])}\n".encode("utf-8", "surrogatepass"))
        loss = unescape(self.marked)
        self.masked.update(loss.encode("utf-8", "surrogatepass"))
        self.loss_chars += len(loss)
        self.marked = ""
        self.count += 1

    def result(self) -> tuple:
        if self.waiting:
            raise ValueError("formatted text that ends inside a turn")
        whole = self.error is None and self.role in self.template.final
        return (self.count, self.turns.hexdigest(), self.loss_chars, self.masked.hexdigest(), self.chars, self.error, whole)


def _read(template: Template, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, current, kind = None, None, None

    def made(rows):
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "order_error", "complete"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for batch in batches:
        kind, done = batch.schema.field(0).type, []
        for conv, text, loss, allowed in zip(*(c.to_pylist() for c in batch.columns)):
            if reader is None or conv != current:
                if reader is not None:
                    done.append((current, *reader.result()))
                reader, current = _Reader(template), conv
            reader.feed(text, loss, allowed)
        if done:
            yield made(done)
    if reader is not None:
        yield made([(current, *reader.result())])
