"""Chat formatting by a finite-state machine over roles and a declarative template.

A conversation is read turn by turn in order of (turn, role, text). The machine checks the turn order; the template says
what stands before and after each text and whether the text counts for the loss. Texts and roles are escaped so that no
control string of the template can appear inside them, and ``read_back`` undoes this exactly.

Rows are dealt by conversation and sorted inside each partition, and the mapper streams over them, so memory holds one
conversation at a time, whatever the number of conversations.

Defined results: null role or text counts as empty; rows with a null conv_id form one conversation; equal (turn, role,
text) rows are separate turns; null turns come first; a conversation that breaks the turn order is formatted all the same,
with valid = false and the position of the first wrong turn in bad_turn (-1 if none); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What is written around a turn, which roles count for the loss, and the allowed turn order."""

    before_role: str = "<turn>### "
    after_role: str = ": "
    after_text: str = "</turn>\n"
    loss_roles: frozenset = frozenset({"assistant"})
    #: (state, role) -> state; the state is the role read last, "" at the start.
    order: frozenset = field(
        default=frozenset({("", "system"), ("", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user"), ("assistant", "tool"), ("tool", "assistant")})
    )
    final: frozenset = frozenset({"assistant"})


#: The escape sign, and what would read as a control string of the template: ### and the turn marks.
ESCAPE = re.compile(r"\\|#(?=##)|<(?=/?turn>)")
ESCAPE_ROLE = re.compile(r"\\|:|#(?=##)|<(?=/?turn>)")
UNESCAPE = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"<turn>### ((?:[^\\:]+|\\.)*): ((?:[^\\<]+|\\.|<(?!/turn>))*)</turn>\n", re.S)


def escape(text: str, what: re.Pattern = ESCAPE) -> str:
    return what.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


class Machine:
    """Takes turns in order; ``segments`` of a turn are (text, loss flag)."""

    def __init__(self, template: Template) -> None:
        self.template, self.state, self.n, self.bad = template, "", 0, -1

    def turn(self, role: str, text: str) -> list[tuple[str, bool]]:
        t = self.template
        if self.bad < 0 and (self.state, role) not in t.order:
            self.bad = self.n
        self.state, self.n = role, self.n + 1
        return [(t.before_role + escape(role, ESCAPE_ROLE) + t.after_role, False), (escape(text), role in t.loss_roles), (t.after_text, False)]

    @property
    def valid(self) -> bool:
        return self.bad < 0 and self.state in self.template.final


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation; raises where it isn't one."""
    out, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text between turns")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("text after the last turn")
    return out


FORMATTED = "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>, n_turns long, valid boolean, bad_turn long"


def _format(template: Template):
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_spans", spans), ("n_turns", pa.int64()), ("valid", pa.bool_()), ("bad_turn", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size, now, machine, parts, loss, at = 0, None, None, [], [], 0

        def close() -> None:
            nonlocal size
            if machine:
                rows.append({"conv_id": now, "formatted": "".join(parts), "loss_spans": loss, "n_turns": machine.n, "valid": machine.valid, "bad_turn": machine.bad})
                size += at

        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if machine is None or conv != now:
                    close()
                    now, machine, parts, loss, at = conv, Machine(template), [], [], 0
                    if size > 8_000_000 or len(rows) > 5_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                for piece, flag in machine.turn(role or "", text or ""):
                    parts.append(piece)
                    if flag:
                        loss.append({"start": at, "end": at + len(piece)})
                    at += len(piece)
        close()
        yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def format_conversations(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation: the formatted text, the code-point spans under the loss mask, and the machine's verdict."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), "turn")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(_format(template), FORMATTED)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, formatted, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
            turns = read_back(formatted)
            under = [unescape(formatted[s["start"] : s["end"]]) for s in spans]
            sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
            out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), sum(map(len, under)), sha("".join(under)), len(formatted)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)


def digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted text."""
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(
        _digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
