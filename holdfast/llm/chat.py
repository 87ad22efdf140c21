"""Chat formatting: a finite-state machine over roles, and a declarative template that yields segments with loss flags.

A turn becomes three segments: its header, its escaped text and its end. In texts each character that could begin a control
string, and the escape character, is preceded by the escape character; so control strings stand only where the template put them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions


@dataclass(frozen=True)
class Template:
    """``header`` takes a title; a role without one is shown after ``other``. ``follows`` and ``last`` are the state machine."""

    header: str = "### {}: "
    end: str = " </turn>\n"
    escape: str = "\\"
    other: str = "@"
    titles: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    last: frozenset[str] = frozenset({"user", "assistant"})

    def escaped(self, text: str) -> str:
        # " </turn>" begins with a blank: its second character is the one that texts never have bare.
        return re.sub(f"([{re.escape(self.escape + self.header[0] + self.end.lstrip()[0])}])", lambda m: self.escape + m[1], text)

    def segments(self, role: str | None, text: str | None) -> list[tuple[str, bool]]:
        title = self.titles.get(role or "", None) or self.other + self.escaped(role or "").replace(":", self.escape + ":")
        return [(self.header.format(title), False), (self.escaped(text or ""), role in self.loss), (self.end, False)]

    def fault(self, roles: list[str | None]) -> int | None:
        """The place of the first turn that the state machine refuses, len(roles) if it may not end there, else None."""
        state = ""
        for i, role in enumerate(roles):
            if (role or "?") not in self.follows.get(state, ()):
                return i
            state = role
        return None if state in self.last else len(roles)

    def parsed(self, formatted: str) -> list[tuple[str, str]]:
        """Roles and texts of a formatted conversation."""
        before, after = self.header.split("{}")
        e = re.escape(self.escape)
        turn = re.compile(f"{re.escape(before)}((?:{e}.|[^:{e}])*){re.escape(after)}((?:{e}.|[^{e}{re.escape(before[0] + self.end.lstrip()[0])}])*){re.escape(self.end)}", re.S)
        roles, out, at = {v: k for k, v in self.titles.items()}, [], 0
        while at < len(formatted):
            m = turn.match(formatted, at)
            if not m:
                raise ValueError(f"no turn at character {at}")
            out.append((roles.get(m[1]) or self.unescaped(m[1][len(self.other) :]), self.unescaped(m[2])))
            at = m.end()
        return out

    def unescaped(self, text: str) -> str:
        return re.sub(f"{re.escape(self.escape)}(.)", r"\1", text, flags=re.S)


FORMATTED = "conv_id bigint, formatted string, loss_spans array<struct<start:bigint,end:bigint>>, fault int"


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row for each conversation: conv_id, formatted, loss_spans (code points, end exclusive), fault.

    Turns (conv_id, turn, role, text) go by turn, then role and text; a null turn comes first, a null text or role counts as empty.
    Conversations whose order the state machine refuses are formatted too, and ``fault`` says where (null: nowhere). Repeated
    rows are turns each. Rows with a null conv_id are one conversation. Other columns are ignored, whatever their names; an empty
    table gives no rows. A very long text is one segment; a task holds one conversation's texts at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True))
        done, held = [], 0
        for conv, group in groupby(rows, key=lambda r: r[0]):
            roles, parts, spans, at = [], [], [], 0
            for _, role, text in group:
                roles.append(role)
                for part, loss in template.segments(role, text):
                    if loss:
                        spans.append({"start": at, "end": at + len(part)})
                    parts.append(part)
                    at += len(part)
            done.append((conv, "".join(parts), spans, template.fault(roles)))
            held += at
            if held > 1 << 22:
                yield _batch(done)
                done, held = [], 0
        yield _batch(done)

    dealt = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text").repartition(shuffle_partitions(turns.sparkSession), "conv_id")
    return dealt.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, FORMATTED)


_span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    types = [pa.int64(), pa.string(), _span, pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "formatted", "loss_spans", "fault"])


def digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """What reading the formatted conversations back gives, as counts and digests."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                turns = template.parsed(r["formatted"])
                loss = "".join(template.unescaped(r["formatted"][s["start"] : s["end"]]) for s in r["loss_spans"])
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append((r["conv_id"], len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(r["formatted"]), r["fault"]))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in READ.split(", ")])

    return formatted.mapInArrow(run, READ)


READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, fault int"
