"""Conversation structure repair: the cheapest edits that give a conversation's roles the form ``(s?(ua)+)?``.

Wu-Manber-style cost layers: for each turn, from the last to the first, and each increasing cost, a bitset of the grammar's
states from which the rest can be finished at that cost. The first layer that holds the start state is the cost; following the
bits from there, least letter first, gives the least audit. The costs of a turn's four states lie within ``BAND`` of each other,
since two insertions lead from each to each but for a deletion, so a turn needs ``BAND`` + 1 layers of four bits: one word. Words recur, and
what a row does to a word is worked out once.

A conversation's rows come to its task twice: first without texts, for the layers, then with them, to be edited as they pass.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_WHITE_RUN, WHITE_CHAR, shuffle_partitions

#: States: nothing yet, after a system, a user, an assistant turn. What an inserted or reroled turn leads to, and what a kept one does.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ROLE = {USER: "user", ASSISTANT: "assistant"}
ACCEPT, ALL = 1 << START | 1 << ASSISTANT, 15
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
BAND = 7
#: Faults by number; rows with the first two must go.
FAULTS = (None, "blank", "duplicate", "truncated")


def _layer(word: int, d: int) -> int:
    return 0 if d < 0 else ALL if d > BAND else word >> 4 * d & ALL


def _before(states: int, moves: dict[int, int]) -> int:
    return sum(1 << s for s, t in moves.items() if states >> t & 1)


def _packed(layers: list[int]) -> tuple[int, int]:
    """The word of the layers from the first that isn't empty, and the place of that."""
    base = next(d for d, states in enumerate(layers) if states)
    return sum((layers[base + d] if base + d < len(layers) else ALL) << 4 * d for d in range(BAND + 1)), base


def _closed(layers: list[int]) -> list[int]:
    """Layers with what insertions add."""
    for d in range(INSERT, len(layers)):
        layers[d] |= layers[d - 1] | _before(layers[d - INSERT], NEXT)
    return layers


@cache
def last_word() -> int:
    return _packed(_closed([ACCEPT] * (BAND + 1)))[0]


@cache
def earlier_word(word: int, initial: str, fault: int) -> tuple[int, int]:
    """The word of the turn before, and how much dearer its first layer is than this one's."""
    layers = []
    for d in range(BAND + DELETE + 1):
        states = _layer(word, d - DELETE)
        if fault not in (1, 2):
            extra = CUT_OFF * (fault == 3)
            states |= _before(_layer(word, d - extra), KEEP.get(initial, {})) | _before(_layer(word, d - extra - REROLE), NEXT)
        layers.append(states)
    return _packed(_closed(layers))


class Layers:
    """The words of a conversation, from initials and faults of its rows; 13 bytes a row."""

    def __init__(self) -> None:
        self.rows, self.words, self.bases = bytearray(), array("I"), array("q")

    def add(self, initial: str, fault: int) -> None:
        self.rows.append(" sua".find(initial) * 4 + fault if initial in KEEP else fault)

    def solve(self) -> int:
        """The least cost."""
        n = len(self.rows)
        self.words, self.bases = array("I", bytes(4 * (n + 1))), array("q", bytes(8 * (n + 1)))
        word, base = last_word(), 0
        self.words[n] = word
        for i in range(n - 1, -1, -1):
            word, more = earlier_word(word, " sua"[self.rows[i] >> 2], self.rows[i] & 3)
            base += more
            self.words[i], self.bases[i] = word, base
        return next(base + d for d in range(BAND + 1) if word >> 4 * d & 1 << START)

    def edits(self) -> Iterator[tuple[str, int]]:
        """(letter, state after it) of the cheapest edits; the least letter that stays on a cheapest way is the next."""
        state, i, left = START, 0, self.solve()

        def can(to: int | None, at: int, cost: int) -> bool:
            return to is not None and _layer(self.words[at], left - cost - self.bases[at]) >> to & 1 == 1

        while i < len(self.rows) or left:
            initial, fault = (" sua"[self.rows[i] >> 2], self.rows[i] & 3) if i < len(self.rows) else ("", 1)
            extra, stays = CUT_OFF * (fault == 3), fault in (0, 3)
            kept = KEEP.get(initial, {}).get(state)
            if i < len(self.rows) and can(state, i + 1, DELETE):
                letter, to, cost = "D", state, DELETE
            elif can(NEXT[state], i, INSERT):
                letter, to, cost = "I", NEXT[state], INSERT
            elif stays and can(kept, i + 1, extra):
                letter, to, cost = "K", kept, extra
            else:
                letter, to, cost = "R", NEXT[state], REROLE + extra
            yield letter, to
            state, left, i = to, left - cost, i + (letter != "I")


EDITS = "conv_id bigint, edit string, turn bigint, was string, fault string, role string, text string"
_NAMES = ["conv_id", "edit", "turn", "was", "fault", "role", "text"]
_TYPES = [pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 4]


def repair(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """The edits of each conversation, in order: conv_id, edit (K, R, D or I), turn and role before, fault, role and text after.

    Turns (conv_id, turn, role, text) go by turn, null first, then role and text; null roles and texts count as one blank. A
    row's first fault counts: blank (nothing but white space), duplicate (role and text were in an earlier row), truncated (the
    last character that isn't white is none of ``.!?``). Keeping a row costs 0, another role 2, deleting it 3, inserting an empty
    turn 2, a truncated row that stays 1; blank and duplicate rows must go. Roles are judged by their first character; those
    but s, u and a (an empty role too) can't be kept. Of equally cheap edits the ones with the ASCII-least letters are made.

    A conversation whose rows are all not ``present`` gives one row without an edit. Rows with a null conv_id are one
    conversation; repeated rows are duplicates. Other columns are ignored, whatever their names; an empty table gives no rows.
    A task reads a conversation's rows one after another and holds 13 bytes for each and one very long text at a time; it has
    to be one task, as what is cheapest for a turn depends on all later ones.
    The rows of a conversation lie one after another in one partition, in order: ``summaries`` reads them as they lie.
    """
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), here.alias("here"))
    dealt = rows.repartition(shuffle_partitions(turns.sparkSession), "conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "here", "role", "text").orderBy("turn"))
    blank, cut = ~F.rlike("text", F.lit(NOT_WHITE_RUN)), ~F.rlike("text", F.lit(rf"[.!?]{WHITE_CHAR}*\z"))
    fault = F.when(blank, 1).when(F.col("seen") > 1, 2).when(cut, 3).otherwise(0)
    judged = dealt.withColumn("seen", seen).withColumn("fault", fault).withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    twice = F.explode(F.array(F.lit(False), F.lit(True))).alias("again")
    twice = judged.select("conv_id", "place", "turn", "role", "text", "here", "fault", twice).withColumn("text", F.when(F.col("again"), F.col("text")))
    return twice.sortWithinPartitions("conv_id", "again", "place").select("conv_id", "again", "turn", "role", "text", "here", "fault").mapInArrow(_edited, EDITS)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    held, conv, layers, edits, first_pass = 0, object(), Layers(), iter(()), True

    def trailing() -> list[tuple]:
        """What is inserted after the last row; a conversation without rows is named."""
        if first_pass:
            return []
        more = [(conv, letter, None, None, None, ROLE[state], "") for letter, state in edits]
        return more if len(layers.rows) else [(conv, None, None, None, None, None, None)]

    for batch in batches:
        columns = [batch.column(k) for k in ("conv_id", "again", "turn", "role", "here", "fault")]
        for i, (of, again, turn, role, here, fault) in enumerate(zip(*(c.to_pylist() for c in columns), strict=True)):
            if of != conv:
                out += trailing()
                conv, layers, edits, first_pass = of, Layers(), iter(()), True
            if not again:
                if here:
                    layers.add(role[:1], fault)
                continue
            if first_pass:
                first_pass, edits = False, layers.edits()
            if not here:
                continue
            for letter, state in edits:
                if letter == "I":
                    out.append((conv, letter, None, None, None, ROLE[state], ""))
                    continue
                text = None if letter == "D" else batch.column("text")[i].as_py()
                out.append((conv, letter, turn, role, FAULTS[fault], None if letter == "D" else ROLE[state] if letter == "R" else role, text))
                held += len(text or "")
                break
            if held + 64 * len(out) > 1 << 22:
                yield _batch(out, _TYPES, _NAMES)
                out, held = [], 0
    out += trailing()
    yield _batch(out, _TYPES, _NAMES)


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


SUMMARY = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_LEGAL = {"su", "ua", "au"}


class _Summary:
    def __init__(self, conv: int | None) -> None:
        self.conv, self.faults, self.illegal, self.cost, self.audit = conv, dict.fromkeys(FAULTS, 0), 0, 0, []
        self.low = self.high = self.last = None
        self.turns, self.sha, self.said = 0, hashlib.sha256(), False

    def add(self, edit: str | None, turn: int | None, was: str | None, fault: str | None, role: str | None, text: str | None) -> None:
        if edit is None:
            return
        self.audit.append(edit)
        self.cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (CUT_OFF if fault == "truncated" and edit != "D" else 0)
        if edit != "I":
            self.faults[fault] += 1
            self.illegal += self.last is not None and self.last + was[:1] not in _LEGAL
            self.last = was[:1]
            if turn is not None:
                self.turns += turn != self.high
                self.low, self.high = turn if self.low is None else self.low, turn
        if edit != "D":
            self.sha.update((b"\n" if self.said else b"") + f"{role}:{text}".encode())
            self.said = True

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        audit = "".join(self.audit)
        return (self.conv, gaps if gaps < 1 << 63 else None, *(self.faults[f] for f in FAULTS[1:]), self.illegal, self.cost, audit, self.sha.hexdigest())


def summaries(edits: DataFrame) -> DataFrame:
    """One row for each conversation of ``repair``'s edits, which are read as they lie: counts of gaps, faults and illegal
    neighbours before the repair, its cost and letters, and the digest of the repaired ``role:text`` lines. Gaps beyond a long are null."""
    fields = [f.split() for f in SUMMARY.split(", ")]
    types, names = [pa.string() if t == "string" else pa.int64() for _, t in fields], [n for n, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, done = None, []
        for batch in batches:
            for conv, *edit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is None or conv != at.conv:
                    done += [at.row()] if at else []
                    at = _Summary(conv)
                at.add(*edit)
            if len(done) > 10_000:
                yield _batch(done, types, names)
                done = []
        yield _batch(done + ([at.row()] if at else []), types, names)

    return edits.mapInArrow(run, SUMMARY)


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """``turns`` with faults to be found again, by crc32(``conv_id:turn``) mod 20: 0 drops the row, 1 empties its text, 2 removes
    its ``.!?``, 3 repeats it, 4 makes it a user's. Also the condition that a row is still there. Nulls become one blank."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(F.concat(conv, F.lit(":"), turn)) % 20).alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    out = rows.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "harm", copies.alias("copy"))
    return out.select("conv_id", "turn", "role", "text", "harm"), F.col("harm") != 0
