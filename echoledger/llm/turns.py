"""Conversation structure repair: faults of turns, and the cheapest edits that give alternating roles.

Rows are dealt by conversation, sorted by turn and streamed through Arrow batches. For every prefix of a
conversation the kernel holds four survivors, one for each place in the role pattern `(s?(ua)+)?`: nothing yet,
after a system turn, after a user turn, after an assistant turn. It needs their costs, the order of their audits and
one byte a survivor of how each was reached. Those backpointers, and the turns that may be kept, go to files of the
task once a conversation outgrows memory; at its end the winner is traced back and its turns are read once more.

Survivors need no stored audits to be compared: each ends with the edit of the same row, so no audit is the start
of another, and the order of two longer ones is that of the shorter ones they stem from, then that of the new edits.

Defined cases. A null role or text reads as one space, a null in the key of `damage` too. Null conv_id is a
conversation of its own. Null turns come first; equal turns are ordered by role and text (bytes), so repeated
rows are neighbours. Blank and empty texts are blank, at any length. A role that is empty, or whose first letter is
none of s, u and a, cannot be kept. An empty table gives an empty table. Further columns, whatever their names,
are left aside. A conversation of any length takes one task's time but not its memory: only its audit, a byte a
row, is held, as the result asks for it in one cell.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from echoledger.llm.shared import documents_of, parts

#: Costs of edits: keep, rerole, delete, insert; and of a truncated turn that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Bytes of a conversation that stay in memory, for turns and for backpointers each.
SPILL_BYTES = 1 << 22
#: Rows whose backpointers are traced back at a time.
TRACE_ROWS = 1 << 16

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
NO_FAULT, IS_BLANK, IS_DUPLICATE, IS_TRUNCATED = range(4)
_INITIALS = {"s": 0, "u": 1, "a": 2}
_OTHER = 3
_FAR = 1 << 62


def _inserted(state: int) -> int:
    return ASSISTANT if state == USER else USER


def _kept(state: int, initial: int) -> int | None:
    if initial == 0:
        return SYSTEM if state == NOTHING else None
    if initial == 1:
        return USER if state != USER else None
    return ASSISTANT if initial == 2 and state == USER else None


#: The edits of one row with the inserts before it; their places here are the low bits of a backpointer.
EDITS = ("D", "ID", "IID", "IIK", "IIR", "IK", "IR", "K", "R")


def _moves(initial: int, fault: int) -> list[list[tuple[int, int, int]]]:
    """For each state after a row, its ways there: (state before, cost, edits). One way for each state before."""
    ways: list[dict[int, tuple[int, int]]] = [{} for _ in range(4)]
    stay = TRUNCATED if fault == IS_TRUNCATED else 0
    for before in range(4):
        middle = before
        for inserts in range(3):
            if inserts:
                middle = _inserted(middle)
            ends = [("D", middle, DELETE)]
            if fault in (NO_FAULT, IS_TRUNCATED):
                if (after := _kept(middle, initial)) is not None:
                    ends.append(("K", after, KEEP + stay))
                ends.append(("R", _inserted(middle), REROLE + stay))
            for edit, after, cost in ends:
                way = (cost + INSERT * inserts, EDITS.index("I" * inserts + edit))
                ways[after][before] = min(ways[after].get(before, way), way)
    return [[(before, *way) for before, way in sorted(w.items())] for w in ways]


MOVES = [[_moves(initial, fault) for fault in range(4)] for initial in range(4)]
#: Inserts after the last row, by state.
CLOSING = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


class Conversation:
    """One conversation as it streams by: add() for each row in order, then audit and repaired turns."""

    def __init__(self, spill_bytes: int = SPILL_BYTES):
        self.steps = tempfile.SpooledTemporaryFile(spill_bytes)
        self.turns = tempfile.SpooledTemporaryFile(spill_bytes)
        self.reset()

    def reset(self) -> None:
        for f in (self.steps, self.turns):
            f.seek(0)
            f.truncate()
        self.rows = 0
        self.costs = [0, _FAR, _FAR, _FAR]
        self.ranks = [0, 0, 0, 0]
        self.faults = [0, 0, 0, 0]
        self.illegal = 0
        self.initial: str | None = None
        self.low = self.high = self.last_turn = None
        self.distinct = 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        self.faults[fault] += 1
        if turn is not None:
            if self.low is None:
                self.low = turn
            if turn != self.last_turn:
                self.distinct += 1
            self.high = self.last_turn = turn
        costs, ranks = self.costs, self.ranks
        after_costs, order, back = [], [], []
        for state, ways in enumerate(MOVES[_INITIALS.get(initial, _OTHER)][fault]):
            best = (_FAR, 0, 0, 0)
            for before, cost, edits in ways:
                if costs[before] < _FAR:
                    best = min(best, (costs[before] + cost, ranks[before], edits, before))
            after_costs.append(best[0])
            order.append((best[1], best[2], state))
            back.append(best[2] << 2 | best[3])
        for rank, (_, _, state) in enumerate(sorted(order)):
            ranks[state] = rank
        self.costs = after_costs
        self.steps.write(bytes(back))
        keep = fault in (NO_FAULT, IS_TRUNCATED)
        raw_role, raw_text = (role.encode(), text.encode()) if keep else (b"", b"")
        self.turns.write(struct.pack("<IQ", len(raw_role), len(raw_text)))
        self.turns.write(raw_role)
        self.turns.write(raw_text)
        self.rows += 1

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct

    def audit(self) -> tuple[int, str]:
        """(cost, edits) of the cheapest repair, the ASCII-least of several."""
        cost, _, state = min((self.costs[s] + INSERT * len(CLOSING[s]), self.ranks[s], s) for s in range(4) if self.costs[s] < _FAR)
        out = bytearray(CLOSING[state].encode())
        end = self.rows
        while end:
            start = max(0, end - TRACE_ROWS)
            self.steps.seek(4 * start)
            block = self.steps.read(4 * (end - start))
            for k in range(end - start - 1, -1, -1):
                step = block[4 * k + state]
                out += EDITS[step >> 2][::-1].encode()
                state = step & 3
            end = start
        out.reverse()
        return cost, out.decode()

    def repaired(self, audit: str) -> Iterator[tuple[str, bytes, bytes]]:
        """(edit, role, text) of the turns that the edits leave, in order."""
        self.turns.seek(0)
        state = NOTHING
        for edit in audit:
            if edit == "I":
                state = _inserted(state)
                yield edit, ROLES[state].encode(), b""
                continue
            n_role, n_text = struct.unpack("<IQ", self.turns.read(12))
            role, text = self.turns.read(n_role), self.turns.read(n_text)
            if edit == "K":
                state = {b"s": SYSTEM, b"u": USER, b"a": ASSISTANT}[role[:1]]
                yield edit, role, text
            elif edit == "R":
                state = _inserted(state)
                yield edit, ROLES[state].encode(), text


def _or_space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present of rows damaged by the CRC-32 of `conv_id:turn`; dropped ones have present false.

    Remainders modulo 20: 0 drops a row, 1 empties its text, 2 removes `[.!?]`, 3 repeats it, 4 makes its role user.
    """
    fate = F.pmod(F.crc32(F.concat(_or_space("conv_id"), F.lit(":"), _or_space("turn")).cast("binary")), F.lit(20))
    plain = documents_of(rows, "conv_id", "turn", "role", "text").select(
        "conv_id", "turn", _or_space("role").alias("role"), _or_space("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return plain.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("fate") != 0).alias("present"), F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("times"),
    ).withColumn("times", F.explode("times")).drop("times")


def _with_faults(rows: DataFrame) -> DataFrame:
    """Rows in order of conversation and turn, with fault and first (this role and text came in an earlier turn: false).

    What came earlier is an aggregate over digests, joined back for repeated ones only; a text that stands in very many rows is
    one row of it, and copies within one turn are neighbours, which the kernel sees.
    """
    present = F.col("present")
    blank = ~F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]"))
    cut = ~F.regexp_like("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    tagged = rows.select(
        "conv_id", "turn", "role", "text", "present",
        F.when(~present, NO_FAULT).when(blank, IS_BLANK).when(cut, IS_TRUNCATED).otherwise(NO_FAULT).alias("fault"),
        F.when(present & ~blank, digest).alias("digest"))
    repeated = (
        tagged.where("digest IS NOT NULL").groupBy("conv_id", "digest")
        .agg(F.count("*").alias("n"), F.count("turn").alias("n_turns"), F.min("turn").alias("first_turn")).where("n > 1")
        .select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), (F.col("n") > F.col("n_turns")).alias("null_first"), "first_turn")
    )
    later = F.coalesce(F.when(F.col("turn").isNull(), False).otherwise(F.col("null_first") | (F.col("turn") > F.col("first_turn"))), F.lit(False))
    return (
        tagged.join(repeated, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
        .select("conv_id", "turn", "role", "text", "present", "fault", later.alias("later"))
        .repartition(parts(rows.sparkSession), "conv_id")
        .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    )


def _conversations(batches: Iterator[pa.RecordBatch], spill_bytes: int) -> Iterator[tuple[int | None, Conversation]]:
    """Each conversation of sorted rows once all its rows have been added; valid until the next one is asked for."""
    state, started, current, before = Conversation(spill_bytes), False, None, None
    for b in batches:
        for conv_id, turn, role, text, present, fault, later in zip(*(c.to_pylist() for c in b.columns)):
            if not started or conv_id != current:
                if started:
                    yield current, state
                    state.reset()
                started, current, before = True, conv_id, None
            if not present:
                continue
            if fault != IS_BLANK and (later or before == (turn, role, text)):
                fault = IS_DUPLICATE
            before = (turn, role, text)
            state.add(turn, role, text, fault)
    if started:
        yield current, state


REPORT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def reports(rows: DataFrame, spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """One row for each conversation: its faults, the cheapest repair, and the digest of what it leaves.

    `rows` has conv_id, turn, role, text (no nulls in the last two) and present; rows that are not present only
    say that there is such a conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for conv_id, state in _conversations(batches, spill_bytes):
            cost, audit = state.audit()
            digest = hashlib.sha256()
            for k, (_, role, text) in enumerate(state.repaired(audit)):
                digest.update((b"\n" if k else b"") + role + b":")
                digest.update(text)
            faults = state.faults
            out.append((conv_id, state.gaps, faults[IS_BLANK], faults[IS_DUPLICATE], faults[IS_TRUNCATED], state.illegal, cost, audit, digest.hexdigest()))
            size += len(audit)
            if len(out) == 1024 or size > SPILL_BYTES:
                yield _batch(out, REPORT)
                out, size = [], 0
        if out:
            yield _batch(out, REPORT)

    return _with_faults(rows).mapInArrow(run, REPORT)


TURNS = "conv_id bigint, position bigint, edit string, role string, text string"


def repaired_turns(rows: DataFrame, spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """The repaired conversations: conv_id, position from 0, the edit that made the turn (K, R or I), role and text."""
    if "present" not in rows.columns:
        rows = documents_of(rows, "conv_id", "turn", "role", "text").select(
            "conv_id", "turn", _or_space("role").alias("role"), _or_space("text").alias("text"), F.lit(True).alias("present"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for conv_id, state in _conversations(batches, spill_bytes):
            for k, (edit, role, text) in enumerate(state.repaired(state.audit()[1])):
                out.append((conv_id, k, edit, role.decode(), text.decode()))
                size += len(text)
                if len(out) == 1024 or size > SPILL_BYTES:
                    yield _batch(out, TURNS)
                    out, size = [], 0
        if out:
            yield _batch(out, TURNS)

    return _with_faults(rows).mapInArrow(run, TURNS)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.strip().split() for f in schema.split(",")]
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def damaged_reports(conversations: DataFrame) -> DataFrame:
    """Reports of the conversations after `damage`."""
    return reports(damage(conversations))
