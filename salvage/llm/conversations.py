"""Repair of conversation structure: secondary-sorted streams of rows through a dynamic program.

Rows are dealt by conversation and sorted by turn; each task reads its conversations as one stream of Arrow batches. Carried
from row to row, and from batch to batch, are the cheapest edits for every state of the roles written so far
(``START``, after ``system``, after ``user``, after ``assistant``): a cost and a rank in the order of the edits' letters.
Of every row one number is remembered, which names the four steps that led to it; when the conversation ends, the steps are
followed back from the best end. These back-pointers and the rows' own texts are held in memory up to ``HELD`` bytes and in a file
of the task beyond that, so a conversation of any length takes bounded memory.

Why a rank is enough for ties: edits are read as "inserts before a row, then the row's own edit". Then no two
states' edits are equal or one the beginning of the other after the same rows, and the first of two stays the first whatever follows.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

START, SYSTEM, USER, ASSISTANT = range(4)
_ROLES = {USER: "user", ASSISTANT: "assistant"}
_INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_AFTER = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
_ENDS = (START, ASSISTANT)
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}

HELD = 8 << 20
_FAR = 1 << 40

# What a row is to the program: the state its role asks for (START: none), must it go, is it truncated.
Kind = tuple[int, bool, bool]
# The state before a row, and the letters of the edits up to it.
Step = tuple[int, str]


def _inserted(state: int, most: int = 2) -> list[tuple[int, str, list[int]]]:
    """Where inserts lead from a state: the new state, the letters, the states passed. More than two come back to a state."""
    found, passed = [(state, "", [])], []
    for _ in range(most):
        state = next(s for s in _AFTER[state] if s in _ROLES)
        passed = [*passed, state]
        found.append((state, "I" * len(passed), passed))
    return found


def _row_edits(state: int, kind: Kind) -> list[tuple[int, str, int]]:
    """What can be done with a row in a state: the new state, the letter, the cost."""
    asked, must_go, truncated = kind
    found = [(state, "D", DELETE)]
    if not must_go:
        if asked in _AFTER[state]:
            found.append((asked, "K", TRUNCATED * truncated))
        found += [(s, "R", REROLE + TRUNCATED * truncated) for s in _AFTER[state] if s in _ROLES]
    return found


class Program:
    """The steps of the dynamic program, each worked out once.

    A situation is four costs less the smallest and four ranks; there are few of them, so rows are looked up by the
    situation and their kind.
    """

    def __init__(self) -> None:
        first = (0, _FAR, _FAR, _FAR), (0, 1, 2, 3)
        self.situations = [first]
        self._numbers = {first: 0}
        self.steps: list[tuple[Step | None, ...]] = []
        self._known: dict[tuple[int, Kind], tuple[int, int, int]] = {}

    def step(self, situation: int, kind: Kind) -> tuple[int, int, int]:
        """The situation after a row, what it cost all states at least, and the number of the steps taken."""
        found = self._known.get((situation, kind))
        if found is None:
            found = self._known[situation, kind] = self._worked_out(*self.situations[situation], kind)
        return found

    def _worked_out(self, costs: tuple[int, ...], ranks: tuple[int, ...], kind: Kind) -> tuple[int, int, int]:
        best: dict[int, tuple[int, int, str, int]] = {}
        for state in range(4):
            if costs[state] < _FAR:
                for between, letters, passed in _inserted(state):
                    for after, letter, cost in _row_edits(between, kind):
                        total = costs[state] + INSERT * len(passed) + cost
                        best[after] = min(best.get(after, (_FAR,)), (total, ranks[state], letters + letter, state))
        least = min(b[0] for b in best.values())
        order = sorted(best, key=lambda s: best[s][1:3])
        new = (
            tuple(best[s][0] - least if s in best else _FAR for s in range(4)),
            tuple(order.index(s) if s in best else 4 for s in range(4)),
        )
        if new not in self._numbers:
            self._numbers[new] = len(self.situations)
            self.situations.append(new)
        self.steps.append(tuple((best[s][3], best[s][2]) if s in best else None for s in range(4)))
        return self._numbers[new], least, len(self.steps) - 1

    def end(self, situation: int) -> tuple[int, str, int]:
        """The state to stop in, the inserts that end the conversation, and their cost."""
        costs, ranks = self.situations[situation]
        ends = [
            (costs[s] + INSERT * len(passed), ranks[s], letters, s)
            for s in range(4) if costs[s] < _FAR
            for between, letters, passed in _inserted(s) if between in _ENDS
        ]
        cost, _, letters, state = min(ends)
        return state, letters, cost


class _Spool:
    """Numbers and byte strings of a conversation in their order, in memory first, then in a file of the task."""

    def __init__(self, held: int) -> None:
        self._file = tempfile.SpooledTemporaryFile(max_size=held)
        self._held = held

    def write(self, raw: bytes) -> None:
        self._file.write(raw)

    def forwards(self, width: int) -> Iterator[bytes]:
        """The file in parts of whole items of ``width`` bytes."""
        self._file.seek(0)
        while part := self._file.read(max(1, self._held // width) * width):
            yield part

    def backwards(self, width: int) -> Iterator[bytes]:
        """The same from its end."""
        at = self._file.seek(0, 2)
        while at:
            size = min(at, max(1, self._held // width) * width)
            at -= size
            self._file.seek(at)
            yield self._file.read(size)

    def read(self, size: int) -> bytes:
        return self._file.read(size)

    def rewind(self) -> None:
        self._file.seek(0)

    def close(self) -> None:
        self._file.close()


class _Conversation:
    """One conversation as its rows come in."""

    def __init__(self, conv_id: int | None, program: Program, held: int) -> None:
        self.conv_id, self._program, self._held = conv_id, program, held
        self._situation = self._cost = 0
        self._pointers, self._texts, self._sizes = _Spool(held), _Spool(held), _Spool(held)
        self._new_pointers, self._new_sizes = array("i"), array("q")
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self._least = self._last_turn = self._initial = None
        self._turns = 0

    def add(self, turn: int | None, role: str, text: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        initial = role[:1]
        if self._initial is not None:
            self.illegal += (self._initial, initial) not in _LEGAL
        self._initial = initial
        if turn is not None and turn != self._last_turn:
            self._turns += 1
            self._least = turn if self._least is None else self._least
            self._last_turn = turn
        truncated = truncated and not blank and not duplicate
        self.blank += blank
        self.duplicate += duplicate and not blank
        self.truncated += truncated
        kind = _INITIALS.get(initial, START), blank or duplicate, truncated
        self._situation, cost, pointer = self._program.step(self._situation, kind)
        self._cost += cost
        self._new_pointers.append(pointer)
        for part in (role, text):
            raw = part.encode("utf-8", "surrogatepass")
            self._texts.write(raw)
            self._new_sizes.append(len(raw))
        if len(self._new_sizes) >= 1 << 16:
            self._put_away()

    def _put_away(self) -> None:
        self._pointers.write(self._new_pointers.tobytes())
        self._sizes.write(self._new_sizes.tobytes())
        del self._new_pointers[:], self._new_sizes[:]

    def _edits(self, state: int, last: str) -> bytes:
        """The letters of all edits, followed back from the end."""
        audit, steps = bytearray(last.encode()), self._program.steps
        for part in self._pointers.backwards(4):
            for pointer in reversed(array("i", part)):
                state, letters = steps[pointer][state]
                audit += letters[::-1].encode()
        return bytes(reversed(audit))

    def _repaired(self, audit: bytes) -> str:
        """The digest of the repaired rows."""
        digest, state, first = hashlib.sha256(), START, True

        def put(*parts: bytes) -> None:
            nonlocal first
            if not first:
                digest.update(b"\n")
            first = False
            for part in parts:
                digest.update(part)

        self._texts.rewind()
        sizes = iter(size for part in self._sizes.forwards(8) for size in array("q", part))
        for letter in audit:
            if letter in b"IR":
                state = next(s for s in _AFTER[state] if s in _ROLES)
            if letter == b"I"[0]:
                put(_ROLES[state].encode(), b":")
                continue
            role, text = self._texts.read(next(sizes)), self._texts.read(next(sizes))
            if letter == b"R"[0]:
                put(_ROLES[state].encode(), b":", text)
            elif letter == b"K"[0]:
                state = _INITIALS[role[:1].decode()]
                put(role, b":", text)
        return digest.hexdigest()

    def result(self) -> tuple:
        self._put_away()
        state, last, cost = self._program.end(self._situation)
        audit = self._edits(state, last)
        gaps = 0 if self._least is None else self._last_turn - self._least + 1 - self._turns
        row = (
            self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal,
            self._cost + cost, audit.decode(), self._repaired(audit),
        )
        for spool in (self._pointers, self._texts, self._sizes):
            spool.close()
        return row


REPAIRED = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)


def _rows(conversations: DataFrame, *extra: Column) -> DataFrame:
    """``conv_id``, ``turn``, ``role`` and ``text``; a null role or text is one space."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")),
        *extra,
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows as a faulty export leaves them, by crc32 of ``conv_id:turn`` modulo 20, with the column ``there``.

    0 drops a row (it stays here with ``there`` false), 1 empties its text, 2 removes its ``.!?``, 3 repeats it,
    4 makes it the user's. Nulls are one space, in the key as in role and text. No rows, no result rows; other columns
    are left behind.
    """
    rows = _rows(conversations)
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.pmod(F.crc32(F.concat_ws(":", *part).cast("binary")), F.lit(20))
    text = F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (fault != 0).alias("there"), F.explode(copies).alias("copy"),
    ).drop("copy")


def _last_sign(text: Column) -> Column:
    """The last character that is not of ``[\\x20\\x09-\\x0D]``; empty without one."""
    return F.substring(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), -1, 1)


def repaired(rows: DataFrame, there: str | None = None, held: int = HELD) -> DataFrame:
    """One row per conversation, as ``REPAIRED`` names the columns, with the cheapest edits to roles ``(s?(ua)+)?``.

    ``rows`` has ``conv_id``, ``turn``, ``role`` and ``text``; ``there`` names a column that is false in rows which only say
    that their conversation exists. Rows are taken by turn, nulls first, those of one turn by role and text. A row's first
    fault counts: blank, duplicate (role and text seen earlier), truncated. Keep is free, rerole costs 3, delete 4 and must
    be done to blank and duplicate rows, insert 3; a truncated row that stays adds 3. ``audit`` has the edits' letters, the
    least of the cheapest.

    Rows without a conversation id are one conversation. A conversation without rows has zeros, an empty audit and
    the digest of nothing. Null roles and texts are one space. No rows, no result rows; other columns are ignored.

    One shuffle deals the rows by conversation; duplicates are numbered and rows sorted inside its partitions, by sorts
    that spill. A very long conversation is one task's work, but never held whole in memory.
    """
    is_there = F.lit(True) if there is None else F.col(there)
    taken = _rows(rows, is_there.alias("there"))
    spoken = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    dealt = taken.withColumn("said", F.when(F.col("there"), spoken)).repartition("conv_id")
    earlier = Window.partitionBy("conv_id", "said").orderBy(F.col("turn").asc_nulls_first())
    last = _last_sign(F.col("text"))
    in_order = (
        dealt.withColumn("duplicate", F.row_number().over(earlier) > 1)
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "duplicate")
        .select(
            # As text, for numbers with nulls among them would lose digits on their way.
            F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("turn"), "there",
            "role", "text", (last == "").alias("blank"), "duplicate", (~last.isin(".", "!", "?")).alias("truncated"),
        )
    )

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        program, current, done = Program(), None, []
        for frame in frames:
            for conv_id, turn, is_there, *row in zip(*(frame[c].tolist() for c in frame.columns)):
                conv_id = None if conv_id is None else int(conv_id)
                if current is None or conv_id != current.conv_id:
                    if current is not None:
                        done.append(current.result())
                    current = _Conversation(conv_id, program, held)
                if is_there:
                    current.add(None if turn is None else int(turn), *row)
            if done:
                yield _frame(done)
                done = []
        if current is not None:
            yield _frame([current.result()])

    return in_order.mapInPandas(work, REPAIRED)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in REPAIRED.split(", ")]
    columns = dict(zip(names, zip(*rows)))
    return pd.DataFrame({"conv_id": pd.array(columns.pop("conv_id"), "Int64"), **columns})
