"""Conversations with faults, repaired at the least cost.

A conversation is a path through the states nothing, system, user and assistant said last. Each
row is kept, given another role or deleted, and turns may be inserted anywhere. One integer is
the weight of a path: its high digits are the cost, and below them each edit's letter is a digit
in octal at the place of the edit, with zeros to the end. The least integer is then the cheapest
path, and of the cheapest the first in the order of their letters, so a minimum of integers per
state and row decides everything. (Two paths of one cost to one state are never one the
beginning of the other: what is longer has inserted more.)

A conversation streams through one task in its order, since its hash needs it whole. What all
paths have in common is written down every few rows, so memory does not grow with its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crivo.llm.common import row_bytes

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# Digits in the order of the letters; zero is no letter.
_LETTERS = str.maketrans("1234", "DIKR")
_D, _I, _K, _R = 1, 2, 3, 4
_NOTHING, _SYSTEM, _USER, _ASSISTANT = range(4)
_ROLE = {_USER: b"user", _ASSISTANT: b"assistant"}
# Who speaks next by edit, and whose initial may be kept where.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_KEPT = ({b"s": _SYSTEM, b"u": _USER}, {b"u": _USER}, {b"a": _ASSISTANT}, {b"u": _USER})
_LEGAL = {b"su", b"ua", b"au"}


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text`` and ``copies`` after damage by the crc32 of ``conv:turn`` modulo 20.

    0 drops a row (no copies), 1 empties its text, 2 takes its ``[.!?]``, 3 repeats it, 4 makes
    it the user's. Null roles and texts are one space, as are nulls in what the crc32 is of.
    """
    def known(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.encode(F.concat(known(conv), F.lit(":"), known(turn)), "UTF-8")), F.lit(20))
    changed = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(known(text), ".!?", "")).otherwise(known(text))
    return turns.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(known(role)).alias("role"),
        changed.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


class Path:
    """The best edits of one conversation so far, for every state it can be in."""

    def __init__(self, width: int = 96) -> None:
        self.width, self.cost, self.audit = width, 0, []
        # State: weight, letters of it that are not yet written down, hash of the repaired rows.
        self.states = {_NOTHING: (0, 0, hashlib.sha256())}

    def _extended(self, state: int, cost: int, letter: int) -> tuple[int, int]:
        weight, letters, _ = self.states[state]
        return weight + (cost << 3 * self.width) + (letter << 3 * (self.width - letters - 1)), letters + 1

    def _hashed(self, state: int, role: bytes, text: bytes):
        found = self.states[state][2].copy()
        found.update((b"" if state == _NOTHING else b"\n") + role + b":" + text)
        return found

    def insert(self) -> None:
        """Let turns be inserted here: two at most, as more would only come back to a state."""
        for _ in range(2):
            for state in list(self.states):
                into = _NEXT[state]
                weight, letters = self._extended(state, INSERT, _I)
                if into not in self.states or weight < self.states[into][0]:
                    self.states[into] = weight, letters, self._hashed(state, _ROLE[into], b"")

    def row(self, role: bytes, text: bytes, gone: bool, truncated: bool) -> None:
        """The next row; ``gone`` must be deleted."""
        self.insert()
        extra = TRUNCATED if truncated else 0
        best: dict[int, tuple] = {}

        def offer(state: int, into: int, cost: int, letter: int, said: bytes | None) -> None:
            weight, letters = self._extended(state, cost, letter)
            if into not in best or weight < best[into][0]:
                best[into] = weight, letters, state, said

        for state in self.states:
            offer(state, state, DELETE, _D, None)
            if gone:
                continue
            into = _KEPT[state].get(role[:1])
            if into is not None:
                offer(state, into, KEEP + extra, _K, role)
            offer(state, _NEXT[state], REROLE + extra, _R, _ROLE[_NEXT[state]])
        self.states = {
            into: (weight, letters, self.states[state][2] if said is None else self._hashed(state, said, text))
            for into, (weight, letters, state, said) in best.items()}
        if max(letters for _, letters, _ in self.states.values()) > self.width - 8:
            self._settle()

    def _settle(self) -> None:
        """Write down the letters that all states agree on; if they are few, widen the weights."""
        low = (1 << 3 * self.width) - 1
        weights = [w & low for w, _, _ in self.states.values()]
        apart = max(w ^ weights[0] for w in weights).bit_length()
        common = min(self.width - (apart + 2) // 3, *(n for _, n, _ in self.states.values()))
        wider = max(self.width, 2 * (self.width - common))
        least = min(w >> 3 * self.width for w, _, _ in self.states.values())
        if common:
            self.audit.append(_spelled(weights[0] >> 3 * (self.width - common), common))
        self.cost += least
        self.states = {
            state: (((w >> 3 * self.width) - least) << 3 * wider | ((w << 3 * common) & low) << 3 * (wider - self.width), n - common, h)
            for state, (w, n, h) in self.states.items()}
        self.width = wider

    def end(self) -> tuple[int, str, str]:
        """Cost, letters and hash of the best path that ends with nothing or the assistant."""
        self.insert()
        weight, letters, found = min((self.states[s] for s in (_NOTHING, _ASSISTANT) if s in self.states), key=lambda s: s[0])
        digits = (weight & ((1 << 3 * self.width) - 1)) >> 3 * (self.width - letters)
        return self.cost + (weight >> 3 * self.width), "".join(self.audit) + _spelled(digits, letters), found.hexdigest()


def _spelled(digits: int, letters: int) -> str:
    return format(digits, "o").zfill(letters).translate(_LETTERS) if letters else ""


class Conversation:
    """Counts the faults of one conversation's rows and repairs them."""

    def __init__(self) -> None:
        self.path, self.before = Path(), None
        self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: bytes, text: bytes, seen: bool) -> None:
        if turn is not None and (self.first is None or turn != self.last):
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if self.before is not None and self.before + role[:1] not in _LEGAL:
            self.illegal += 1
        self.before = role[:1]
        said = text.strip()  # bytes.strip() takes ASCII white space alone
        blank, cut = not said, said[-1:] not in (b".", b"!", b"?")
        if blank:
            self.blank += 1
        elif seen:
            self.duplicate += 1
        elif cut:
            self.truncated += 1
        self.path.row(role, text, blank or seen, cut)

    def end(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.path.end()


def repaired(rows: DataFrame) -> DataFrame:
    """Faults and the cheapest repair of every ``conv`` of ``rows`` (``conv``, ``turn``, ``role``, ``text``, ``copies``).

    A conversation's rows are taken by turn, nulls first, then by role and text; rows of no
    copies only name their conversation. A null ``conv`` is a conversation of its own. Roles
    count by their first letter, and an empty role has none that may be kept.
    """
    there = F.col("copies") > 0
    one = rows.select("conv", *[F.when(there, F.col(c)).alias(c) for c in ("turn", "role", "text")], "copies")
    # Equal rows of one turn are one row with a number, so that copies do not travel.
    grouped = one.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    earlier = Window.partitionBy("conv", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    marked = grouped.withColumn("seen", F.row_number().over(earlier) > 1)
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    streamed = marked.repartition("conv").sortWithinPartitions(*order)
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, types = None, None, []

        def finished(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)

        for batch in batches:
            types = [batch.schema.field("conv").type, *[pa.int64()] * 6, pa.string(), pa.string()]
            done = []
            columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "copies", "seen")]
            for conv, turn, copies, seen, role, text in zip(*columns, row_bytes(batch.column("role")), row_bytes(batch.column("text"))):
                if current is None or conv != held:
                    if current is not None:
                        done.append((held, *current.end()))
                    current, held = Conversation(), conv
                for copy in range(copies):
                    current.add(turn, role, text, seen or copy > 0)
            if done:
                yield finished(done)
        if current is not None:
            yield finished([(held, *current.end())])

    schema = f"conv {rows.schema['conv'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in names[1:7]) + ", audit string, repaired_sha256 string"
    return streamed.mapInArrow(run, schema)
