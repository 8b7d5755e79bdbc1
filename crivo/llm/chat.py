"""Conversations of typed content parts as one marked text.

A turn is a list of parts: text, image, audio or document. A visitor flattens them in order:
text is escaped, every other part becomes a numbered placeholder, and its reference and the
number of tokens it will expand to are recorded. A formatted turn reads

    ### role: body</turn>

and a conversation is its turns one after the other. A backslash precedes every control string
inside a role or a text, and every backslash, so that reading gives back what was written.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MIDDLE, END = "### ", ": ", "</turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>|<\|")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|<\||:")
_MARK = re.compile(r"\\(\\|###|</turn>|<\||:)|(</turn>\n|: )|<\|(image|audio|document):(\d+)\|>")
ATTACHMENTS = "array<struct<turn_index:int,kind:string,ref:string,n_tokens:long>>"


def escaped(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def text_part(text: Column) -> Column:
    """A list of one text part; null is an empty text."""
    return F.array(F.struct(
        F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("double").alias("width"), F.lit(None).cast("double").alias("height"), F.lit(None).cast("double").alias("length"),
    ))


@dataclass
class Expansion:
    """How many tokens an attachment stands for."""

    pixels: float = 28.0
    per_second: float = 25.0
    per_page: float = 256.0

    def image(self, width: float, height: float) -> int:
        return math.ceil(width / self.pixels) * math.ceil(height / self.pixels)

    def audio(self, seconds: float) -> int:
        return math.ceil(seconds * self.per_second)

    def document(self, pages: float) -> int:
        return math.ceil(pages * self.per_page)


@dataclass
class Flattener:
    """Visits the parts of one turn in order."""

    expansion: Expansion
    body: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict | None) -> None:
        kind = (part or {}).get("kind")
        if part is None:
            return
        visitor = getattr(self, f"visit_{kind}", None)
        if visitor is None:
            raise ValueError(f"unknown kind of part: {kind}")
        visitor(part)

    def visit_text(self, part: dict) -> None:
        self.body.append(escaped(part["text"] or ""))

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, self.expansion.image(part["width"] or 0, part["height"] or 0))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, self.expansion.audio(part["length"] or 0))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, self.expansion.document(part["length"] or 0))

    def _attach(self, kind: str, part: dict, n_tokens: int) -> None:
        self.body.append(f"<|{kind}:{len(self.attachments)}|>")
        self.attachments.append({"turn_index": len(self.attachments), "kind": kind, "ref": part["ref"], "n_tokens": n_tokens})


def format_turn(role: str, parts: list[dict], expansion: Expansion) -> tuple[str, int, int, list[dict]]:
    """The formatted turn, where its body starts and ends, and its attachments."""
    flat = Flattener(expansion)
    for part in parts:
        flat.visit(part)
    head = START + _ROLE_CONTROL.sub(lambda m: "\\" + m[0], role) + MIDDLE
    body = "".join(flat.body)
    return head + body + END, len(head), len(head) + len(body), flat.attachments


def read_turns(formatted: str) -> Iterator[tuple[str, list[tuple[str, str]], int, int]]:
    """Role, parts, and start and end of the body of every turn of a formatted text.

    Parts are ("text", text) and (kind, number as text).
    """
    at = 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        at += len(START)
        role, parts, held, body, done = None, [], [], 0, False
        last = at
        for mark in _MARK.finditer(formatted, at):
            plain = formatted[last:mark.start()]
            if mark[1] is not None:
                held += [plain, mark[1]]
            elif mark[3] is not None and role is not None:
                parts += [("text", "".join([*held, plain])), (mark[3], mark[4])]
                held = []
            elif mark[2] == MIDDLE and role is None:
                role, held, body = "".join([*held, plain]), [], mark.end()
            elif mark[2] == END and role is not None:
                yield role, [*parts, ("text", "".join([*held, plain]))], body, mark.start()
                at, done = mark.end(), True
                break
            else:
                held += [plain, mark[0]]
            last = mark.end()
        if not done:
            raise ValueError("a turn does not end")


def format_turns(
    turns: DataFrame, parts: Column, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
    expansion: Expansion = Expansion(), loss_role: str = "assistant",
) -> DataFrame:
    """One row per turn: ``conv``, ``turn``, ``formatted``, the loss mask and the attachments.

    The conversation is its turns' ``formatted`` in the order of ``turn``, equal turns in that
    of ``formatted``. ``mask_start`` and ``mask_end`` bound what is learned from in the turn,
    both 0 for other roles than ``loss_role``. A null role is empty; null parts are none.
    """
    rows = turns.select(
        F.col(f"`{conv_column}`").alias("conv"), F.col(f"`{turn_column}`").alias("turn"),
        F.coalesce(F.col(f"`{role_column}`").cast("string"), F.lit("")).alias("role"), parts.alias("parts"),
    )
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("conv", "turn")}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles = batch.column("role").to_pylist()
            made = [format_turn(r, p.as_py() or [], expansion) for r, p in zip(roles, batch.column("parts"))]
            learn = [r == loss_role for r in roles]
            found = pa.array([m[3] for m in made], pa.list_(pa.struct([("turn_index", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("n_tokens", pa.int64())])))
            yield pa.RecordBatch.from_arrays([
                batch.column("conv"), batch.column("turn"), pa.array([m[0] for m in made], pa.string()),
                pa.array([m[1] if x else 0 for m, x in zip(made, learn)], pa.int64()),
                pa.array([m[2] if x else 0 for m, x in zip(made, learn)], pa.int64()), found,
            ], names=["conv", "turn", "formatted", "mask_start", "mask_end", "attachments"])

    schema = f"conv {kinds['conv']}, turn {kinds['turn']}, formatted string, mask_start long, mask_end long, attachments {ATTACHMENTS}"
    return rows.mapInArrow(run, schema)


def _text(parts: list[tuple[str, str]]) -> str:
    return "".join(text for kind, text in parts if kind == "text")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of every conversation, read from its formatted turns.

    A conversation's turns pass through one task in order, as its hashes need, but one at a
    time: a conversation of any length takes the memory of its longest turn.
    """
    kind = formatted.schema["conv"].dataType.simpleString()
    ordered = formatted.repartition("conv").sortWithinPartitions("conv", "turn", "formatted")
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        conv, count, every, chars, loss, total = nothing, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
        done: list[tuple] = []
        conv_type = None

        def out() -> pa.RecordBatch:
            types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array([d[i] for d in done], t) for i, t in enumerate(types)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            conv_type = batch.schema.field("conv").type
            for c, text, start, end in zip(batch.column("conv").to_pylist(), batch.column("formatted").to_pylist(),
                                           batch.column("mask_start").to_pylist(), batch.column("mask_end").to_pylist()):
                if conv is nothing or c != conv:
                    if conv is not nothing:
                        done.append((conv, count, every.hexdigest(), chars, loss.hexdigest(), total))
                    conv, count, every, chars, loss, total = c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                for role, parts, body, stop in read_turns(text):
                    said = _text(parts)
                    every.update(f"{role}\n{said}\n".encode())
                    count += 1
                    if start <= body and stop <= end and end > 0:
                        chars += len(said)
                        loss.update(said.encode())
                total += len(text)
            yield out()
        if conv is not nothing:
            done.append((conv, count, every.hexdigest(), chars, loss.hexdigest(), total))
            yield out()

    schema = f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.mapInArrow(run, schema)
