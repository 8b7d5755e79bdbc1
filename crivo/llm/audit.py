"""How filters interact: what each removes, finds already removed, or removes alone, in every order.

Every document gets a mask, a bit per filter it fails. One filter asks the whole table: is the
text that of a smaller id? Radix tries answer it. A task inserts its texts into compressed
tries whose terminals hold the smallest id so far; every row beaten there is a duplicate for
certain, and only one row per text, task and id travels on with its text. Those rows are dealt
out by ranges of text prefixes. A prefix under which too much text lies is made longer until it
parts the texts, so a line that many texts start with does not fill one task. Each range is
inserted into tries again, and what their terminals hold at the end is no duplicate.

The masks are then reduced to counts, and all orders are worked out from the counts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crivo.llm.common import row_bytes, stored, tidy
from crivo.shared import lookup, measured

# A trie is emptied when it holds about so many bytes of text.
TRIE_BYTES = 16 << 20
# Prefixes are made longer by this factor, from this many bytes on.
FIRST_PREFIX, LONGER = 16, 4
# The prefixes to be made longer number at most so many: more text may lie under each of them.
MOST_HEAVY = 1_000_000

_CONTINUED = bytes(range(0x80, 0xC0))
_NO_CAPITALS = bytes(b for b in range(256) if not 65 <= b <= 90)
_SIGNS = re.compile(rb"[#$%&*|]")


# ---- filters of one text ---------------------------------------------------------------

def too_short(text: bytes, words: list[bytes]) -> bool:
    return len(words) < 200


def repetitive(text: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < 50 * len(words)


def shouting(text: bytes, words: list[bytes]) -> bool:
    return 100 * len(text.translate(None, _NO_CAPITALS)) > 3 * len(text.translate(None, _CONTINUED))


def holds_signs(text: bytes, words: list[bytes]) -> bool:
    return _SIGNS.search(text) is not None


Test = Callable[[bytes, list[bytes]], bool]
TESTS: dict[str, Test] = {"A": too_short, "B": repetitive, "C": shouting, "D": holds_signs}
DUPLICATE = "E"


def failed(text: bytes, tests: Sequence[Test]) -> int:
    """A bit for each of the tests that the UTF-8 text fails."""
    words = text.split()  # bytes.split() parts at ASCII white space alone
    return sum(1 << i for i, test in enumerate(tests) if test(text, words))


# ---- tries -----------------------------------------------------------------------------

class Node:
    """A node of a radix trie; ``rows`` counts the rows of the smallest id by part, if a text ends here."""

    __slots__ = ("label", "children", "mask", "least", "rows")

    def __init__(self, label: bytes) -> None:
        self.label = label
        self.children: dict[int, Node] = {}
        self.mask, self.least, self.rows = 0, None, None


def _same(label: bytes, text: bytes, at: int) -> int:
    """How many bytes ``label`` and ``text`` from ``at`` on have in common."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == text[at + low:at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """Texts with the smallest id of each. Rows known to be duplicates are put into ``settled``."""

    def __init__(self, duplicate: int) -> None:
        self.duplicate = duplicate
        self.settled: list[tuple] = []
        self.clear()

    def clear(self) -> None:
        self.root, self.size = Node(b""), 0

    def terminal(self, text: bytes) -> Node:
        """The node where ``text`` ends, made if need be."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                self.size += len(text) - at
                return child
            if text.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            same = _same(child.label, text, at)
            fork = node.children[text[at]] = Node(child.label[:same])
            child.label = child.label[same:]
            fork.children[child.label[0]] = child
            node, at = fork, at + same
        return node

    def add(self, text: bytes, ident: object, part: str, n: int, mask: Callable[[bytes], int]) -> None:
        """Insert ``n`` equal rows; ``mask`` is asked once for each text."""
        node = self.terminal(text)
        if node.rows is None:
            node.mask, node.least, node.rows = mask(text), ident, {}
            self.size += 200
        if ident > node.least:
            self.settled.append((ident, part, node.mask | self.duplicate, n))
            return
        if ident < node.least:
            self.settled.extend((node.least, p, node.mask | self.duplicate, k) for p, k in node.rows.items())
            node.least, node.rows = ident, {}
        node.rows[part] = node.rows.get(part, 0) + n

    def firsts(self) -> Iterator[tuple[bytes, object, str, int, int]]:
        """Text, id, part, mask and number of the rows that no smaller id has beaten."""
        waiting = [(self.root, b"")]
        while waiting:
            node, before = waiting.pop()
            text = before + node.label
            if node.rows is not None:
                for part, n in node.rows.items():
                    yield text, node.least, part, node.mask, n
            waiting.extend((child, text) for child in node.children.values())


def _columns(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names=names)


def _locally(docs: DataFrame, tests: Sequence[Test]) -> DataFrame:
    """``id``, ``part``, ``mask``, ``n`` and, where another task may have a smaller id, ``text``."""
    duplicate = 1 << len(tests)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, types, names = Trie(duplicate), [], ["id", "part", "mask", "n", "text"]

        def emptied() -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for text, ident, part, mask, n in trie.firsts():
                rows.append((ident, part, mask, n, text))
                size += len(text)
                if size > 4 << 20:
                    yield _columns(rows, types, names)
                    rows, size = [], 0
            yield _columns(rows, types, names)
            trie.clear()

        for batch in batches:
            types = [batch.schema.field("id").type, pa.string(), pa.int32(), pa.int64(), pa.binary()]
            idents, parts = batch.column("id").to_pylist(), batch.column("part").to_pylist()
            for ident, part, text in zip(idents, parts, row_bytes(batch.column("text"))):
                if ident is None:
                    trie.settled.append((None, part, failed(text, tests), 1))
                else:
                    trie.add(text, ident, part, 1, lambda t: failed(t, tests))
                if trie.size > TRIE_BYTES:
                    yield from emptied()
            yield _columns([(*row, None) for row in trie.settled], types, names)
            trie.settled.clear()
        if types:
            yield from emptied()

    return docs.mapInArrow(tidy(run), f"id {docs.schema['id'].dataType.simpleString()}, part string, mask int, n long, text binary")


def _by_range(rows: DataFrame, duplicate: int) -> DataFrame:
    """``id``, ``part``, ``mask`` and ``n`` of rows that come sorted by ``key``, a prefix of ``text``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, before, names = Trie(duplicate), None, ["id", "part", "mask", "n"]
        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.schema.field("id").type, pa.string(), pa.int32(), pa.int64()]
            columns = [batch.column(c).to_pylist() for c in ("key", "id", "part", "mask", "n")]
            for key, ident, part, mask, n, text in zip(*columns, row_bytes(batch.column("text").cast(pa.large_binary()))):
                # Equal texts have equal keys, so a trie may be emptied where the key changes.
                if key != before and trie.size > TRIE_BYTES:
                    yield _columns([row[1:] for row in trie.firsts()], types, names)
                    trie.clear()
                before = key
                trie.add(text, ident, part, n, lambda t: mask)
            yield _columns(trie.settled, types, names)
            trie.settled.clear()
        if types:
            yield _columns([row[1:] for row in trie.firsts()], types, names)

    chosen = rows.select("key", "id", "part", "mask", "n", "text")
    return chosen.mapInArrow(tidy(run), f"id {rows.schema['id'].dataType.simpleString()}, part string, mask int, n long")


def keyed(rows: DataFrame, most_bytes: int | None = None) -> tuple[DataFrame, int]:
    """``rows`` with ``key``, a prefix of the bytes of ``text`` under which at most ``most_bytes`` lie, and all bytes.

    By default that is half of a task's share, and no more than a trie takes. The prefix is
    longer only where it must be. A whole text is a key whatever its copies take.
    """
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = most_bytes or max(min(TRIE_BYTES, total // (2 * tasks)), total // MOST_HEAVY)
    out, length = rows.withColumn("key", F.substring("text", 1, FIRST_PREFIX)), FIRST_PREFIX
    while True:
        longer = out.where((F.octet_length("text") > length) & (F.octet_length("key") == length))
        heavy = stored(longer.groupBy("key").agg(F.sum(F.octet_length("text")).alias("size")).where(F.col("size") > most).select("key"), "prefixes")
        if heavy.isEmpty():
            return out, total
        length *= LONGER
        found = lookup(out, heavy.withColumn("heavy", F.lit(True)), ["key"], measured(heavy))
        out = found.withColumn("key", F.when(F.col("heavy"), F.substring("text", 1, length)).otherwise(F.col("key"))).drop("heavy")


def masks(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang",
    tests: dict[str, Test] = TESTS, most_bytes: int | None = None,
) -> DataFrame:
    """``id``, ``part``, ``mask`` and ``n``: how many rows of an id and a part fail just these filters.

    Bit i of the mask is the i-th of ``tests``, the next bit tells a duplicate: a row whose text
    is that of a smaller id. Null texts are empty, a null part is the empty text. A row without an
    id is no duplicate and makes none; repeated rows of one id are no duplicates of each other.
    """
    rows = docs.select(
        F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{part_column}`").cast("string"), F.lit("")).alias("part"),
        F.col(f"`{text_column}`").cast("string").alias("text"))
    local = stored(_locally(rows, list(tests.values())), "local-firsts")
    prefixed, size = keyed(local.where("text IS NOT NULL"), most_bytes)
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    needed = size // (128 << 20) + 1
    ranges = prefixed.repartitionByRange(needed, "key") if needed > least else prefixed.repartitionByRange("key")
    found = _by_range(ranges.sortWithinPartitions("key"), 1 << len(tests))
    every = found.union(local.where("text IS NULL").select("id", "part", "mask", "n"))
    return every.groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))


# ---- orders ----------------------------------------------------------------------------

def labelled(found: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Rows of `masks` counted by ``part``, ``mask``, ``good`` and ``toxic``.

    A document is good if a row of ``labels`` gives it the quality 1, toxic if one says so.
    """
    said = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    both = found.join(said, "id", "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    return both.groupBy("part", "mask", *flags).agg(F.sum("n").alias("n"))


def interactions(counted: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row per part, order of all filters and step, from counts by mask."""
    lines = []
    for order in permutations(range(len(letters))):
        name, before = "".join(letters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            lines.append((name, step, 1 << i, before))
            before |= 1 << i
    orders = len(lines) // len(letters)
    # One literal instead of thousands of expressions.
    steps = json.dumps([dict(zip(("filter_order", "step", "own", "before"), line)) for line in lines])
    listed = F.from_json(F.lit(steps), "array<struct<filter_order:string,step:int,own:int,before:int>>")
    long = counted.select("*", F.inline(listed))
    fails, earlier = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    removed = fails & ~earlier

    def total(condition, n=F.col("n")):
        return F.sum(F.when(condition, n).otherwise(F.lit(0))).cast("long")

    # Of the filters that a document fails each comes first in the same share of all orders.
    share = (F.col("n") * F.lit(orders) / F.bit_count("mask")).cast("long")
    return long.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier).alias("kept"), total(removed).alias("removed"), total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"), total(removed & F.col("good")).alias("good_lost"),
        total(removed & F.col("toxic")).alias("toxic_lost"), total(fails, share).alias("shapley"))
