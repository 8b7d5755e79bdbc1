"""Removal of repeated passages, by suffix automata over shards of repeated text.

A passage counts as repeated from ``width`` words on. Any window of that many words holds an
anchor: the smallest hash of its runs of ``GRAM`` words. As only the window's own words decide,
equal windows hold equal anchors at equal places. So every occurrence of an anchor stands for
the windows that chose it, a stretch of a few words more than a window, and windows that are
equal meet where stretches of one anchor meet.

Texts are packed into blocks of bounded size. A block asks which of its distinct anchors occur
elsewhere, and sends each distinct stretch of those to the shard of its anchor. A shard builds
suffix automata over its stretches, in order of their first occurrence, and streams them
through: the matching statistics give, for every window, the place where the same words
occur first. Every block that has a stretch gets the verdict on it, by a hash that stands for
the stretch on the way. Anchors that occur very
often, as in a line that many documents share, have stretches without number that hardly
ever agree; their windows are sent one by one, as hashes of 128 bits that need no automaton,
so that no shard grows with such a line.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from crivo.llm.common import bucket_of, hashed_rows, packed, row_bytes, stored, tidy, unpacked, unused

GRAM = 6
# Occurrences from which an anchor's stretches are dealt window by window.
OFTEN = 256
# Words of reference text in one automaton, about.
SHARD_WORDS = 40_000
BLOCK_BYTES = 12 << 20
# Bytes of text for each bucket of anchors and each shard of stretches.
BUCKET_BYTES = 8 << 20
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)


def anchors(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Row, first window, number of windows and hash of every anchor of rows of word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    grams = np.zeros(len(hashes) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        grams = (grams ^ hashes[i:i + len(grams)]) * np.uint64(_MIX[0])
        grams ^= grams >> np.uint64(29)
    grams = (grams ^ (grams >> np.uint64(32))) * np.uint64(_MIX[1])
    span = width - GRAM + 1
    row_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = np.flatnonzero(row_of[:n] == row_of[width - 1:])
    chosen = np.concatenate([
        part + np.lib.stride_tricks.sliding_window_view(grams, span)[part].argmin(axis=1)
        for part in np.array_split(whole, len(whole) // 50_000 + 1)
    ])
    new = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]])[:len(chosen)])
    rows = row_of[whole[new]]
    return rows, whole[new] - bounds[rows], np.diff(np.append(new, len(chosen))), grams[chosen[new]]


class SuffixAutomaton:
    """The suffix automaton of several texts, with the place where each state's words end first."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [(-1, -1)]

    def _state(self, length: int, end: tuple[int, int], moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.end.append(end)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, state: int, word: int) -> int:
        """The state of the longest words that end in ``word`` after ``state``, made if need be."""
        target = self.next[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._state(self.length[state] + 1, self.end[target], dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def add(self, number: int, words: list[int]) -> None:
        """Append one text; its places are ``(number, end position)``."""
        last = 0
        for position, word in enumerate(words):
            if word in self.next[last]:
                last = self._split(last, word)
                continue
            new = self._state(self.length[last] + 1, (number, position), {}, 0)
            state = last
            while state >= 0 and word not in self.next[state]:
                self.next[state][word] = new
                state = self.link[state]
            if state >= 0:
                self.link[new] = self._split(state, word)
            last = new

    def first_ends(self, words: list[int], width: int) -> list[tuple[int, int] | None]:
        """For every position, where the ``width`` words that end there end first; None if nowhere.

        The matched length at a position is its matching statistic; longer matches are cut
        back to ``width`` along the suffix links.
        """
        state, matched, found = 0, 0, []
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            while self.length[self.link[state]] >= width:
                state = self.link[state]
                matched = self.length[state]
            found.append(self.end[state] if matched >= width else None)
        return found


def _judge(stretches: dict[bytes, tuple], width: int) -> Iterator[tuple[bytes, int, int]]:
    """Content, the windows that the automaton finds, and those that occur before its first place, as bits."""
    order = sorted(stretches.items(), key=lambda item: item[1])
    automaton = SuffixAutomaton()
    texts = [np.frombuffer(content, np.int64).tolist() for content, _ in order]
    for number, words in enumerate(texts):
        automaton.add(number, words)
    for number, (content, place) in enumerate(order):
        seen = earlier = 0
        for end, first in enumerate(automaton.first_ends(texts[number], width)):
            if first is not None:
                where = order[first[0]][1]
                seen |= 1 << (end - width + 1)
                if (*where[:2], where[2] + first[1]) < (*place[:2], place[2] + end):
                    earlier |= 1 << (end - width + 1)
        yield content, seen, earlier


# ---- blocks ----------------------------------------------------------------------------

class _Block:
    """Rows of a block: their words' hashes and anchors, piece by piece."""

    def __init__(self, table: pa.Table, text: int, width: int) -> None:
        self.ids = table.column(0).to_pylist()
        self.column = table.column(text).combine_chunks()
        self.texts = list(row_bytes(self.column))
        self.prints = [xxhash.xxh64_intdigest(t) >> 1 for t in self.texts]
        self.width = width

    def pieces(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First row, word hashes and bounds of runs of rows."""
        return hashed_rows(self.column)

    def stretches(self, first: int, hashes: np.ndarray, bounds: np.ndarray, repeated: np.ndarray, often: np.ndarray):
        """Row, place, number of windows, anchor, often and content of stretches of repeated anchors."""
        rows, at, count, found = anchors(hashes, bounds, self.width)
        if not len(found) or not len(repeated):
            return
        where = np.minimum(np.searchsorted(repeated, found), len(repeated) - 1)
        chosen = np.flatnonzero(repeated[where] == found)
        raw = hashes.tobytes()
        numbers = zip(rows[chosen].tolist(), at[chosen].tolist(), count[chosen].tolist(), found[chosen].tolist(), often[where[chosen]].tolist())
        bounds = bounds.tolist()
        for row, start, n, anchor, many in numbers:
            step = 1 if many else n
            prefix = 8 * bounds[row]
            for place in range(start, start + n, step):
                yield first + row, place, step, anchor, many, raw[prefix + 8 * place:prefix + 8 * (place + step + self.width - 1)]

    def place(self, row: int, at: int) -> tuple[int, int, int]:
        return self.ids[row], self.prints[row], at


ROWS = "kind int, block long, bucket int, keys binary, counts binary, data binary"


def _blocks(text: int, width: int, buckets: int):
    """Rows of blocks (kind 0), and of their distinct anchors by bucket (kind 1)."""
    schema = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("data", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def block() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            number = int.from_bytes(os.urandom(8), "little", signed=True)
            found = [anchors(hashes, bounds, width)[3] for _, hashes, bounds in hashed_rows(table.column(text).combine_chunks())]
            keys, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, int))
            bucket = bucket_of(keys, buckets)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = [{"kind": 0, "block": number, "bucket": 0, "data": packed(table)}]
            for b in np.flatnonzero(np.diff(ends)):
                chosen = order[ends[b]:ends[b + 1]]
                out.append({"kind": 1, "block": number, "bucket": int(b), "keys": keys[chosen].tobytes(),
                            "counts": np.minimum(counts[chosen], OFTEN + 1).astype(np.int32).tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

        for batch in batches:
            first, weight = 0, 0
            for end, length in enumerate(pc.binary_length(batch.column(text)).fill_null(0).to_pylist(), 1):
                weight += length
                if size + weight >= BLOCK_BYTES:
                    held.append(batch.slice(first, end - first))
                    yield from block()
                    held, size, weight, first = [], 0, 0, end
            if first < batch.num_rows:
                held.append(batch.slice(first))
                size += weight
        if held:
            yield from block()

    return run


def _repeated(asked: pa.Table) -> pa.Table:
    """For every block the anchors of a bucket that occur twice or more, and which occur often."""
    every = [np.frombuffer(k, np.uint64) for k in asked.column("keys").to_pylist()]
    counts = [np.frombuffer(c, np.int32) for c in asked.column("counts").to_pylist()]
    keys, where = np.unique(np.concatenate(every), return_inverse=True)
    total = np.bincount(where, np.concatenate(counts), len(keys))
    out, at = [], 0
    for block, own in zip(asked.column("block").to_pylist(), every):
        times = total[where[at:at + len(own)]]
        at += len(own)
        out.append({"block": block, "keys": own[times > 1].tobytes(), "often": (times[times > 1] > OFTEN).tobytes()})
    return pa.Table.from_pylist(out, schema=pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("often", pa.binary())]))


def _known(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All repeated anchors of a block in order, and which occur often."""
    keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(k, np.uint64) for k in answers.column("keys").to_pylist())])
    often = np.concatenate([np.zeros(0, bool), *(np.frombuffer(o, bool) for o in answers.column("often").to_pylist())])
    order = np.argsort(keys)
    return keys[order], often[order]


REQUEST = pa.schema([("mark", pa.binary(16)), ("key", pa.uint64()), ("words", pa.binary()), ("id", pa.int64()), ("h", pa.int64()), ("at", pa.int64()), ("times", pa.int64())])
REQUESTS = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("data", pa.binary())])


def _requests(text: int, width: int, shards: int):
    """A block's distinct stretches and often windows, with their first place in it, by shard."""
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        repeated, often = _known(answers)
        rows = _Block(unpacked(block.column("data").to_pylist()[0]), text, width)
        asked: dict[bytes, list] = {}
        for first, hashes, bounds in rows.pieces():
            for row, at, _, anchor, many, content in rows.stretches(first, hashes, bounds, repeated, often):
                mark = xxhash.xxh3_128_digest(content)
                known = asked.get(mark)
                place = rows.place(row, at)
                if known is None:
                    key = int.from_bytes(mark[:8], "little") if many else anchor
                    asked[mark] = [key, None if many else content, place, 1]
                else:
                    known[3] += 1
                    if place < known[2]:
                        known[2] = place
        number = block.column("block").to_pylist()[0]
        values = list(asked.values())
        whole = pa.table([
            list(asked), pa.array([v[0] for v in values], pa.uint64()), pa.array([v[1] for v in values], pa.binary()),
            *(pa.array([v[2][i] for v in values], pa.int64()) for i in range(3)), pa.array([v[3] for v in values], pa.int64()),
        ], schema=REQUEST)
        shard = bucket_of(whole.column("key").to_numpy(), shards)
        out = []
        for s in np.unique(shard):
            out.append({"shard": int(s), "block": number, "data": packed(whole.filter(pa.array(shard == s)))})
        return pa.Table.from_pylist(out, schema=REQUESTS)

    return run


VERDICT = pa.schema([("mark", pa.binary(16)), ("id", pa.int64()), ("h", pa.int64()), ("at", pa.int64()), ("seen", pa.int64()), ("earlier", pa.int64())])


def _verdicts(width: int):
    """For every block the first places of its marks, the windows found, and those that occur before that place."""
    def run(asked: pa.Table) -> pa.Table:
        # By mark: key, words, first place, times.
        marks: dict[bytes, list] = {}
        by_block: dict[int, list[bytes]] = {}
        for block, data in zip(asked.column("block").to_pylist(), asked.column("data").to_pylist()):
            request = unpacked(data)
            columns = [request.column(c).to_pylist() for c in ("mark", "key", "words", "id", "h", "at", "times")]
            by_block.setdefault(block, []).extend(columns[0])
            for mark, key, words, *place, times in zip(*columns):
                known = marks.get(mark)
                if known is None:
                    marks[mark] = [key, words, tuple(place), times]
                else:
                    known[2] = min(known[2], tuple(place))
                    known[3] += times
        # Stretches of one anchor go into one automaton, those of several anchors together. A window
        # sent as a hash is found where it occurs twice.
        found = {mark: (1, 0) for mark, v in marks.items() if v[1] is None}
        stretches = sorted((v[0], mark) for mark, v in marks.items() if v[1] is not None)
        group: dict[bytes, tuple] = {}
        of_content: dict[bytes, bytes] = {}
        words = 0
        for i, (key, mark) in enumerate(stretches):
            _, content, place, _ = marks[mark]
            group[content], of_content[content] = place, mark
            words += len(content) // 8
            if i + 1 == len(stretches) or words >= SHARD_WORDS and stretches[i + 1][0] != key:
                found |= {of_content[c]: verdict for c, *verdict in _judge(group, width)}
                group, of_content, words = {}, {}, 0
        out = []
        for block, own in by_block.items():
            told = [m for m in own if marks[m][3] > 1 or found[m][1]]
            if told:
                answer = pa.table([told, *(pa.array([marks[m][2][i] for m in told], pa.int64()) for i in range(3)),
                                   *(pa.array([found[m][i] for m in told], pa.int64()) for i in (0, 1))], schema=VERDICT)
                out.append({"block": block, "data": packed(answer)})
        return pa.Table.from_pylist(out, schema=pa.schema([("block", pa.int64()), ("data", pa.binary())]))

    return run


def _kept(words: list[bytes], starts: list[int], width: int) -> tuple[int, int, bytes]:
    """Number of words, number removed, and the words kept in one text."""
    if not starts:
        return len(words), 0, b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.array(starts) + width, -1)
    covered = np.cumsum(edges[:-1]) > 0
    return len(words), int(covered.sum()), b" ".join(w for w, gone in zip(words, covered.tolist()) if not gone)


def _cleaned(text: int, width: int):
    """The rows of a block with what is left of their texts."""
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        told = {k: answers.filter(pc.equal(answers.column("kind"), k)) for k in (1, 2)}
        repeated, often = _known(told[1])
        verdicts: dict[bytes, tuple] = {}
        for data in told[2].column("data").to_pylist():
            columns = [c.to_pylist() for c in unpacked(data).columns]
            verdicts |= {mark: (place, seen, earlier) for mark, *place, seen, earlier in zip(*columns)}
        table = unpacked(block.column("data").to_pylist()[0])
        rows = _Block(table, text, width)
        found: list[tuple[int, int, bytes]] = []
        for first, hashes, bounds in rows.pieces():
            starts: list[list[int]] = [[] for _ in bounds[1:]]
            for row, at, n, _, _, content in rows.stretches(first, hashes, bounds, repeated, often):
                verdict = verdicts.get(xxhash.xxh3_128_digest(content))
                if verdict is not None:
                    # Elsewhere than at its first place all that the automaton finds occurs earlier.
                    bits = verdict[2] if verdict[0] == [*rows.place(row, at)] else verdict[1]
                    starts[row - first].extend(at + b for b in range(n) if bits >> b & 1)
            found.extend(_kept(rows.texts[first + i].split(), s, width) for i, s in enumerate(starts))
        added = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
                 pa.array([f[2] for f in found], pa.binary()).cast(pa.string())]
        return pa.Table.from_arrays([*table.columns[1:], *added], names=[*table.column_names[1:], "n_words", "n_removed", "kept"])

    return run


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 20) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept``, the words kept joined by one space.

    A word goes if a window of ``width`` words over it has the same words as one that starts
    earlier: in a smaller id, or earlier in the same text. Words are what ASCII white space
    parts. Ids are integers; a null id is before all others. Rows of one id with different
    texts are different documents, in an order that their texts decide; repeated rows are one
    document and get equal results. Null texts have no words. Columns of the three names are
    replaced, others stay, whatever their names. ``width`` is at least ``GRAM`` and at most ``GRAM + 56``.
    """
    if not GRAM <= width <= GRAM + 56:
        raise ValueError(f"width must be from {GRAM} to {GRAM + 56}: {width}")
    rows = docs.drop("n_words", "n_removed", "kept")
    text = rows.columns.index(text_column) + 1
    ident = F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(-(1 << 63))).alias(unused(rows.columns, "_id")[0])
    whole = rows.select(ident, *[F.col(f"`{c}`") for c in rows.columns])
    size = rows.agg(F.sum(F.octet_length(F.col(f"`{text_column}`")))).first()[0] or 0
    buckets = 4 + size // BUCKET_BYTES
    every = stored(whole.mapInArrow(tidy(_blocks(text, width, buckets)), ROWS), "blocks")

    blocks = every.where("kind = 0").select("block", "data")
    asked = every.where("kind = 1").select("block", "bucket", "keys", "counts")
    known = stored(asked.groupBy("bucket").applyInArrow(tidy(_repeated), "block long, keys binary, often binary"), "anchors")
    requests = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        tidy(_if_there(_requests(text, width, buckets), REQUESTS)), "shard int, block long, data binary")
    verdicts = requests.groupBy("shard").applyInArrow(tidy(_verdicts(width)), "block long, data binary")
    none = F.lit(None).cast("binary")
    answers = known.select(F.lit(1).alias("kind"), "block", "keys", "often", none.alias("data")).union(
        verdicts.select(F.lit(2).alias("kind"), "block", none.alias("keys"), none.alias("often"), "data"))
    added = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())]
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tidy(_cleaned(text, width)), StructType([*rows.schema.fields, *added]))


def _if_there(run, schema: pa.Schema):
    """A block without any answer asks for nothing."""
    return lambda block, answers: run(block, answers) if answers.num_rows else schema.empty_table()
