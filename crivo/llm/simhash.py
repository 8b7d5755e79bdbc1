"""Near-duplicates by 64-bit fingerprints, found through the binary Golay code.

A fingerprint is cut into two segments of 23 bits and one of 18. The (23, 12) Golay code is
perfect: every 23-bit word has exactly one codeword within three bits of it. A segment gets
the codewords of itself and of all words one bit away, six at most, as its fuzzy values;
two segments one bit apart always share one, and so do two segments two bits apart.

Three errors leave few cases, and each is a key of 30 bits or more:

* the last segment is equal, and one of the others has at most one error: (C, fuzzy A) or (C, fuzzy B);
* it is not, then the others hold at most two errors: one of them is equal and the other
  within two, (A, fuzzy B) or (B, fuzzy A), or each of the three has exactly one error, and
  of two halves of B and of C one is equal: (fuzzy A, half of B, half of C), four keys.

So no link is lost. Fingerprints that share a key are compared bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crivo.llm.common import row_bytes, stored, sum_by_row, tidy, two_columns, unused
from crivo.shared import lookup

SEED = 42
MOST_BITS = 3
_LANES = np.uint64(0x0101010101010101)


# ---- fingerprints ----------------------------------------------------------------------

def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of every run of ``width`` words, repeats included; of all words if there are fewer."""
    words = text.lower().split()  # bytes.lower() and bytes.split() know ASCII alone
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1:] - 1).tolist())]


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each row the bits that over half of its hashes have; a row without hashes gives 0.

    Bit counts are added eight at a time, one to a byte, in blocks of up to 255 hashes.
    """
    sizes = np.diff(bounds)
    blocks = -(-sizes // 255)
    block_bounds = np.concatenate([[0], np.cumsum(blocks)])
    if not len(hashes):
        return np.zeros(len(sizes), np.uint64)
    within = np.arange(block_bounds[-1]) - np.repeat(block_bounds[:-1], blocks)
    starts = np.repeat(bounds[:-1], blocks) + 255 * within
    out = np.zeros(len(sizes), np.uint64)
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & _LANES, starts)
        for byte in range(8):
            counts = sum_by_row((lanes >> np.uint64(8 * byte) & np.uint64(255)).astype(np.int64), block_bounds)
            out |= (2 * counts > sizes).astype(np.uint64) << np.uint64(8 * byte + shift)
    return out


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5) -> DataFrame:
    """``id``, ``h``, and ``fp``, the fingerprint of the whole text as a signed 64-bit number.

    ``h`` tells apart different texts of one id. Null, empty and blank texts have
    fingerprint 0. Repeated rows stay.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values: list[np.ndarray] = []
            held: list[int] = []
            sizes: list[int] = []

            def flush() -> None:
                if sizes:
                    values.append(majority(np.array(held, np.uint64), np.concatenate([[0], np.cumsum(sizes)])))
                    held.clear()
                    sizes.clear()

            for text in row_bytes(batch.column("text")):
                hashes = shingle_hashes(text, width)
                held.extend(hashes)
                sizes.append(len(hashes))
                if len(held) > 200_000:
                    flush()
            flush()
            fps = np.concatenate(values) if values else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(fps.view(np.int64))], names=["id", "h", "fp"])

    rows = two_columns(docs, id_column, text_column).select("id", F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(tidy(run), f"id {rows.schema['id'].dataType.simpleString()}, h long, fp long")


# ---- Golay code ------------------------------------------------------------------------

# Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the code.
GENERATOR = 0b110001110101


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


def _leaders() -> np.ndarray:
    """For each of the 2048 remainders the only error of up to three bits that gives it."""
    errors = [0]
    for a in range(23):
        errors.append(1 << a)
        for b in range(a):
            errors.append(1 << a | 1 << b)
            errors.extend(1 << a | 1 << b | 1 << c for c in range(b))
    table = np.zeros(2048, np.int64)
    errors = np.array(errors)
    table[_syndromes(errors)] = errors
    return table


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword within three bits of each 23-bit word."""
    return (words ^ _leaders()[_syndromes(words)]) >> 11


def fuzzy_values(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and codeword indices of each word and of all words one bit from it."""
    near = np.concatenate([[0], 1 << np.arange(23)])
    found = np.sort(codeword_indices((words[:, None] ^ near[None, :]).ravel()).reshape(len(words), 24), axis=1)
    new = np.concatenate([np.ones((len(words), 1), bool), found[:, 1:] != found[:, :-1]], axis=1)
    rows, columns = np.nonzero(new)
    return rows, found[rows, columns]


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of unsigned fingerprints."""
    a = (fps & np.uint64((1 << 23) - 1)).astype(np.int64)
    b = (fps >> np.uint64(23) & np.uint64((1 << 23) - 1)).astype(np.int64)
    c = (fps >> np.uint64(46)).astype(np.int64)
    rows_a, fuzzy_a = fuzzy_values(a)
    rows_b, fuzzy_b = fuzzy_values(b)
    made = [
        (rows_a, 0 << 56 | c[rows_a] << 12 | fuzzy_a),
        (rows_b, 1 << 56 | c[rows_b] << 12 | fuzzy_b),
        (rows_b, 2 << 56 | a[rows_b] << 12 | fuzzy_b),
        (rows_a, 3 << 56 | b[rows_a] << 12 | fuzzy_a),
    ]
    halves_b, halves_c = (b & 0x7FF, b >> 11), (c & 0x1FF, c >> 9)
    for i in range(2):
        for j in range(2):
            key = (4 + 2 * i + j) << 56 | halves_b[i][rows_a] << 24 | halves_c[j][rows_a] << 12 | fuzzy_a
            made.append((rows_a, key))
    return np.concatenate([r for r, _ in made]), np.concatenate([k for _, k in made])


# ---- links -----------------------------------------------------------------------------

def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= MOST_BITS


def _trees(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join what can be reached through near fingerprints: one for each but the first.

    Every fingerprint reached is compared only with those not reached yet.
    """
    links, left = [], fps
    while len(left) > 1:
        waiting, left = [left[0]], left[1:]
        while waiting and len(left):
            at = waiting.pop()
            near = _near(left, at)
            if near.any():
                found, left = left[near], left[~near]
                links.append((np.full(len(found), at), found))
                waiting.extend(found)
    return links


SMALL = 8


def _links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between near fingerprints of one key; rows come sorted by key.

    A key's rows may span batches, so the last key of a batch waits for the next.
    """
    kept_key, kept_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def found(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        sizes = np.diff(np.append(starts, len(key)))
        size = np.repeat(sizes, sizes)
        for step in range(1, SMALL):
            at = np.flatnonzero((size[step:] <= SMALL) & (key[step:] == key[:-step]))
            at = at[_near(fp[at], fp[at + step])]
            pairs.append((fp[at], fp[at + step]))
        for run in np.flatnonzero(sizes > SMALL):
            pairs.extend(_trees(fp[starts[run]:starts[run] + sizes[run]]))
        x = np.concatenate([p[0] for p in pairs] or [np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
        y = np.concatenate([p[1] for p in pairs] or [np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
        both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    for batch in batches:
        key = np.concatenate([kept_key, batch.column("key").to_numpy()])
        fp = np.concatenate([kept_fp, batch.column("fp").to_numpy().view(np.uint64)])
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))
        yield found(key[:last], fp[:last])
        kept_key, kept_fp = key[last:], fp[last:]
    yield found(kept_key, kept_fp)


def links(distinct: DataFrame) -> DataFrame:
    """Links ``a < b`` between fingerprints of ``distinct`` (column ``fp``, no repeats).

    They join exactly the fingerprints that a chain of pairs within three bits joins; a key
    with many fingerprints gives a tree of such pairs and not all of them.
    """
    def expand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("fp").to_numpy()
            for first in range(0, len(every), 20_000):
                fps = every[first:first + 20_000]
                rows, found = keys(fps.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(fps[rows])], names=["key", "fp"])

    keyed = distinct.select("fp").mapInArrow(expand, "key long, fp long")
    together = keyed.repartition("key").sortWithinPartitions("key")
    return together.mapInArrow(_links, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node of ``edges``.

    Each round links all neighbours of a node to the smallest of them, first the larger ones
    and then the smaller ones, until every component is a star around its smallest node.
    Nodes with many links are spread over tasks; every round is written down.
    """
    edges = stored(edges.where("a != b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct(), "links")
    while True:
        both = edges.union(edges.selectExpr("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) AS m")
        larger = lookup(both, least, ["a"], None).where("b > a").selectExpr("m AS a", "b")
        larger = larger.where("a != b").distinct()
        # Now every link goes from a smaller node a to a larger node b.
        smallest = larger.groupBy("b").agg(F.min("a").alias("m"))
        moved = lookup(larger, smallest, ["b"], None)
        smaller = moved.selectExpr("m AS a", "a AS b").union(moved.selectExpr("m AS a", "b"))
        after = stored(smaller.where("a != b").distinct(), "links")
        if _fixed(edges, after):
            return after.selectExpr("b AS node", "a AS root").union(after.selectExpr("a AS node", "a AS root").distinct())
        edges = after


def _fixed(before: DataFrame, after: DataFrame) -> bool:
    """Are both the same set of links? By count and by two sums of hashes."""
    def mark(df: DataFrame) -> list:
        sums = [F.sum(F.expr(f"cast(xxhash64(a, b, {i}) AS decimal(38, 0))")) for i in (1, 2)]
        return list(df.agg(F.count("*"), *sums).first())
    return mark(before) == mark(after)


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5) -> DataFrame:
    """``id``, ``h``, ``fp``, ``root`` and ``component``: the smallest id reachable through near fingerprints.

    A row for every row of ``docs``. Equal fingerprints are one node, so copies cost nothing;
    null ids belong to a component but never name one.
    """
    prints = stored(fingerprints(docs, id_column, text_column, width), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = components(links(nodes))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    of_print = rooted.join(named, "root").select("fp", "root", "component")
    return lookup(prints, of_print, ["fp"], None)


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5) -> DataFrame:
    """One row of ``docs`` from each component: one of its smallest id.

    Of rows of that id with different texts one stays, and one of repeated rows. Null, empty and
    blank texts are copies of each other. All columns stay, whatever their names.
    """
    return one_of_classes(docs, classes(docs, id_column, text_column, width), id_column, text_column)


def one_of_classes(docs: DataFrame, found: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The rows of ``docs`` that stand for their component in ``found``; columns may have any names."""
    chosen = found.where("id <=> component").groupBy("root").agg(F.min("id").alias("id"), F.min("h").alias("h")).select("id", "h").distinct()
    ident, mark, picked, same_mark = unused(docs.columns, "own_id", "own_h", "chosen_id", "chosen_h")
    own = docs.withColumns({ident: F.col(f"`{id_column}`"), mark: F.xxhash64(F.col(f"`{text_column}`").cast("string"))})
    wanted = chosen.select(F.col("id").alias(picked), F.col("h").alias(same_mark))
    same = F.col(ident).eqNullSafe(F.col(picked)) & (F.col(mark) == F.col(same_mark))
    kept = own.join(wanted, same).dropDuplicates([picked, same_mark])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
