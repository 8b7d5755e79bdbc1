"""Largest inner products by one-bit codes of randomly rotated vectors.

A vector is its nearest centre plus a rest. The rest is turned by a random rotation into a space
of more dimensions and kept as the signs of its coordinates, with two numbers: its length, and
the inner product of its unit vector with the signs' unit vector. From these the inner product
with any query is estimated without bias, and the error is within ``EPSILON`` times a known
amount but for rare cases. The vectors of one centre lie together, as a list. A query first meets
a sample of all vectors; its k-th best there is what any other vector must reach. It passes
over a list that cannot reach it, and in the others only vectors whose upper bound does are
compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crivo.llm.common import stored, tidy

# Ids, vectors, turned unit vectors with a 1, and what must be reached.
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]

# Width of the error bound, and of the bound of a list, in units of their standard sizes.
EPSILON = 3.0
PROBE = 3.5
# Signs in a code: so many at least, and twice the vectors' dimensions.
BITS = 512
# Rows to which the centres are fitted and that queries meet first: those of the smallest hash of their id.
SAMPLE = 10_000
# Rows of the sample for a centre, at least.
ROWS_OF_CENTRE = 20
# Queries that pass over the index together, about.
QUERY_BLOCK = 4096
ROWS = 1024
PAIRS = 100_000


def usable(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id`` and ``vector`` (doubles) of the vectors that take part, one per id.

    Null, empty and zero vectors, and those that hold a null or no finite number, do not;
    neither do rows without an id, nor vectors of another length than the most common one
    (the smaller of equals). Of several vectors of one id the smallest stays.
    """
    rows = df.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector_column}`").cast("array<double>").alias("vector"))
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    fit = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).where(whole & some)
    length = fit.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").first()
    fit = fit.where(F.size("vector") == (length["length"] if length else -1))
    return fit.groupBy("id").agg(F.min("vector").alias("vector"))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def rotation(size: int, bits: int, seed: int = 42) -> np.ndarray:
    """A random rotation of ``bits`` dimensions, as far as it acts on the first ``size``."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, size)))
    return q * np.sign(np.diag(r))


def centres(sample: np.ndarray, count: int, rounds: int = 10) -> np.ndarray:
    """Centres of a sample by Lloyd's steps from evenly chosen rows."""
    found = sample[np.linspace(0, len(sample) - 1, min(count, len(sample))).astype(int)]
    for _ in range(rounds):
        nearest = _nearest(sample, found)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, sample)
        sizes = np.bincount(nearest, minlength=len(found))[:, None]
        found = np.where(sizes > 0, sums / np.maximum(sizes, 1), found)
    return found


def _nearest(rows: np.ndarray, found: np.ndarray) -> np.ndarray:
    return (((found ** 2).sum(axis=1)) - 2 * rows @ found.T).argmin(axis=1)


def index(vectors: DataFrame, turn: np.ndarray, found: np.ndarray, slots: np.ndarray) -> DataFrame:
    """Codes of every row: ``centre``, packed signs ``code``, ``length`` of the rest, ``fit``.

    A list is dealt out over as many tasks as its centre has ``slots``; in a task the rows of a
    centre follow each other.
    """
    shared = vectors.sparkSession.sparkContext.broadcast((turn, found, slots))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, found, slots = shared.value
        for batch in batches:
            rows = matrix(batch.column("vector"))
            centre = _nearest(rows, found)
            rest = rows - found[centre]
            length = np.sqrt((rest ** 2).sum(axis=1))
            unit = (rest / np.maximum(length, 1e-300)[:, None]) @ turn.T
            codes = np.packbits(unit > 0, axis=1)
            fit = np.abs(unit).sum(axis=1) / math.sqrt(unit.shape[1])
            slot = batch.column("spread").to_numpy() % slots[centre]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("vector"), pa.array(centre.astype(np.int32)), pa.array(slot.astype(np.int32)),
                pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(fit),
            ], names=["id", "vector", "centre", "slot", "code", "length", "fit"])

    spread = vectors.withColumn("spread", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1 << 40)))
    coded = spread.mapInArrow(tidy(run), "id long, vector array<double>, centre int, slot int, code binary, length double, fit double")
    return coded.repartition("centre", "slot").sortWithinPartitions("centre")


def bounds(codes: np.ndarray, length: np.ndarray, fit: np.ndarray, bits: int, exact: bool) -> np.ndarray:
    """Rows whose product with a turned unit query and a final 1 bounds the rest's inner product from above.

    The signs are unpacked once for all queries of a list: a matrix product takes a quarter of
    the time that counting the bits of packed words takes here.
    """
    fit = np.maximum(fit, 1e-12)
    # Cauchy and Schwarz bound the error for certain; by chance it is smaller by the root of the dimensions.
    width = 1.0 if exact else min(1.0, EPSILON / math.sqrt(max(bits - 1, 1)))
    error = length * (np.sqrt(np.maximum(1 - fit ** 2, 0)) / fit * width + 1e-5)
    # Beyond what single precision holds everything is compared exactly.
    error = np.where(length < 1e30, error, np.inf)
    scale = length / (fit * math.sqrt(bits))
    signs = np.unpackbits(codes, axis=1, count=bits).astype(np.float32) * 2 - 1
    return np.hstack([signs * scale.astype(np.float32)[:, None], error.astype(np.float32)[:, None]])


class Best:
    """The ``k`` best rows of every query so far: largest score, then smallest id."""

    def __init__(self, reach: np.ndarray, k: int) -> None:
        self.k = k
        self.query, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        # What a row must reach to be among the best.
        self.least = reach.copy()

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        query, ids, score = np.concatenate([self.query, query]), np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        starts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, int)
        rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
        full = rank == self.k - 1
        self.least[query[full]] = np.maximum(self.least[query[full]], score[full])
        keep = rank < self.k
        self.query, self.id, self.score = query[keep], ids[keep], score[keep]


def _lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one centre."""
    for batch in batches:
        centre = batch.column("centre").to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], centre[1:] != centre[:-1], [True]])) if len(centre) else np.zeros(1, int)
        for first, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
            for at in range(first, end, ROWS):
                yield batch.slice(at, min(ROWS, end - at))


def _pass(batches: Iterable[pa.RecordBatch], block: Block, found: np.ndarray, k: int, exact: bool) -> Iterator[pa.RecordBatch]:
    """The best rows of the partition for each query of a block."""
    ids, queries, turned, reach = block
    best = Best(reach, k)
    norms = np.maximum(np.sqrt((queries ** 2).sum(axis=1)), 1e-300)
    place = {i: q for q, i in enumerate(ids.tolist())}
    wide = 1.0 if exact else min(1.0, PROBE / math.sqrt(queries.shape[1]))
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for part in _lists(batches):
        own = part.column("id").to_numpy()
        centre, length, fit = (part.column(c).to_numpy() for c in ("centre", "length", "fit"))
        # What the rest of a row must add, for a query of length 1.
        need = (best.least - queries @ found[centre[0]]) / norms
        need -= 1e-6 * np.abs(need)
        asked = np.flatnonzero(~(wide * length.max() * (1 + 1e-9) < need))
        if not len(asked):
            continue
        codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(own), -1)
        rows = matrix(part.column("vector"))
        upper = bounds(codes, length, fit, turned.shape[1] - 1, exact)
        itself = np.array([place.get(i, -1) for i in own.tolist()])
        step = max(1, (1 << 20) // len(own))
        for some in (asked[at:at + step] for at in range(0, len(asked), step)):
            # Written so that what is not a number passes.
            row, query = np.nonzero(~(upper @ turned[some].T < need[some].astype(np.float32)))
            query = some[query]
            other = itself[row] != query
            row, query = row[other], query[other]
            for at in range(0, len(row), PAIRS):
                r, q = row[at:at + PAIRS], query[at:at + PAIRS]
                held.append((q, own[r], (rows[r] * queries[q]).sum(axis=1)))
                size += len(r)
                if size >= PAIRS:
                    best.add(*(np.concatenate(c) for c in zip(*held)))
                    held, size = [], 0
    if held:
        best.add(*(np.concatenate(c) for c in zip(*held)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[best.query]), pa.array(best.id), pa.array(best.score)], names=["query_id", "vec_id", "score"])


def reached(asked: DataFrame, ids: np.ndarray, sample: np.ndarray, k: int) -> DataFrame:
    """``asked`` with ``reach``, the score of the ``k``-th best other vector of the sample."""
    shared = asked.sparkSession.sparkContext.broadcast((ids, sample))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sample = shared.value
        place = {i: at for at, i in enumerate(ids.tolist())}
        for batch in batches:
            reach = [np.zeros(0)]
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                scores = matrix(part.column("vector")) @ sample.T
                for at, i in enumerate(part.column("id").to_pylist()):
                    if i in place:
                        scores[at, place[i]] = -np.inf
                many = scores.shape[1]
                reach.append(np.partition(scores, many - k, axis=1)[:, many - k] if many >= k else np.full(len(scores), -np.inf))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(np.concatenate(reach))], names=["id", "vector", "reach"])

    return asked.mapInArrow(tidy(run), "id long, vector array<double>, reach double")


def nearest(vectors: DataFrame, is_query, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", exact: bool = False) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` largest inner products of each query.

    ``is_query`` is a condition on ``id``. Every other row is a candidate. Blocks of queries
    of bounded size pass over the index, one after the other; scores are exact, in double
    precision, and ties go to the smaller id. With ``exact``, lists and vectors are passed over
    only by bounds that hold for certain, so nothing is missed. See :func:`usable` for what
    takes no part.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors, id_column, vector_column), "vectors")
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    empty = "query_id long, rank int, vec_id long, score double"
    if not len(chosen):
        return spark.createDataFrame([], empty)
    sample = np.array(chosen["vector"].tolist())
    bits = max(BITS, 64 * math.ceil(sample.shape[1] / 32))
    turn = rotation(sample.shape[1], bits)
    found = centres(sample, max(1, min(math.isqrt(rows.count()), len(sample) // ROWS_OF_CENTRE)))
    share = np.bincount(_nearest(sample, found), minlength=len(found)) / len(sample)
    slots = np.maximum(1, np.ceil(share * 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))).astype(np.int64)
    coded = stored(index(rows, turn, found, slots), "codes")

    asked = stored(reached(rows.where(is_query), chosen["id"].to_numpy(np.int64), sample, k), "asked")
    blocks = math.ceil(asked.count() / QUERY_BLOCK)
    parts = []
    for number in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)) == number).toPandas()
        if not len(block):
            continue
        queries = np.array(block["vector"].tolist())
        norms = np.maximum(np.sqrt((queries ** 2).sum(axis=1)), 1e-300)
        turned = np.hstack([(queries / norms[:, None]) @ turn.T, np.ones((len(queries), 1))]).astype(np.float32)
        shared = spark.sparkContext.broadcast(((block["id"].to_numpy(np.int64), queries, turned, block["reach"].to_numpy()), found))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            return _pass(batches, *shared.value, k, exact)

        parts.append(stored(_ranked(coded.mapInArrow(run, "query_id long, vec_id long, score double"), k), "nearest"))
    if not parts:
        return spark.createDataFrame([], empty)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
