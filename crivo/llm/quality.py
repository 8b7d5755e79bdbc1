"""Document quality by pairwise ranking.

In the Bradley-Terry model a document of score s beats one of score t with the odds
exp(s - t). Scores are linear in features of the text, so the differences of the features of
preferred and other documents fit them by logistic loss, without an intercept. A quantile of
the training scores, the share of documents that are not preferred, is the threshold, and the
score is turned so that the threshold is ``CUT``.

All labelled rows teach. Bin borders and the threshold are exact quantiles over all of them;
weights are fitted on blocks of rows side by side, every row in one, and averaged: a score is
linear in its weights, so that is the mean of the blocks' scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from crivo.llm.common import row_bytes, stored

CUT = 0.7
# Labelled rows of a block, about; and how many of either class it has at least, if need be by
# having rows of the rarer class in several blocks.
BLOCK_ROWS, LEAST_OF_CLASS = 20_000, 1_000
# Pairs per preferred document; those come from all others by turns.
PAIRS = 16
BINS = 8
L2 = 1e-4
STEPS = 400

# Byte classes whose shares of a text are features.
CLASSES = [
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b"!", b"?", b";:",
    b"'\"", b"()[]{}", b"<>", b"&", b"$", b"#", b"%", b"*", b"@", b"|", b"/\\", b"-_", b"=+~^`", bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0x100)),
]
_CLASS = np.full(256, len(CLASSES), np.int64)
for _i, _members in enumerate(CLASSES):
    _CLASS[list(_members)] = _i


def features_of(text: bytes) -> list[float]:
    """Features of a whole text; an empty one has zeros."""
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n_words, n_lines = max(len(words), 1), max(len(lines), 1)
    shares = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=len(CLASSES) + 1) / max(len(text), 1)
    distinct = len(set(words))
    ends = sum(1 for w in words if not w[-1:].isalnum() and w[-1] < 128)
    runs = sum(1 for a, b in zip(words, words[1:]) if a == b)
    pairs = len(set(zip(words, words[1:])))
    return [
        *shares.tolist(), math.log1p(len(text)), math.log1p(len(words)), math.log1p(len(lines)),
        sum(map(len, words)) / n_words, max(map(len, words), default=0), distinct / n_words, distinct / math.sqrt(n_words),
        ends / n_words, runs / n_words, pairs / n_words, len(set(lines)) / n_lines, len(text) / n_lines,
        max(map(len, lines), default=0) / max(len(text), 1),
    ]


N_FEATURES = len(features_of(b""))


def with_features(docs: DataFrame, text_column: str) -> DataFrame:
    """``docs`` without the text, with ``features``, an array of doubles."""
    names = [c for c in docs.columns if c != text_column]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([features_of(t) for t in row_bytes(batch.column(text_column))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), found], names=[*names, "features"])

    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    return docs.mapInArrow(run, f"{schema}, features array<double>")


@dataclass
class Ranking:
    """Bin borders per feature, weights per bin, and where the threshold lies."""

    borders: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, features: np.ndarray) -> np.ndarray:
        total = np.zeros(len(features))
        for i in range(features.shape[1]):
            total += self.weights[i][np.searchsorted(self.borders[i], features[:, i], side="right")]
        return total

    def scores(self, features: np.ndarray) -> np.ndarray:
        at = np.clip(self.raw(features) - self.threshold, -500, 500) + math.log(CUT / (1 - CUT))
        # The threshold itself counts as above it, whatever the rounding.
        return np.where(at == math.log(CUT / (1 - CUT)), CUT, 1 / (1 + np.exp(-at)))


def bins_of(features: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """The place of each feature's weight among all weights."""
    return np.stack([np.searchsorted(borders[i], features[:, i], side="right") + i * BINS for i in range(features.shape[1])], axis=1)


def fitted_weights(bins: np.ndarray, preferred: np.ndarray, size: int) -> np.ndarray:
    """Weights that rank preferred rows above the others; with one class alone they are 0."""
    good, bad = np.flatnonzero(preferred), np.flatnonzero(~preferred)
    weights = np.zeros(size)
    if not len(good) or not len(bad):
        return weights
    # Every preferred row meets others by turns, and every other row meets preferred ones.
    many = max(len(good), len(bad))
    count = many * PAIRS
    steps = np.random.default_rng(0)
    winners, losers = steps.permutation(np.resize(good, count)), steps.permutation(np.resize(bad, count))
    momentum, scale = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        raw = weights[bins].sum(axis=1)
        lost = 1 / (1 + np.exp(np.clip(raw[winners] - raw[losers], -500, 500)))
        of_row = np.bincount(losers, lost, len(raw)) - np.bincount(winners, lost, len(raw))
        slope = np.bincount(bins.ravel(), np.repeat(of_row, bins.shape[1]), len(weights)) / count + L2 * weights
        momentum, scale = 0.9 * momentum + 0.1 * slope, 0.99 * scale + 0.01 * slope ** 2
        weights = weights - 0.05 * (momentum / (1 - 0.9 ** step)) / (np.sqrt(scale / (1 - 0.99 ** step)) + 1e-8)
    return weights


def fit(features: np.ndarray, preferred: np.ndarray) -> Ranking:
    """A ranking fitted on rows at hand, as one block.

    With one class alone there is nothing to rank: all weights are 0, and the threshold puts
    every score on that class's side.
    """
    borders = np.stack([np.quantile(features[:, i], np.linspace(0, 1, BINS + 1)[1:-1]) if len(features) else np.zeros(BINS - 1)
                        for i in range(features.shape[1])]) if features.shape[1] else np.zeros((0, BINS - 1))
    bins = bins_of(features, borders)
    weights = fitted_weights(bins, preferred, features.shape[1] * BINS)
    if preferred.all() or not preferred.any():
        return Ranking(borders, weights.reshape(-1, BINS), -1.0 if len(preferred) and preferred.all() else 1.0)
    return Ranking(borders, weights.reshape(-1, BINS), between(weights[bins].sum(axis=1), (~preferred).sum() / len(preferred)))


def middle(n: int, share: float) -> int:
    """How many of ``n`` sorted scores lie below the quantile of that share."""
    return min(max(round(share * n), 1), n - 1)


def between(scores: np.ndarray, share: float) -> float:
    """The quantile of that share, in the middle of the gap above the scores below it."""
    order, at = np.sort(scores), middle(len(scores), share)
    return float(order[at - 1] + order[at]) / 2


def at_places(values: DataFrame, places: list[int]) -> dict[tuple[int, int], float]:
    """What stands at places, from 0, among the sorted ``value`` of each ``feature``.

    Ranges of values number their own, and the sizes of the ranges before give the offset, so
    no task holds all values of a feature.
    """
    counted = values.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("many"))
    # The range of a value must not change between reads, so it is written down.
    ranged = stored(counted.repartitionByRange("feature", "value").withColumn("range", F.spark_partition_id()), "quantiles")
    earlier = Window.partitionBy("feature").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("feature", "range").agg(F.sum("many").alias("size"))
    offsets = sizes.select("feature", "range", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("feature", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ends = ranged.withColumn("end", F.sum("many").over(within)).join(offsets, ["feature", "range"])
    # Where a value's run of places begins and ends; the wanted ones are few.
    run = ends.select("feature", "value", (F.col("offset") + F.col("end")).alias("end"), "many")
    held = F.filter(F.array(*[F.lit(p).cast("long") for p in places]), lambda p: (p < F.col("end")) & (p >= F.col("end") - F.col("many")))
    return {(r["feature"], r["place"]): r["value"] for r in run.select("feature", "value", F.explode(held).alias("place")).collect()}


def borders_of(rows: DataFrame, n: int) -> np.ndarray:
    """The quantiles of each feature over all ``n`` rows, between two values as ``np.quantile`` has them."""
    if not n:
        return np.zeros((N_FEATURES, BINS - 1))
    shares = [(n - 1) * k / BINS for k in range(1, BINS)]
    found = at_places(rows.select(F.posexplode("features").alias("feature", "value")), sorted({f(x) for x in shares for f in (math.floor, math.ceil)}))
    return np.array([[np.quantile([found[i, math.floor(x)], found[i, math.ceil(x)]], x - math.floor(x)) for x in shares] for i in range(N_FEATURES)])


def blocks_of(rows: DataFrame, good: int, bad: int) -> DataFrame:
    """``rows`` with a ``block`` each, by hash; rows of a class too rare for all blocks are in several."""
    blocks = math.ceil((good + bad) / BLOCK_ROWS)
    copies = [min(blocks, math.ceil(blocks * LEAST_OF_CLASS / many)) for many in (good, bad)]
    # Rows that are alike in everything are told apart by a number, or they would fill one block.
    numbered = rows.groupBy("id", "features", "preferred").agg(F.count(F.lit(1)).alias("many"))
    numbered = numbered.select("id", "features", "preferred", F.explode(F.sequence(F.lit(1).cast("long"), "many")).alias("number"))
    turn = F.explode(F.sequence(F.lit(1), F.when(F.col("preferred"), copies[0]).otherwise(copies[1])))
    spread = numbered.withColumn("turn", turn).withColumn("block", F.pmod(F.xxhash64("id", "features", "number") + F.col("turn"), F.lit(blocks)))
    return spread.select("block", "id", "features", "preferred")


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> Ranking:
    """A ranking fitted on all labelled rows of ``docs``.

    Labels other than 0 and 1, rows without a label and labels without a row teach nothing.
    Of several labels of one id the largest counts. The driver gets the quantiles and a list of
    weights per block.
    """
    known = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull())
    known = known.groupBy(F.col(id_column).alias("id")).agg((F.max(label_column) == 1).alias("preferred"))
    texts = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    # Features are found first: they take a fraction of the texts if the join must shuffle them.
    rows = stored(with_features(texts, "text").join(known, "id"), "labelled")
    counts = {r["preferred"]: r["many"] for r in rows.groupBy("preferred").agg(F.count(F.lit(1)).alias("many")).collect()}
    good, bad = counts.get(True, 0), counts.get(False, 0)
    borders = borders_of(rows, good + bad)
    if not good or not bad:
        return Ranking(borders, np.zeros((N_FEATURES, BINS)), -1.0 if good else 1.0)

    def arrays(table: pa.Table | pa.RecordBatch) -> np.ndarray:
        column = table.column("features")
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.flatten().to_numpy().reshape(table.num_rows, N_FEATURES)

    def of_block(table: pa.Table) -> pa.Table:
        features = arrays(table)
        # By id and features, as hashing and shuffling leave no order; equal ids are next to each other.
        ids = pc.rank(table.column("id"), tiebreaker="min").to_numpy()
        places = np.lexsort([*features.T[::-1], ids])
        preferred = table.column("preferred").to_numpy()[places].astype(bool)
        weights = fitted_weights(bins_of(features[places], borders), preferred, N_FEATURES * BINS)
        return pa.table({"block": table.column("block")[:1], "size": pa.array([len(places)]), "weights": pa.array([weights], pa.list_(pa.float64()))})

    found = blocks_of(rows, good, bad).groupBy("block").applyInArrow(of_block, "block long, size long, weights array<double>").toPandas().sort_values("block")
    weights = (np.stack(found["weights"]) * (found["size"] / found["size"].sum()).to_numpy()[:, None]).sum(axis=0)

    def raw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = weights[bins_of(arrays(batch), borders)].sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(scores), np.int32)), pa.array(scores)], names=["feature", "value"])

    at = middle(good + bad, bad / (good + bad))
    around = at_places(rows.select("features").mapInArrow(raw, "feature int, value double"), [at - 1, at])
    return Ranking(borders, weights.reshape(-1, BINS), (around[0, at - 1] + around[0, at]) / 2)


def score(docs: DataFrame, ranking: Ranking, text_column: str = "text") -> DataFrame:
    """``docs`` without its text, with ``score`` between 0 and 1; null texts are empty.

    A column named ``score`` or ``features`` is replaced.
    """
    rows = docs.drop(*[c for c in ("score", "features") if c != text_column])
    shared = docs.sparkSession.sparkContext.broadcast((ranking.borders, ranking.weights, ranking.threshold))
    found = with_features(rows, text_column)
    names = found.columns[:-1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Ranking(*shared.value)
        for batch in batches:
            features = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(known.scores(features))], names=[*names, "score"])

    schema = StructType([*found.schema.fields[:-1], StructField("score", DoubleType())])
    return found.mapInArrow(run, schema)


def predicted(score: Column) -> Column:
    return (score >= CUT).cast("int")
