"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each at a node named by the bits before it, and every node
has a tree of contexts: the last 0, 1, ... ``DEPTH`` bytes. A context estimates the next bit
from its counts (Krichevsky-Trofimov), and its weighted probability is half its own and half
the product of those of the contexts one byte longer. The share of its own half is its weight
against all longer ones, so a bit's probability mixes the estimates of all depths. A context
that training has not seen has no estimate; the longest seen one takes its share.

Contexts that end in the same few bytes are worked out together, those few bytes and shorter
ones level by level with grouped sums, and read from the root down with joins. Texts are
packed into blocks of bounded size; a block asks for its distinct contexts and words only, and
gets one answer for each.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crivo.llm.common import bucket_of, hashed_rows, packed, row_bytes, stored, sum_by_row, unpacked

DEPTH = 5
BLOCK_BYTES = 16 << 20
PIECE = 1 << 20
# Bytes of text per bucket of keys.
BUCKET_BYTES = 32 << 20
BYTES, WORDS = 1, 2
# Contexts of this length are never parted; longer ones go with their last bytes of that length.
SPLIT_DEPTH = 3
SPLIT = (1 << 8 * SPLIT_DEPTH) - 1
# Depths whose contexts are few for any corpus: 256 of one byte.
BOUNDED_DEPTH = 1


def normal(text: bytes) -> bytes:
    """A-Z lower-cased, words parted by one space, a line feed at the end."""
    return b" ".join(text.lower().split()) + b"\n"


# ---- keys of a block -------------------------------------------------------------------

def codes_of(texts: list[bytes]) -> np.ndarray:
    """The last ``DEPTH`` bytes and the byte itself, for every byte of normal texts.

    The most recent byte of the context is its lowest; before a text there are line feeds.
    """
    pad = b"\n" * DEPTH
    data = np.frombuffer(pad + b"".join(t + pad for t in texts), np.uint8).astype(np.uint64)
    sizes = np.array([len(t) for t in texts], np.int64)
    n = len(data) - DEPTH
    code = np.zeros(n, np.uint64)
    for i in range(DEPTH + 1):
        code = code << np.uint64(8) | data[i:i + n]
    at = np.arange(int(sizes.sum())) + DEPTH * np.repeat(np.arange(len(texts)), sizes)
    return code[at]


# Stands for the end of a text among the hashes of words.
TEXT_END = np.uint64(1)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of the words of normal texts, each text followed by its end, and their bounds."""
    found, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, hashes, bounds in hashed_rows(pa.array(texts, pa.large_binary())):
        found.append(np.insert(hashes >> np.uint64(1), bounds[1:], TEXT_END))
        counts.append(np.diff(bounds) + 1)
    return np.concatenate(found), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def pieces(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``PIECE`` bytes."""
    first, size = 0, 0
    for end, text in enumerate(texts, 1):
        size += len(text)
        if size >= PIECE or end == len(texts):
            yield first, end
            first, size = end, 0


class _Counts:
    """Distinct keys and how often training texts have them."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, keys: np.ndarray, train: np.ndarray) -> None:
        marked, n = np.unique(keys << np.uint64(1) | train.astype(np.uint64), return_counts=True)
        self.keys.append(marked >> np.uint64(1))
        self.counts.append(np.where(marked & np.uint64(1), n, 0))
        if len(self.keys) > 12:
            keys, counts = self.total()
            self.keys, self.counts = [keys], [counts]

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        return summed(np.concatenate(self.keys), np.concatenate(self.counts))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order].astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


# Keys and counts, or keys and answers, are packed tables.
PACKED = "kind int, block long, bucket int, keys binary"


def _blocks(buckets: int, id_type: str):
    """Rows of blocks (kind 0) and of their keys, by kind and bucket."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[bool] = []
        texts: list[bytes] = []
        size = 0
        kinds: pa.DataType = pa.int64()

        def out(rows: list[dict]) -> pa.RecordBatch:
            schema = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()),
                                ("ids", pa.list_(kinds)), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("text", pa.binary())])
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        def block() -> Iterator[pa.RecordBatch]:
            number = int.from_bytes(os.urandom(8), "little", signed=True)
            found = {BYTES: _Counts(), WORDS: _Counts()}
            train = ~np.array(held)
            for first, end in pieces(texts):
                part = texts[first:end]
                found[BYTES].add(codes_of(part), np.repeat(train[first:end], [len(t) for t in part]))
                words, ends = words_of(part)
                found[WORDS].add(words, np.repeat(train[first:end], np.diff(ends)))
            for kind, counted in found.items():
                keys, counts = counted.total()
                bucket = bucket_of(keys, buckets)
                order = np.argsort(bucket, kind="stable")
                bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = []
                for b in np.flatnonzero(np.diff(bounds)):
                    chosen = order[bounds[b]:bounds[b + 1]]
                    rows.append({"kind": kind, "block": number, "bucket": int(b), "keys": packed(pa.table({"key": keys[chosen], "n": counts[chosen]}))})
                yield out(rows)
            text = pa.compress(b"".join(texts), codec="zstd", asbytes=True)
            yield out([{"kind": 0, "block": number, "bucket": 0, "ids": ids, "held": held, "sizes": [len(t) for t in texts], "text": text}])

        for batch in batches:
            kinds = batch.schema.field("id").type
            for i, h, text in zip(batch.column("id").to_pylist(), batch.column("held").to_pylist(), row_bytes(batch.column("text"))):
                ids.append(i)
                held.append(h)
                texts.append(normal(text))
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield from block()
                    ids, held, texts, size = [], [], [], 0
        if texts:
            yield from block()

    return run, f"{PACKED}, ids array<{id_type}>, held array<boolean>, sizes array<long>, text binary"


def asked_keys(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The keys that each row of a table asks for; all distinct keys and their total counts."""
    every, counts = [], [np.zeros(0, np.int64)]
    for data in table.column("keys").to_pylist():
        own = unpacked(data)
        every.append(own.column("key").to_numpy())
        counts.append(own.column("n").to_numpy())
    keys, total = summed(np.concatenate([np.zeros(0, np.uint64), *every]), np.concatenate(counts))
    return every, keys, total


def _code_counts(table: pa.Table) -> pa.Table:
    _, keys, counts = asked_keys(table)
    return pa.table({"code": keys.view(np.int64), "n": counts, "part": bucket_of(keys >> np.uint64(8) & np.uint64(SPLIT), 1 << 20).astype(np.int32)})


ANSWER = "block long, kind int, answers binary, total long, known long"


def _answers(table: pa.Table, every: list[np.ndarray], keys: np.ndarray, values: np.ndarray, kind: int, total: int, known: int) -> pa.Table:
    """For each block's row its keys with their values."""
    rows = []
    for block, own in zip(table.column("block").to_pylist(), every):
        answer = packed(pa.table({"key": own, "value": values[np.searchsorted(keys, own)]}))
        rows.append({"block": block, "kind": kind, "answers": answer, "total": total, "known": known})
        total = known = 0
    schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("answers", pa.binary()), ("total", pa.int64()), ("known", pa.int64())])
    return pa.Table.from_pylist(rows, schema=schema)


def _word_answers(table: pa.Table) -> pa.Table:
    """Training counts of every block's words; the first row also has the bucket's totals."""
    every, keys, counts = asked_keys(table)
    return _answers(table, every, keys, counts, WORDS, int(counts.sum()), int((counts > 0).sum()))


def _byte_answers(asked: pa.Table, model: pa.Table) -> pa.Table:
    """Log probabilities of every block's codes."""
    codes = model.column("code").to_numpy().view(np.uint64)
    order = np.argsort(codes)
    values = model.column("logp").to_numpy()[order].astype(np.float32)
    return _answers(asked, asked_keys(asked)[0], codes[order], values, BYTES, 0, 0)


# ---- the tree --------------------------------------------------------------------------

class Level:
    """Nodes of contexts of one length, from keys of context and node with counts."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None = None) -> None:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)])
        self.keys = keys[starts]
        add = lambda x: np.add.reduceat(x[order], starts) if len(starts) else x
        self.n0, self.n1 = add(zeros), add(ones)
        self.below = None if below is None else add(below)
        a, b = self.n0.astype(np.float64), self.n1.astype(np.float64)
        own = np.where(a + b > 0, log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - math.log(math.pi), 0.0)
        self.kt = (b + 0.5) / (a + b + 1)
        self.seen = a + b > 0
        if self.below is None:
            self.lw, self.w = own, np.ones(len(own))
        else:
            self.lw = np.logaddexp(own, self.below) - math.log(2)
            self.w = 1 / (1 + np.exp(np.minimum(self.below - own, 700.0)))

    def shorter(self, depth: int) -> Level:
        """The level of contexts of ``depth`` bytes, one less than this."""
        return Level(shortened(self.keys, depth), self.n0, self.n1, self.lw)


def shortened(keys: np.ndarray, depth: int) -> np.ndarray:
    """Keys of context and node with contexts of ``depth`` bytes."""
    return keys & np.uint64((1 << 8 * (depth + 1)) - 1)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0: Stirling's series eight places up, and down again."""
    z = x + 8
    product = np.prod([x + i for i in range(8)], axis=0)
    series = 1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def bit_nodes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of context and node for each of the eight decisions of a code, and the bits: two (8, n) arrays."""
    b = np.arange(8, dtype=np.uint64)[:, None]
    byte = codes & np.uint64(255)
    node = np.uint64(1) << b | byte >> (np.uint64(8) - b)
    return (codes >> np.uint64(8)) << np.uint64(8) | node, (byte >> (np.uint64(7) - b) & np.uint64(1)).astype(bool)


def grown(codes: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Levels from ``DEPTH`` down to ``SPLIT_DEPTH`` of codes that hold their subtrees whole.

    Codes that training lacks have no count; their nodes are there for the texts that ask.
    """
    keys, bits = bit_nodes(codes)
    n = np.broadcast_to(counts, keys.shape)
    out = [Level(keys.ravel(), np.where(bits, 0, n).ravel(), np.where(bits, n, 0).ravel())]
    for depth in range(DEPTH - 1, SPLIT_DEPTH - 1, -1):
        out.append(out[-1].shorter(depth))
    return out


def _subtrees(table: pa.Table) -> pa.Table:
    """The nodes at ``SPLIT_DEPTH`` above the codes of a part of the contexts."""
    level = grown(table.column("code").to_numpy().view(np.uint64), table.column("n").to_numpy())[-1]
    return pa.table({"ctx": (level.keys >> np.uint64(8)).astype(np.int64), "node": (level.keys & np.uint64(255)).astype(np.int32),
                     "n0": level.n0, "n1": level.n1, "lw": level.lw, "w": level.w})


def upper_levels(split: DataFrame) -> list[DataFrame]:
    """The levels of contexts of 0 to ``SPLIT_DEPTH`` bytes, each from grouped sums of the one below."""
    out = [split]
    for depth in range(SPLIT_DEPTH - 1, -1, -1):
        shorter = out[-1].withColumn("ctx", F.col("ctx").bitwiseAND((1 << 8 * depth) - 1))
        merged = shorter.groupBy("ctx", "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("lw").alias("below"))
        out.append(stored(_weighted(merged), f"level{depth}"))
    return out[::-1]


def _weighted(level: DataFrame) -> DataFrame:
    """``lw``, the log of a node's weighted probability, and ``w``, the share of its own estimate."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Rows are distinct nodes; their places stand for them.
            found = Level(np.arange(batch.num_rows, dtype=np.uint64), *(batch.column(c).to_numpy() for c in ("n0", "n1", "below")))
            columns = [*(batch.column(c) for c in ("ctx", "node", "n0", "n1")), pa.array(found.lw), pa.array(found.w)]
            yield pa.RecordBatch.from_arrays(columns, names=["ctx", "node", "n0", "n1", "lw", "w"])

    return level.mapInArrow(run, NODES)


NODES = "ctx long, node int, n0 long, n1 long, lw double, w double"


def mixed(tree: list[DataFrame]) -> DataFrame:
    """``ctx``, ``node`` at ``SPLIT_DEPTH`` with what all shorter contexts and this one give.

    ``sum``: estimates with their shares; ``rest``: the share left for longer contexts;
    ``stop``: the probability of a 1 if nothing longer is known.
    """
    seen = F.col("n0") + F.col("n1") > 0
    kt = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
    done = tree[0].select("ctx", "node", (F.col("w") * kt).alias("sum"), (1 - F.col("w")).alias("rest"), F.when(seen, kt).otherwise(0.5).alias("stop"))
    for depth in range(1, SPLIT_DEPTH + 1):
        parent = done.withColumnRenamed("ctx", "short")
        if depth - 1 <= BOUNDED_DEPTH:
            # At most 256 contexts of 255 nodes.
            parent = F.broadcast(parent)
        # A context has at most 256 longer ones, so no key is hot.
        level = tree[depth].withColumn("short", F.col("ctx").bitwiseAND((1 << 8 * (depth - 1)) - 1))
        joined = level.join(parent, ["short", "node"])
        stop = F.when(seen, F.col("sum") + F.col("rest") * kt).otherwise(F.col("stop"))
        done = joined.select("ctx", "node", (F.col("sum") + F.col("rest") * F.col("w") * kt).alias("sum"),
                             (F.col("rest") * (1 - F.col("w"))).alias("rest"), stop.alias("stop"))
    return done


def _code_scores(buckets: int):
    """The log10 probabilities of the codes of a part of the contexts."""
    def run(codes: pa.Table, above: pa.Table) -> pa.Table:
        own = codes.column("code").to_numpy().view(np.uint64)
        levels = grown(own, codes.column("n").to_numpy())
        keys = above.column("ctx").to_numpy().view(np.uint64) << np.uint64(8) | above.column("node").to_numpy().astype(np.uint64)
        order = np.argsort(keys)
        keys, total, rest, stop = keys[order], *(above.column(c).to_numpy()[order] for c in ("sum", "rest", "stop"))
        for level, depth in zip(levels[-2::-1], range(SPLIT_DEPTH + 1, DEPTH + 1)):
            at = np.searchsorted(keys, shortened(level.keys, depth - 1))
            total, rest, stop = total[at], rest[at], stop[at]
            stop = np.where(level.seen, total + rest * level.kt, stop)
            total, rest, keys = total + rest * level.w * level.kt, rest * (1 - level.w), level.keys
        nodes, bits = bit_nodes(own)
        p1 = stop[np.searchsorted(keys, nodes)]
        logp = np.log10(np.where(bits, p1, 1 - p1)).sum(axis=0)
        return pa.table({"code": own.view(np.int64), "logp": logp, "bucket": bucket_of(own, buckets).astype(np.int32)})

    return run


def model(codes: DataFrame, parts: int, buckets: int) -> DataFrame:
    """``code``, ``logp`` and ``bucket``: the log10 probability of a byte after its context.

    ``codes`` has ``code``, ``n`` and ``part``, a number that codes of one context of
    ``SPLIT_DEPTH`` bytes share. Longer contexts are worked out part by part, shorter ones
    level by level over all.
    """
    dealt = codes.withColumn("part", F.pmod("part", F.lit(parts)))
    split = stored(dealt.groupBy("part").applyInArrow(_subtrees, NODES), f"level{SPLIT_DEPTH}")
    done = mixed(upper_levels(split))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = bucket_of(batch.column("ctx").to_numpy().view(np.uint64), 1 << 20) % parts
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], names=[*batch.schema.names, "part"])

    placed = done.mapInArrow(place, "ctx long, node int, sum double, rest double, stop double, part int")
    return dealt.groupBy("part").cogroup(placed.groupBy("part")).applyInArrow(_code_scores(buckets), "code long, logp double, bucket int")


# ---- scores ----------------------------------------------------------------------------

class Answers:
    """Keys with values, in an open hash table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.zeros(1 << self.bits, values.dtype)
        self.taken = np.zeros(1 << self.bits, bool)
        left, slots = np.arange(len(keys)), self._slots(keys)
        while len(left):
            # Of several keys for one free slot the last stays.
            free = ~self.taken[slots]
            self.keys[slots[free]] = keys[left[free]]
            self.values[slots[free]] = values[left[free]]
            self.taken[slots[free]] = True
            missed = self.keys[slots] != keys[left]
            left, slots = left[missed], (slots[missed] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (((keys ^ keys >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys that are all there."""
        slots = self._slots(keys)
        out = self.values[slots]
        left = np.flatnonzero(self.keys[slots] != keys)
        slots = slots[left]
        while len(left):
            slots = (slots + 1) & ((1 << self.bits) - 1)
            out[left] = self.values[slots]
            missed = self.keys[slots] != keys[left]
            left, slots = left[missed], slots[missed]
        return out


def _scored(total: int, known: int):
    """Scores of the texts of a block from its answers."""
    def table(answers: pa.Table, kind: int) -> Answers:
        own = [unpacked(a) for a in answers.filter(pc.equal(answers.column("kind"), kind)).column("answers").to_pylist()]
        return Answers(*(np.concatenate([t.column(c).to_numpy() for t in own]) for c in ("key", "value")))

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        of_bytes, of_words = table(answers, BYTES), table(answers, WORDS)
        sizes = np.array(block.column("sizes").to_pylist()[0], np.int64)
        raw = pa.decompress(block.column("text").to_pylist()[0], int(sizes.sum()), codec="zstd", asbytes=True)
        bounds = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        texts = [raw[a:b] for a, b in zip(bounds, bounds[1:])]
        score, base, tokens, hits = (np.zeros(len(texts)) for _ in range(4))
        for first, end in pieces(texts):
            part = texts[first:end]
            ends = np.concatenate([[0], np.cumsum([len(t) for t in part])])
            score[first:end] = sum_by_row(of_bytes.of(codes_of(part)).astype(np.float64), ends)
            words, ends = words_of(part)
            counts = of_words.of(words)
            logs = np.log10((counts + 0.5) / (total + 0.5 * (known + 1)))
            base[first:end], hits[first:end] = sum_by_row(logs, ends), sum_by_row(counts > 0, ends)
            tokens[first:end] = np.diff(ends)
        flat = block.column("ids").chunk(0).flatten() if block.column("ids").num_chunks else pa.array([])
        return pa.table({
            "id": flat, "held": pa.array(block.column("held").to_pylist()[0], pa.bool_()), "n_tokens": tokens.astype(np.int64),
            "n_known": hits.astype(np.int64), "train_tokens": np.full(len(texts), total, np.int64), "base_score": base, "score": score,
            "n_bytes": sizes,
        })

    return run


def scores(docs: DataFrame, held: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Log10 probabilities of all texts, learned from the rows that ``held`` does not name.

    Columns: ``id``, ``held``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (words
    counted alone), ``score`` (the weighted tree), ``n_bytes``. Scored are the lower-cased words
    of a text, parted by single spaces, and its end. Null texts are empty; repeated rows stay
    and each counts. With no training row every bit has probability one half.
    """
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(f"`{text_column}`").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 8 + size // BUCKET_BYTES
    kind = rows.schema["id"].dataType.simpleString()
    run, schema = _blocks(buckets, kind)
    every = stored(rows.mapInArrow(run, schema), "blocks")

    asked = {k: every.where(F.col("kind") == k).select("block", "bucket", "keys") for k in (BYTES, WORDS)}
    of_words = stored(asked[WORDS].groupBy("bucket").applyInArrow(_word_answers, ANSWER), "word-answers")
    total, known = of_words.agg(F.sum("total"), F.sum("known")).first()
    codes = stored(asked[BYTES].groupBy("bucket").applyInArrow(_code_counts, "code long, n long, part int"), "codes")
    scored = model(codes, buckets, buckets)
    of_bytes = asked[BYTES].groupBy("bucket").cogroup(scored.groupBy("bucket")).applyInArrow(_byte_answers, ANSWER)
    answers = of_words.union(of_bytes).select("block", "kind", "answers")
    blocks = every.where("kind = 0").select("block", "ids", "held", "sizes", "text")
    columns = f"id {kind}, held boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored(total or 0, known or 0), columns)
