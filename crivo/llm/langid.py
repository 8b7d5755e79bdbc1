"""Language identification by n-gram filters that hold a bit for every language.

All languages share the slots of one Bloom filter: a slot is a machine word whose bit ``l``
belongs to language ``l``, so the bits ``l`` of all slots form the filter of that language.
The words of an n-gram's slots, joined by AND, name every language that has the n-gram.
A text is given the language with the most n-grams found, after the share of finds that
its filter gives by mere chance is taken off.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from crivo.llm.common import slices, stored, sum_by_row, tidy, two_columns, unused, utf8_pieces

# A language has an n-gram if the n-gram makes up at least this share of its n-grams. That
# bounds the filter: no language can have more than 1 / SHARE n-grams.
SHARE = 2e-5
SLOTS_PER_GRAM = 12
HASHES = 3
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
UNDETERMINED = "und"

_SPACE = 32
# ASCII letters stay, other ASCII becomes a space; bytes of other characters stay.
_FOLD = bytes(c if c >= 128 or chr(c).isalpha() else _SPACE for c in range(256))


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the byte 3- and 4-grams of folded rows, and each row's bounds in them.

    Only n-grams whose inner bytes are no spaces count, so none spans two words.
    """
    folded = np.frombuffer(data.tobytes().translate(_FOLD), dtype=np.uint8)
    sizes = np.diff(offsets)
    # One space before and after each row; rows never share an n-gram.
    at = offsets[:-1] + 2 * np.arange(len(sizes)) + 1
    padded = np.full(len(folded) + 2 * len(sizes) + 3, _SPACE, dtype=np.uint8)
    padded[np.arange(len(folded)) + np.repeat(at - offsets[:-1], sizes)] = folded
    letter = padded != _SPACE
    wide = padded.astype(np.uint32)
    n = len(padded) - 3
    three = (wide[:n] << 16) | (wide[1:n + 1] << 8) | wide[2:n + 2]
    keep3 = np.flatnonzero(letter[1:n + 1])
    keep4 = np.flatnonzero(letter[1:n + 1] & letter[2:n + 2])
    four = (three[keep4] << np.uint32(8)) | wide[3:n + 3][keep4]
    codes = np.concatenate([three[keep3].astype(np.uint64), four.astype(np.uint64) | np.uint64(1 << 32)])
    starts = np.append(at - 1, at[-1] + sizes[-1] + 1 if len(at) else 0)
    return codes, np.stack([np.searchsorted(keep3, starts), np.searchsorted(keep4, starts) + len(keep3)])


def _lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.fill_null("").cast(pa.large_string()))


def _count_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per language and n-gram of the partition."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def add(lang: str, codes: np.ndarray) -> None:
        parts = held.setdefault(lang, [])
        parts.append(np.unique(codes, return_counts=True))
        if len(parts) > 16:
            held[lang] = [_merged(parts)]

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for lang in sorted(set(langs)):
            chosen = _lowered(batch.column("text").filter(pa.array(langs == lang)))
            for _, data, offsets in utf8_pieces(chosen):
                if len(data):
                    add(lang, _grams(data, offsets)[0])
    for lang, parts in held.items():
        codes, counts = _merged(parts)
        for i in range(0, len(codes), 50_000):
            part = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(codes[part]), pa.string()), pa.array(codes[part].astype(np.int64)), pa.array(counts[part].astype(np.int64))],
                names=["lang", "gram", "n"],
            )


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


@dataclass
class Filters:
    """The shared filter: ``words[w, slot]`` holds the bits of languages ``64 w`` and on."""

    languages: list[str]
    words: np.ndarray
    by_chance: np.ndarray

    def has(self, codes: np.ndarray) -> np.ndarray:
        """For each n-gram the bits of all languages that have it."""
        found = self.words[:, _slots(codes, 0, self.words.shape[1])]
        for h in range(1, HASHES):
            found &= self.words[:, _slots(codes, h, self.words.shape[1])]
        return found


def _slots(codes: np.ndarray, h: int, n_slots: int) -> np.ndarray:
    return (codes * np.uint64(MULTIPLIERS[h])) >> np.uint64(64 - int(math.log2(n_slots)))


def build(languages: list[str], grams: np.ndarray, langs: np.ndarray) -> Filters:
    """The filter of (n-gram, language number) pairs."""
    n_slots = 1 << max(10, math.ceil(math.log2(max(1, len(np.unique(grams))) * SLOTS_PER_GRAM)))
    words = np.zeros((max(1, -(-len(languages) // 64)), n_slots), dtype=np.uint64)
    codes = grams.astype(np.uint64)
    for h in range(HASHES):
        np.bitwise_or.at(words, (langs // 64, _slots(codes, h, n_slots)), np.uint64(1) << (langs % 64).astype(np.uint64))
    fill = [np.count_nonzero(words[i // 64] >> np.uint64(i % 64) & np.uint64(1)) / n_slots for i in range(len(languages))]
    return Filters(languages, words, np.array(fill) ** HASHES)


def learn(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> Filters:
    """Filters of all languages named in ``docs``.

    Every n-gram of every row is counted. Rows without a language or a text teach nothing;
    an empty table gives filters of no language. What reaches the driver is bounded by
    languages / ``SHARE`` n-grams.
    """
    known = two_columns(docs, lang_column, text_column).select(F.col("id").cast("string").alias("lang"), "text")
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # The counts per partition are few; they are kept, as sums and shares both read them.
    parts = known.mapInArrow(tidy(_count_grams), "lang string, gram long, n long")
    counts = stored(parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "langid-grams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Filters([], np.zeros((1, 1024), np.uint64), np.zeros(0))
    least = F.create_map(*[F.lit(x) for lang in languages for x in (lang, totals[lang] * SHARE)])
    frequent = counts.where(F.col("n") >= least[F.col("lang")]).select("lang", "gram").toPandas()
    number = {lang: i for i, lang in enumerate(languages)}
    return build(languages, frequent["gram"].to_numpy(np.int64), frequent["lang"].map(number).to_numpy(np.int64))


def _scored(texts: pa.Array, filters: Filters) -> tuple[pa.Array, np.ndarray]:
    """Language and score of each text."""
    grams = np.zeros(len(texts))
    hits = np.zeros((len(filters.languages), len(texts)))
    for rows, data, offsets in utf8_pieces(_lowered(texts)):
        if not len(data):
            continue
        codes, bounds = _grams(data, offsets)
        np.add.at(grams, rows, sum(np.diff(b) for b in bounds))
        found = filters.has(codes)
        for i in range(len(filters.languages)):
            bit = (found[i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(np.uint8)
            np.add.at(hits[i], rows, sum(sum_by_row(bit, b) for b in bounds))
    chance = filters.by_chance[:, None]
    rates = np.clip((hits - grams * chance) / ((1 - chance) * np.maximum(grams, 1)), 0, 1)
    letters = pc.match_substring_regex(texts.fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
    if not filters.languages:
        return pa.array([UNDETERMINED] * len(texts), pa.string()), grams * 0
    best = np.where(letters, rates.argmax(axis=0), len(filters.languages))
    names = np.array([*filters.languages, UNDETERMINED], dtype=object)
    return pa.array(names[best], pa.string()), np.where(letters, rates.max(axis=0), 0.0)


def identify(docs: DataFrame, filters: Filters, text_column: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the share of n-grams found beyond chance.

    Null texts and texts without a letter are ``und`` with score 0, as is every text if no
    language was learned. Equal rates go to the language first in code-point order. Columns
    of those two names are replaced; the others pass unchanged.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((filters.languages, filters.words, filters.by_chance))
    docs = docs.drop("lang_pred", "score")
    names = docs.columns

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, text = Filters(*shared.value), names.index(text_column)
        for batch in batches:
            for part in slices(batch, text):
                langs, scores = _scored(part.column(text), known)
                yield pa.RecordBatch.from_arrays([*part.columns, langs, pa.array(scores)], names=[*names, "lang_pred", "score"])

    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return docs.mapInArrow(tidy(predict), StructType([*docs.schema.fields, *added]))


def accepted(docs: DataFrame, filters: Filters, least: float, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` in a learned language: not ``und``, and of a score of ``least`` or more.

    Null texts and texts without a letter go. Repeated rows stay, as do all columns, whatever
    their names.
    """
    columns = unused(docs.columns, *[f"own_{i}" for i in range(len(docs.columns))])
    renamed = docs.toDF(*columns)
    found = identify(renamed, filters, columns[docs.columns.index(text_column)])
    kept = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return kept.select(*[F.col(c).alias(name) for c, name in zip(columns, docs.columns)])
