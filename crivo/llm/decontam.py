"""Benchmark passages in documents, by a prefix-filtered set join over item-sized windows.

An item's windows of ``size`` words (the whole item if it is shorter) are records. Its words
are ordered by rarity, as counted over all documents. Containment must be complete, so the
prefix that two records must share is a single token: the window's rarest word. Documents
join on that word alone; the word's place in the window then fixes the only place in the
document where the window can start (positional bound), which must leave room for all of it
(length bound), and the words there are compared one by one.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crivo.llm.common import stored, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What is no ASCII letter, digit or control sign parts words; other characters belong to them.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Beyond this many bytes of prefix words and windows the join is not a broadcast.
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    """Words of the whole text with A-Z lower-cased; null has none."""
    # lower() is quick, and on a text of ASCII alone it is the same as translate().
    ascii_only = F.length(text) == F.octet_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def text_key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))


def windows(items: DataFrame, size: int) -> DataFrame:
    """Distinct ``window`` word lists of ``items`` (columns ``item``, ``words``) with the ``items`` that hold them."""
    last = F.greatest(F.size("words") - size, F.lit(0))
    starts = F.when(F.size("words") > 0, F.sequence(F.lit(0), last))
    cut = items.select("item", "words", F.explode(starts).alias("start"))
    window = F.slice("words", F.col("start") + 1, F.least(F.lit(size), F.size("words")))
    return cut.select("item", window.alias("window")).groupBy("window").agg(F.collect_set("item").alias("items"))


def prefixes(cut: DataFrame, docs: DataFrame) -> DataFrame:
    """``token``, ``offset``, ``window``, ``items``: each window under its rarest word.

    Rarity is the word's count over all documents; equal counts go to the smaller word, and a
    word that a window holds twice stands at its first place.
    """
    tokens = cut.select(F.explode("window").alias("token")).distinct()
    said = docs.select(F.explode("words").alias("token"))
    counts = said.join(bounded(tokens), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    placed = cut.select("window", "items", F.posexplode("window").alias("offset", "token"))
    ranked = placed.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = F.min(F.struct("n", "token", "offset")).alias("least")
    return ranked.groupBy("window").agg(rarest, F.first("items").alias("items")).select("least.token", "least.offset", "window", "items")


def bounded(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if its measured bytes allow it."""
    return F.broadcast(df) if measured_bytes(df) <= BROADCAST_BYTES else df


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all rows written as JSON, an upper bound for the words they hold."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    return size or 0


def occurrences(docs: DataFrame, keyed: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """``key``, ``start``, ``len``, ``items`` of every occurrence of a window in ``docs`` (``key``, ``words``).

    With a small benchmark the words are compared where the document is read. Otherwise the
    prefix words are joined through a shuffle, and the candidates go back to the document's
    words once per document.
    """
    start = F.col("at") - F.col("offset")
    room = (start >= 0) & (start + F.size("window") <= F.col("n_words"))
    there = F.expr("slice(words, at - offset + 1, size(window)) = window")
    if broadcast if broadcast is not None else measured_bytes(keyed) <= BROADCAST_BYTES:
        said = docs.select("key", "words", "n_words", F.posexplode("words").alias("at", "token"))
        found = said.join(F.broadcast(keyed), "token").where(room & there)
    else:
        said = docs.select("key", "n_words", F.posexplode("words").alias("at", "token"))
        near = said.join(keyed, "token").where(room).select("key", "at", "offset", "window", "items").distinct()
        found = near.join(docs, "key").where(there)
    return found.select("key", start.alias("start"), F.size("window").alias("len"), "items")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text: str = "text", size: int = 10, broadcast: bool | None = None,
) -> DataFrame:
    """One row per document: ``id``, ``key``, ``n_words``, ``n_hit``, and the sorted ``items`` found in it.

    ``n_hit`` counts the words inside any occurrence of a window. Texts without words have
    none, and items without words are nowhere. Null item ids read as the empty text. Repeated
    rows, also of one id, are judged each by its own text. The documents' words are written
    down once; the counts, the join and the result read them from there.
    """
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    # Equal texts have equal hits, so they share a key.
    split = stored(rows.select("id", text_key(F.col("text")).alias("key"), words(F.col("text")).alias("words"))
                   .withColumn("n_words", F.size("words")), "words")
    listed = benchmark.select(
        F.coalesce(F.col(f"`{item_column}`").cast("string"), F.lit("")).alias("item"),
        words(F.col(f"`{item_text}`").cast("string")).alias("words"),
    )
    cut = stored(windows(listed, size), "windows")
    keyed = stored(prefixes(cut, split), "prefixes")
    found = occurrences(split, keyed, broadcast)
    spans = F.collect_set(F.struct("start", "len")).alias("spans")
    hit = found.groupBy("key").agg(spans, F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.expr("size(array_distinct(flatten(transform(spans, s -> sequence(s.start, s.start + s.len - 1)))))")
    hits = hit.select("key", covered.alias("n_hit"), "items")
    none = F.array().cast("array<string>")
    return split.select("id", "key", "n_words").join(hits, "key", "left").select(
        "id", "key", F.col("n_words").cast("long"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items")
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark.

    Null and blank texts hold none and stay, as do repeated rows and all columns, whatever their
    names; an empty benchmark takes no row away.
    """
    found = contaminated(docs, benchmark, id_column, text_column, **options).where("n_hit > 0").select("key").distinct()
    mark, hit = unused(docs.columns, "own_key", "hit_key")
    own = docs.withColumn(mark, text_key(F.col(f"`{text_column}`").cast("string")))
    return own.join(found.withColumnRenamed("key", hit), F.col(mark) == F.col(hit), "left_anti").drop(mark)
