"""From raw documents to token ids, in five stages.

Language identification, near-duplicates, repeated passages, benchmark passages, encoding.
Every stage reads what the one before has written as Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crivo.llm import bpe, decontam, langid, simhash, substring
from crivo.llm.common import stored, table, unused
from crivo.llm.queries import tokenizer_json

# Texts of which fewer n-grams than this share are known in any language are rejected.
LEAST_KNOWN = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the corpus names.

    Null and empty texts and those without a letter go. Repeated rows stay, as do all columns,
    whatever their names; that holds for the next three stages too. Without rows there are none.
    """
    return langid.accepted(docs, langid.learn(docs), LEAST_KNOWN)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by fingerprints of three-word shingles within three bits.

    The one of the smallest id stays, and one of its repeated rows. Texts without words are one
    group; a null id stands for a group only if it holds no other.
    """
    return simhash.one_of_each(docs, width=3)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 20 words that occur earlier; those left empty go.

    Texts that lose nothing stay as they are, null and empty ones among them. Null ids come
    first. ``n_chars`` follows a text that is cut.
    """
    own = unused(docs.columns + ["n_words", "n_removed", "kept"], *[f"own_{i}" for i in range(len(docs.columns))])
    ident, text, size = (own[docs.columns.index(c)] for c in ("doc_id", "text", "n_chars"))
    found = substring.without_repeats(docs.toDF(*own), ident, text, width=20).where("n_removed = 0 OR n_removed < n_words")
    cut = F.col("n_removed") > 0
    changed = {text: F.when(cut, F.col("kept")).otherwise(F.col(text)), size: F.when(cut, F.length("kept").cast("long")).otherwise(F.col(size))}
    return found.select(*[changed.get(c, F.col(c)).alias(name) for c, name in zip(own, docs.columns)])


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item; null and empty texts stay."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their number and the hashes of ids and decoded text.

    Null and empty texts have none. Repeated rows stay; other columns do not.
    """
    encoded = bpe.encode(docs, tokenizer_json())
    counted = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return encoded.select(F.col("id").alias("doc_id"), counted, "ids", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("tokens", tokens),
]

# SQL can state neither the learned language nor the tokens; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
