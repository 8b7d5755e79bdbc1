"""Unions of tables whose columns differ."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crivo.operators.contingency import quoted


def all_columns(frames: Sequence[DataFrame]) -> list[str]:
    """Sorted union of all column names; only schemas are read."""
    return sorted({c for df in frames for c in df.columns})


def column_presence(frames: Mapping[str, DataFrame]) -> dict[str, list[str]]:
    """For every column of the union, the sources that have it."""
    return {
        c: [name for name, df in frames.items() if c in df.columns]
        for c in all_columns(list(frames.values()))
    }


def filled_counts(df: DataFrame, source: str | None = None, absent: str | None = None) -> DataFrame:
    """How many values each column has: ``source, column, n_rows, n_filled``, from one pass.

    Counts are by ``source`` if one is named; ``absent`` names a list column with what the row's
    source does not have at all, and such columns have no line.
    """
    names = [c for c in df.columns if c not in (source, absent)]
    key = quoted(source).cast("string").alias("source") if source else F.lit(None).cast("string").alias("source")
    lacking = F.first(quoted(absent), ignorenulls=True).alias("_absent") if absent else F.lit(None).cast("array<string>").alias("_absent")
    counts = [F.count(quoted(c)).alias(f"_{i}") for i, c in enumerate(names)]
    wide = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), lacking, *counts)
    lines = [F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("n_filled")) for i, c in enumerate(names)]
    long = wide.select("source", "n_rows", "_absent", F.inline(F.array(*lines)))
    return long.where(~F.coalesce(F.array_contains("_absent", F.col("column")), F.lit(False))).select("source", "column", "n_rows", "n_filled")


def presence(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Which sources have a column, by their rows: ``column, source, n_rows, n_filled``.

    A source that has the column without any value has a line with 0; one without rows has none.
    """
    counted = [filled_counts(df).withColumn("source", F.lit(name)) for name, df in frames.items()]
    return reduce(DataFrame.unionByName, counted).where("n_rows > 0").select("column", "source", "n_rows", "n_filled")


def aligned(df: DataFrame, columns: Sequence[str], fill: object = 0) -> DataFrame:
    """Exactly these columns: absent ones hold ``fill``, others are dropped.

    A missing value in a column the table does have stays missing.
    """
    def pick(c: str) -> Column:
        return quoted(c) if c in df.columns else F.lit(fill).alias(c)
    return df.select(*[pick(c) for c in columns])


def numbers_aligned(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """`aligned` with 0, features cast to double and the target to int."""
    whole = aligned(df, columns)
    return whole.select(*[quoted(c).cast("int" if c == target else "double").alias(c) for c in columns])


def aligned_union(
    frames: Sequence[DataFrame], fill: object | None = 0, columns: Sequence[str] | None = None
) -> DataFrame:
    """Union by name over the sorted set of all columns.

    ``fill=0`` writes 0 for a column a table lacks; ``fill=None`` leaves it missing.
    """
    if not frames:
        raise ValueError("no input tables")
    names = all_columns(frames) if columns is None else list(columns)
    return reduce(DataFrame.unionByName, [aligned(df, names, fill) for df in frames])


def consolidated(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name in first-seen column order, missing where a table lacks the column."""
    if not frames:
        raise ValueError("no input tables")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def row_audit(df: DataFrame, source: str = "source_file") -> DataFrame:
    """Rows per source and, as ``(total)``, of all: ``<source>, n_rows, n_columns``."""
    columns = len([c for c in df.columns if c != source])
    named = df.select(quoted(source).cast("string").alias("_source"))
    counted = named.rollup("_source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.grouping("_source").alias("_total")
    )
    return counted.select(
        F.when(F.col("_total") == 1, F.lit("(total)")).otherwise(F.col("_source")).alias(source),
        "n_rows", F.lit(columns).alias("n_columns"),
    )


def empty_sources(df: DataFrame, sources: DataFrame, source: str = "source_file") -> DataFrame:
    """The listed sources that contribute no row."""
    return sources.join(df.select(quoted(source).alias(source)).distinct(), source, "left_anti")


def require_rows(df: DataFrame) -> DataFrame:
    """Fail when there is no row at all; looks for one row only."""
    if df.isEmpty():
        raise ValueError("none of the inputs holds data")
    return df
