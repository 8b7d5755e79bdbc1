"""Projections and filters that turn raw columns into analysis columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crivo.functions import text
from crivo.operators.contingency import quoted

# Lists the columns that the file of a row does not have.
ABSENT = "_absent_columns"


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.StringType, T.VarcharType, T.CharType))


def is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def text_columns(df: DataFrame) -> list[str]:
    """Names of the text columns."""
    return [c for c in df.columns if is_text(df, c)]


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    """Fail with the names that are missing."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")


def present(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The names the table has, without repeats, in the given order."""
    return [c for c in dict.fromkeys(names) if c in df.columns]


def replaced(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """One projection that swaps some columns and keeps the order of all."""
    return df.select(*[changes[c].alias(c) if c in changes else quoted(c) for c in df.columns])


def normalize_names(df: DataFrame) -> DataFrame:
    """Column names without accents and outer space; two names may not become one."""
    names = [text.normalize_name(c) for c in df.columns]
    doubled = sorted({c for c in names if [d.lower() for d in names].count(c.lower()) > 1})
    if doubled:
        raise ValueError(f"column names collide after normalisation: {doubled}")
    return df.toDF(*names)


def clean_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Strip accents from the content of text columns (all of them by default).

    Latin text, the common case, stays in generated code. The exact expression for all
    of Unicode is large, so it stands in the plan once for all columns, and only rows
    that reach beyond Latin letters evaluate it.
    """
    names = text_columns(df) if columns is None else list(columns)
    if not names:
        return df
    wanted = reduce(lambda a, b: a | b, [text.beyond_latin(quoted(c)) for c in names])
    spelled = F.transform(F.array(*[quoted(c) for c in names]), text.strip_accents)
    marked = df.select("*", F.when(wanted, spelled).alias("_spelled"))
    either = {
        c: F.coalesce(F.get("_spelled", F.lit(i)), text.strip_latin_accents(quoted(c))) for i, c in enumerate(names)
    }
    return replaced(marked, either).drop("_spelled")


def binary_target(df: DataFrame, source: str, positive: str, target: str) -> DataFrame:
    """Flag 1 where the trimmed source text equals ``positive``, else 0; missing counts as 0."""
    # Trimming takes a regular expression, so only texts that hold ``positive`` get it.
    equal = text.trim_all(quoted(source)).eqNullSafe(F.lit(positive))
    flag = F.when(quoted(source).contains(positive), equal).otherwise(F.lit(False)).cast("int")
    return df.withColumn(target, flag)


def exclude_values(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Leave out rows whose trimmed text is one of the values; missing text stays."""
    if not values:
        return df
    matched = text.trim_all(quoted(column)).isin(*values)
    return df.where(~F.coalesce(matched, F.lit(False)))


def drop_strict(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop columns, all of which must exist."""
    require_columns(df, names)
    return drop_present(df, names)


def drop_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop the columns that exist."""
    return df.select(*[quoted(c) for c in df.columns if c not in set(names)])


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Keep rows without any missing value (null or not-a-number) in any column.

    A column that the row's file does not have, by ``ABSENT``, is not missing in it.
    """
    def filled(c: str) -> Column:
        whole = quoted(c).isNotNull()
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            whole = whole & ~F.isnan(quoted(c))
        return whole | F.array_contains(ABSENT, c) if ABSENT in df.columns else whole
    names = [c for c in df.columns if c != ABSENT]
    return df.where(reduce(lambda a, b: a & b, map(filled, names))) if names else df


def to_numbers(df: DataFrame, target: str | None = None) -> DataFrame:
    """Features as double, target as int; unreadable text becomes missing."""
    def cast(c: str) -> Column:
        kind = "int" if c == target else "double"
        return quoted(c).try_cast(kind) if is_text(df, c) else quoted(c).cast(kind)
    return df.select(*[cast(c).alias(c) for c in df.columns])


def to_categories(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns as text, ready for cross-tabulation."""
    return replaced(df, {c: quoted(c).cast("string") for c in names})


def fill_zero(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Missing numbers as 0 (all numeric columns by default)."""
    chosen = [c for c in df.columns if is_number(df, c)] if names is None else list(names)
    return df.na.fill(0, subset=["`" + c + "`" if "." in c else c for c in chosen]) if chosen else df


def clip_negative(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Negative numbers as 0 (all numeric columns by default); missing stays missing."""
    chosen = [c for c in df.columns if is_number(df, c)] if names is None else names
    return replaced(df, {
        c: F.when(quoted(c) < 0, F.lit(0).cast(df.schema[c].dataType)).otherwise(quoted(c)) for c in chosen
    })


def day_first_epochs(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add ``<name>_timestamp``: epoch second of a day-first date text, 0 when unreadable."""
    return df.select("*", *[text.day_first_epoch(quoted(c)).alias(f"{c}_timestamp") for c in names])


def column_profile(df: DataFrame) -> DataFrame:
    """Per column, from one pass: ``column, kind, rows, missing, any_missing, any_negative``."""
    parts = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(df.columns):
        absent = quoted(c).isNull()
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            absent = absent | F.isnan(quoted(c))
        parts.append(F.count_if(absent).alias(f"m{i}"))
        if is_number(df, c):
            parts.append(F.coalesce(F.bool_or(quoted(c) < 0), F.lit(False)).alias(f"n{i}"))
    wide = df.agg(*parts)
    lines = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit("text" if is_text(df, c) else "number" if is_number(df, c) else "other").alias("kind"),
            F.col("_rows").alias("rows"),
            F.col(f"m{i}").alias("missing"),
            (F.col(f"m{i}") > 0).alias("any_missing"),
            (F.col(f"n{i}") if is_number(df, c) else F.lit(False)).alias("any_negative"),
        )
        for i, c in enumerate(df.columns)
    ]
    return wide.select(F.inline(F.array(*lines)))


def for_chi_square(df: DataFrame, target: str) -> DataFrame:
    """Numeric features ready for the class-sum score: missing as 0, then negatives as 0."""
    names = [c for c in df.columns if c != target and is_number(df, c)]
    return clip_negative(fill_zero(df, names), names)


def assemble(df: DataFrame, features: Sequence[str], target: str, group: str | None = None) -> DataFrame:
    """Feature vector ``x`` and label ``y`` for the model library; a missing value counts as 0."""
    from pyspark.ml.feature import VectorAssembler

    numbers = df.where(quoted(target).isNotNull()).select(
        *[F.coalesce(F.nanvl(quoted(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"f{i}") for i, c in enumerate(features)],
        quoted(target).cast("double").alias("y"),
        *([quoted(group).alias(group)] if group else []),
    )
    vectors = VectorAssembler(inputCols=[f"f{i}" for i in range(len(features))], outputCol="x")
    return vectors.transform(numbers).select("x", "y", *([group] if group else []))
