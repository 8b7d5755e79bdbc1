"""Agreement of two score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crivo.functions.stats import is_close
from crivo.operators.align import filled_counts
from crivo.operators.contingency import quoted
from crivo.operators.rank import TOP_K, head_ranks

# The result columns the reference compares.
METRICS = ("chi2_score", "cramers_v", "p_value")


def shapes(a: DataFrame, b: DataFrame) -> DataFrame:
    """``rows_a, columns_a, rows_b, columns_b, same_shape``."""
    counted = (
        a.select(F.lit(1).alias("a"), F.lit(0).alias("b"))
        .unionByName(b.select(F.lit(0).alias("a"), F.lit(1).alias("b")))
        .agg(F.coalesce(F.sum("a"), F.lit(0)).alias("rows_a"), F.coalesce(F.sum("b"), F.lit(0)).alias("rows_b"))
    )
    same_width = len(a.columns) == len(b.columns)
    return counted.select(
        "rows_a", F.lit(len(a.columns)).alias("columns_a"),
        "rows_b", F.lit(len(b.columns)).alias("columns_b"),
        ((F.col("rows_a") == F.col("rows_b")) & F.lit(same_width)).alias("same_shape"),
    )


def same_columns(a: DataFrame, b: DataFrame) -> bool:
    """Same names in the same order."""
    return a.columns == b.columns


def column_differences(a: DataFrame, b: DataFrame) -> list[tuple[str, str]]:
    """Columns only one table has, each with ``a`` or ``b``."""
    only_a = [(c, "a") for c in a.columns if c not in b.columns]
    return only_a + [(c, "b") for c in b.columns if c not in a.columns]


def column_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Values per column of both tables: ``column, filled_a, filled_b, only_in``, from one pass over each.

    Where a table lacks a column its count is missing and ``only_in`` names the other.
    """
    left, right = (filled_counts(df).select("column", F.col("n_filled").alias(f"filled_{side}"), F.lit(True).alias(f"_in_{side}")) for df, side in ((a, "a"), (b, "b")))
    only = F.when(F.col("_in_b").isNull(), F.lit("a")).when(F.col("_in_a").isNull(), F.lit("b"))
    return left.join(right, "column", "full_outer").select("column", "filled_a", "filled_b", only.alias("only_in"))


def feature_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Features only one table has: ``feature, only_in``."""
    sides = a.select("feature", F.lit("a").alias("side")).unionByName(b.select("feature", F.lit("b").alias("side")))
    grouped = sides.groupBy("feature").agg(F.min("side").alias("only_in"), F.max("side").alias("_last"))
    return grouped.where(F.col("only_in") == F.col("_last")).select("feature", "only_in")


def matched(a: DataFrame, b: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Both tables side by side by feature, with ``only_in`` set where one lacks it."""
    left = a.select("feature", *[quoted(m).alias(f"{m}_a") for m in metrics], F.lit(True).alias("_in_a"))
    right = b.select("feature", *[quoted(m).alias(f"{m}_b") for m in metrics], F.lit(True).alias("_in_b"))
    only = F.when(F.col("_in_b").isNull(), F.lit("a")).when(F.col("_in_a").isNull(), F.lit("b"))
    return left.join(right, "feature", "full_outer").select(
        "feature", *[quoted(f"{m}_{side}") for m in metrics for side in "ab"], only.alias("only_in")
    )


def error_metrics(a: DataFrame, b: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean absolute, mean squared and largest difference: ``metric, mae, mse, max_diff``.

    Metrics that a table lacks are left out; features that one table lacks do not count.
    """
    shared = [m for m in metrics if m in a.columns and m in b.columns]
    if not shared:
        return a.sparkSession.createDataFrame([], "metric string, mae double, mse double, max_diff double")
    both = matched(a, b, shared)
    parts = []
    for m in shared:
        gap = F.abs(F.col(f"{m}_a") - F.col(f"{m}_b"))
        parts += [F.avg(gap).alias(f"{m}_mae"), F.avg(gap * gap).alias(f"{m}_mse"), F.max(gap).alias(f"{m}_max")]
    lines = [
        F.struct(F.lit(m).alias("metric"), F.col(f"{m}_mae").alias("mae"), F.col(f"{m}_mse").alias("mse"), F.col(f"{m}_max").alias("max_diff"))
        for m in shared
    ]
    return both.agg(*parts).select(F.inline(F.array(*lines)))


def rank_differences(a: DataFrame, b: DataFrame, score_a: str, score_b: str, k: int = TOP_K) -> DataFrame:
    """Places among the first ``k`` where the two rankings name different features.

    ``rank, feature_a, feature_b``; a place that only one ranking has is not compared.
    """
    first = head_ranks(a, score_a, k).select("rank", F.col("feature").alias("feature_a"))
    second = head_ranks(b, score_b, k).select("rank", F.col("feature").alias("feature_b"))
    return first.join(second, "rank").where(F.col("feature_a") != F.col("feature_b"))


def verdict(a: DataFrame, b: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """One line: ``verdict`` is ``identical``, ``equal within tolerance`` or ``different``.

    Tables are identical if all columns are the same in the same order and all values are
    equal; all other shared columns must be equal too where the metrics are only close. A
    missing metric column or an unmatched feature makes the tables different. A value
    missing on both sides is identical, but not close to anything.
    """
    if any(m not in df.columns for df in (a, b) for m in metrics):
        return a.sparkSession.range(1).select(F.lit("different").alias("verdict"))
    others = [c for c in a.columns if c in b.columns and c not in metrics and c != "feature"]
    both = matched(a, b, [*metrics, *others])
    unmatched = F.col("only_in").isNotNull()
    exact, close = ~unmatched, ~unmatched
    for m in metrics:
        exact = exact & F.col(f"{m}_a").eqNullSafe(F.col(f"{m}_b"))
        close = close & is_close(F.col(f"{m}_a"), F.col(f"{m}_b"))
    for c in others:
        same = quoted(f"{c}_a").eqNullSafe(quoted(f"{c}_b"))
        exact, close = exact & same, close & same
    judged = both.agg(
        F.coalesce(F.bool_and(exact), F.lit(True)).alias("exact"),
        F.coalesce(F.bool_and(close), F.lit(True)).alias("close"),
    )
    same_names = a.columns == b.columns
    return judged.select(
        F.when(F.col("exact") & F.lit(same_names), F.lit("identical"))
        .when(F.col("close"), F.lit("equal within tolerance"))
        .otherwise(F.lit("different"))
        .alias("verdict")
    )
