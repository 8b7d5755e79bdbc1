"""Rankings and top-k selection. Ties break by feature name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed value: how many features the reference keeps.
TOP_K = 30


def best_first(score: str, tie: str = "feature") -> list[Column]:
    """Descending order, missing scores last."""
    return [F.col(score).desc_nulls_last(), F.col(tie).asc()]


def ranked(scores: DataFrame, score: str, tie: str = "feature") -> DataFrame:
    """All rows, best first."""
    return scores.orderBy(*best_first(score, tie))


def top_k(scores: DataFrame, score: str, k: int = TOP_K, tie: str = "feature") -> DataFrame:
    """The ``k`` best rows; rows without a score never qualify."""
    return scores.where(F.col(score).isNotNull()).orderBy(*best_first(score, tie)).limit(k)


def head_ranks(scores: DataFrame, score: str, k: int = TOP_K, tie: str = "feature") -> DataFrame:
    """The ``k`` first rows numbered from 1, rows without a score last.

    The single-partition window sees only the ``k`` rows that the top-k step lets through.
    """
    head = scores.orderBy(*best_first(score, tie)).limit(k)
    return head.withColumn("rank", F.row_number().over(Window.orderBy(*best_first(score, tie))))


def top_names(scores: DataFrame, score: str, k: int = TOP_K, tie: str = "feature") -> list[str]:
    """Names of the ``k`` best rows, on the driver (at most ``k`` strings)."""
    return [row[0] for row in top_k(scores, score, k, tie).select(tie).collect()]


def project_top(df: DataFrame, scores: DataFrame, score: str, target: str, k: int = TOP_K) -> DataFrame:
    """The ``k`` best feature columns and the target."""
    return df.select(*["`" + c + "`" for c in [*top_names(scores, score, k), target]])


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The ``k`` first rows of every group, numbered in ``rank``.

    A group limit runs before the shuffle, so a task ships at most ``k`` rows per group.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
