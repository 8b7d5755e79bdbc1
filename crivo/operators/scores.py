"""Chi-square scores, contingency tests, Cramer's V and residuals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crivo.functions import stats
from crivo.operators.contingency import feature_name, with_expected
from crivo.operators.rank import top_k, top_per_group


def class_sum_scores(sums: DataFrame) -> DataFrame:
    """Chi-square of class sums, ``sum (O - E)^2 / E``, with its p-value.

    A feature whose sum is zero has no score. ``feature, chi2_score, p_value``.
    """
    gap = F.col("o") - F.col("expected")
    scored = with_expected(sums).groupBy("feature").agg(
        F.sum(F.try_divide(gap * gap, F.col("expected"))).alias("chi2_score"),
        F.count(F.lit(1)).alias("_classes"),
        F.count_if(F.col("expected") == 0).alias("_undefined"),
    )
    score = F.when(F.col("_undefined") == 0, F.col("chi2_score"))
    return scored.select(
        "feature", score.alias("chi2_score"), (F.col("_classes") - 1).alias("_dof")
    ).select("feature", "chi2_score", stats.chi2_sf("chi2_score", "_dof").alias("p_value"))


def full_scores(sums: DataFrame, keep_value: bool = False) -> DataFrame:
    """Chi-square over presence and absence of a feature in [0, 1], simple V and p-value.

    ``feature, chi2_score, cramers_v, p_value``. Sums of one-hot features are kept apart by
    column and ``value`` and named last, so features of one name are scored each;
    ``keep_value`` gives ``feature`` and ``value`` as they are.
    """
    keys = ["feature", *(["value"] if "value" in sums.columns else [])]
    guard = F.lit(stats.EPSILON)
    present = F.col("o") - F.col("expected")
    absent = (F.col("n_class") - F.col("o")) - (F.col("n_class") - F.col("expected"))
    term = (
        present * present / (F.col("expected") + guard)
        + F.try_divide(absent * absent, F.col("n_class") - F.col("expected") + guard)
    )
    scored = with_expected(sums).groupBy(*keys).agg(
        F.sum(term).alias("chi2_score"),
        F.first("n").alias("_n"),
        (F.count(F.lit(1)) - 1).alias("_dof"),
    )
    named = keys if keep_value or len(keys) == 1 else [feature_name(F.col("feature"), F.col("value")).alias("feature")]
    return scored.select(
        *named, "chi2_score",
        stats.simple_v(F.col("chi2_score"), F.col("_n")).alias("cramers_v"),
        stats.chi2_sf("chi2_score", "_dof").alias("p_value"),
    )


def total_test(scores: DataFrame, n_classes: int) -> DataFrame:
    """All features at once: ``n_features, chi2_score, dof, p_value``."""
    total = scores.agg(
        F.count(F.lit(1)).alias("n_features"), F.sum("chi2_score").alias("chi2_score")
    ).withColumn("dof", (F.col("n_features") - 1) * F.lit(n_classes - 1))
    return total.withColumn("p_value", stats.chi2_sf("chi2_score", "dof"))


def contingency_tests(table: DataFrame, yates: bool = True) -> DataFrame:
    """Independence test per feature: ``feature, n, n_rows, n_cols, chi2, dof, p_value``.

    With one degree of freedom and ``yates``, each gap is drawn in by up to one half.
    """
    gap = F.abs(F.col("o") - F.col("expected"))
    drawn = gap - F.least(F.lit(0.5), gap)
    summed = table.groupBy("feature").agg(
        F.first("n").alias("n"),
        F.first("n_classes").alias("n_cols"),
        F.count(F.lit(1)).alias("_cells"),
        F.sum(gap * gap / F.col("expected")).alias("_plain"),
        F.sum(drawn * drawn / F.col("expected")).alias("_drawn"),
    )
    sized = summed.withColumn("n_rows", (F.col("_cells") / F.col("n_cols")).cast("long"))
    sized = sized.withColumn("dof", (F.col("n_rows") - 1) * (F.col("n_cols") - 1))
    corrected = (F.col("dof") == 1) & F.lit(yates)
    chi2 = (
        F.when(F.col("dof") == 0, F.lit(0.0))
        .when(corrected, F.col("_drawn"))
        .otherwise(F.col("_plain"))
    )
    tested = sized.select("feature", "n", "n_rows", "n_cols", chi2.alias("chi2"), "dof")
    return tested.withColumn("p_value", stats.chi2_sf("chi2", "dof"))


def cramers_v(tests: DataFrame) -> DataFrame:
    """Bias-corrected Cramer's V from `contingency_tests`: ``feature, cramers_v``."""
    v = stats.corrected_v(F.col("chi2"), F.col("n"), F.col("n_rows"), F.col("n_cols"))
    return tests.select("feature", v.alias("cramers_v"))


def adjusted_residuals(table: DataFrame) -> DataFrame:
    """Adjusted residual of every cell: ``feature, value, class, z, abs_z``."""
    z = stats.adjusted_residual(
        F.col("o"), F.col("expected"), F.col("row_total"), F.col("col_total"), F.col("n")
    )
    return table.select("feature", "value", "class", z.alias("z"), F.abs(z).alias("abs_z"))


def significant(residuals: DataFrame, threshold: float = stats.SIGNIFICANT_Z) -> DataFrame:
    """Cells whose residual lies beyond the threshold."""
    return residuals.where(F.col("abs_z") > threshold)


def strongest_residuals(
    table: DataFrame, n_features: int = 5, k: int = 5, threshold: float = stats.SIGNIFICANT_Z
) -> DataFrame:
    """The ``k`` strongest significant residuals of the features with the highest V.

    ``feature, value, class, z, abs_z, rank, direction``.
    """
    chosen = top_k(cramers_v(contingency_tests(table)), "cramers_v", n_features).select("feature")
    residuals = significant(adjusted_residuals(table.join(F.broadcast(chosen), "feature", "left_semi")), threshold)
    # Both classes of a binary target have the same strength up to rounding noise.
    order = [F.round("abs_z", 9).desc(), F.col("value").asc(), F.col("class").asc()]
    return top_per_group(residuals, ["feature"], order, k).withColumn("direction", stats.direction(F.col("z")))


def residual_preview(table: DataFrame, feature: str, full_up_to: int = 20, head: int = 10) -> DataFrame:
    """Residuals of one feature for display: all rows, or the first ``head`` of a long table.

    One line per value with the residuals of its classes as a map (one entry per class).
    """
    residuals = adjusted_residuals(table.where(F.col("feature") == feature))
    lines = residuals.groupBy("value").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("class", "z")))).alias("z_by_class")
    )
    first = lines.orderBy("value").limit(full_up_to + 1)
    numbered = first.selectExpr(
        "*",
        "row_number() over (order by value) as line",
        "count(*) over () as lines",
    )
    shown = (F.col("lines") <= full_up_to) | (F.col("line") <= head)
    return numbered.where(shown).select("line", "value", "z_by_class")


def select_k_best(scores: DataFrame, k: int, n_features: int) -> DataFrame:
    """The ``min(k, n_features)`` best features of a score table, best first."""
    return top_k(scores, "chi2_score", min(k, n_features))


def without_features(scores: DataFrame, names: Sequence[str]) -> DataFrame:
    """Leave out features by name."""
    return scores.where(~F.col("feature").isin(*names))

