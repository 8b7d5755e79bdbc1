"""Class sums and contingency counts, kept in long form.

Two frames carry everything the scores need:

* class sums: ``feature, class, o, n_class, total, n`` for numeric features;
* a contingency table: ``feature, value, class, o, row_total, col_total, n,
  n_classes, expected`` for categorical ones.

Both come from one pass over the data in which only partial aggregates are shuffled.
No window or join is ever keyed by the feature alone on a frame that grows with the
number of categories.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from crivo.shared import BroadcastBudget, materialize, measured

# Sums per wide aggregation; beyond it the columns of a row become lines inside the task.
SUM_WIDTH = 200


def quoted(name: str) -> Column:
    """A column whose name may hold dots, blanks or slashes."""
    return F.col("`" + name.replace("`", "``") + "`")


def features_of(df: DataFrame, target: str, exclude: Sequence[str] = ()) -> list[str]:
    """All columns but the target and the excluded ones."""
    return [c for c in df.columns if c != target and c not in exclude]


def _number(df: DataFrame, name: str) -> Column:
    """The column as double, with not-a-number read as missing."""
    c = quoted(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c.cast("double"))
    return c.cast("double")


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """Rows per class with the class probability: ``class, n_class, n, prob``."""
    counts = (
        df.where(quoted(target).isNotNull())
        .groupBy(quoted(target).alias("class"))
        .agg(F.count(F.lit(1)).alias("n_class"))
    )
    n = F.sum("n_class").over(Window.partitionBy())
    return counts.select("class", "n_class", n.alias("n"), (F.col("n_class") / n).alias("prob"))


def class_sums(df: DataFrame, features: Sequence[str], target: str, width: int = SUM_WIDTH) -> DataFrame:
    """Sum of every numeric feature per class, with class and grand totals, from one scan.

    Up to ``width`` features each row updates one hash entry with all sums. Wider tables
    turn a row into numbered lines that are summed inside the task before the shuffle.
    Either way the result has ``features x classes`` rows.
    """
    kept = df.where(quoted(target).isNotNull())
    if len(features) <= width:
        totals = [F.coalesce(F.sum(_number(df, c)), F.lit(0.0)).alias(c) for c in features]
        wide = kept.groupBy(quoted(target).alias("_class")).agg(F.count(F.lit(1)).alias("_n"), *totals)
        long = wide.unpivot(["_class", "_n"], [quoted(c) for c in features], "feature", "o")
        sums = long.select("feature", F.col("_class").alias("class"), "o", F.col("_n").alias("n_class"))
    else:
        values = F.array(*[_number(df, c) for c in features])
        lines = kept.select(quoted(target).alias("class"), F.posexplode(values).alias("_i", "_x"))
        summed = lines.groupBy("class", "_i").agg(F.coalesce(F.sum("_x"), F.lit(0.0)).alias("o"), F.count(F.lit(1)).alias("n_class"))
        names = F.array(*[F.lit(c) for c in features])
        sums = summed.select(F.get(names, F.col("_i")).alias("feature"), "class", "o", "n_class")
    return with_totals(sums, ["feature"])


def sparse_class_sums(rows: DataFrame, target: str) -> DataFrame:
    """Sums by class of sparse rows (``indices``, ``values``), as `class_sums` with an index as ``feature``.

    Entries are summed inside the task before the shuffle. An index that no row has is left out.
    """
    kept = rows.where(quoted(target).isNotNull())
    entries = kept.select(quoted(target).alias("class"), F.inline(F.arrays_zip("indices", "values")))
    sums = entries.groupBy("indices", "class").agg(F.sum("values").alias("o"))
    # A row per class and index, also where the sum is zero: classes are few, indices need not be.
    counts = materialize(class_counts(rows, target).select("class", "n_class", "n"), "classes")
    classes = counts.agg(F.collect_list(F.struct("class", "n_class", "n"))).scalar()
    by_class = sums.groupBy("indices").agg(F.map_from_entries(F.collect_list(F.struct("class", "o"))).alias("by_class"), F.sum("o").alias("total"))
    long = by_class.select("indices", "by_class", "total", F.inline(classes))
    return long.select(
        F.col("indices").alias("feature"), "class", F.coalesce(F.try_element_at("by_class", F.col("class")), F.lit(0.0)).alias("o"), "n_class", "total", "n")


def with_totals(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the feature total and the number of rows; a group holds one row per class."""
    by_feature = Window.partitionBy(*keys)
    return sums.select(
        *keys, "class", "o", "n_class",
        F.sum("o").over(by_feature).alias("total"),
        F.sum("n_class").over(by_feature).alias("n"),
    )


def with_expected(sums: DataFrame) -> DataFrame:
    """Add the expected sum under independence, ``n_class / n * total``."""
    return sums.withColumn("expected", F.col("n_class") / F.col("n") * F.col("total"))


def cell_counts(
    df: DataFrame, features: Sequence[str], target: str, keep_missing: bool = False
) -> DataFrame:
    """Rows per feature, value and class: ``feature, value, class, o``.

    One scan for all features; combined map-side before the only shuffle, under a
    feature number instead of its name. Missing values are left out as in a
    cross-tabulation, unless ``keep_missing``.
    """
    entries = [
        F.struct(F.lit(i).alias("_feature"), quoted(c).cast("string").alias("value")) for i, c in enumerate(features)
    ]
    long = df.where(quoted(target).isNotNull()).select(quoted(target).alias("class"), F.inline(F.array(*entries)))
    if not keep_missing:
        long = long.where(F.col("value").isNotNull())
    counts = long.groupBy("_feature", "value", "class").agg(F.count(F.lit(1)).alias("o"))
    names = F.array(*[F.lit(c) for c in features])
    return counts.select(F.get(names, F.col("_feature")).alias("feature"), "value", "class", "o")


def column_margins(cells: DataFrame) -> DataFrame:
    """Per feature and class: ``feature, class, col_total, n, n_classes``.

    A window group holds the classes of one feature.
    """
    totals = cells.groupBy("feature", "class").agg(F.sum("o").alias("col_total"))
    by_feature = Window.partitionBy("feature")
    return totals.select(
        "feature", "class", "col_total",
        F.sum("col_total").over(by_feature).alias("n"),
        F.count(F.lit(1)).over(by_feature).alias("n_classes"),
    )


def row_margins(cells: DataFrame) -> DataFrame:
    """Per feature and value: ``feature, value, row_total`` and the counts by class as a map."""
    return cells.groupBy("feature", "value").agg(
        F.sum("o").alias("row_total"),
        F.map_from_entries(F.collect_list(F.struct("class", "o"))).alias("by_class"),
    )


def contingency_table(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    keep_missing: bool = False,
    n_classes: int | None = None,
) -> DataFrame:
    """The full table, empty cells included, with margins and expected counts.

    The cell counts are written down first: margins and later filters read them several
    times, and none of that may reach the data again.
    """
    cells = materialize(cell_counts(df, features, target, keep_missing), "cells")
    return table_of(cells, len(features), n_classes)


def table_of(cells: DataFrame, n_features: int, n_classes: int | None = None) -> DataFrame:
    """`contingency_table` from counts at hand, best written ones.

    The margins by class are joined to the categories by feature. They have at most
    ``features x n_classes`` rows; with ``n_classes`` unknown they are written and measured.
    Margins too large to be broadcast are joined by feature and salt, so that a feature with
    many categories is spread over tasks.
    """
    margins = column_margins(cells)
    if n_classes is None:
        margins = materialize(margins, "margins")
        size = measured(margins)
    else:
        # A name, a class and three numbers a row, with room for long names.
        size = n_features * n_classes * 256
    values = row_margins(cells)
    if BroadcastBudget().take(size):
        joined = values.join(F.broadcast(margins), "feature")
    else:
        # Every value goes to one salt, whatever task reads it.
        salts = 16
        salted = values.withColumn("_salt", F.pmod(F.xxhash64("value"), F.lit(salts)).cast("int"))
        copies = margins.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = salted.join(copies, ["feature", "_salt"]).drop("_salt")
    observed = F.coalesce(F.try_element_at("by_class", F.col("class")), F.lit(0).cast("long"))
    return joined.select(
        "feature", "value", "class", observed.alias("o"), "row_total", "col_total", "n", "n_classes",
        (F.col("row_total").cast("double") * F.col("col_total") / F.col("n")).alias("expected"),
    )


def one_hot_sums(table: DataFrame, drop_first: bool = True) -> DataFrame:
    """Class sums of the 0/1 columns that one-hot encoding would make, without making them.

    ``table`` must keep missing values: a row without the value still counts for its
    class. The sum of an indicator over a class is the cell count itself. The first
    category in code-point order is dropped. A feature is a column and its ``value``: two
    of them may have one name, ``a_b`` and ``c`` like ``a`` and ``b_c``.
    """
    present = table.where(F.col("value").isNotNull())
    if drop_first:
        # One line per encoded column.
        firsts = table.groupBy("feature").agg(F.min("value").alias("_first"))
        present = present.join(F.broadcast(firsts), "feature").where(F.col("value") != F.col("_first"))
    return present.select(
        "feature", "value", "class",
        F.col("o").cast("double").alias("o"), F.col("col_total").alias("n_class"),
        F.col("row_total").cast("double").alias("total"), "n",
    )


def feature_name(name: Column, value: Column) -> Column:
    """``<name>_<value>``, or the name alone where there is no value."""
    return F.when(value.isNull(), name).otherwise(F.concat_ws("_", name, value))


def cross_tab(df: DataFrame, feature: str, target: str, classes: Sequence | None = None) -> DataFrame:
    """One feature against the classes, one column per class, for display.

    Without ``classes`` all classes of the target have a column, in order.
    """
    if classes is None:
        classes = [r["class"] for r in class_counts(df, target).orderBy("class").collect()]
    counts = [
        F.count(F.when(quoted(target) == F.lit(c), F.lit(1))).alias(str(c)) for c in classes
    ]
    return (
        df.where(quoted(feature).isNotNull() & quoted(target).isNotNull())
        .groupBy(quoted(feature).cast("string").alias("value"))
        .agg(*counts)
    )
