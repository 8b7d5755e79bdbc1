"""Ordinal, label and one-hot encoding, and min-max scaling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crivo.functions.stats import EPSILON
from crivo.operators.clean import is_text, present, replaced, require_columns
from crivo.operators.contingency import quoted
from crivo.shared import BroadcastBudget, hot_keys, lookup, materialize

# The reference's income bands and codes.
INCOME_CODES = {
    "Nao declarada": 0,
    "0<RFP<=0,5": 1,
    "0,5<RFP<=1,0": 2,
    "1,0<RFP<=1,5": 3,
    "1,5<RFP<=2,5": 4,
    "2,5<RFP<=3,5": 5,
    "RFP>3,5": 6,
}
UNKNOWN = -1
# Text that stands for a missing value when it is a category of its own.
MISSING = "nan"

# Values of one column up to which a single window numbers them.
WINDOW_VALUES = 1_000_000


def ordinal(c: Column, codes: dict[str, int] = INCOME_CODES, unknown: int = UNKNOWN) -> Column:
    """Code of a text by a small fixed order; other text and missing give ``unknown``."""
    entries = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, c), F.lit(unknown))


def ordinal_encode(
    df: DataFrame, column: str, codes: dict[str, int] = INCOME_CODES, unknown: int = UNKNOWN
) -> DataFrame:
    """Replace a column by its ordinal code."""
    return replaced(df, {column: ordinal(quoted(column), codes, unknown)})


def category_text(c: Column, missing_as: str | None = None) -> Column:
    """The value as text; missing becomes ``missing_as`` when given."""
    spelled = c.cast("string")
    return spelled if missing_as is None else F.coalesce(spelled, F.lit(missing_as))


def categories(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), missing_as: str | None = None
) -> DataFrame:
    """Distinct text values of several columns from one pass: ``*by, column, value``."""
    keys = [quoted(c).alias(f"_by{i}") for i, c in enumerate(by)]
    texts = [category_text(quoted(c), missing_as).alias(c) for c in columns]
    long = df.select(*keys, *texts).unpivot(
        [F.col(f"_by{i}") for i in range(len(by))], [quoted(c) for c in columns], "column", "value"
    )
    return long.where(F.col("value").isNotNull()).distinct().select(
        *[F.col(f"_by{i}").alias(c) for i, c in enumerate(by)], "column", "value"
    )


def numbered(values: DataFrame, group: Sequence[str], biggest: int, window_values: int = WINDOW_VALUES) -> DataFrame:
    """Number the distinct ``value`` texts of every group from 0 in code-point order.

    Groups of up to ``window_values`` values go through one window. Larger ones are
    range-partitioned by value first: every range numbers its own values, and the sizes
    of the ranges before it give the offset, so no task ever holds a whole group.
    """
    by_value = Window.partitionBy(*group).orderBy("value")
    if biggest <= window_values:
        return values.select(*group, "value", (F.row_number().over(by_value) - 1).cast("int").alias("code"))
    # The range of a value must not change between reads, so it is written down.
    ranged = materialize(
        values.repartitionByRange(*group, "value").withColumn("_range", F.spark_partition_id()), "ranges"
    )
    sizes = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, "_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy(*group, "_range").orderBy("value")) - 1
    placed = ranged.withColumn("_place", within).join(offsets, [*group, "_range"])
    return placed.select(*group, "value", (F.col("_offset") + F.col("_place")).cast("int").alias("code"))


@dataclass(frozen=True)
class Labels:
    """A fitted label dictionary: ``*by, column, value, code``, its rows and bytes per column."""

    frame: DataFrame
    sizes: dict[str, int]
    by: tuple[str, ...] = ()
    missing_as: str | None = None
    bytes: dict[str, int] = field(default_factory=dict)


def fit_labels(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = (),
    missing_as: str | None = None,
    window_values: int = WINDOW_VALUES,
) -> Labels:
    """Fit label codes of all columns in one pass; the dictionary is written down and sized.

    With ``by`` (such as the source file) every group gets codes of its own.
    """
    require_columns(df, columns)
    values = materialize(categories(df, columns, by, missing_as), "labels")
    length = F.lit(48) + sum((F.coalesce(F.octet_length(quoted(c).cast("string")), F.lit(0)) for c in ["value", *by]), F.lit(0))
    counted = values.groupBy("column").agg(F.count(F.lit(1)), F.sum(length.cast("long"))).collect()
    sizes = {row[0]: row[1] for row in counted}
    codes = materialize(numbered(values, [*by, "column"], max(sizes.values(), default=0), window_values), "codes")
    return Labels(codes, sizes, tuple(by), missing_as, {row[0]: row[2] for row in counted})


def encode_labels(
    df: DataFrame, labels: Labels, columns: Sequence[str], unseen: int = UNKNOWN, most_bytes: int | None = None,
) -> DataFrame:
    """Replace columns by their codes; a value the fit did not see gives ``unseen``.

    Dictionaries of up to ``most_bytes`` (default `BROADCAST_BYTES`) together are broadcast. For the others one pass over
    ``df`` measures which values are heavy, and those are spread by their share.
    """
    budget = BroadcastBudget(most_bytes)
    sent = {c: budget.take(labels.bytes.get(c)) for c in columns}
    keyed = df.withColumns({f"_key{i}": category_text(quoted(c), labels.missing_as) for i, c in enumerate(columns)})
    hot = hot_keys(keyed, {c: [f"_key{i}", *labels.by] for i, c in enumerate(columns) if not sent[c]})
    joined = keyed
    for i, c in enumerate(columns):
        part = labels.frame.where(F.col("column") == c).select(
            *[quoted(b) for b in labels.by], F.col("value").alias(f"_key{i}"), F.col("code").alias(f"_code{i}")
        )
        keys = [f"_key{i}", *labels.by]
        joined = joined.join(F.broadcast(part), keys, "left") if sent[c] else lookup(joined, part, keys, None, hot=hot[c])
    codes = {c: F.coalesce(F.col(f"_code{i}"), F.lit(unseen)) for i, c in enumerate(columns)}
    return joined.select(*[codes[c].alias(c) if c in codes else quoted(c) for c in df.columns])


def encode_remaining_text(df: DataFrame, target: str) -> DataFrame:
    """Label-encode every feature column that is still text, missing as a category."""
    texts = [c for c in df.columns if c != target and is_text(df, c)]
    return encode_labels(df, fit_labels(df, texts, missing_as=MISSING), texts) if texts else df


def label_report(labels: Labels, columns: Sequence[str], first: int = 15) -> DataFrame:
    """The first codes of each column and how many follow: ``column, code, value, more``.

    A requested column without a dictionary gives one line without code.
    """
    spark = labels.frame.sparkSession
    wanted = spark.createDataFrame(
        [(c, labels.sizes.get(c), max(labels.sizes.get(c, 0) - first, 0)) for c in columns],
        "column string, _size long, more long",
    )
    shown = labels.frame.where(F.col("code") < first).select("column", "code", "value")
    return wanted.join(shown, "column", "left").select(
        "column", "code", "value", F.when(F.col("_size").isNotNull(), F.col("more")).alias("more")
    )


def category_lists(labels: Labels, columns: Sequence[str]) -> dict[str, list[str]]:
    """Values per column in code order, on the driver, for building a column from each.

    A wide table has as many columns; `one_hot_long` and the scores by counts do without.
    """
    rows = labels.frame.where(F.col("column").isin(*columns)).collect()
    return {
        c: [r["value"] for r in sorted((r for r in rows if r["column"] == c), key=lambda r: r["code"])]
        for c in columns
    }


def one_hot_wide(df: DataFrame, values: dict[str, list[str]], drop_first: bool = True) -> DataFrame:
    """Replace columns by 0/1 columns ``<column>_<value>``; a missing value is 0 in all."""
    kept = {c: v[1:] if drop_first else v for c, v in values.items()}
    names = [c for c in df.columns if c not in kept] + [f"{c}_{v}" for c, vs in kept.items() for v in vs]
    folded = [n.lower() for n in names]
    if len(set(folded)) < len(folded):
        doubled = sorted({n for n in names if folded.count(n.lower()) > 1})
        raise ValueError(f"one-hot names differ only by case or collide: {doubled}")
    flags = [
        F.when(quoted(c).cast("string") == v, 1).otherwise(0).alias(f"{c}_{v}")
        for c, vs in kept.items() for v in vs
    ]
    return df.select(*[quoted(c) for c in df.columns if c not in kept], *flags)


def one_hot_long(df: DataFrame, ids: Sequence[str], labels: Labels, columns: Sequence[str], drop_first: bool = True) -> DataFrame:
    """The ones of a one-hot table, one per line: ``*ids, feature, value`` with value 1."""
    if labels.by:
        raise ValueError("one-hot columns need one dictionary for all groups")
    texts = [category_text(quoted(c), labels.missing_as).alias(c) for c in columns]
    long = df.select(*[quoted(c) for c in ids], *texts).unpivot(
        [quoted(c) for c in ids], [quoted(c) for c in columns], "column", "text"
    ).where(F.col("text").isNotNull())
    if drop_first:
        # One line per column.
        firsts = labels.frame.where(F.col("code") == 0).select("column", F.col("value").alias("text"))
        long = long.join(F.broadcast(firsts), ["column", "text"], "left_anti")
    return long.select(*[quoted(c) for c in ids], F.concat_ws("_", "column", "text").alias("feature"), F.lit(1).alias("value"))


@dataclass(frozen=True)
class SparseLayout:
    """Where the features of sparse rows stand: numbers first, then the categories of each column."""

    numbers: tuple[str, ...]
    offsets: dict[str, int]
    width: int
    first: int

    @classmethod
    def of(cls, labels: Labels, columns: Sequence[str], numbers: Sequence[str] = (), drop_first: bool = True) -> SparseLayout:
        if labels.by:
            raise ValueError("one-hot columns need one dictionary for all groups")
        offsets, at, first = {}, len(numbers), int(drop_first)
        for c in columns:
            offsets[c] = at
            at += max(0, labels.sizes.get(c, 0) - first)
        return cls(tuple(numbers), offsets, at, first)

    def names(self, labels: Labels) -> DataFrame:
        """``index, feature, value`` from the dictionary table; a number has no value."""
        spark = labels.frame.sparkSession
        starts = spark.createDataFrame([(c, at - self.first) for c, at in self.offsets.items()], "column string, _start long")
        coded = labels.frame.where(F.col("code") >= self.first).join(F.broadcast(starts), "column")
        plain = spark.createDataFrame([(j, c) for j, c in enumerate(self.numbers)], "index long, feature string")
        return coded.select((F.col("_start") + F.col("code")).alias("index"), F.col("column").alias("feature"), "value").unionByName(
            plain.withColumn("value", F.lit(None).cast("string")))


def one_hot_sparse(df: DataFrame, labels: Labels, layout: SparseLayout) -> DataFrame:
    """Replace a layout's columns by ``indices`` and ``values``, what a one-hot table has that is not zero.

    Indices ascend. Rows have one entry per column at most, however many categories there are,
    and no list of them is needed: a place is the column's offset and the value's code. A
    missing or unknown category has no entry, nor has a number that is missing or zero.
    """
    coded = encode_labels(df, labels, list(layout.offsets))
    numbers = [F.struct(F.lit(j).cast("long").alias("i"), quoted(c).cast("double").alias("v")) for j, c in enumerate(layout.numbers)]
    places = [F.when(quoted(c) >= layout.first, quoted(c) + F.lit(at - layout.first).cast("long")) for c, at in layout.offsets.items()]
    entries = F.filter(F.array(*numbers, *[F.struct(p.alias("i"), F.lit(1.0).alias("v")) for p in places]), lambda e: e["i"].isNotNull() & (e["v"] != 0))
    kept = [quoted(c) for c in df.columns if c not in layout.offsets and c not in layout.numbers]
    return coded.select(*kept, entries.alias("_entries")).select(
        *kept, F.transform("_entries", lambda e: e["i"]).alias("indices"), F.transform("_entries", lambda e: e["v"]).alias("values"))


def min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest and largest value per column: ``feature, min, max``, from one pass."""
    names = present(df, columns)
    wide = df.agg(
        *[f(quoted(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max))]
    )
    lines = [F.struct(F.lit(c).alias("feature"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"))
             for i, c in enumerate(names)]
    return wide.select(F.inline(F.array(*lines)))


def min_max_by(df: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """Smallest and largest value per group and column: ``<by>, feature, min, max``.

    A group without values of a column has no bounds there.
    """
    names = present(df, columns)
    wide = df.groupBy(quoted(by).alias(by)).agg(
        *[f(quoted(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max))]
    )
    lines = [F.struct(F.lit(c).alias("feature"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"))
             for i, c in enumerate(names)]
    return wide.select(quoted(by), F.inline(F.array(*lines)))


def merged_bounds(bounds: DataFrame) -> DataFrame:
    """Global bounds from bounds by group."""
    return bounds.groupBy("feature").agg(F.min("min").alias("min"), F.max("max").alias("max"))


def scale_by(df: DataFrame, bounds: DataFrame, columns: Sequence[str], epsilon: float = EPSILON) -> DataFrame:
    """Scale columns to ``(x - min) / (max - min + epsilon)`` by a table of bounds.

    The bounds enter as a scalar subquery, evaluated once for all columns. A constant
    column becomes 0 and absent columns are skipped.
    """
    names = present(df, columns)
    if not names:
        return df
    picked = bounds.agg(*[
        f(F.when(F.col("feature") == c, F.col(k))).alias(f"{k}{i}")
        for i, c in enumerate(names) for k, f in (("min", F.min), ("max", F.max))
    ]).select(F.struct("*").alias("bounds")).scalar()
    return replaced(df, {
        c: (quoted(c).cast("double") - picked[f"min{i}"]) / (picked[f"max{i}"] - picked[f"min{i}"] + F.lit(epsilon))
        for i, c in enumerate(names)
    })


def scale_min_max(df: DataFrame, columns: Sequence[str], epsilon: float = EPSILON) -> DataFrame:
    """Scale columns by their own global bounds, found in the same query.

    For repeated use (training) write `min_max` down once and use `scale_by`.
    """
    names = present(df, columns)
    return scale_by(df, min_max(df, names), names, epsilon) if names else df
