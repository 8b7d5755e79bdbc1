"""Writing tables, results and label dictionaries."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from crivo.operators.align import row_audit
from crivo.operators.contingency import quoted
from crivo.operators.encode import Labels
from crivo.shared import materialize, spread_writes
from crivo.sources.files import SOURCE


def write_partitions(df: DataFrame, path: str, source: str = SOURCE, rows_per_file: int = 5_000_000, together: bool = False) -> None:
    """Parquet parts in one folder per source file.

    Rows are brought together by source, unless the caller has done so (``together``); adaptive
    execution splits a large source over several tasks and files. An earlier output is replaced.
    """
    spread = df if together else df.hint("rebalance", source)
    with spread_writes(df.sparkSession):
        spread.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(source).parquet(path)


def write_delimited_partitions(df: DataFrame, path: str, source: str = SOURCE, sep: str = ",") -> None:
    """Delimited parts in one folder per source file, each with a header."""
    with spread_writes(df.sparkSession):
        df.hint("rebalance", source).write.mode("overwrite").partitionBy(source).csv(path, sep=sep, header=True, encoding="UTF-8")


# Sources that one write can count; the sketch that counts them is exact for so many.
MOST_SOURCES = 1_000


def write_consolidated(df: DataFrame, path: str, source: str = SOURCE, tests: Mapping[str, Column] | None = None) -> DataFrame:
    """All rows as one Parquet table; returns the rows per source and in total.

    The rows are counted while they are written, so nothing is read again. ``tests`` adds a
    column per name: the rows of each source that meet a condition (malformed, incomplete). With
    more than `MOST_SOURCES` sources the written table is counted instead.
    """
    conditions = {"n_rows": F.lit(True), **(tests or {})}
    name = F.to_json(F.struct(quoted(source).cast("string").alias("s")))
    seen = Observation()
    # Distinct counts that stay below the sketch's size are exact.
    counts = [F.call_function("approx_top_k", F.when(test, name), F.lit(MOST_SOURCES + 1), F.lit(8 * MOST_SOURCES)).alias(c) for c, test in conditions.items()]
    columns = len([c for c in df.columns if c != source])
    df.observe(seen, *counts).write.mode("overwrite").parquet(path)
    found = {c: {json.loads(r["item"]).get("s"): r["count"] for r in seen.get[c] or [] if r["item"] is not None} for c in conditions}
    spark = df.sparkSession
    if len(found["n_rows"]) > MOST_SOURCES:
        written = spark.read.schema(df.schema).parquet(path)
        if not tests:
            return row_audit(written, source)
        keys = written.select(quoted(source).cast("string").alias("_source"), *[F.when(t, 1).alias(f"_{c}") for c, t in conditions.items()])
        sums = keys.rollup("_source").agg(*[F.count(f"_{c}").alias(c) for c in conditions], F.grouping("_source").alias("_total"))
        label = F.when(F.col("_total") == 1, F.lit("(total)")).otherwise(F.col("_source")).alias(source)
        return sums.select(label, "n_rows", F.lit(columns).alias("n_columns"), *(tests or {}))
    lines = [(s, found["n_rows"][s], columns, *[found[c].get(s, 0) for c in tests or {}]) for s in found["n_rows"]]
    total = ("(total)", sum(found["n_rows"].values()), columns, *[sum(found[c].values()) for c in tests or {}])
    schema = ", ".join([f"`{source}` string", "n_rows long", "n_columns int", *[f"`{c}` long" for c in tests or {}]])
    return spark.createDataFrame([*lines, total], schema)


def write_result(df: DataFrame, path: str, order: Sequence = (), single_file: bool = True) -> None:
    """A result table as CSV with a header.

    A score table has a row per feature and goes into one file, through one task, whatever
    its size; without ``single_file`` it is a folder of range-sorted files.
    """
    ordered = df.orderBy(*order) if order else df
    if single_file:
        # Only the writing goes through one task; the sort before it does not.
        ordered = materialize(df, "result").coalesce(1)
        ordered = ordered.sortWithinPartitions(*order) if order else ordered
    ordered.write.mode("overwrite").csv(path, header=True, encoding="UTF-8")


def label_mapping(labels: Labels, columns: Sequence[str]) -> DataFrame:
    """One JSON object per column, ``{value: code}`` in code order: ``column, mapping``.

    A column's dictionary is one row; `write_labels` can also write an entry per line.
    """
    chosen = labels.frame.where(F.col("column").isin(*columns))
    pairs = F.sort_array(F.collect_list(F.struct("code", "value")))
    entries = F.transform(pairs, lambda p: F.struct(p["value"], p["code"]))
    return chosen.groupBy("column").agg(F.to_json(F.map_from_entries(entries)).alias("mapping"))


def write_labels(labels: Labels, columns: Sequence[str], path: str, one_object: bool = True) -> None:
    """Export the dictionary as JSON: one object ``{column: {value: code}}``, an entry per line.

    The entries are sorted and streamed into one file, so no row and no task holds a
    dictionary, whatever its size. Without ``one_object`` it is JSON lines, one entry each, in a
    folder per column, written side by side. The caller chooses; size does not.
    """
    if labels.by:
        raise ValueError("one object needs one dictionary for all groups")
    present = sorted(c for c in columns if c in labels.sizes)
    chosen = labels.frame.where(F.col("column").isin(*present))
    if not one_object:
        chosen.write.mode("overwrite").partitionBy("column").json(path)
        return
    if not present:
        labels.frame.sparkSession.range(1).select(F.lit("{}").alias("value")).coalesce(1).write.mode("overwrite").text(path)
        return
    place = F.array_position(F.array(*[F.lit(c) for c in present]), F.col("column"))
    size = F.element_at(F.create_map(*[F.lit(x) for c in present for x in (c, labels.sizes[c])]), F.col("column"))
    head = F.concat(F.when(place == 1, "{").otherwise(""), _json_text(F.col("column")), F.lit(":{"))
    tail = F.when(F.col("code") < size - 1, ",").when(place < len(present), "},").otherwise("}}")
    line = F.concat(F.when(F.col("code") == 0, head).otherwise(""), _json_text(F.col("value")), F.lit(":"), F.col("code"), tail)
    # The lines are sorted in ranges first; the one task that writes merges what it can spill.
    sorted_lines = materialize(chosen.select(place.alias("place"), "code", line.alias("value")).repartitionByRange("place", "code"), "entries")
    sorted_lines.coalesce(1).sortWithinPartitions("place", "code").select("value").write.mode("overwrite").text(path)


def _json_text(c):
    """A JSON string literal of a text column."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("k"))), r"^\{\"k\":(.*)\}$", 1)
