"""Raw files processed source by source, again only where they have changed.

The output holds a folder per source and, beside them, a manifest: what each source's files were
when it was written. A run compares names, sizes and times of the files with it, reads the files
of changed sources alone, and replaces their folders in one commit; the manifest is written after
that. A run that fails leaves the folders as they were, and what it did not finish is done again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from crivo.operators.contingency import quoted
from crivo.plans import enrolments as en
from crivo.shared import spread_writes
from crivo.sources import files
from crivo.sources.files import SOURCE

# Folders that begin with an underscore are no data to Spark's readers.
MANIFEST, LABELS = "_manifest", "_labels"


def sources_of(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The sources behind paths, from a listing: ``source_file, mark, files``.

    The mark changes with the name, size or time of any file of the source.
    """
    listed = spark.read.format("binaryFile").load(paths).select(
        files.source_names(files.input_files(spark, paths)).alias(SOURCE), "path", "length", "modificationTime")
    entry = F.struct("path", "length", F.unix_micros("modificationTime").alias("time"))
    return listed.groupBy(SOURCE).agg(F.sort_array(F.collect_list(entry)).alias("entries")).select(
        SOURCE, F.sha2(F.to_json("entries"), 256).alias("mark"), F.transform("entries", lambda e: e["path"]).alias("files"))


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """The last entry of each source: ``source_file, mark, n_rows``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{MANIFEST}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], f"{SOURCE} string, mark string, n_rows long")
    entries = spark.read.schema(f"{SOURCE} string, mark string, n_rows long, run long").json(f"{out}/{MANIFEST}")
    last = Window.partitionBy(SOURCE).orderBy(F.col("run").desc())
    return entries.withColumn("_place", F.row_number().over(last)).where("_place = 1 AND mark IS NOT NULL").select(SOURCE, "mark", "n_rows")


def _noted(spark: SparkSession, out: str, entries: list[tuple[str, str | None, int]]) -> None:
    before = manifest_runs(spark, out)
    lines = spark.createDataFrame([(*e, before + 1) for e in entries], f"{SOURCE} string, mark string, n_rows long, run long")
    lines.coalesce(1).write.mode("append").json(f"{out}/{MANIFEST}")


def manifest_runs(spark: SparkSession, out: str) -> int:
    """How many runs have written to the manifest."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{MANIFEST}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return 0
    return spark.read.schema("run long").json(f"{out}/{MANIFEST}").agg(F.max("run")).first()[0] or 0


def process(spark: SparkSession, paths: str | Sequence[str], out: str, preset: en.Preset = en.LABELS, sep: str = ";", **options) -> DataFrame:
    """Encode the changed sources into ``out``: ``source_file, status, n_rows`` of all of them.

    Status is ``written``, ``kept`` or, for a source whose files are gone but whose folder is
    left, ``gone`` (see `clear`). Each source has codes of its own, so that one can change
    without the others; their dictionaries are beside the data, in ``_labels``.
    """
    known = {r[SOURCE]: r for r in manifest(spark, out).collect()}
    # One line per source; the names of the files are needed to read them.
    found = {r[SOURCE]: r for r in sources_of(spark, paths).collect()}
    changed = sorted(s for s, r in found.items() if s not in known or known[s]["mark"] != r["mark"])
    counts: dict[str, int] = {}
    if changed:
        chosen = [f for s in changed for f in found[s]["files"]]
        raw = files.read_files(spark, chosen, sep, among=[f for r in found.values() for f in r["files"]], **options)
        prepared = en.prepare(raw, replace(preset, by_file=True))
        seen = Observation()
        tallies = F.call_function("approx_top_k", quoted(SOURCE), F.lit(max(1, len(changed))), F.lit(max(100, 8 * len(changed))))
        _overwrite(prepared.table.observe(seen, tallies.alias("n")), out)
        if prepared.labels is not None:
            _overwrite(prepared.labels.frame, f"{out}/{LABELS}")
        counts = {r["item"]: r["count"] for r in seen.get["n"] or []}
        # A source that has no rows left has no folder in the write, so its old one goes.
        for s in changed:
            if s not in counts and s in known:
                _remove(spark, out, s)
        _noted(spark, out, [(s, found[s]["mark"], counts.get(s, 0)) for s in changed])
    lines = [(s, "written", counts.get(s, 0)) if s in changed else (s, "kept", known[s]["n_rows"]) for s in sorted(found)]
    lines += [(s, "gone", known[s]["n_rows"]) for s in sorted(known.keys() - found.keys())]
    return spark.createDataFrame(lines, f"{SOURCE} string, status string, n_rows long")


def clear(spark: SparkSession, out: str, sources: Sequence[str]) -> None:
    """Forget sources: their folders go, and the next run writes them again if their files are there."""
    # The manifest goes first, so that a failure between leaves a folder to be written over.
    _noted(spark, out, [(s, None, 0) for s in sources])
    for s in sources:
        _remove(spark, out, s)


def processed(spark: SparkSession, out: str) -> DataFrame:
    """All sources as one table; a column that a source lacks is missing in its rows."""
    schema = spark.read.option("mergeSchema", "true").parquet(out).schema
    # A folder's name is text, whatever it looks like.
    fields = [T.StructField(f.name, T.StringType() if f.name == SOURCE else f.dataType) for f in schema.fields]
    return spark.read.schema(T.StructType(fields)).parquet(out)


def _overwrite(df: DataFrame, path: str) -> None:
    """Replace the folders of the sources in ``df`` in one commit; others stay."""
    spread = df.hint("rebalance", SOURCE)
    with spread_writes(df.sparkSession):
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(SOURCE).parquet(path)


def _remove(spark: SparkSession, out: str, source: str) -> None:
    name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(source)
    for base in (out, f"{out}/{LABELS}"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{SOURCE}={name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
