"""Shared storage for small intermediate tables, and size-checked broadcasts."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import lru_cache
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# All broadcasts of one plan together take at most so many bytes, by measure or proof.
BROADCAST_BYTES = 64 << 20


@lru_cache(maxsize=1)
def _test_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="crivo-")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where it is unset, as in tests, a session of one process takes a temporary folder; on a
    cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if re.match(r"local($|\[)", spark.sparkContext.master):
        return _test_dir()
    raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/crivo/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives the optimizer the real size.
    """
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Encoded rows shrink to a fraction in a shuffle, so a task of a write by source takes so many
# shuffled bytes; it writes to so many files at once before it must sort its rows.
PIECE_BYTES, OPEN_FILES = 8 << 20, 16


@contextmanager
def spread_writes(spark: SparkSession) -> Iterator[None]:
    """Settings for a write of rows brought together by source: more tasks for a large one, and no sort in them.

    A session that has set smaller pieces or more open files keeps them.
    """
    pieces, files = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.maxConcurrentOutputFileWriters"
    before = {k: spark.conf.get(k) for k in (pieces, files)}
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before[pieces])
    spark.conf.set(pieces, str(min(size, PIECE_BYTES)))
    spark.conf.set(files, str(max(int(before[files]), OPEN_FILES)))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class BroadcastBudget:
    """Bytes that the broadcasts of one plan may take together."""

    def __init__(self, most: int | None = None) -> None:
        self.left = BROADCAST_BYTES if most is None else most

    def take(self, size: int | None) -> bool:
        """May a table of at most ``size`` bytes be broadcast? If so, it counts."""
        fits = size is not None and size <= self.left
        self.left -= size if fits else 0
        return fits


# The sketch of heavy keys keeps this many; it misses none that holds 1/2000 of the rows.
TRACKED = 10_000
MOST_HOT = 1_000


def key_hash(columns: Sequence[str]) -> Column:
    """64 bits that stand for a key; nulls are a key too."""
    return F.xxhash64(*[F.col("`" + c.replace("`", "``") + "`") for c in columns])


def hot_keys(df: DataFrame, keys: Mapping[str, Sequence[str]], tasks: int | None = None) -> dict[str, dict[int, int]]:
    """How many tasks the rows of each heavy key need, by name of a list of key columns.

    A key is heavy if it holds over one task's share of the rows; it gets as many salts as
    shares. One pass over ``df`` for all lists, with a mergeable sketch that each task sends.
    """
    if not keys:
        return {}
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = min(tasks, MOST_HOT)
    hashed = df.select(*[key_hash(columns).alias(f"k{i}") for i, columns in enumerate(keys.values())])
    tops = [F.expr(f"approx_top_k(k{i}, {most}, {TRACKED})").alias(f"t{i}") for i in range(len(keys))]
    found = hashed.agg(F.count(F.lit(1)).alias("n"), *tops).first()
    return {
        name: {top["item"]: math.ceil(top["count"] * tasks / found["n"]) for top in found[f"t{i}"] or [] if top["count"] * tasks > found["n"]}
        for i, name in enumerate(keys)
    }


def lookup(
    df: DataFrame,
    table: DataFrame,
    keys: list[str],
    size: int | None,
    salts: int = 16,
    budget: BroadcastBudget | None = None,
    hot: Mapping[int, int] | None = None,
) -> DataFrame:
    """Left join ``df`` to ``table`` without letting a hot key pile up.

    A table known to take at most ``size`` bytes is broadcast if the budget allows it.
    Otherwise both sides are shuffled on the keys and a salt. With ``hot``, what `hot_keys`
    measured for these keys, a heavy key's rows spread over as many salts as their share needs,
    and only its lines of the table are repeated. Without a measure each input partition of
    ``df`` sends a key to one of ``salts``, and the whole table is repeated once per salt.
    """
    if (budget or BroadcastBudget()).take(size):
        return df.join(F.broadcast(table), keys, "left")
    if hot is None:
        salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return salted.join(copies, [*keys, "_salt"], "left").drop("_salt")
    if not hot:
        return df.join(table, keys, "left")
    of_key, key = F.create_map(*[F.lit(v) for pair in hot.items() for v in pair]), key_hash(keys)
    shares = F.when(key.isin(*hot), F.try_element_at(of_key, key)).otherwise(F.lit(1))
    # The salt depends on the row's values and partition alone, so that a task run again gives it again.
    others = [F.col("`" + f.name.replace("`", "``") + "`") for f in df.schema.fields if f.name not in keys and isinstance(f.dataType, T.AtomicType)]
    row = F.xxhash64(F.spark_partition_id(), *others)
    salted = df.withColumn("_salt", F.when(key.isin(*hot), F.pmod(row, shares).cast("int")).otherwise(F.lit(0)))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), shares - 1)))
    return salted.join(copies, [*keys, "_salt"], "left").drop("_salt")


def measured(df: DataFrame) -> int:
    """Rows of a small written table in bytes: eight per value and row, and the length of its texts."""
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "varchar", "char", "binary")]
    length = sum((F.coalesce(F.octet_length(F.col("`" + c.replace("`", "``") + "`")), F.lit(0)) for c in texts), F.lit(16 + 8 * len(df.columns)))
    return df.agg(F.coalesce(F.sum(length.cast("long")), F.lit(0))).first()[0]


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete written intermediates that nobody reads any more.

    Only folders that `work_path` named go: those right under ``crivo`` in the shared folder.
    A table without such a folder is left alone.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    home = fs_path(f"{shared_dir(spark)}/crivo").toUri().getPath() + "/"
    for table in tables:
        folders = set()
        for file in table.inputFiles():
            path = unquote(fs_path(file).toUri().getPath())
            if path.startswith(home):
                folders.add(home + path.removeprefix(home).split("/", 1)[0])
        for folder in folders:
            path = fs_path(f"{shared_dir(spark)}/crivo/{folder.removeprefix(home)}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
