"""Reading delimited files whose headers differ."""

from __future__ import annotations

import csv
import re
import warnings
from collections import defaultdict
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crivo.functions import numbers
from crivo.functions.text import NA_VALUES, base_name, na_to_null, normalize_name
from crivo.operators.align import aligned_union, consolidated
from crivo.operators.clean import ABSENT
from crivo.operators.contingency import quoted

SOURCE = "source_file"
# Holds the text of a record that does not fit its header.
CORRUPT = "_corrupt_record"
# So much of a file is read at a time for its header, and of so many files at once.
HEAD_BYTES, HEAD_READERS = 8 << 10, 32
# Columns whose type the reference declares.
DECLARED_TYPES = {
    "Carga Horaria": "double",
    "Carga Horaria Minima": "double",
    "Idade": "double",
    "Ano": "bigint",
}


def input_files(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    """Sorted files behind paths or globs; a path without any file is an error."""
    listing = spark.read.text(paths)
    files = sorted(unquote(f) for f in listing.inputFiles())
    if not files:
        raise FileNotFoundError(f"no input files at {paths}")
    return files


def plain_path(path: str) -> str:
    """A path spelled alike however many slashes Spark puts after its scheme."""
    return re.sub(r"^([a-zA-Z][a-zA-Z0-9+.-]*):/+", r"\1:/", path) if path.startswith("file:") else path


def headers(spark: SparkSession, files: Sequence[str], sep: str = ";") -> dict[str, tuple[str, ...]]:
    """Column names by file; a file without any line has none."""
    return {path: names for path, (names, _) in _first_lines(spark, files, sep).items()}


def _head(spark: SparkSession, path: str, most_bytes: int = HEAD_BYTES) -> tuple[str, bool]:
    """The header record of a file, and whether anything but blank lines follows it.

    Reads a few kilobytes from the file's start, and more only until the header ends and a
    line that is not blank begins. A header may hold quoted line breaks.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    settings = spark._jsc.hadoopConfiguration()
    stream = where.getFileSystem(settings).open(where)
    codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(settings).getCodec(where)
    stream = codec.createInputStream(stream) if codec is not None else stream
    try:
        read, size = bytearray(), most_bytes
        while True:
            more = bytes(stream.readNBytes(size))
            read += more
            end = _record_end(read)
            whole = len(more) < size
            if whole or (end < len(read) and read[end:].strip()):
                break
            size = len(read)
    finally:
        stream.close()
    return read[:end].decode("utf-8-sig", "replace").rstrip("\r\n"), bool(read[end:].strip())


def _record_end(read: bytes) -> int:
    """Where the first record ends: after the first line break outside of quotes."""
    at = 0
    while True:
        at = read.find(b"\n", at) + 1
        if not at:
            return len(read)
        if read.count(b'"', 0, at) % 2 == 0:
            return at


def _first_lines(spark: SparkSession, files: Sequence[str], sep: str) -> dict[str, tuple[tuple[str, ...], bool]]:
    """Column names by file, and whether any line follows them.

    The files' first kilobytes are read side by side through the store's own client, so the
    work grows with the number of files and not with their size.
    """
    with ThreadPoolExecutor(min(HEAD_READERS, max(1, len(files)))) as pool:
        heads = list(pool.map(lambda f: _head(spark, f), files))
    return {f: (tuple(next(csv.reader([line], delimiter=sep), [])), more) for f, (line, more) in zip(files, heads)}


def source_names(files: Sequence[str]) -> Column:
    """The source of a row: the partition folder's value, or else the name of its file.

    Parts written by source are in folders ``source_file=...``, which keep the source through
    any number of rewrites. Other files are named without folder and extension, or, if two
    would get the same name, with their folders.
    """
    def escaped(c: Column) -> Column:
        return F.replace(c, F.lit("+"), F.lit("%2B"))

    # Done for each row, so of a folder only its name is decoded.
    address, begin = F.col("_metadata.file_path"), f"/{SOURCE}="
    path = F.url_decode(escaped(address))
    folder = F.url_decode(escaped(F.regexp_extract(address, f"{begin}([^/]*)/", 1)))
    others = [unquote(f) for f in files if f"/{SOURCE}=" not in f]
    short = [re.sub(r"(?<=.)\.[^.]*$", "", f.rsplit("/", 1)[-1]) for f in others]
    named = base_name(path) if len(set(short)) == len(short) else F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")
    # Spark escapes signs in folder names once more.
    return F.when(address.contains(begin), F.try_url_decode(escaped(folder))).otherwise(named)


def read_group(
    spark: SparkSession, files: Sequence[str], names: Sequence[str], sep: str, na_values: Sequence[str],
    source: Column, malformed: str = "fail", multi_line: bool = False,
) -> DataFrame:
    """Files of one header as text columns with clean names, plus the source."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, CORRUPT]])
    # Records are split whole whatever is selected later, or a wrong number of fields would pass.
    raw = spark.read.option("columnPruning", "false").csv(
        list(files), schema=schema, sep=sep, header=True, encoding="UTF-8", enforceSchema=True,
        escape='"', multiLine=multi_line, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT,
    )
    bad = quoted(CORRUPT).isNotNull()
    # A condition on the corrupt text must name another column too.
    first = F.coalesce(F.octet_length(quoted(names[0])), F.lit(0))
    if malformed == "fail":
        told = F.concat(F.lit("malformed record in "), F.col("_metadata.file_path"), F.lit(": "), F.substring(quoted(CORRUPT), 1, 200), F.substring(F.lit(""), 1, first))
        raw = raw.where(F.when(bad, F.raise_error(told).cast("boolean")).otherwise(F.lit(True)))
    elif malformed == "drop":
        raw = raw.where(F.when(bad, first < 0).otherwise(F.lit(True)))
    elif malformed != "keep":
        raise ValueError(f"malformed must be fail, drop or keep: {malformed}")
    values = [na_to_null(quoted(c), tuple(na_values)).alias(normalize_name(c)) for c in names]
    extra = [quoted(CORRUPT)] if malformed == "keep" else []
    return raw.select(*values, source.alias(SOURCE), *extra)


def read_files(
    spark: SparkSession,
    paths: str | Sequence[str],
    sep: str = ";",
    fill: object | None = None,
    na_values: Sequence[str] = NA_VALUES,
    malformed: str = "fail",
    multi_line: bool = False,
    among: Sequence[str] | None = None,
) -> DataFrame:
    """All files as one table of text columns with normalised names and a ``source_file``.

    Files are grouped by header and every group is one scan, because a single scan over
    differing headers would match columns by position. Groups are united by name; a
    column a group lacks is missing, or holds ``fill``. Where it is missing, ``ABSENT`` lists
    the columns the row's file does not have, so that dropping incomplete rows can tell
    a missing value from a missing column.

    A record with too many or too few fields fails the query; ``malformed`` may also
    ``drop`` such records, or ``keep`` them with their text in ``CORRUPT`` (see
    `malformed_records`). ``multi_line`` reads quoted line breaks, at the price of one task
    per file. Files without rows are named in a warning; if no file has any, that is an error.
    Sources are told apart ``among`` these files (default: those read), see `source_names`.
    """
    files = input_files(spark, paths)
    first = _first_lines(spark, files, sep)
    empty = [f for f, (_, more) in first.items() if not more]
    if len(empty) == len(files):
        raise ValueError(f"none of the inputs holds data: {paths}")
    if empty:
        warnings.warn(f"input files without rows: {empty}", stacklevel=2)
    groups = defaultdict(list)
    for path, (names, _) in first.items():
        if names:
            groups[names].append(path)
    source = source_names(files if among is None else among)
    frames = [read_group(spark, group, names, sep, na_values, source, malformed, multi_line) for names, group in groups.items()]
    for frame in frames:
        folded = [c.lower() for c in frame.columns]
        if len(set(folded)) < len(folded):
            raise ValueError(f"column names collide after normalisation: {sorted(frame.columns)}")
    if fill is None:
        every = {c for frame in frames for c in frame.columns}
        absent = [sorted(every - set(frame.columns)) for frame in frames]
        if any(absent):
            frames = [f.withColumn(ABSENT, F.array(*map(F.lit, a)).cast("array<string>")) for f, a in zip(frames, absent)]
        return consolidated(frames)
    names = sorted({c for f in frames for c in f.columns} - {SOURCE})
    return aligned_union(frames, str(fill), [*names, SOURCE])


def malformed_records(spark: SparkSession, paths: str | Sequence[str], sep: str = ";", multi_line: bool = False) -> DataFrame:
    """Records per source that do not fit their header: ``source_file, malformed``."""
    kept = read_files(spark, paths, sep, malformed="keep", multi_line=multi_line)
    texts = [c for c in kept.columns if c not in (SOURCE, CORRUPT, ABSENT)]
    bad = quoted(CORRUPT).isNotNull() & (F.coalesce(*[F.octet_length(quoted(c)) for c in texts], F.lit(0)) >= 0)
    return kept.groupBy(SOURCE).agg(F.count_if(bad).alias("malformed"))


def fits(c: Column, kind: str) -> Column:
    """Does the type hold the number that a text spells? Every text fits ``string``."""
    if kind == "bigint":
        return numbers.is_whole(c)
    if kind == "double":
        return numbers.is_double(c)
    decimal = re.fullmatch(r"decimal\((\d+), ?(\d+)\)", kind)
    if decimal:
        return numbers.is_decimal(c, *map(int, decimal.groups()))
    return F.lit(True) if kind == "string" else c.try_cast(kind).isNotNull()


def infer_types(
    df: DataFrame, declared: dict[str, str] = DECLARED_TYPES, allow_loss: bool = False, exact_text: bool = False,
) -> dict[str, str]:
    """A type per text column: declared, or the first that loses no value of bigint, double, decimal(38, s) and string.

    A value fits a type if the type gives its number back: ``1d`` is text, and a code of 20
    digits is a decimal. Different numbers stay different; ``007`` and ``7`` are one number
    unless ``exact_text`` asks for types that give the very text back. The scale of a decimal
    is what the column's longest fraction needs, as long as 38 digits hold all of it.

    One aggregate over all rows. A declared type that would lose a value is an error unless
    ``allow_loss``; `misfits` counts such values.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in (SOURCE, CORRUPT)]
    tests = []
    for i, name in enumerate(texts):
        c = quoted(name)
        filled = c.isNotNull()

        def every(test: Column, default: bool) -> Column:
            return F.coalesce(F.bool_and(F.when(filled, test)), F.lit(default))

        if name in declared:
            tests.append(every(fits(c, declared[name]), True).alias(f"declared{i}"))
            continue
        after = numbers.point_digits(c, exact_text)
        plain = numbers.is_written_decimal(c) if exact_text else numbers.whole_digits(c).isNotNull()
        tests += [
            every(numbers.is_whole(c, exact_text), False).alias(f"bigint{i}"), every(numbers.is_double(c, exact_text), False).alias(f"double{i}"),
            every(plain, False).alias(f"plain{i}"), F.max(numbers.whole_digits(c)).alias(f"whole{i}"),
            F.max(after).alias(f"after{i}"), F.min(after).alias(f"least{i}"),
        ]
    found = df.agg(*tests).first() if tests else None
    lossy = [c for i, c in enumerate(texts) if c in declared and not found[f"declared{i}"]]
    if lossy and not allow_loss:
        raise ValueError(f"values that do not fit the declared type in: {lossy}")

    def chosen(i: int, name: str) -> str:
        if name in declared:
            return declared[name]
        if found[f"bigint{i}"]:
            return "bigint"
        if found[f"double{i}"]:
            return "double"
        alike = not exact_text or found[f"after{i}"] == found[f"least{i}"]
        if found[f"plain{i}"] and alike and found[f"whole{i}"] + found[f"after{i}"] <= numbers.MOST_DIGITS:
            return f"decimal({numbers.MOST_DIGITS},{found[f'after{i}']})"
        return "string"

    return {name: chosen(i, name) for i, name in enumerate(texts)}


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast text columns; text that does not fit its type becomes missing."""
    return df.select(*[
        F.when(fits(quoted(c), types[c]), quoted(c).try_cast(types[c])).alias(c) if types.get(c, "string") != "string" else quoted(c)
        for c in df.columns
    ])


def misfits(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """How many values each cast would lose: ``column, type, lost``."""
    cast = {c: t for c, t in types.items() if t != "string"}
    wide = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(quoted(c).isNotNull() & ~fits(quoted(c), t)).alias(f"l{i}") for i, (c, t) in enumerate(cast.items())],
    )
    lines = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"l{i}").alias("lost"))
             for i, (c, t) in enumerate(cast.items())]
    if not lines:
        return df.sparkSession.createDataFrame([], "column string, type string, lost long")
    return wide.select(F.inline(F.array(*lines)))


def read_encoded(spark: SparkSession, paths: str | Sequence[str], target: str, sep: str = ",", fill: object = 0) -> DataFrame:
    """Encoded parts as numbers over the sorted union of their columns, plus the file name."""
    texts = read_files(spark, paths, sep, fill=fill)
    return texts.select(*[
        quoted(c) if c == SOURCE else quoted(c).try_cast("int" if c == target else "double").alias(c)
        for c in texts.columns
    ])
