"""What the operators of this package share."""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crivo.shared import work_path


def give_back() -> None:
    """Give the memory a task has freed back to the system; its worker waits for other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """A function of batches or of tables that gives memory back when it is done."""
    def by_batch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    def by_table(*tables: pa.Table) -> pa.Table:
        found = run(*tables)
        give_back()
        return found

    if inspect.isgeneratorfunction(run):
        return by_batch
    # Spark tells by the number of arguments whether a function takes a key.
    one = lambda table: by_table(table)
    two = lambda left, right: by_table(left, right)
    return one if len(inspect.signature(run).parameters) == 1 else two


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back; cuts the lineage."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.pmod(F.crc32(F.encode(text, "UTF-8")), F.lit(modulus)).cast("int")


def two_columns(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``id`` and ``text`` alone, whatever else the table holds."""
    return df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))


def unused(columns: list[str], *names: str) -> list[str]:
    """The names with underscores ahead, as many as it takes to be none of ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts take about ``most_bytes``; a long row is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    first = 0
    while first < batch.num_rows:
        before = int(ends[first - 1]) if first else 0
        end = max(first + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield batch.slice(first, end - first)
        first = end


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows and the rows' offsets in them; null rows are empty."""
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    texts = texts.fill_null(b"" if pa.types.is_large_binary(texts.type) else "")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64, count=n + 1, offset=texts.offset * 8)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def utf8_pieces(
    texts: pa.Array, most_bytes: int = 1 << 20, whole_words: bool = False,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of about ``most_bytes``: the row each part belongs to, the bytes, the parts' offsets.

    Rows stay whole unless they are longer than that; those are cut after white space or
    control signs (a word longer than a piece is cut). With ``whole_words`` they are cut after
    ASCII white space alone, and a piece grows until it comes to one. Null rows are empty parts.
    """
    data, offsets = utf8(texts)
    rows, starts = np.arange(len(offsets) - 1), offsets[:-1]
    for row in np.flatnonzero(np.diff(offsets) > most_bytes)[::-1]:
        cuts, at, end = [], int(offsets[row]), int(offsets[row + 1])
        while end - at > most_bytes:
            if whole_words:
                at = _after_word(data, at, end, most_bytes)
            else:
                blanks = np.flatnonzero(data[at:at + most_bytes] <= 32)
                at += int(blanks[-1]) + 1 if len(blanks) else most_bytes
            if at < end:
                cuts.append(at)
        rows = np.insert(rows, row + 1, [row] * len(cuts))
        starts = np.insert(starts, row + 1, cuts)
    bounds = np.append(starts, offsets[-1])
    first = 0
    while first < len(rows):
        end = int(np.searchsorted(bounds, bounds[first] + most_bytes, side="right")) - 1
        end = min(len(rows), max(end, first + 1))
        yield rows[first:end], data[bounds[first]:bounds[end]], bounds[first:end + 1] - bounds[first]
        first = end


# A word's hash is the sum of a random number per byte times a power per place, modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_OF_BYTE = np.random.default_rng(20_001).integers(1, 1 << 64, 256, dtype=np.uint64)
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])


def _after_word(data: np.ndarray, at: int, end: int, most_bytes: int) -> int:
    """The place after the last white space within ``most_bytes``, else after the first one, else the end."""
    blanks = np.flatnonzero(_BLANK[data[at:at + most_bytes]])
    if len(blanks):
        return at + int(blanks[-1]) + 1
    for first in range(at + most_bytes, end, most_bytes):
        blanks = np.flatnonzero(_BLANK[data[first:min(first + most_bytes, end)]])
        if len(blanks):
            return first + int(blanks[0]) + 1
    return end


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[:1] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (what ASCII white space parts) of consecutive texts, and words per text."""
    inside = ~_BLANK[data]
    breaks = offsets[1:-1]
    before = np.concatenate([[False], inside[:-1]])[:len(inside)]
    before[breaks[breaks < len(inside)]] = False
    after = np.concatenate([inside[1:], [False]])[:len(inside)]
    after[breaks[breaks > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    # Longer data than there are powers, a long word, is summed step by step.
    hashes, steps = np.zeros(len(starts), np.uint64), len(powers[0])
    for first in range(0, len(data), steps):
        part = data[first:first + steps]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_OF_BYTE[part] * powers[0][:len(part)], out=sums[1:])
        here = slice(np.searchsorted(ends, first, side="right"), np.searchsorted(starts, first + len(part)))
        since = starts[here] - first
        sums = sums[np.minimum(ends[here] - first, len(part))] - sums[np.maximum(since, 0)]
        # A word that began before goes on at the place it has in the word.
        before = pow(_BASE, max(0, -int(since[0])), 1 << 64) if len(since) else 1
        shift = powers[1][np.maximum(since, 0)]
        shift[:1] *= np.uint64(before)
        hashes[here] += sums * shift
    hashes = (hashes ^ hashes >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return hashes ^ hashes >> np.uint64(32), np.diff(np.searchsorted(starts, offsets))


def hashed_rows(texts: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, word hashes and bounds of the rows in them, for runs of whole rows."""
    powers = _powers(most_bytes)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush() -> tuple[int, np.ndarray, np.ndarray]:
        rows = np.concatenate([h[0] for h in held])
        counts = np.bincount(rows - rows[0], np.concatenate([h[2] for h in held]), rows[-1] - rows[0] + 1).astype(np.int64)
        return int(rows[0]), np.concatenate([h[1] for h in held]), np.concatenate([[0], np.cumsum(counts)])

    for rows, data, offsets in utf8_pieces(texts, most_bytes, whole_words=True):
        # A long row comes in several pieces.
        if held and held[-1][0][-1] != rows[0]:
            yield flush()
            held = []
        held.append((rows, *word_hashes(data, offsets, powers)))
    if held:
        yield flush()


def row_bytes(texts: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each row; null is empty."""
    data, offsets = utf8(texts)
    view = memoryview(data)
    bounds = offsets.tolist()
    for i in range(len(bounds) - 1):
        yield bytes(view[bounds[i]:bounds[i + 1]])


def row_groups(texts: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """First row and UTF-8 bytes of runs of rows of about ``most_bytes``; null is empty."""
    held, size, first = [], 0, 0
    for row, text in enumerate(row_bytes(texts)):
        held.append(text)
        size += len(text)
        if size > most_bytes:
            yield first, held
            held, size, first = [], 0, row + 1
    yield first, held


def sum_by_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values[bounds[i]:bounds[i + 1]]``; empty ranges give zero."""
    total = np.zeros(len(values) + 1, dtype=np.int64 if values.dtype.kind in "iub" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def packed(table: pa.Table) -> bytes:
    """A table as compressed bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for each unsigned key, spread whatever the keys look like."""
    mixed = (keys ^ keys >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
