"""Helpers that the operators share: shared-folder tables, worker caches, batch text codecs, label folds."""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.sources.shared import cut as materialize
from graphloom.sources.shared import discard, shared_dir  # noqa: F401

#: Fixed 64-bit odd multipliers of the hash functions below.
MIX1 = np.uint64(0xFF51AFD7ED558CCD)
MIX2 = np.uint64(0xC4CEB9FE1A85EC53)
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes up to which a table is broadcast.
BROADCAST_BYTES = 64_000_000
#: Bytes of text that a worker turns into arrays at once (a longer text stands alone).
CHUNK = 128_000


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, across tasks."""
    name = "_graphloom_worker_cache"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def trimmed(run):
    """A function of Arrow batches that gives freed memory back to the system when a task ends: workers live on between tasks."""

    def trimming(batches):
        yield from run(batches)
        import ctypes

        import pyarrow

        pyarrow.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return trimming


def map_texts(df: DataFrame, make, added: list[tuple[str, str]], text: str = "text", limit: int = CHUNK) -> DataFrame:
    """df with further columns (name, type): make(texts) gives their values, a list or Arrow array each, for a slice of rows.

    Rows go through in slices of about limit bytes of text, so neither side holds a batch's results at once; columns pass as they are.
    """
    types = [to_arrow_type(T._parse_datatype_string(kind)) for _, kind in added]
    names = [*df.columns, *(n for n, _ in added)]

    def run(batches):
        for batch in batches:
            for a, texts in text_slices(batch.column(batch.schema.get_field_index(text)), limit):
                more = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(make(texts), types)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, len(texts)).columns, *more], names=names)

    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T._parse_datatype_string(kind)) for n, kind in added)])
    return df.mapInArrow(trimmed(run), schema)


def sized(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df to broadcast if its values have at most so many bytes: 16 a value, and those of texts, arrays' texts and binaries."""
    width = F.lit(16 * len(df.columns))
    for c, kind in df.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind == "array<string>":
            width = width + F.coalesce(F.octet_length(F.array_join(c, "")) + 16 * F.size(c), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            raise ValueError(f"no known width, {kind}")
    n = df.agg(F.sum(width.cast("long"))).first()[0] or 0
    return F.broadcast(df) if n <= most else df


def in_training_fold(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 5 is not 0; null ids are never in it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != 0, F.lit(False))


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over a uint64 array, in place on a copy."""
    h = h ^ (h >> np.uint64(33))
    h *= MIX1
    h ^= h >> np.uint64(29)
    h *= MIX2
    h ^= h >> np.uint64(32)
    return h


def column_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names of our own result columns that don't clash with df's: a clash gets underscores."""
    have, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one uint32 array, each with a zero before and after it, and the index of the text of each place."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 2
    joined = "\0" + "\0\0".join(texts) + "\0"
    array = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return array, np.repeat(np.arange(len(texts), dtype=np.int32), lengths)


def text_slices(column, limit: int = CHUNK):
    """(first row, texts) of slices of an Arrow column whose texts have about limit bytes together; a null text is empty.

    A batch is never turned into Python strings as a whole, so a worker's memory hangs on limit and the longest text only.
    """
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, total = 0, np.cumsum(size)
    while at < len(size):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield at, [t or "" for t in column.slice(at, end - at).to_pylist()]
        at = end


def text_chunks(texts, limit: int = CHUNK):
    """Consecutive index ranges of a batch whose texts have about limit characters together, to bound memory."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def letter_fold() -> np.ndarray:
    """For each code point: its lower-case letter, or a space if it is none (cached in the worker)."""
    cache = worker_cache()
    if "fold" not in cache:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                table[cp] = ord(low) if len(low) == 1 else cp
        cache["fold"] = table
    return cache["fold"]
