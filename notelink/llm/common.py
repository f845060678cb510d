"""Shared helpers of the training-data operators: reading, appending columns, hashing of words."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelink.plans.materialize import shuffles_removed  # noqa: F401
from notelink.session import ensure_checkpoint_dir

# Bytes of text that one vectorised step holds (a longer text is a step of its own).
SLAB_BYTES = 2 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str | None = None, **options) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: later steps
    survive lost executors without running what came before once more."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# The most that Spark may broadcast of what a bounded step joins, by Spark's estimate: that is the compressed size
# of files, many times less than their rows in the driver, which collects them.
BROADCAST_BYTES = 256 * 1024


@contextlib.contextmanager
def broadcasts_bounded(spark: SparkSession, limit: int = BROADCAST_BYTES) -> Iterator[None]:
    """In it, Spark broadcasts no side of a join above ``limit``; a lower threshold of the session stays."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)i?b?", before.strip().lower()).groups()
    spark.conf.set(name, str(min(limit, int(number) * 1024 ** " kmgtp".index(unit or " "))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches hold at most ``rows`` texts: the default of 10,000 is meant for narrow rows,
    and each task holds a batch twice, in the JVM and in its Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns that an operator is about to add (any case)."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after each, a worker gives back the memory that Arrow keeps of those before, and at the
    end what its C library keeps too, as a worker that waits for its next task would hold on to it."""
    pool = pa.default_memory_pool()
    for batch in batches:
        yield batch
        del batch
        pool.release_unused()
    give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


def append_columns(df: DataFrame, fields: list[T.StructField], fn: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
                   keep: list[str] | None = None, slab: int = SLAB_BYTES) -> DataFrame:
    """``df`` with new columns computed batch by batch in Python workers.

    ``fn()`` is called once per task and returns the function from record batch
    to the new arrays. Input columns named like a new one are replaced, unless
    ``fn`` needs them: then list the columns to keep in ``keep``. ``slab``: bytes
    that ``fn``'s function gets at once. Workers give back memory (``released``).
    """
    bounded_batches(df.sparkSession)
    low = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in low and (keep is None or f.name in keep)]
    schema = T.StructType([*kept, *fields])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = fn()
        for batch in released(batches):
            for part in slabs(batch, slab):
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *each(part)],
                                                 names=[*names, *[f.name for f in fields]])
            part = batch = None  # not held while memory is given back

    return df.mapInArrow(run, schema)


def slabs(batch: pa.RecordBatch, limit: int = SLAB_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a record batch so that each piece holds about ``limit`` bytes (one row at least)."""
    n = batch.num_rows
    if n == 0:
        return
    size = np.zeros(n, np.int64)
    for col in batch.columns:
        if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) or pa.types.is_binary(col.type):
            size += np.diff(text_buffers(col)[1])
        elif pa.types.is_list(col.type):
            size += 8 * np.diff(np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + n + 1].astype(np.int64))
    ends = np.cumsum(size)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string or binary array; null is empty."""
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    if len(col) == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


# --- hashing of words --------------------------------------------------------

_MUL = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise."""
    x = x + _MUL
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(256, dtype=np.uint64)) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the multiplier, modulo 2^64."""
    global _POWERS
    if len(_POWERS) < n:
        m = 1 << (n - 1).bit_length()
        _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, _MUL, np.uint64)]))
    return _POWERS[:n]


def word_hashes(data: np.ndarray, off: np.ndarray, blank: np.ndarray = BLANK, prefixes: tuple[int, ...] = ()):
    """Hashes of the lower-cased (A-Z) words of each document and, per document, where they begin.

    Words are runs of bytes that are not ``blank``. Returns ``(hash, first)``:
    the words of document ``i`` are ``hash[first[i]:first[i + 1]]``. With
    ``prefixes``, ``hash`` has one more column for each of these lengths: the
    hash of the word's first so many bytes.
    """
    starts, first, v, pos, size = _words(data, off, blank)
    if not len(starts):
        return np.zeros((0, 1 + len(prefixes)) if prefixes else 0, np.uint64), first
    salt = np.uint64(0xD6E8FEB86659FD93)
    whole = mix(np.add.reduceat(v, starts) ^ (size * salt))
    if not prefixes:
        return whole, first
    cols = [whole]
    for n in prefixes:
        part = np.add.reduceat(np.where(pos < n, v, np.uint64(0)), starts)
        cols.append(mix(part ^ (np.minimum(size, np.uint64(n)) * salt)))
    return np.column_stack(cols), first


def _words(data: np.ndarray, off: np.ndarray, blank: np.ndarray):
    """Where words start (from the first on), per document the first one, each byte's part of
    its word's hash, its place in the word, and the words' sizes."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64), None, None, None
    b = LOWER[data]
    word = ~blank[b]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    edge = off[:-1][off[:-1] < len(data)]
    begin[edge] = word[edge]
    starts = np.flatnonzero(begin)
    first = np.searchsorted(starts, off)
    if not len(starts):
        return starts, first, None, None, None
    base = starts[0]
    span = np.diff(np.concatenate([starts, [len(b)]]))
    pos = np.arange(base, len(b)) - np.repeat(starts, span)
    v = BYTE_VALUES[b[base:]] * powers(int(span.max()))[pos]
    v[~word[base:]] = 0
    starts = starts - base
    return starts, first, v, pos, np.add.reduceat(word[base:].astype(np.uint64), starts)


def fold(acc: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Hash of a sequence one item longer (order counts)."""
    return mix(acc * np.uint64(0xC2B2AE3D27D4EB4F) + nxt)


def shard_of(h: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` equal ranges of the 64-bit hash order each value lies in."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def unique_ids(df: DataFrame, key: str) -> bool:
    """Whether no value of ``key`` occurs twice (one pass over that column alone)."""
    return df.groupBy(key).count().filter("count > 1").limit(1).count() == 0


# Tasks among which the rows of one key of a looked-up table are spread.
SALTS = 32


def salted_lookup(rows: DataFrame, table: DataFrame, on: list[str], spread: Column, salts: int = SALTS) -> DataFrame:
    """``rows`` left-joined with ``table`` (one row per key): the rows of a key are dealt by the hash
    ``spread`` to ``salts`` tasks, each of which gets a copy of the key's one row. The copies are sorted and
    merged: Spark does not count them when it estimates a size, and would broadcast all of them."""
    copies = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    return rows.withColumn("__salt", F.pmod(spread, F.lit(salts)).cast("int")).join(copies, [*on, "__salt"], "left").drop("__salt")


# --- arrays in binary columns ------------------------------------------------

def squeeze(x: np.ndarray, ordered: bool = False, level: int = 1) -> bytes:
    """A compact binary form of a numeric array: byte planes, compressed; of differences if it is ``ordered``."""
    if ordered and len(x):
        x = np.concatenate([x[:1], np.diff(x)])
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T) if len(x) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=level).compress(planes.tobytes())


def unsqueeze(b: bytes, dtype, ordered: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(dtype).itemsize
    x = np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel() if len(raw) else np.zeros(0, dtype)
    return np.cumsum(x, dtype=dtype) if ordered and len(x) else x
