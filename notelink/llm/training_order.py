"""Operator 2: token ids in training order, as fixed-stride binary shards.

Texts are cut into sequences of a fixed number of ids. Every sequence has a number
(tasks count first, then each numbers its own from where the task before ends),
and a keyed Feistel network with cycle-walking maps numbers one to one to
global slots: the training order, without sorting by random numbers. Slots are
dealt to shards by range, and a shard is one file of records of one size, so
record ``r`` of shard ``s`` is found by arithmetic and a reader goes on at any slot.

Ids are those of a rank file: texts are encoded once, and the stored ids are
counted and numbered; a place of a record is as wide as the vocabulary's largest
id needs. Without a rank file, ids are the UTF-8 bytes, 0 to 255. Unused places of
a last sequence are 0, and each record says how many ids it has.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelink.llm import bpe
from notelink.llm.common import bounded_batches, mix, shared_path, slabs, squeeze, text_buffers, unsqueeze, written

HEAD = np.dtype([("slot", "<i8"), ("key", "<i8"), ("part", "<i4"), ("null_key", "<u2"), ("n", "<u2")])
ROUNDS = 6
# Records of a shard that a reading task holds at once.
READ_RECORDS = 4096
# Bytes of ids that a task deals to shards at once.
MOVED_BYTES = 16 * 1024 * 1024
# How closely ids are stored, and rows whose ids tell which are frequent (this only makes moved ids smaller).
STORED = {"parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(8 * 1024 * 1024)}
BOOK_ROWS, BOOK_BYTES = 1000, 1 << 20


class Permutation:
    """A keyed permutation of 0 to n - 1: a balanced Feistel network over the next even number of
    bits, walked along its cycle until the value is below n."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + mix(np.array([key], np.uint64)))

    def _rounds(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & self.mask)
        return left << self.half | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in self.keys[::-1]:
            left, right = right ^ (mix(left ^ k) & self.mask), left
        return left << self.half | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        x = step(np.asarray(x, np.uint64))
        out = np.flatnonzero(x >= self.n)
        while len(out):
            x[out] = step(x[out])
            out = out[x[out] >= self.n]
        return x.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, lambda x: self._rounds(x, self.keys))

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        """The inverse."""
        return self._walk(slots, self._back)


@dataclass
class Shards:
    """Where the shards are and how they are laid out."""

    path: str
    sequences: int
    ids: int  # of a sequence
    per_shard: int
    width: int = 1  # bytes of an id, little-endian

    @property
    def stride(self) -> int:
        return HEAD.itemsize + self.ids * self.width

    def place(self, slot: int) -> tuple[int, int]:
        """Shard and byte offset of a slot's record."""
        return slot // self.per_shard, slot % self.per_shard * self.stride


_MOVED = "shard int, head binary, data binary"


def _book(rows: DataFrame, width: int) -> np.ndarray:
    """Ids, the frequent ones of some rows first; others that fit the width follow as they are (up to 65,536)."""
    some = rows.select(F.substring("data", 1, BOOK_BYTES // BOOK_ROWS // width * width).alias("data")).limit(BOOK_ROWS).collect()
    seen = np.frombuffer(b"".join(bytes(r.data or b"") if width > 1 else (r.data or "").encode()[:BOOK_BYTES // BOOK_ROWS] for r in some), f"<u{width}")
    often = np.bincount(seen[seen < 1 << 16], minlength=1 << min(16, 8 * width))
    return np.argsort(-often, kind="stable")


def _swapped(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Each id replaced; ids beyond the table stay."""
    if len(by) > np.iinfo(x.dtype).max:
        return by[x].astype(x.dtype)
    return np.where(x < len(by), by[np.minimum(x, len(by) - 1)], x).astype(x.dtype)


def _sends(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], per_shard: int, width: int, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sequences (heads, where their ids begin, ids), one row for each shard: the heads and the ids of its
    sequences, each compressed together. Ids are sent as their ``place`` in the book, so that most have the
    same high bytes, and sequences of like ids (by their median) lie together."""
    if not held:
        return
    head, ids = np.concatenate([h for h, _, _ in held]), _swapped(np.concatenate([x for _, _, x in held]), place)
    base = np.cumsum([0, *[len(x) for _, _, x in held]])
    begin = np.concatenate([b + at for (_, b, _), at in zip(held, base)])
    shard = head["slot"] // per_shard
    order = np.argsort(shard, kind="stable")
    cut = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
    for own in np.split(order, cut[1:-1]) if len(order) else ():
        parts = [ids[a:z] for a, z in zip(begin[own].tolist(), (begin[own] + head["n"][own]).tolist())]
        alike = np.argsort([np.partition(x, len(x) // 2)[len(x) // 2] for x in parts], kind="stable")
        data = squeeze(np.concatenate([parts[k] for k in alike]), level=6)
        yield pa.RecordBatch.from_arrays([pa.array([shard[own[0]]], pa.int32()), pa.array([squeeze(head[own[alike]])], pa.binary()), pa.array([data], pa.binary())],
                                         names=["shard", "head", "data"])


def write_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", ids: int = 512, per_shard: int = 32_768,
                 seed: int = 20_240_601, path: str | None = None, rank_file: str | None = None) -> Shards:
    """Write the sequences of ``docs``, in a training order given by ``seed``, to ``path`` (a new
    folder of the shared ``spark.checkpoint.dir`` if not given). Ids are those of ``rank_file``, or
    bytes if there is none.

    Without a rank file ``docs`` must be a stored table, or a plain selection from one: its tasks
    are run twice and must have the same rows each time; if they do not, the job fails and writes
    nothing (use ``common.written`` on other inputs). With one, the ids are stored first. Null and empty texts have no sequence; equal
    rows are separate sequences; a null key is kept as null. Long texts give many sequences.
    """
    if not 0 < ids < 1 << 16:
        raise ValueError("a sequence has 1 to 65535 ids")
    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or shared_path(spark, "training-order")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    if rank_file is None:
        width, n_ids = 1, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
        rows = rows.select("key", F.col("text").alias("data"), n_ids.alias("n_ids"))
    else:
        width = bpe.id_type(rank_file).itemsize
        coded = bpe.encode_packed(rows, rank_file).select("key", F.col("packed_ids").alias("data"), "n_ids")
        rows = written(coded, "training-ids", "zstd", **STORED)
    if (HEAD.itemsize + ids * width) * per_shard >= 1 << 31:
        raise ValueError("a shard has less than 2 GB: take a smaller per_shard")
    rows = rows.withColumn("check", F.xxhash64("key", "n_ids"))
    counted = rows.select(F.spark_partition_id().alias("task"), F.floor((F.col("n_ids") + ids - 1) / ids).alias("n"), "check").groupBy("task").agg(
        F.sum("n").alias("n"), F.bit_xor("check").alias("check")).collect()
    first, total = {}, 0
    for r in sorted(counted, key=lambda r: r.task):
        first[r.task] = (total, r.check)
        total += r.n
    first = spark.sparkContext.broadcast(first)
    order, book = Permutation(max(total, 1), seed), _book(rows, width)
    n_shards = max(1, -(-total // per_shard))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, expected = first.value.get(TaskContext.get().partitionId(), (0, 0))
        seen, held = 0, []
        for batch in batches:
            for part in slabs(batch):
                data, off = text_buffers(part.column("data"))
                off = off // width
                seen ^= int(np.bitwise_xor.reduce(part.column("check").to_numpy(), initial=0))
                count = -(-np.diff(off) // ids)
                n = int(count.sum())
                doc = np.repeat(np.arange(len(count)), count)
                head = np.zeros(n, HEAD)
                head["part"] = np.arange(n) - np.repeat(np.cumsum(count) - count, count)
                begin = off[doc] + head["part"].astype(np.int64) * ids
                head["slot"], head["n"] = order.slots(np.arange(at, at + n)), np.minimum(begin + ids, off[doc + 1]) - begin
                key = part.column("key")
                head["key"], head["null_key"] = key.fill_null(0).to_numpy()[doc], key.is_null().to_numpy(zero_copy_only=False)[doc]
                at += n
                held.append((head, begin, data.view(f"<u{width}")))
                if sum(x.nbytes for _, _, x in held) >= MOVED_BYTES:
                    yield from _sends(held, per_shard, width, np.argsort(book))
                    held = []
        yield from _sends(held, per_shard, width, np.argsort(book))
        if seen != expected:
            raise RuntimeError("the input's tasks differ between two runs; write it to a table first")

    def record(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        shard = got[0].column("shard")[0].as_py()
        out = np.zeros((min(per_shard, total - shard * per_shard), HEAD.itemsize + ids * width), np.uint8)
        filled = np.zeros(len(out), bool)
        for b in got:
            for packed, data in zip(b.column("head"), b.column("data")):
                head, raw = unsqueeze(packed.as_buffer(), HEAD), _swapped(unsqueeze(data.as_buffer(), f"<u{width}"), book).view(np.uint8)
                place = head["slot"] - shard * per_shard
                if len(np.unique(place)) != len(place) or filled[place].any():
                    raise RuntimeError(f"shard {shard} is not complete")
                filled[place] = True
                out[place, :HEAD.itemsize] = head.view(np.uint8).reshape(len(head), -1)
                end = np.cumsum(head["n"].astype(np.int64) * width)
                for r, a, z in zip(place.tolist(), [0, *end[:-1].tolist()], end.tolist()):
                    out[r, HEAD.itemsize:HEAD.itemsize + z - a] = raw[a:z]
        if not filled.all():
            raise RuntimeError(f"shard {shard} is not complete")
        del got
        whole = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, out.nbytes], np.int32)), pa.py_buffer(out)])
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), whole], names=["shard", "data"])

    moved = rows.mapInArrow(number, _MOVED).repartitionById(n_shards, "shard")
    files = moved.mapInArrow(record, "shard int, data binary")
    # One row per shard: Spark's writer commits whole files only; a line end follows the last record.
    files.select("shard", F.col("data").cast("string").alias("value")).write.partitionBy("shard").text(path)
    return Shards(path, total, ids, per_shard, width)


def _opened(path: str):
    """A file to seek in, of the local or a remote store that pyarrow knows."""
    at = urlparse(path)
    if at.scheme in ("", "file"):
        return open(at.path, "rb")
    store, inside = pafs.FileSystem.from_uri(path)
    return store.open_input_file(inside)


def _seekable(path: str) -> bool:
    if urlparse(path).scheme in ("", "file"):
        return True
    try:
        return pafs.FileSystem.from_uri(path) is not None
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def read_shards(spark: SparkSession, shards: Shards, first: int = 0, count: int | None = None) -> DataFrame:
    """The records of slots ``first`` to ``first + count - 1`` (to the last if not given), from the files
    that hold them: (slot, shard, key, part, n_ids, ids as bytes, ``shards.width`` for each).

    Tasks seek to ranges of ``READ_RECORDS`` records and hold one range at a time. In a store that only Spark can
    open, a task holds a whole shard instead.
    """
    last = shards.sequences if count is None else min(shards.sequences, first + count)
    schema = "slot long, shard int, key long, part int, n_ids int, ids binary"
    if first >= last:
        return spark.createDataFrame([], schema)
    stride, per_shard, width = shards.stride, shards.per_shard, shards.width
    files = spark.read.format("binaryFile").load(shards.path)
    files = files.filter(F.col("shard").between(first // per_shard, (last - 1) // per_shard))
    if _seekable(shards.path):
        # the first slot of each range; only names are read here, no contents
        start = F.greatest(F.lit(first), F.col("shard").cast("long") * per_shard)
        end = F.least(F.lit(last), (F.col("shard").cast("long") + 1) * per_shard)
        ranges = files.select("path", "shard", end.alias("end"), F.explode(F.sequence(start, end - 1, F.lit(READ_RECORDS).cast("long"))).alias("slot"))
        ranges = ranges.select("shard", "path", F.lit(None).cast("binary").alias("content"), "slot", F.least("end", F.col("slot") + READ_RECORDS).alias("end"))
    else:
        ranges = files.select("shard", "path", "content", F.lit(first).cast("long").alias("slot"), F.lit(last).cast("long").alias("end"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                shard, path, data, slot, end = (batch.column(n)[r] for n in ("shard", "path", "content", "slot", "end"))
                base = shard.as_py() * per_shard
                a, b = max(0, slot.as_py() - base), min(per_shard, end.as_py() - base)
                if data.is_valid:
                    raw = memoryview(data.as_buffer())[a * stride:min(b * stride, len(data.as_buffer()) // stride * stride)]
                else:
                    with _opened(path.as_py()) as f:
                        f.seek(a * stride)
                        raw = f.read((b - a) * stride)
                rows = np.frombuffer(raw, np.uint8).reshape(-1, stride)
                for at in range(0, len(rows), READ_RECORDS):
                    some = rows[at:at + READ_RECORDS]
                    head = np.ascontiguousarray(some[:, :HEAD.itemsize]).view(HEAD).ravel()
                    body = [x[:n * width].tobytes() for x, n in zip(some[:, HEAD.itemsize:], head["n"].tolist())]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(head["slot"]), pa.array(np.full(len(some), shard.as_py(), np.int32)), pa.array(head["key"], mask=head["null_key"] > 0),
                        pa.array(head["part"]), pa.array(head["n"].astype(np.int32)), pa.array(body, pa.binary())],
                        names=["slot", "shard", "key", "part", "n_ids", "ids"])

    return ranges.mapInArrow(records, schema)


def iterate(shards: Shards, first: int = 0) -> Iterator[tuple[int, bytes]]:
    """(slot, ids as bytes) one after another from ``first`` on, for a trainer that reads the shared folder as
    a file system: it seeks to the record and reads on."""
    root = urlparse(shards.path).path
    slot = first
    while slot < shards.sequences:
        shard, at = shards.place(slot)
        folder = os.path.join(root, f"shard={shard}")
        with open(os.path.join(folder, next(x for x in os.listdir(folder) if x.startswith("part-"))), "rb") as f:
            f.seek(at)
            while slot < shards.sequences and slot // shards.per_shard == shard:
                row = f.read(shards.stride)
                head = np.frombuffer(row, HEAD, 1)[0]
                yield int(head["slot"]), row[HEAD.itemsize:HEAD.itemsize + int(head["n"]) * shards.width]
                slot += 1
