"""Operator 13: near duplicates by circulant MinHash, links confirmed on full sets.

A document is the set of its distinct word n-grams. Two permutations of the 64-bit
numbers give every coordinate of its signature: the first one scatters the set,
the second one ranks it, and coordinate ``c`` is the least rank when the second
permutation is shifted by ``c`` places around the circle.

1. Equal sets become one class, represented by its smallest document.
2. Signatures are cut into bands; classes that agree on a band share a bucket.
3. In every bucket the classes are compared with the one that shares most buckets with
   others, which connects groups of near copies. Then classes that still share a bucket,
   but no component, are compared with each other, each pair in its first common band only.
4. A pair is bounded by its sizes, by how many n-grams of each set no other class left has, and by
   a bitmap of each set, whose bits that the other one lacks cannot be shared. All
   three bounds are exact. What they allow is decided on the full sets.

No bucket, band or candidate is capped. Two sets that link agree on no band with
a probability below ``(1 - s ** ROWS) ** BANDS``, 7e-10 at a similarity of 0.8; nothing else
is left to chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelink.llm.common import append_columns, bounded_batches, fold, mix, salted_lookup, slabs, text_buffers, written
from notelink.llm.jaccard import components, shingle_sets

BANDS, ROWS = 40, 4
# Bits of a set's bitmap.
CELLS = 2048
# Text of which signatures are computed at once (its arrays stay in a core's cache).
STEP_BYTES = 256 * 1024

_SIGMA, _PI = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def signatures(h: np.ndarray, first: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """(documents, ``size``) least ranks of the sets ``h[first[i]:first[i + 1]]``; an empty set has zeros.

    Both permutations are keyed ``mix``, which maps the 64-bit numbers one to one;
    adding ``c`` (modulo 2^64) shifts the second one around the circle.
    """
    out = np.zeros((len(first) - 1, size), np.uint64)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return out
    scattered = mix(h ^ _SIGMA) + _PI
    rank, spare = np.empty_like(scattered), np.empty_like(scattered)
    for c in range(size):
        np.add(scattered, np.uint64(c), out=rank)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            np.right_shift(rank, np.uint64(shift), out=spare)
            np.bitwise_xor(rank, spare, out=rank)
            np.multiply(rank, np.uint64(factor), out=rank)
        np.right_shift(rank, np.uint64(31), out=spare)
        np.bitwise_xor(rank, spare, out=rank)
        out[full, c] = np.minimum.reduceat(rank, first[:-1][full])
    return out


_SIGNED = T.StructType([T.StructField("n", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()),
                        T.StructField("buckets", T.ArrayType(T.LongType())), T.StructField("cells", T.ArrayType(T.LongType()))])


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return (total[first[1:]] - total[first[:-1]]).view(np.int64)


def _rows(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1])), pa.array(np.ascontiguousarray(x).ravel()))


def _bitmaps(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(documents, CELLS / 64): the bits of the cells in which each set has an n-gram."""
    cell = (h >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)
    full = np.zeros((len(first) - 1, CELLS), np.uint8)
    full[np.repeat(np.arange(len(first) - 1), np.diff(first)), cell] = 1
    return np.packbits(full, axis=1).view(np.int64)


def signed(docs: DataFrame, k: int) -> DataFrame:
    """(key, v, n, d1, d2, buckets, cells): each document's set size and digest, its bucket in every
    band, and its bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slabs(batch, STEP_BYTES):
                h, first = shingle_sets(*text_buffers(part.column("text")), k)
                sig = signatures(h, first)
                bucket = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sig), BANDS))
                for r in range(ROWS):
                    bucket = fold(bucket, sig[:, r::ROWS])
                yield pa.RecordBatch.from_arrays([
                    part.column("key"), part.column("v"), pa.array(np.diff(first).astype(np.int64)), pa.array(_sums(mix(h), first)),
                    pa.array(_sums(mix(h ^ _PI), first)), _rows(bucket.view(np.int64)), _rows(_bitmaps(h, first))],
                    names=["key", "v", *_SIGNED.names])

    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("v", T.LongType()), *_SIGNED.fields])
    return docs.select("key", "v", "text").mapInArrow(run, schema)


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(c, grams): sorted n-grams of each text."""

    def build():
        def one(batch: pa.RecordBatch) -> list[pa.Array]:
            h, first = shingle_sets(*text_buffers(batch.column("text")), k)
            at = pa.array((first * 8).astype(np.int32))
            return [pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, at.buffers()[1], pa.py_buffer(np.ascontiguousarray(h))])]

        return one

    return append_columns(docs, [T.StructField("grams", T.BinaryType())], build, keep=["c"])


def _alike(a: str, b: str, num: int, den: int) -> Column:
    """Whether sizes and bitmaps of two classes allow a link."""
    fits = F.least(f"n{a}", f"n{b}") * den >= F.greatest(f"n{a}", f"n{b}") * num

    def own(x: str, y: str) -> Column:
        """n-grams of x that y can have: all but one for every cell that only x has."""
        alone = F.aggregate(F.zip_with(f"cells{x}", f"cells{y}", lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, x: s + x)
        return F.col(f"n{x}") - alone

    need = num * (F.col(f"n{a}") + F.col(f"n{b}"))
    return fits & ((num + den) * own(a, b) >= need) & ((num + den) * own(b, a) >= need)


def _lone(sets: DataFrame) -> DataFrame:
    """(c, lone): how many n-grams of each class no other class has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slabs(batch):
                grams, off = text_buffers(part.column("grams"))
                c = np.repeat(part.column("c").to_numpy(), np.diff(off) // 8)
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(c)], names=["gram", "c"])

    grams = sets.select("c", "grams").mapInArrow(run, "gram long, c long")
    return grams.groupBy("gram").agg(F.count("*").alias("n"), F.min("c").alias("c")).filter("n = 1").groupBy("c").agg(F.count("*").alias("lone"))


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, y) whose full sets link. Spark splits the keys that very many pairs have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for r in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(g)[r].as_buffer(), np.uint64) for g in ("gx", "gy"))
                o = len(np.intersect1d(a, b, assume_unique=True))
                ok[r] = den * o >= num * (len(a) + len(b) - o)
            yield batch.select(["x", "y"]).filter(pa.array(ok))

    gx, gy = (sets.select(F.col("c").alias(x), F.col("grams").alias(f"g{x}")) for x in "xy")
    return pairs.join(gx, "x").join(gy, "y").select("x", "y", "gx", "gy").mapInArrow(run, "x long, y long")


def class_links(classes: DataFrame, sets_of, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Links (x, y) between classes, enough to connect all that link, and their components (doc, comp).

    ``classes`` holds (c, n, buckets, cells); ``sets_of`` gives (c, grams) for a table of classes (c).
    """
    rows = classes.select("c", F.posexplode("buckets").alias("band", "bucket"))
    several = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    # a bucket is one band's: the band is part of its hash
    rows = written(rows.join(several, "bucket"), "buckets")
    # how often a class meets others: the middle of a group of copies meets most
    members = rows.groupBy("c").agg(F.sum("size").alias("meets"))
    able = written(classes.join(members, "c").select("c", "meets", "n", "buckets", "cells"), "candidates")
    sets = written(sets_of(able.select("c")), "sets")

    def side(df: DataFrame, x: str) -> DataFrame:
        return df.join(able.select(F.col("c").alias(x), *[F.col(n).alias(f"{n}{x}") for n in ("n", "cells")]), x)

    # every bucket's classes with the one in its middle
    lead = rows.join(able.select("c", "meets"), "c").groupBy("bucket").agg(F.max_by("c", F.struct("meets", -F.col("c"))).alias("x"))
    met = rows.join(lead, "bucket").filter("c != x").select("x", F.col("c").alias("y")).distinct()
    pairs = written(side(side(met, "x"), "y").filter(_alike("x", "y", num, den)).select("x", "y"), "pairs")
    links = written(_confirmed(pairs, sets, num, den), "links")
    comp = components(links)

    # the pairs left: of one bucket, but of two components
    own = rows.select("c", "band", "bucket").join(comp.withColumnRenamed("doc", "c"), "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    own = written(own, "open")
    mixed = own.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a < b").select("bucket")
    left = written(own.join(mixed, "bucket"), "left")
    lone = written(_lone(sets.join(left.select("c").distinct(), "c")), "lone")
    about = able.join(lone, "c", "left").withColumn("m", F.col("n") - F.coalesce("lone", F.lit(0))).filter(F.col("m") * den >= F.col("n") * num)
    left = left.join(about.select("c", "n", "m", "buckets", "cells"), "c")
    a, b = (left.select("bucket", "band", *[F.col(n).alias(f"{n}{x}") for n in ("c", "comp", "n", "m", "buckets", "cells")]) for x in "xy")
    shared = (num + den) * F.least("mx", "my") >= num * (F.col("nx") + F.col("ny"))
    first = F.array_position(F.zip_with("bucketsx", "bucketsy", lambda x, y: x == y), True)
    pairs = a.join(b.drop("band"), "bucket").filter(
        (F.col("compx") < F.col("compy")) & shared & (first == F.col("band") + 1) & _alike("x", "y", num, den))
    pairs = written(pairs.select(F.col("cx").alias("x"), F.col("cy").alias("y")), "pairs")
    more = written(_confirmed(pairs, sets, num, den), "links")
    links = links.unionByName(more)
    return links, components(links) if more.limit(1).count() else comp


def minhash_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, num: int = 80, den: int = 100) -> DataFrame:
    """(key, text_hash, n_shingles, class_id, component_id, kept) of every document.

    Documents whose sets of ``k``-word n-grams (64-bit hashes) have a Jaccard
    similarity of ``num / den`` or more link. ``class_id`` is the smallest key with an equal
    set, ``component_id`` the smallest that links lead to, ``kept`` whether that is the
    document's own; ``text_hash`` is Spark's ``xxhash64`` of the text. Words are runs of
    characters other than blank and tab to carriage return, A-Z lower-cased; a text
    of fewer than k words is one n-gram. A text without words, or null, has an
    empty set, a class of its own and no links. Rows with a null key have a size and
    nulls besides. Rows with one key and different texts are separate documents; equal
    rows get equal results. Only ``key`` (long) and ``text`` are read.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    bounded_batches(docs.sparkSession)
    known = rows.filter("key IS NOT NULL").withColumn("v", F.xxhash64("text"))
    info = written(signed(known, k), "signed")
    same = ["n", "d1", "d2"]
    first = info.filter("n > 0").groupBy(*same).agg(F.min(F.struct("key", "v")).alias("rep"), F.count("*").alias("rows"))
    classes = written(first.select(F.monotonically_increasing_id().alias("c"), *same, "rep.*", "rows"), "classes")
    heads = info.select("key", "v", "buckets", "cells").join(classes, ["key", "v"]).dropDuplicates(["c"])

    def sets_of(members: DataFrame) -> DataFrame:
        wanted = classes.join(members, "c").select("c", "key", "v")
        return _sets(known.join(wanted, ["key", "v"]).dropDuplicates(["c"]).select("c", "text"), k)

    _, comp = class_links(heads.select("c", "n", "buckets", "cells"), sets_of, num, den)
    # The smallest key of each component, for every class that is not its document's alone.
    placed = classes.join(comp.withColumnRenamed("doc", "c"), "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    placed = written(placed.select("comp", "key", "rows", *same), "placed")
    least = placed.groupBy("comp").agg(F.min("key").alias("component_id"), F.count("*").alias("classes"))
    found = placed.join(least.filter("classes > 1").drop("classes"), "comp", "left").filter("rows > 1 OR component_id IS NOT NULL")
    found = found.select(*same, F.col("key").alias("class_id"), F.coalesce("component_id", "key").alias("component_id"))
    out = salted_lookup(info.select("key", "v", *same), found, same, spread=F.xxhash64("key", "v"))
    out = out.select("key", F.col("v").alias("text_hash"), F.col("n").alias("n_shingles"),
                     F.coalesce("class_id", "key").alias("class_id"), F.coalesce("component_id", "key").alias("component_id"))
    out = out.unionByName(_without_key(rows.filter("key IS NULL"), k))
    return out.withColumn("kept", F.col("key") == F.col("component_id")).withColumnRenamed("key", key)


def _without_key(rows: DataFrame, k: int) -> DataFrame:
    def build():
        return lambda batch: [pa.array(np.diff(shingle_sets(*text_buffers(batch.column("text")), k)[1]), pa.int64())]

    null = F.lit(None).cast("long")
    return append_columns(rows, [T.StructField("n_shingles", T.LongType())], build, keep=["key", "text"]).select(
        "key", F.xxhash64("text").alias("text_hash"), "n_shingles", null.alias("class_id"), null.alias("component_id"))
