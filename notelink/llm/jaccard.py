"""Operator 5: n-gram Jaccard join by vertical partitioning.

A document is the set of its distinct word n-grams. Two documents link when
their Jaccard similarity reaches ``num / den``. The steps:

1. *Screen.* In hash order, two linked documents share several of the n-grams of
   their prefixes. N-grams travel to ranges of the hash order; a range tells each
   document how many of its prefix n-grams others have. Documents with too
   few are linked with nothing. (A task first settles what its own documents share,
   and sends one row for it, so a very common n-gram is a few rows.)
2. Equal sets become one class, represented by its smallest document.
3. *Order.* The n-grams of the representatives left are counted; the global
   order is by frequency class, then hash, and is cut into fragments.
4. *Candidates.* Representatives that share a n-gram of their prefixes in this
   order are compared: first with the smallest and the largest of those that
   share it, which already connects groups of near copies, then all that
   are not connected yet. Pairs inside a connected component need no comparison.
5. *Partial overlaps* of a pair are counted in each fragment by itself and
   summed per pair; the sum decides exactly.

All bounds are exact: no n-gram, document or candidate is left out. N-grams are
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelink.llm.common import (append_columns, bounded_batches, broadcasts_bounded, fold, mix, released, salted_lookup, shard_of, slabs,
                                 text_buffers, word_hashes, written)

# N-grams that a task gathers before it settles them (bounds its memory), and text
# per range of the hash order.
FLUSH, SHARD_BYTES = 1_500_000, 32 * 1024 * 1024
# Rounds in which each n-gram's documents are compared with one of them, before all others are.
LEADERS = 2
# Ranges of the hash order by which candidates are bounded (a power of two).
RANGES = 32
# One n-gram more in a prefix for each so many of the document: the screen asks for that many more matches.
EXTRA = 20


def _need(n, num: int, den: int):
    """The least overlap of a set of ``n`` with any set it is linked with."""
    return -(-n * num // den)


def _screen_prefix(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many n-grams in hash order the screen looks at; any two linked sets share
    ``m // EXTRA + 1`` of them, where m is the smaller set's size."""
    return np.where(n > 0, n - _need(n, num, den) + n // EXTRA + 1, 0)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word n-grams of each text, and where each text's begin. A text of
    fewer words, unless none, has all its words as its one n-gram."""
    w, first = word_hashes(data, off)
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    if len(w) >= k:
        h = w[:len(w) - k + 1]
        for j in range(1, k):
            h = fold(h, w[j:len(w) - k + 1 + j])
        inside = row[:len(h)] == row[k - 1:]
        h, row = h[inside], row[:len(inside)][inside]
    else:
        h, row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for size in range(1, k):
        short = np.flatnonzero(count == size)
        if len(short):
            at = first[short]
            s = w[at]
            for j in range(1, size):
                s = fold(s, w[at + j])
            h = np.concatenate([h, mix(s ^ np.uint64(size))])
            row = np.concatenate([row, short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(count) + 1))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def _runs(h: np.ndarray) -> np.ndarray:
    """Lengths of runs of equal values, for each element of a sorted array."""
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([edge, [len(h)]]))
    return np.repeat(size, size)


def _bin(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


# --- 1. screen ---------------------------------------------------------------

_MOVED = "shard int, batch long, kind int, a binary, b binary, c binary, d binary"
_INFO, _GRAMS, _COUNTS = 0, 1, 2


def _moved(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)],
                                      names=["shard", "batch", "kind", "a", "b", "c", "d"])


class _Gathered:
    """Documents of a task since the last flush."""

    def __init__(self):
        self.docs, self.grams, self.n_docs, self.n_grams = [], [], 0, 0

    def add(self, key: np.ndarray, v: np.ndarray, h: np.ndarray, first: np.ndarray, num: int, den: int) -> None:
        n = np.diff(first)
        digest = np.column_stack([_sums(mix(h), first), _sums(mix(h ^ np.uint64(0x5851F42D4C957F2D)), first)])
        self.docs.append((key, v, n.astype(np.int32), digest))
        place = np.arange(len(h)) - np.repeat(first[:-1], n)
        low = place < np.repeat(_screen_prefix(n, num, den), n)
        row = np.repeat(np.arange(len(n), dtype=np.int32), n)[low]
        # hashed once more: the lowest hashes of each set would crowd the first ranges
        self.grams.append((mix(h[low]), row + np.int32(self.n_docs)))
        self.n_docs += len(n)
        self.n_grams += len(row)

    def flush(self, batch: int, n_shards: int) -> list[tuple]:
        h, row = (np.concatenate(x) for x in zip(*self.grams))
        order = np.argsort(h, kind="stable")
        h, row = h[order], row[order]
        common = _runs(h) > 1
        settled = np.bincount(row[common], minlength=self.n_docs).astype(np.int32)
        lead = common.copy()
        lead[1:] &= h[1:] != h[:-1]
        row = np.where(common, np.int32(-1), row)
        h, row = h[~common | lead], row[~common | lead]
        key, v, n, digest = (np.concatenate(x) for x in zip(*self.docs))
        out = [(batch % n_shards, batch, _INFO, _bin(key) + _bin(v), _bin(n), _bin(digest), _bin(settled))]
        at = np.searchsorted(shard_of(h, n_shards), np.arange(n_shards + 1))
        out += [(s, batch, _GRAMS, _bin(h[a:b]), _bin(row[a:b]), b"", b"") for s, (a, b) in enumerate(zip(at, at[1:])) if b > a]
        self.__init__()
        return out


def _screen(docs: DataFrame, k: int, num: int, den: int, n_shards: int) -> DataFrame:
    """(key, v, n, d1, d2, shared): size and digest of each document's set, and how many of its
    prefix n-grams other documents' prefixes have."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, got = TaskContext.get().partitionId(), 0, _Gathered()
        for batch in released(batches):
            for part in slabs(batch):
                h, first = shingle_sets(*text_buffers(part.column("text")), k)
                got.add(part.column("key").to_numpy(), part.column("v").to_numpy(), h, first, num, den)
                if got.n_grams >= FLUSH or got.n_docs >= FLUSH:
                    yield _moved(got.flush((task << 24) + done, n_shards))
                    done += 1
        if got.n_docs:
            yield _moved(got.flush((task << 24) + done, n_shards))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, hs, idx = [], [], []
        for batch in released(batches):
            for r in batch.to_pylist():
                if r["kind"] == _INFO:
                    yield _moved([tuple(r.values())])
                else:
                    rows.append(r["batch"])
                    hs.append(np.frombuffer(r["a"], np.uint64))
                    idx.append(np.frombuffer(r["b"], np.int32))
        if not rows:
            return
        h, i = np.concatenate(hs), np.concatenate(idx)
        owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) for x in idx])
        order = np.argsort(h, kind="stable")
        shared = np.zeros(len(h), bool)
        shared[order] = _runs(h[order]) > 1
        shared &= i >= 0
        i, at = i[shared], np.searchsorted(owner[shared], np.arange(len(rows) + 1))
        for r, (a, b) in enumerate(zip(at, at[1:])):
            if b > a:
                doc, n = np.unique(i[a:b], return_counts=True)
                yield _moved([(0, rows[r], _COUNTS, _bin(doc), _bin(n.astype(np.int32)), b"", b"")])

    def settle(group: tuple, t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        info = next(r for r in rows if r["kind"] == _INFO)
        ids = np.frombuffer(info["a"], np.int64)
        n, digest = np.frombuffer(info["b"], np.int32), np.frombuffer(info["c"], np.int64).reshape(-1, 2)
        shared = np.frombuffer(info["d"], np.int32).copy()
        for r in rows:
            if r["kind"] == _COUNTS:
                shared[np.frombuffer(r["a"], np.int32)] += np.frombuffer(r["b"], np.int32)
        half = len(ids) // 2
        return pa.table({"key": ids[:half], "v": ids[half:], "n": n.astype(np.int64), "d1": digest[:, 0], "d2": digest[:, 1],
                         "shared": shared.astype(np.int64)})

    sent = docs.select("key", "v", "text").mapInArrow(gather, _MOVED).repartitionById(n_shards, "shard")
    return sent.mapInArrow(count, _MOVED).groupBy("batch").applyInArrow(
        settle, "key long, v long, n long, d1 long, d2 long, shared long")


# --- 3. global order ---------------------------------------------------------

_PACK = "pack long, docs binary, n binary, grams binary"
_ORDERED = T.StructType([
    T.StructField("doc", T.LongType()), T.StructField("n", T.LongType()), T.StructField("m", T.LongType()),
    T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("prefix", T.ArrayType(T.LongType())),
    T.StructField("fragments", T.ArrayType(T.StructType([
        T.StructField("fragment", T.IntegerType()), T.StructField("grams", T.ArrayType(T.LongType()))])))])


def _packs(docs: DataFrame, k: int) -> DataFrame:
    """Sets of documents, many to a row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes, sets, total = [], [], [], 0

        def row() -> pa.RecordBatch:
            key = np.concatenate(keys)
            return pa.RecordBatch.from_arrays(
                [pa.array([int(key[0])]), *[pa.array([_bin(x)], pa.binary()) for x in (key, np.concatenate(sizes), np.concatenate(sets))]],
                names=["pack", "docs", "n", "grams"])

        for batch in released(batches):
            for part in slabs(batch):
                h, first = shingle_sets(*text_buffers(part.column("text")), k)
                keys.append(part.column("key").to_numpy())
                sizes.append(np.diff(first).astype(np.int64))
                sets.append(h)
                total += len(h)
                if total >= FLUSH:
                    yield row()
                    keys, sizes, sets, total = [], [], [], 0
        if keys:
            yield row()

    return docs.mapInArrow(pack, _PACK)


def _frequencies(packs: DataFrame, n_shards: int) -> DataFrame:
    """(pack, h, df): for each pack, its n-grams that at least two documents have."""
    kind = "shard int, pack long, h binary, n binary"

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                                          names=["shard", "pack", "h", "n"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for r in range(batch.num_rows):
                h, n = np.unique(np.frombuffer(batch.column("grams")[r].as_py(), np.uint64), return_counts=True)
                at = np.searchsorted(shard_of(h, n_shards), np.arange(n_shards + 1))
                out = [(s, batch.column("pack")[r].as_py(), _bin(h[a:b]), _bin(n[a:b].astype(np.int64)))
                       for s, (a, b) in enumerate(zip(at, at[1:])) if b > a]
                if out:
                    yield rows(out)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs_, hs, ns = [], [], []
        for batch in released(batches):
            for r in batch.to_pylist():
                packs_.append(r["pack"])
                hs.append(np.frombuffer(r["h"], np.uint64))
                ns.append(np.frombuffer(r["n"], np.int64))
        if not packs_:
            return
        h = np.concatenate(hs)
        words, at = np.unique(h, return_inverse=True)
        df = np.bincount(at, weights=np.concatenate(ns), minlength=len(words)).astype(np.int64)[at]
        cut = np.concatenate([[0], np.cumsum([len(x) for x in hs])])
        for p, a, b in zip(packs_, cut, cut[1:]):
            keep = df[a:b] > 1
            if keep.any():
                yield rows([(0, p, _bin(h[a:b][keep]), _bin(df[a:b][keep]))])

    return packs.select("pack", "grams").mapInArrow(local, kind).repartitionById(n_shards, "shard").mapInArrow(total, kind).drop("shard")


def _ordered(packs: DataFrame, df: DataFrame, num: int, den: int) -> DataFrame:
    """Per document that can still link: its size n, how many of its n-grams others have (m),
    also by RANGES of the hash order (counts), its prefix in the global order, and its shared n-grams by fragment."""

    def order(left: pa.Table, right: pa.Table) -> pa.Table:
        known = right.to_pylist()
        if not left.num_rows or not known:
            return pa.Table.from_batches([], schema=_ordered_arrow())
        h_all = np.concatenate([np.frombuffer(r["h"], np.uint64) for r in known])
        df_all = np.concatenate([np.frombuffer(r["n"], np.int64) for r in known])
        sort = np.argsort(h_all)
        h_all, df_all = h_all[sort], df_all[sort]
        parts = []
        for r in left.to_pylist():
            doc, n, h = (np.frombuffer(r[c], t) for c, t in (("docs", np.int64), ("n", np.int64), ("grams", np.uint64)))
            row = np.repeat(np.arange(len(doc)), n)
            at = np.minimum(np.searchsorted(h_all, h), len(h_all) - 1)
            both = h_all[at] == h
            h, row, freq = h[both], row[both], df_all[at[both]]
            shared = np.bincount(row, minlength=len(doc))
            able = (n > 0) & (shared >= _need(n, num, den))
            keep = able[row]
            h, row, freq = h[keep], row[keep], freq[keep]
            counts = np.bincount(row * RANGES + (h >> np.uint64(64 - RANGES.bit_length() + 1)).astype(np.int64),
                                 minlength=len(doc) * RANGES).reshape(-1, RANGES).astype(np.int32)
            fragment = (np.log2(freq).astype(np.int32) << 2) | (h >> np.uint64(62)).astype(np.int32)
            sort = np.lexsort((h, fragment, row))
            h, row, fragment = h[sort].view(np.int64), row[sort], fragment[sort]
            docs = np.flatnonzero(able)
            first = np.searchsorted(row, np.concatenate([docs, [len(doc)]]))
            # n-grams that no other document has come first in the order, and match nothing
            take = np.maximum(0, n[docs] - _need(n[docs], num, den) + 1 - (n[docs] - shared[docs]))
            place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
            in_prefix = place < np.repeat(take, np.diff(first))
            p_at = np.concatenate([[0], np.cumsum(np.minimum(take, np.diff(first)))])
            edge = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (fragment[1:] != fragment[:-1])])) if len(h) else np.zeros(0, int)
            grams = pa.ListArray.from_arrays(pa.array(np.concatenate([edge, [len(h)]]), pa.int32()), pa.array(h))
            struct = pa.StructArray.from_arrays([pa.array(fragment[edge]), grams], names=["fragment", "grams"])
            parts.append(pa.Table.from_arrays([
                pa.array(doc[docs]), pa.array(n[docs]), pa.array(shared[docs]),
                pa.ListArray.from_arrays(pa.array(np.arange(len(docs) + 1) * RANGES, pa.int32()), pa.array(counts[docs].ravel())),
                pa.ListArray.from_arrays(pa.array(p_at, pa.int32()), pa.array(h[in_prefix])),
                pa.ListArray.from_arrays(pa.array(np.searchsorted(row[edge], np.concatenate([docs, [len(doc)]])), pa.int32()), struct),
            ], schema=_ordered_arrow()))
        return pa.concat_tables(parts)

    return packs.groupBy("pack").cogroup(df.groupBy("pack")).applyInArrow(order, _ORDERED)


def _ordered_arrow() -> pa.Schema:
    return pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("counts", pa.list_(pa.int32())), ("prefix", pa.list_(pa.int64())),
                      ("fragments", pa.list_(pa.struct([("fragment", pa.int32()), ("grams", pa.list_(pa.int64()))])))])


# --- 4. and 5. candidates, partial overlaps ----------------------------------

def _linked(pairs: DataFrame, parts: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, y) that link: overlaps are counted per fragment and summed per pair."""
    a = parts.select(F.col("doc").alias("x"), "fragment", F.col("grams").alias("gx"))
    b = parts.select(F.col("doc").alias("y"), "fragment", F.col("grams").alias("gy"))
    partial = pairs.join(a, "x").join(b, ["y", "fragment"]).select("x", "y", F.size(F.array_intersect("gx", "gy")).alias("o"))
    total = partial.groupBy("x", "y").agg(F.sum("o").alias("o"))
    nx, ny = sizes.select(F.col("doc").alias("x"), F.col("n").alias("nx")), sizes.select(F.col("doc").alias("y"), F.col("n").alias("ny"))
    return total.join(nx, "x").join(ny, "y").filter(den * F.col("o") >= num * (F.col("nx") + F.col("ny") - F.col("o"))).select("x", "y")


def components(links: DataFrame) -> DataFrame:
    """(doc, comp): the smallest document of each document's connected component.

    Each round every document takes its neighbours' smallest label, then its
    label's label; rounds are written to the shared folder. Only documents with links occur.
    """
    edges = written(links.select(F.col("x").alias("doc"), F.col("y").alias("to"))
                    .unionByName(links.select(F.col("y").alias("doc"), F.col("x").alias("to"))), "edges")
    label = written(edges.groupBy("doc").agg(F.least("doc", F.min("to")).alias("comp")), "labels")
    while True:
        seen = edges.join(label.withColumnRenamed("doc", "to"), "to").groupBy("doc").agg(F.min("comp").alias("near"))
        near = label.join(seen, "doc").select("doc", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        # only documents that are labels of others are looked up, and each label's followers are spread over tasks
        jump = label.join(label.select(F.col("comp").alias("doc")).distinct(), "doc").select(F.col("doc").alias("comp"), F.col("comp").alias("far"))
        new = salted_lookup(near, jump.filter("comp != far"), ["comp"], spread=F.xxhash64("doc"))
        new = written(new.select("doc", "was", F.least("comp", F.coalesce("far", "comp")).alias("comp")), "labels")
        changed = new.filter("was != comp").limit(1).count()
        label = new.select("doc", "comp")
        if not changed:
            return label


def _fits(num: int, den: int) -> Column:
    """Whether sizes and numbers of shared n-grams allow the similarity: a pair's overlap in a range
    of the hash order is at most the lesser number of n-grams there that others have."""
    need = num * (F.col("nx") + F.col("ny"))
    most = F.lit(0)
    for r in range(RANGES):
        most = most + F.least(F.col("cx")[r], F.col("cy")[r])
    return ((den + num) * F.least("mx", "my") >= need) & ((den + num) * most >= need)


def _pairs(a: Column, b: Column, df: DataFrame) -> DataFrame:
    return df.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct()


def representative_links(ordered: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Links (x, y) between representatives, enough to connect all that link, and (doc, comp)."""
    spark = ordered.sparkSession
    sizes = ordered.select("doc", "n")
    parts = ordered.select("doc", F.explode("fragments").alias("f")).select("doc", "f.fragment", "f.grams")
    about = ordered.select("doc", "n", "m", "counts")
    grams = ordered.select("doc", F.explode("prefix").alias("h"))
    # n-grams of one prefix only propose nothing
    several = grams.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h")
    grams = written(grams.join(several, "h"), "prefixes")
    none = spark.createDataFrame([], "x long, y long")
    links, tested, comp = none, none, spark.createDataFrame([], "doc long, comp long")
    leaders = spark.createDataFrame([], "h long, of long")

    def test(pairs: DataFrame) -> None:
        nonlocal links, tested, comp
        pairs = written(pairs.join(tested, ["x", "y"], "left_anti"), "pairs")
        links = written(links.unionByName(_linked(pairs, parts, sizes, num, den)), "links")
        tested = tested.unionByName(pairs)
        comp = components(links)

    def side(df: DataFrame, doc: str, x: str) -> DataFrame:
        return df.join(about.select(F.col("doc").alias(doc), F.col("n").alias(f"n{x}"), F.col("m").alias(f"m{x}"), F.col("counts").alias(f"c{x}")), doc)

    for _ in range(LEADERS):
        own = grams.join(comp, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
        # The next leader is of a component that has not led yet: the document that is least unlike the others.
        led = leaders.join(comp.select(F.col("doc").alias("of"), "comp"), "of", "left").select("h", F.coalesce("comp", "of").alias("comp")).distinct()
        open_ = written(own.join(led, ["h", "comp"], "left_anti"), "open")
        lead = open_.join(about.select("doc", (F.col("n") - F.col("m")).alias("own")), "doc").groupBy("h").agg(
            F.min(F.struct("own", "doc", "comp")).alias("lead"), F.count("*").alias("c")).filter("c > 1")
        lead = written(lead.select("h", F.col("lead.doc").alias("of"), F.col("lead.comp").alias("of_comp")), "leaders")
        met = open_.join(lead, "h").filter("comp != of_comp").select("doc", "of").distinct()
        test(_pairs(F.col("doc"), F.col("of"), side(side(met, "doc", "x"), "of", "y").filter(_fits(num, den))))
        leaders = leaders.unionByName(lead.select("h", "of"))
    # All others that share a prefix n-gram and are not connected: between components, not inside. A
    # component's bounds are the best of its documents'; the smaller of two is unfolded first.
    own = about.join(comp, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    most = F.array(*[F.max(F.col("counts")[r]) for r in range(RANGES)])
    bounds = written(own.groupBy("comp").agg(F.min("n").alias("n"), F.max("m").alias("m"), most.alias("c"), F.count("*").alias("size")), "bounds")
    docs = written(grams.join(own, "doc"), "prefixes")
    sides = docs.select("h", "comp").distinct().join(bounds, "comp")
    sa, sb = (sides.select("h", F.struct("size", "comp").alias(f"s{x}"), *[F.col(c).alias(f"{c}{x}") for c in "nmc"]) for x in "xy")
    both = sa.join(sb, "h").filter((F.col("sx") < F.col("sy")) & _fits(num, den)).select("h", F.col("sx.comp").alias("a"), F.col("sy.comp").alias("b"))
    both = written(both, "component-pairs")
    # Each pair of documents comes from one n-gram, the least that both prefixes have: of the n-grams
    # through which its components meet, which are the same for all pairs of two components.
    used = both.select("h", F.col("a").alias("comp")).unionByName(both.select("h", F.col("b").alias("comp"))).distinct()
    docs = written(docs.join(used, ["h", "comp"]), "unfolded")
    through = docs.groupBy("doc").agg(F.collect_set("h").alias("hs"))
    da, db = (docs.join(through, "doc").select("h", F.col("comp").alias(c), *[F.col(n).alias(f"{s}{x}") for n, s in (
        ("doc", "d"), ("n", "n"), ("m", "m"), ("counts", "c"), ("hs", "h"))]) for c, x in zip("ab", "xy"))
    least = F.array_min(F.array_intersect("hx", "hy")) == F.col("h")
    # each row has all of its document's n-grams, which its files hold once: merged, as Spark would broadcast by their size
    met = both.join(da.hint("merge"), ["h", "a"]).join(db.hint("merge"), ["h", "b"])
    test(_pairs(F.col("dx"), F.col("dy"), met.filter(_fits(num, den) & least)))
    return links, comp


# --- the operator ------------------------------------------------------------

@dataclass
class Joined:
    """``members``: every document's (key, text_hash, n_shingles, class_id, component_id), where
    ``text_hash`` is Spark's ``xxhash64`` of the text; ``links``: (x, y) of
    representatives that link, enough of them to connect every component."""

    members: DataFrame
    links: DataFrame


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 75, den: int = 100) -> Joined:
    """Link all documents whose sets of ``k``-word n-grams have a Jaccard similarity of ``num / den`` or more.

    Words are runs of characters other than blank and tab to carriage return,
    A-Z lower-cased. A text of fewer than k words is one n-gram; a text without
    words, or null, has an empty set, a class of its own and no links. Rows with
    a null key have a size, but null class and component, and link with nothing.
    Rows with one key and different texts are separate documents, and equal rows
    get equal results. Only ``key`` (long) and ``text`` are read.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    known = rows.filter("key IS NOT NULL").withColumn("v", F.xxhash64("text"))
    spark = docs.sparkSession
    bounded_batches(spark)
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    info = written(_screen(known, k, num, den, n_shards), "screened")

    classes = info.filter("n > 0").groupBy("n", "d1", "d2").agg(
        F.min(F.struct("key", "v")).alias("rep"), F.max("shared").alias("shared"), F.count("*").alias("rows"))
    smallest = F.ceil(F.col("n") * num / den)
    able = classes.filter(F.col("shared") >= F.floor(smallest / EXTRA) + 1).select("rep.*")
    found = known.join(able, ["key", "v"])
    if info.groupBy("key", "v").count().filter("count > 1").limit(1).count():
        found = found.dropDuplicates(["key", "v"])
    with broadcasts_bounded(spark):
        packs = written(_packs(found.select("key", "text"), k), "sets")
        ordered = written(_ordered(packs, _frequencies(packs, n_shards), num, den), "ordered")
        links, comp = representative_links(ordered, num, den)

    # Class and component of every class that is not one document alone; the copies of a text are spread over tasks.
    ids = classes.select("n", "d1", "d2", "rows", F.col("rep.key").alias("class_id"))
    ids = ids.join(comp.withColumnRenamed("doc", "class_id"), "class_id", "left").filter("rows > 1 OR comp IS NOT NULL").drop("rows")
    with broadcasts_bounded(spark):
        ids = written(ids, "classes")
    own = salted_lookup(info, ids, ["n", "d1", "d2"], spread=F.xxhash64("key", "v"))
    own = own.withColumn("class_id", F.coalesce("class_id", "key"))
    out = own.select(
        F.col("key").alias(key), F.col("v").alias("text_hash"), F.col("n").alias("n_shingles"), "class_id",
        F.coalesce("comp", "class_id").alias("component_id"))
    return Joined(out.unionByName(_without_key(rows.filter("key IS NULL"), key, k)), links)


def _without_key(rows: DataFrame, key: str, k: int) -> DataFrame:
    def build():
        return lambda batch: [pa.array(np.diff(shingle_sets(*text_buffers(batch.column("text")), k)[1]), pa.int64())]

    null = F.lit(None).cast("long")
    return append_columns(rows, [T.StructField("n_shingles", T.LongType())], build, keep=["key", "text"]).select(
        F.col("key").alias(key), F.xxhash64("text").alias("text_hash"), "n_shingles", null.alias("class_id"), null.alias("component_id"))
