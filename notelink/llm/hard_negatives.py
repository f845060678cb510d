"""Operator 12: hard negatives from a forest of STR-packed R-trees.

Rows are dealt to groups by sort-tile-recursive cuts of their first coordinates; a group is an
R-tree, packed by sort-tile-recursive too, with the label as its first
coordinate. The box around a node's vectors gives an interval for every term of
an inner product, so a least and a largest score of all rows below it.

An anchor searches a tree with a queue, the node of the largest score first. Nodes
are pruned whose labels do not fit, whose interval misses all its score windows, or
whose largest score is strictly below the k-th found. First it searches its home, the
group in which it lies itself; the k-th score found there goes with it to
the level above, the boxes of all groups, and then to the groups that can hold better.
All bounds are integers and safe, so results are exact: nothing is approximated or capped.

Anchors search twice: for positives (rows of their label, one open window), then for
negatives (rows of other labels, a window for each positive's score).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelink.llm.common import written

# Rows of a tree, of a leaf, and children of a node.
GROUP, LEAF, FAN = 16_384, 64, 16
# Slabs by the first and by the second coordinate, at most (cuts are fitted to the whole table).
SLABS = 64
# Anchors that one task searches a tree for, and groups whose boxes are tested together.
ANCHORS, ROOTS = 256, 256
LOW, HIGH = -(1 << 62), 1 << 62


# --- one tree ----------------------------------------------------------------

def str_order(label: np.ndarray, v: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The rows in the order of the leaves: sorted by label and cut into slabs, each
    slab by the next coordinate, those that vary most first."""
    keys = [label, *v.T[np.argsort(-v.astype(float).var(axis=0), kind="stable")]] if len(v) else [label]

    def sort(rows: np.ndarray, depth: int) -> list[np.ndarray]:
        rows = rows[np.argsort(keys[depth % len(keys)][rows], kind="stable")]
        leaves = -(-len(rows) // leaf)
        if leaves <= 1:
            return [rows]
        slabs = min(leaves, 4)
        size = -(-leaves // slabs) * leaf
        return [x for a in range(0, len(rows), size) for x in sort(rows[a:a + size], depth + 1)]

    return np.concatenate(sort(np.arange(len(label)), 0)) if len(label) else np.zeros(0, np.int64)


class Tree:
    """A packed R-tree over rows in leaf order; level 0 has the leaves' boxes, the last one root."""

    def __init__(self, ids: np.ndarray, label: np.ndarray, v: np.ndarray):
        self.ids, self.label, self.v = ids, label, v
        self.largest = float(np.abs(v).max(initial=0))
        at = np.arange(0, len(ids), LEAF)
        self.levels = [(np.minimum.reduceat(v, at), np.maximum.reduceat(v, at), np.minimum.reduceat(label, at), np.maximum.reduceat(label, at))]
        while len(self.levels[-1][0]) > 1:
            lo, hi, first, last = self.levels[-1]
            at = np.arange(0, len(lo), FAN)
            self.levels.append((np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)))
        self.doubles = None

    def arrays(self, q: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
        """Levels, vectors and query as doubles while these hold every sum exactly."""
        if self.largest * float(np.abs(q).max(initial=0)) * max(1, len(q)) >= 2.0**53:
            return self.levels, self.v, q
        if self.doubles is None:
            self.doubles = [(lo.astype(float), hi.astype(float), a, b) for lo, hi, a, b in self.levels], self.v.astype(float)
        return *self.doubles, q.astype(float)


def bounds(lo: np.ndarray, hi: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest inner product of ``q`` with vectors in each box."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return lo @ up + hi @ down, hi @ up + lo @ down


def fits(lo, hi, first, last, q, label: int, same: bool, windows: list[tuple[int, int]], floors: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which boxes can hold a row that counts, and their largest scores. ``floors``: a row of a window
    counts from this score on."""
    least, most = bounds(lo, hi, q)
    ok = (first <= label) & (label <= last) if same else (first != label) | (last != label)
    some = np.zeros(len(ok), bool)
    for (a, b), floor in zip(windows, floors):
        some |= (most >= max(a, floor)) & (least <= b)
    return ok & some, most


def search(tree: Tree, q: np.ndarray, own: int, label: int, same: bool, windows: list[tuple[int, int]], floors: list[int], k: int,
           visited: list | None = None) -> list[list[tuple[int, int]]]:
    """For each window the best k (score, id), by score, then the smaller id, of the rows of
    the label (or of the others) without the id ``own``, as far as they reach the window's floor."""
    levels, v, q = tree.arrays(q)
    floors, best = list(floors), [[] for _ in windows]
    top = max(b for _, b in windows)
    queue: list[tuple] = []

    def push(level: int, a: int, b: int) -> None:
        lo, hi, first, last = (x[a:b] for x in levels[level])
        ok, most = fits(lo, hi, first, last, q, label, same, windows, floors)
        for i in np.flatnonzero(ok):
            heapq.heappush(queue, (-min(int(most[i]), top), level, a + int(i), int(most[i])))

    push(len(levels) - 1, 0, len(levels[-1][0]))
    while queue:
        _, level, node, most = heapq.heappop(queue)
        if all(most < max(a, floor) for (a, _), floor in zip(windows, floors)):
            continue
        if level:
            push(level - 1, node * FAN, min((node + 1) * FAN, len(levels[level - 1][0])))
            continue
        rows = slice(node * LEAF, (node + 1) * LEAF)
        if visited is not None:
            visited.append(node)
        score = (v[rows] @ q).astype(np.int64)
        ids = tree.ids[rows]
        ok = ((tree.label[rows] == label) == same) & (ids != own)
        for w, (a, b) in enumerate(windows):
            new = np.flatnonzero(ok & (score >= max(a, floors[w])) & (score <= b))
            if len(new):
                best[w] = sorted([*best[w], *zip(score[new].tolist(), ids[new].tolist())], key=lambda x: (-x[0], x[1]))[:k]
                if len(best[w]) == k:
                    floors[w] = max(floors[w], best[w][-1][0])
    return best


# --- groups ------------------------------------------------------------------

def _above(x: Column, cuts: list) -> Column:
    """How many of the cuts lie below x."""
    return F.size(F.filter(F.lit(cuts).cast("array<long>"), lambda c: c < x)) if cuts else F.lit(0)


def _tiles(rows: DataFrame) -> Callable[[Column], Column]:
    """The tile of a vector: a slab by its first coordinate, and within it one by its second. Equal numbers of
    rows, about; at most ``SLABS`` squared tiles, whatever the table's size."""
    n = rows.count()
    tiles = min(SLABS * SLABS, max(1, -(-n // GROUP)))
    across = math.ceil(math.sqrt(tiles))
    down = -(-tiles // across)

    def cuts(x: Column, parts: int) -> Column:
        return F.percentile_approx(x, [i / parts for i in range(1, parts)], 1000) if parts > 1 else F.array().cast("array<long>")

    x, y = F.col("v")[0], F.try_element_at("v", F.lit(2))
    first = rows.agg(cuts(x, across).alias("c")).first().c or []
    second = {r.s: r.c or [] for r in rows.groupBy(_above(x, first).alias("s")).agg(cuts(y, down).alias("c")).collect()} if down > 1 else {}
    inner = [list(second.get(s, [])) for s in range(across)]

    def tile(v: Column) -> Column:
        slab = _above(v[0], first)
        if not second:
            return slab
        own = F.element_at(F.lit(inner).cast("array<array<long>>"), slab + 1)
        return slab * down + F.size(F.filter(own, lambda c: c < F.coalesce(F.try_element_at(v, F.lit(2)), F.lit(0))))

    return tile


def _grouped(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` (dim, tile, id) with their group; a tile of too many rows is several groups."""
    return rows.join(counts, ["dim", "tile"], "left").withColumn(
        "slot", F.xxhash64("dim", "tile", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))))).drop("parts", "tile")


_TREES = "slot long, dim int, ids binary, labels binary, matrix binary, lo array<long>, hi array<long>, first long, last long"


def _trees(entries: DataFrame) -> DataFrame:
    """One packed tree per group, with its box and its range of labels."""

    def pack(group, pdf):
        v = np.stack(pdf["v"].to_numpy()).astype(np.int64)
        label, ids = pdf["label"].to_numpy(np.int64), pdf["id"].to_numpy(np.int64)
        at = str_order(label, v)
        v, label, ids = v[at], label[at], ids[at]
        narrow = v.astype(np.int32) if np.abs(v).max() < 2**31 else v
        return pd.DataFrame([(group[0], v.shape[1], ids.tobytes(), label.tobytes(), narrow.tobytes(), v.min(axis=0), v.max(axis=0),
                              int(label.min()), int(label.max()))],
                            columns=["slot", "dim", "ids", "labels", "matrix", "lo", "hi", "first", "last"])

    return entries.groupBy("slot").applyInPandas(pack, _TREES)


# --- searching them ----------------------------------------------------------

_PROBE = "a long, id long, label long, v array<long>, windows array<struct<lo:long,hi:long>>, floors array<long>"


def _met(sides: DataFrame, probes: DataFrame, load: Callable, each: Callable, schema: str) -> DataFrame:
    """``each(load(row), probes)`` for every row of ``sides`` and the probes of its ``slot``.

    Rows and probes meet sorted, the row first: a task holds one of ``sides`` at a time, and its probes
    come in batches. Sides without probes are not sent; a side of many is copied for every ``ANCHORS`` of them.
    """
    load_names = [c for c in sides.columns if c != "slot"]
    probe_names = [c for c in probes.columns if c != "slot"]
    counts = written(probes.groupBy("slot").agg(F.ceil(F.count("*") / ANCHORS).cast("int").alias("copies")), "probe-counts")
    dealt = probes.join(counts, "slot").withColumn("copy", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int")).drop("copies")
    copied = sides.join(counts, "slot").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    both = copied.select("slot", "copy", F.lit(0).alias("kind"), F.struct(*load_names).alias("side")).unionByName(
        dealt.select("slot", "copy", F.lit(1).alias("kind"), F.struct(*probe_names).alias("probe")), allowMissingColumns=True)
    parts = int(sides.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(parts, "slot", "copy").sortWithinPartitions("slot", "copy", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            edges = [*np.flatnonzero(np.diff(np.concatenate([[0], kind])) | (kind == 0)).tolist(), batch.num_rows]
            if not edges or edges[0]:
                edges = [0, *edges]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if kind[a] == 0:
                    now = load(batch.column("side")[a].as_py())
                else:
                    yield from each(now, batch.column("probe").slice(a, b - a).to_pylist())

    return both.mapInArrow(run, schema)


def _load_tree(r: dict) -> Tree:
    ids, label = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
    size = len(r["matrix"]) // max(1, len(ids) * r["dim"])
    return Tree(ids, label, np.frombuffer(r["matrix"], np.int32 if size == 4 else np.int64).reshape(len(ids), -1).astype(np.int64))


def _searched(trees: DataFrame, probes: DataFrame, same: bool, k: int) -> DataFrame:
    """(a, w, score, id): what each probe finds in the tree of its slot, for each of its windows."""

    def each(tree: Tree, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        out = []
        for r in rows:
            windows = [(w["lo"], w["hi"]) for w in r["windows"]]
            found = search(tree, np.array(r["v"], np.int64), r["id"], r["label"], same, windows, r["floors"], k)
            out += [(r["a"], w, s, i) for w, own in enumerate(found) for s, i in own]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                                             names=["a", "w", "score", "id"])

    return _met(trees, probes, _load_tree, each, "a long, w int, score long, id long")


def _reached(trees: DataFrame, probes: DataFrame, same: bool) -> DataFrame:
    """The probes with every other group whose box can hold a row that counts: the forest's upper level."""
    block = F.pmod("slot", F.ceil(F.lit(trees.count()) / ROOTS)).cast("int")
    roots = trees.select("dim", block.alias("block"), F.struct("slot", "lo", "hi", "first", "last").alias("root"))
    roots = written(roots.groupBy("dim", "block").agg(F.collect_list("root").alias("roots")).withColumn("slot", F.xxhash64("dim", "block")), "roots")
    # Every anchor meets the boxes of its length, a block of them at a time.
    blocks = roots.groupBy("dim").agg(F.collect_list("slot").alias("slots"))
    asked = probes.withColumn("dim", F.size("v")).join(F.broadcast(blocks) if roots.count() < ROOTS else blocks, "dim")
    asked = asked.withColumn("home", F.col("slot")).withColumn("slot", F.explode("slots")).drop("slots", "dim")

    def load(r: dict) -> tuple:
        own = r["roots"]
        return (np.array([x["slot"] for x in own]), *[np.array([x[n] for x in own], np.int64) for n in ("lo", "hi", "first", "last")])

    def each(boxes: tuple, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        slot, lo, hi, first, last = boxes
        i, j = [], []
        for n, r in enumerate(rows):
            windows = [(w["lo"], w["hi"]) for w in r["windows"]]
            ok, _ = fits(lo, hi, first, last, np.array(r["v"], np.int64), r["label"], same, windows, r["floors"])
            at = np.flatnonzero(ok & (slot != r["home"]))
            i += [n] * len(at)
            j += slot[at].tolist()
        if i:
            t = pa.Table.from_pylist([{c: r[c] for c in ("a", "id", "label", "v", "windows", "floors")} for r in rows], _ARROW)
            yield from t.take(pa.array(i)).append_column("slot", pa.array(j, pa.int64())).combine_chunks().to_batches()

    return _met(roots.select("slot", "roots"), asked, load, each, _PROBE + ", slot long")


_ARROW = pa.schema([("a", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("v", pa.list_(pa.int64())),
                    ("windows", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), ("floors", pa.list_(pa.int64()))])


def _best(trees: DataFrame, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """(a, w, rank, score, id): the best k rows of every window of every anchor (a, id, label, v, slot, windows)."""
    names = ["a", "id", "label", "v", "windows", "floors", "slot"]
    none = F.transform("windows", lambda w: F.lit(LOW).cast("long"))
    home = written(_searched(trees, anchors.withColumn("floors", none).select(*names), same, k), "home")
    kth = home.groupBy("a", "w").agg(F.min("score").alias("floor"), F.count("*").alias("n")).filter(F.col("n") == k)
    kth = kth.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("w", "floor"))).alias("kth"))
    floors = F.transform("windows", lambda w, i: F.coalesce(F.try_element_at("kth", i), F.lit(LOW).cast("long")))
    known = anchors.join(kth, "a", "left").withColumn("floors", floors).select(*names)
    away = _searched(trees, written(_reached(trees, known, same), "reached"), same, k)
    rank = F.row_number().over(Window.partitionBy("a", "w").orderBy(F.desc("score"), "id"))
    return home.unionByName(away).withColumn("rank", rank).filter(F.col("rank") <= k)


def _percent(p: int, x: Column) -> Column:
    """floor(p * x / 100) in whole numbers; no product is larger than ``x`` if p is at most 100."""
    rest = F.pmod(x, F.lit(100))
    whole = F.call_function("div", x - rest, F.lit(100))
    small = p * rest
    return p * whole + F.call_function("div", small - F.pmod(small, F.lit(100)), F.lit(100))


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   key: str = "vec_id", label: str = "label", vector: str = "v") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor its first
    ``positives`` other rows of the same label, and for each of these the first ``negatives`` rows of other
    labels whose score lies within ``low`` and ``high`` percent of the positive's.

    ``vectors`` holds ``key`` and ``label`` (long) and ``vector`` (array of long). Score: inner product with
    the anchor, higher first, ties to the smaller key; it must fit in 64 bits. Rows with
    a null key, label or vector, or an empty vector, take no part; only vectors of equal length are
    compared; equal rows count once; a row with the anchor's own key is neither its positive nor its
    negative. Fewer than asked for are all returned, and a positive without negatives has no row.
    Other columns are not read.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"),
                          F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND size(v) > 0").distinct().withColumn("dim", F.size("v"))
    rows = written(rows, "vectors")
    # Of rows with equal label and vector, only those with the smallest ids can be among the best (one may be the anchor's own).
    nth = F.row_number().over(Window.partitionBy("label", "v").orderBy("id"))
    entries = rows.select("dim", "id", "label", "v").withColumn("n", nth).filter(F.col("n") <= max(positives, negatives) + 1).drop("n")
    tile = _tiles(entries)
    entries = written(entries.withColumn("tile", tile(F.col("v"))), "entries")
    counts = written(entries.groupBy("dim", "tile").agg(F.ceil(F.count("*") / GROUP).alias("parts")), "tiles")
    trees = written(_trees(_grouped(entries, counts)), "trees")
    anchors = rows.filter("is_anchor").withColumn("tile", tile(F.col("v"))).withColumn("a", F.monotonically_increasing_id())
    anchors = written(_grouped(anchors, counts).select("a", "id", "label", "v", "slot"), "anchors")

    def window(lo: Column, hi: Column) -> Column:
        return F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))

    every = anchors.withColumn("windows", F.array(window(F.lit(LOW), F.lit(HIGH))))
    good = written(_best(trees, every, True, positives).select("a", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")),
                   "positives")
    # The windows of each anchor: one for each score of a positive.
    s = F.col("positive_score")
    ranges = good.select("a", window(-_percent(-low, s), _percent(high, s)).alias("w"), "positive_score").distinct()
    ranges = ranges.filter("w.lo <= w.hi").groupBy("a").agg(F.sort_array(F.collect_set("w")).alias("windows"))
    ranges = written(ranges, "windows")
    bad = _best(trees, anchors.join(ranges, "a"), False, negatives).select(
        "a", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    at = ranges.select("a", F.posexplode("windows").alias("w", "range"))
    found = good.drop("rank").withColumn("range", window(-_percent(-low, s), _percent(high, s))).join(at, ["a", "range"]).join(bad, ["a", "w"])
    return found.join(anchors.select("a", F.col("id").alias("anchor_id")), "a").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
