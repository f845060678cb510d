import numpy as np
import pytest
from pyspark.sql import functions as F

from notelink.llm import hard_negatives as hn


def brute(rows, positives=5, negatives=3):
    ok = sorted({(i, g, tuple(v)) for i, g, v in rows if i is not None and g is not None and v})
    out = []
    for i, g, v in ok:
        if i % 5:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, h) for j, h, w in ok if j != i and len(w) == len(v))
        for p, j, _ in [x for x in scored if x[2] == g][:positives]:
            fit = [(n, m) for n, m, h in scored if h != g and 50 * -p <= 100 * -n <= 95 * -p][:negatives]
            out += [(i, j, r, m, -p, -n) for r, (n, m) in enumerate(fit, 1)]
    return sorted(out)


def small(monkeypatch):
    for name, n in (("GROUP", 40), ("LEAF", 4), ("FAN", 3), ("ANCHORS", 5), ("ROOTS", 3)):
        monkeypatch.setattr(hn, name, n)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, label long, v array<long>")
    return sorted(tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % 5 == 0, **more).collect())


@pytest.mark.parametrize("seed,low,high", [(1, -3, 6), (2, 0, 9), (3, -9, 2)])
def test_equals_brute_force(spark, monkeypatch, seed, low, high):
    small(monkeypatch)
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(0, 4)), rng.integers(low, high, 6).tolist()) for i in range(260)]
    rows += [(i, int(rng.integers(0, 2)), rng.integers(-5, 9, 3).tolist()) for i in range(300, 340)]  # another length
    rows += [(500 + i, 1, [4, 4, 4, 4, 4, 4]) for i in range(90)] + [(600 + i, 2, [4, 4, 4, 4, 4, 4]) for i in range(50)]  # copies
    got = mined(spark, rows)
    assert got == brute(rows) and (got or high < 3)


def test_clusters_and_far_labels(spark, monkeypatch):
    small(monkeypatch)
    rng = np.random.default_rng(4)
    centres = rng.integers(-60, 60, (9, 16))
    rows = [(i, i % 3, (centres[i % 9] + rng.integers(-6, 7, 16)).tolist()) for i in range(400)]
    rows = [(i, g if i % 4 else 2**40 - g, v) for i, g, v in rows]
    assert mined(spark, rows, positives=3, negatives=2) == brute(rows, 3, 2)


def test_products_beyond_doubles(spark, monkeypatch):
    small(monkeypatch)
    rng = np.random.default_rng(6)
    rows = [(i, i % 2, (rng.integers(2**29, 2**30, 3) | 1).tolist()) for i in range(80)]
    assert mined(spark, rows) == brute(rows)


def test_left_out_rows_ties_and_empty_table(spark):
    v = [2, 1]
    rows = [(0, 1, v), (0, 1, v), (1, 1, v), (2, 1, [2, 1]), (3, 2, [1, 2]), (4, 2, [1, 2]), (6, None, v), (None, 1, v), (7, 2, None), (8, 2, []), (9, 3, [2, 0])]
    assert mined(spark, rows) == brute(rows) != []
    df = spark.createDataFrame(rows, "vec_id long, label long, v array<long>").withColumn("a", F.lit(1)).withColumn("slot", F.lit("x"))
    assert sorted(tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % 5 == 0).collect()) == brute(rows)
    assert hn.hard_negatives(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert hn.hard_negatives(df.filter("vec_id = 1"), F.col("vec_id") % 5 == 0).count() == 0


def test_ids_with_several_rows(spark, monkeypatch):
    small(monkeypatch)
    rng = np.random.default_rng(8)
    rows = [(int(i), int(rng.integers(0, 2)), rng.integers(0, 9, 5).tolist()) for i in rng.integers(1, 120, 240)]
    anchored = {i for i, _, _ in rows if i % 5 == 0}
    seen, once = set(), []
    for r in rows:  # an anchor is one row here; other ids have several
        if r[0] not in anchored or r[0] not in seen:
            once.append(r)
        seen.add(r[0])
    def scores(x):
        return sorted((a, p, r, ps, ns) for a, p, r, _, ps, ns in x)

    assert scores(mined(spark, once)) == scores(brute(once))


def test_tree_boxes_hold_their_rows_and_prune():
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.integers(-5, 5, (2000, 8)) + c for c in rng.integers(-200, 200, (8, 8))])
    label = np.repeat(np.arange(8), 2000)
    at = hn.str_order(label, v)
    assert sorted(at.tolist()) == list(range(len(v)))
    tree = hn.Tree(at, label[at], v[at])
    for level, (lo, hi, first, last) in enumerate(tree.levels):
        size = hn.LEAF * hn.FAN**level
        for n in range(len(lo)):
            rows = slice(n * size, (n + 1) * size)
            assert (tree.v[rows] >= lo[n]).all() and (tree.v[rows] <= hi[n]).all()
            assert first[n] <= tree.label[rows].min() and last[n] >= tree.label[rows].max()
    assert len(tree.levels[-1][0]) == 1
    visited: list = []
    best = hn.search(tree, v[77], 77, 0, True, [(hn.LOW, hn.HIGH)], [hn.LOW], 5, visited)[0]
    score = v @ v[77]
    want = sorted((-int(score[i]), i) for i in range(2000) if i != 77)[:5]
    assert best == [(-s, i) for s, i in want] and len(visited) < len(tree.levels[0][0]) / 4


def test_bounds_are_safe():
    rng = np.random.default_rng(2)
    lo = rng.integers(-9, 3, (30, 5))
    hi = lo + rng.integers(0, 7, (30, 5))
    q = rng.integers(-6, 7, 5)
    least, most = hn.bounds(lo, hi, q)
    for i in range(30):
        x = rng.integers(lo[i], hi[i] + 1, (40, 5)) @ q
        assert least[i] <= x.min() and x.max() <= most[i]
