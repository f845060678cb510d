import numpy as np
import pytest
from pyspark.sql import functions as F

from notelink.llm import topk as tk


def brute(rows, k):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v}
    out = []
    for q in sorted({(i, v) for i, v in ok if i % 5 == 0}):
        scored = sorted((-sum(a * b for a, b in zip(q[1], v)), i) for i, v in ok if i != q[0] and len(v) == len(q[1]))
        out += [(q[0], r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed,parts", [(1, 2), (2, 3), (3, 1)])
def test_equals_brute_force_with_ties_copies_and_lengths(spark, monkeypatch, seed, parts):
    monkeypatch.setattr(tk, "CANDIDATES", 30)
    monkeypatch.setattr(tk, "QUERIES", 7)
    rng = np.random.default_rng(seed)
    rows = [(i, rng.integers(-4, 5, 6).tolist()) for i in range(150)] + [(i, rng.integers(-9, 9, 3).tolist()) for i in range(150, 158)]
    rows += [(i, [1, 2, 3, 0, 0, 1]) for i in range(200, 260)] + [(300, [7, 7]), (305, [2**30, -(2**30)]), (310, [2**31, 2**29])]
    rows += [rows[0], (None, [1] * 6), (400, None), (405, [])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = tk.top_k(df, F.col("vec_id") % 5 == 0, k=4, parts=parts).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 4)


def test_scaling_and_left_out_vectors(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, [0.5, -0.001]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, None), (6, [])],
                               "vec_id long, e array<float>")
    got = {r.vec_id: r.v for r in df.select("vec_id", tk.scaled("e").alias("v")).collect()}
    assert got == {1: [128, -1], 2: None, 3: None, 4: None, 5: None, 6: None}


def test_few_candidates_and_empty_table(spark):
    df = spark.createDataFrame([(0, [1, 1]), (1, [2, 2]), (50, [1, 1])], "vec_id long, v array<long>")
    got = sorted(tuple(r) for r in tk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 1, 4), (0, 2, 50, 2), (50, 1, 1, 4), (50, 2, 0, 2)]
    assert tk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_ids_with_several_vectors(spark, monkeypatch, seed):
    monkeypatch.setattr(tk, "CANDIDATES", 30)
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.integers(-4, 5, 6).tolist()) for i in rng.integers(0, 60, 200)] + [(0, [9 - j, 9, 9, 9, 9, 9]) for j in range(12)]
    rows += [(7, [8, 8, 8, 0, 0, 0]), (7, [0, 0, 0, 8, 8, 8])]
    got = tk.top_k(spark.createDataFrame(rows, "vec_id long, v array<long>"), F.col("vec_id") % 5 == 0, k=4).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 4)


@pytest.mark.parametrize("few", [True, False])
def test_copies_of_query_blocks_are_not_broadcast(spark, monkeypatch, few):
    monkeypatch.setattr(tk, "CANDIDATES", 20)
    if not few:
        monkeypatch.setattr(tk, "QUERY_BYTES", 0)
    plans, nodes = [], tk._nodes

    def seen(pairs, emit):
        plans.append(pairs._jdf.queryExecution().sparkPlan().toString())
        return nodes(pairs, emit)

    monkeypatch.setattr(tk, "_nodes", seen)
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-4, 5, 6).tolist()) for i in range(150)]
    got = tk.top_k(spark.createDataFrame(rows, "vec_id long, v array<long>"), F.col("vec_id") % 5 == 0, k=4).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 4)
    # Spark estimates copies as one: it must not be the one to decide
    assert len(plans) == 2
    assert all(("BroadcastHashJoin" in p) == few and ("Generate" in p) != few for p in plans)
