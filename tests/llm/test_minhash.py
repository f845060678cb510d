import random

import numpy as np
import pytest

from notelink.llm import minhash as mh
from notelink.llm.common import _MUL, mix
from notelink.llm.jaccard import shingle_sets
from tests.llm.test_jaccard import sets


def brute(docs, k=4, percent=80):
    """(n_shingles, class_id, component_id) of rows (id, text) with distinct ids."""
    own = {i: frozenset(sets(t, k)) for i, t in docs}
    comp = {i: i for i in own}

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(own)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            o = len(own[a] & own[b])
            if o and 100 * o >= percent * len(own[a] | own[b]):
                x, y = top(a), top(b)
                comp[max(x, y)] = min(x, y)
    same = {}
    for i in ids:
        same.setdefault(own[i] or i, i)
    return {i: (len(own[i]), same[own[i] or i], top(i)) for i in ids}


def corpus(seed, families=10, most=9):
    """Families of near copies at similarities on both sides of the threshold, chains, short texts."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randint(0, 500)
    docs = []
    for _ in range(families):
        base = [word() for _ in range(rng.choice([3, 4, 9, 30, 80, 200]))]
        docs.append(" ".join(base))
        for _ in range(rng.randint(1, most)):
            near = base[:]
            for _ in range(rng.randint(0, 1 + len(base) // 30)):
                near[rng.randrange(len(near))] = word()
            docs.append("  ".join(near) if rng.random() < 0.2 else " ".join(near).upper() if rng.random() < 0.2 else " ".join(near))
            if rng.random() < 0.4:
                base = near
    docs += ["a b", "A\tb", "a b c", "a b c d", "", " \n", None, "one", "One"]
    rng.shuffle(docs)
    return list(enumerate(docs, 5))


def result(df):
    return {r.doc_id: (r.n_shingles, r.class_id, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    docs = corpus(seed)
    got = mh.minhash_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    want = brute(docs)
    assert result(got) == want
    assert {r.doc_id: r.kept for r in got.collect()} == {i: i == c for i, (_, _, c) in want.items()}


def test_one_large_group(spark):
    """A group of near copies that its middle connects in part only."""
    rng = random.Random(7)
    base = ["w%d" % rng.randint(0, 900) for _ in range(90)]
    docs = []
    for i in range(150):
        near = base[:]
        for _ in range(rng.randint(0, 6)):
            near[rng.randrange(90)] = "x%d" % rng.randint(0, 10**6)
        docs.append((i, " ".join(near)))
    docs += [(1000 + i, " ".join(base)) for i in range(60)] + [(2000 + i, "lone %d text of its own words %d" % (i, i * i)) for i in range(40)]
    assert result(mh.minhash_dedup(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_coordinates_are_one_permutation_shifted():
    """Coordinate c is the least value of one permutation at places that the first one gives, moved by c."""
    h = np.sort(np.random.default_rng(3).integers(0, 2**64, 50, np.uint64))
    sig = mh.signatures(h, np.array([0, 20, 20, 50]), 16)
    assert not sig[1].any()
    place = mh.mix(h ^ mh._SIGMA)
    for c in range(16):
        rank = mix(place + mh._PI + np.uint64(c) - _MUL)  # mix adds the constant itself
        assert sig[0, c] == rank[:20].min() and sig[2, c] == rank[20:].min()


def test_share_of_equal_coordinates_estimates_similarity():
    h = np.random.default_rng(5).integers(0, 2**64, 3000, np.uint64)
    a, b = np.sort(h[:2400]), np.sort(h[300:])
    sig = mh.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 512)
    assert abs((sig[0] == sig[1]).mean() - 2100 / 3000) < 0.09


def test_lone_ngrams(spark):
    sets = {1: [1, 2, 3], 2: [2, 3, 4, 5], 3: [9], 4: [3]}
    df = spark.createDataFrame([(c, np.array(g, np.uint64).tobytes()) for c, g in sets.items()], "c long, grams binary")
    assert {r.c: r.lone for r in mh._lone(df).collect()} == {1: 1, 2: 2, 3: 1}


def test_a_large_group_makes_few_pairs(spark, monkeypatch):
    """Near copies too far from the middle to link, and from each other: no pair of them is compared."""
    rng = random.Random(3)
    base = ["w%d" % i for i in range(120)]
    docs = []
    for _ in range(400):
        near = base[:]
        for _ in range(rng.choice([1, 1, 2, 6, 7, 8])):
            near[rng.randrange(120)] = "x%d" % rng.randint(0, 10**9)
        docs.append(" ".join(near))
    seen = []
    old = mh.written

    def spy(df, name, *more):
        out = old(df, name, *more)
        if name == "pairs":
            seen.append(out.count())
        return out

    monkeypatch.setattr(mh, "written", spy)
    docs = list(enumerate(docs))
    assert result(mh.minhash_dedup(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)
    assert sum(seen) < 2 * len(docs)


def test_nulls_repeats_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d e", "x", 0), (1, "a b c d e", "y", 1), (1, "other words than those here", "z", 2), (None, "a b c d e", "n", 3), (4, None, "", 4),
         (5, "A B C D E", "", 5)], "doc_id long, text string, component_id string, c long")
    got = sorted(((r.doc_id, r.n_shingles, r.class_id, r.component_id, r.kept) for r in mh.minhash_dedup(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1, 1, True)] * 3 + [(None, 2, None, None, None), (4, 0, 4, 4, True), (5, 2, 1, 1, False)], key=str)
    empty = mh.minhash_dedup(docs.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text_hash", "n_shingles", "class_id", "component_id", "kept"]


def test_very_long_text(spark):
    rng = random.Random(1)
    long = [str(rng.randint(0, 10**6)) for _ in range(150_000)]
    near = long[:]
    for _ in range(3000):
        near[rng.randrange(len(near))] = "z%d" % rng.randint(0, 10**6)
    docs = [(1, " ".join(near)), (2, " ".join(long)), (3, " ".join(long[:60_000]))]
    assert result(mh.minhash_dedup(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_shingles_have_four_words():
    text = b"a b c d e"
    h, first = shingle_sets(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 4)
    assert len(h) == 2 and list(first) == [0, 2]


def test_bitmaps_bound_the_overlap():
    h = np.random.default_rng(9).integers(0, 2**64, 400, np.uint64)
    a, b = np.sort(h[:300]), np.sort(h[60:])
    x, y = mh._bitmaps(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])).view(np.uint8)
    only = int(np.unpackbits(x & ~y).sum())
    assert 240 <= len(a) - only < 260 and only <= 60
