import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelink.llm import phrases as ph


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def pieces(t):
    return [[w for w in re.split("[ \t]", p) if w] for p in re.split("[.,;:!?\n\x0b\x0c\r]", low(t))]


def brute(docs, min_count=10, longest=3, top=2000, inside=50):
    out = []
    for lang in {g or "und" for _, _, g in docs}:
        f, n = Counter(), 0
        for _, t, g in docs:
            if (g or "und") == lang:
                for w in pieces(t):
                    n += len(w)
                    f.update(tuple(w[i:i + s]) for s in range(1, longest + 1) for i in range(len(w) - s + 1))
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        rows = []
        for p, a in cand.items():
            if any(100 * b >= inside * a for q, b in cand.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]], k))
        out += [(lang, r, p.decode(), -a, lf, rf, n, -s, k) for r, (s, a, p, lf, rf, k) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def corpus(seed, docs=120):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(40)] + ["Über", "naïve", "don't", "-", "a" * 70]
    fixed = [[rng.choice(words) for _ in range(rng.randint(2, 6))] for _ in range(12)]
    out = []
    for i in range(docs):
        text = []
        for _ in range(rng.randint(0, 30)):
            text += rng.choice(fixed) if rng.random() < 0.5 else [rng.choice(words)]
            text.append(rng.choice([" ", "  ", "\t", " ", " ", ". ", ",", "!\n", " ? "]))
        t = "".join(x if x.strip(" \t\n.,!?") == "" else " " + x for x in text)
        out.append((i, rng.choice([t, t.upper(), t, t]), rng.choice(["en", "de", "en", None])))
    return out + [(1000, None, "en"), (1001, "", None), (1002, "one", "xx"), (1003, " .,;", "yy")]


def mined(spark, docs, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    return sorted(tuple(r) for r in ph.mine_phrases(df, **more).collect())


@pytest.mark.parametrize("seed,more", [
    (1, {}), (2, dict(min_count=4)), (3, dict(min_count=3, longest=4, inside=80)), (4, dict(min_count=5, longest=2, top=7)),
    (5, dict(min_count=4, sample_one_in=1)), (6, dict(min_count=4, sample_one_in=1_000_000))])
def test_equals_brute_force(spark, monkeypatch, seed, more):
    if seed % 2:
        monkeypatch.setattr(ph, "FLUSH_WORDS", 200)
        monkeypatch.setattr(ph, "SEND_ROWS", 17)
    docs = corpus(seed)
    want = brute(docs, **{k: v for k, v in more.items() if k != "sample_one_in"})
    assert mined(spark, docs, **more) == want != []


def test_crowded_filters_change_nothing(spark, monkeypatch):
    """Phrases that seem proposed by chance are counted, and their counts decide."""
    monkeypatch.setattr(ph, "FILTER_BITS", 64)
    docs = corpus(8)
    assert mined(spark, docs, min_count=4) == brute(docs, 4)


def test_border_failures_are_closed_by_an_expansion_pass(spark):
    """A sample without documents proposes nothing: all frequent words fail, then pairs and triples of them are counted."""
    docs = corpus(9)
    rows = spark.createDataFrame(docs, "key long, text string, lang string")
    found, passes = ph.frequent_phrases(rows, 4, 3, sample_one_in=1_000_000_007)
    assert passes == 2
    got = {(r.lang or "und", r.phrase): r.f for r in found.filter("size > 0").collect()}
    f = Counter()
    for _, t, g in docs:
        for w in pieces(t):
            f.update(((g or "und"), " ".join(w[i:i + s])) for s in (1, 2, 3) for i in range(len(w) - s + 1))
    assert got == {p: n for p, n in f.items() if n >= 4}
    # everything is in the sample: no failure
    _, passes = ph.frequent_phrases(rows, 4, 3, sample_one_in=1)
    assert passes == 1


@pytest.mark.parametrize("longest,sample", [(3, 7), (4, 1_000_000_007), (5, 3)])
def test_no_phrase_is_counted_twice_or_left_out(spark, longest, sample):
    docs = corpus(10)
    rows = spark.createDataFrame(docs, "key long, text string, lang string").repartition(4)
    found, _ = ph.frequent_phrases(rows, 3, longest, sample_one_in=sample)
    got = [(r.lang or "und", r.phrase, r.f) for r in found.filter("size > 0").collect()]
    f = Counter()
    for _, t, g in docs:
        for w in pieces(t):
            f.update(((g or "und"), " ".join(w[i:i + s])) for s in range(1, longest + 1) for i in range(len(w) - s + 1))
    assert sorted(got) == sorted((*p, n) for p, n in f.items() if n >= 3)


def test_runs_of_words_as_numbers_and_by_place():
    rng = np.random.default_rng(1)
    word = rng.integers(0, 9, 400)
    i = np.flatnonzero(rng.random(395) < 0.7)
    want = Counter(tuple(word[x:x + 3].tolist()) for x in i)
    for known in (9, 1 << 22):
        places, n = ph._distinct(word.astype(np.int64), i, 3, known)
        assert {tuple(int(p[j]) for p in places): int(c) for j, c in enumerate(n)} == want


def test_infrequent_words_make_no_longer_phrases(spark):
    """Only phrases whose parts are proposed are counted."""
    rng = random.Random(2)
    docs = [(i, " ".join("u%d" % rng.randint(0, 10**9) for _ in range(200)) + " often seen here", "en") for i in range(60)]
    rows = spark.createDataFrame(docs, "key long, text string, lang string")
    now = ph.Proposals([1, 2])
    got = ph._counted(rows, [2, 3], now, None, False)
    assert got.count() == 0
    now, new = now.grow(spark.createDataFrame([("en", "often", 1), ("en", "seen", 1), ("en", "often seen", 2), ("en", "seen here", 2)],
                                              "lang string, phrase string, size int"))
    got = {(r.phrase, r.c) for r in ph._counted(rows, [2, 3], now, None, False).groupBy("phrase").agg(F.sum("c").alias("c")).collect()}
    assert new and got == {("often seen", 60), ("often seen here", 60)}
    assert not now.grow(spark.createDataFrame([("en", "seen", 1)], "lang string, phrase string, size int"))[1]


def test_products_past_64_bits(spark):
    counts = [("x y", 2, 3_000_000_000), ("x", 1, 4_000_000_000), ("y", 1, 5_000_000_000), ("", 0, 2**40)]
    df = spark.createDataFrame([("en", p, s, f) for p, s, f in counts], "lang string, phrase string, size int, f long")
    old = ph.frequent_phrases
    try:
        ph.frequent_phrases = lambda *a: (df, 1)
        got = ph.mine_phrases(spark.createDataFrame([(1, "", "en")], "doc_id long, text string, lang string")).collect()
    finally:
        ph.frequent_phrases = old
    assert [(r.a, r.l, r.r, r.n, r.score) for r in got] == [
        (3 * 10**9, 4 * 10**9, 5 * 10**9, 2**40, 1_000_000 * (3 * 10**9) ** 2 // (20 * 10**18))]


def test_repeated_rows_clashing_columns_and_empty_table(spark):
    docs = [(1, "big red bus. big red bus", "en")] * 5 + [(None, "big red bus", "en")] * 2
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("phrase", F.lit(1)).withColumn("rank", F.lit("x"))
    got = sorted(tuple(r) for r in ph.mine_phrases(df).collect())
    assert got == brute(docs) == [("en", 1, "big red bus", 12, 12, 12, 36, 1_000_000, 1)]
    empty = ph.mine_phrases(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score", "k"]


def test_long_text_and_words_are_cut_like_the_rules():
    text = "Ab\tcd, ef  gh\x0bij é! " * 3 + "x" * 500
    raw = text.encode()
    a, b, row, follows = ph._cut(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert [low(raw[i:j].decode()) for i, j in zip(a, b)] == [w for p in pieces(text) for w in p]
    runs, at = [], 0
    for i, ok in enumerate(follows):
        if not ok:
            runs.append(i + 1 - at)
            at = i + 1
    assert runs == [len(p) for p in pieces(text) if p] and not row.any()
