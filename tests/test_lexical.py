import math
import random

import pytest

from notelink.functions import similarity as sm
from notelink.functions.text import normalize_py
from notelink.operators import lexical as lx


def test_similarity_goldens():
    assert round(sm.levenshtein_sim("fibre", "fiebre"), 4) == 0.8333
    assert sm.jaro_winkler("abcd", "axyz") == 0.5
    assert round(sm.jaro_winkler("dixon", "dicksonx"), 4) == 0.8133
    assert sm.token_sort("alta fiebre", "fiebre alta") == 1.0
    assert sm.token_set("alta fiebre", "fiebre") == 1.0


def test_method_and_threshold_checks():
    assert lx.canonical_method("token_sort_ratio") == "token-sort-ratio"
    with pytest.raises(ValueError):
        lx.canonical_method("cosine")
    with pytest.raises(ValueError):
        lx.check_threshold(1.5)


def _gaz(spark, terms):
    return spark.createDataFrame([(i, t, f"C{i}") for i, t in enumerate(terms)], "gaz_ord long, term string, code string")


def _brute(span, terms, method, threshold):
    m = normalize_py(span)
    seen, g1 = set(), []
    for i, t in enumerate(terms):
        if t not in seen:
            seen.add(t)
            g1.append((i, t, normalize_py(t)))
    last = {}
    for i, t, n in g1:
        last[n] = (t, f"C{i}")
    if m in last:
        return last[m][1], last[m][0], 1.0
    fn = sm.SCORERS[method]
    best = max(g1, key=lambda x: (round(fn(m, x[2]), 6), -x[0]))
    score = round(fn(m, best[2]), 6)
    if score >= threshold:
        t, c = last[best[2]]
        return c, t, score
    return "NO_MAP", span, score


@pytest.mark.parametrize("method", list(lx.METHODS))
def test_fuzzy_exact_against_brute_force(spark, method):
    rnd = random.Random(hash(method) % 1000)
    alphabet = "abcde "
    terms = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 9))).strip() or "a" for _ in range(40)]
    terms += ["Abc", "abc", "zz top"]
    spans = ["".join(rnd.choice(alphabet + "xy") for _ in range(rnd.randint(1, 10))).strip() or "b" for _ in range(60)]
    spans += ["qqqqqqq", "abc", "top zz"]
    ms = spark.createDataFrame([(i, s) for i, s in enumerate(spans)], "ord long, span string")
    got = {r["ord"]: (r["code"], r["term"], r["nel_score"]) for r in lx.link_fuzzy(ms, _gaz(spark, terms), method, 0.7).collect()}
    for i, s in enumerate(spans):
        assert got[i] == _brute(s, terms, method, 0.7), (method, s)


def _bm25_brute(span, terms):
    m = normalize_py(span)
    seen, g1 = set(), []
    for i, t in enumerate(terms):
        if t not in seen:
            seen.add(t)
            g1.append((i, t, normalize_py(t)))
    last = {n: (t, f"C{i}") for i, t, n in g1}
    if m in last:
        return last[m][1], 1.0
    docs = [n.split() for _, _, n in g1]
    N = len(docs)
    avgdl = sum(len(d) for d in docs) / N
    df = {}
    for d in docs:
        for w in set(d):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(N - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    eps = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: (eps if v < 0 else v) for w, v in idf.items()}
    scores = []
    for d in docs:
        sc = 0.0
        for q in m.split():
            tf = d.count(q)
            sc += idf.get(q, 0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / avgdl))
        scores.append(round(sc, 6))
    best = max(range(N), key=lambda j: (scores[j], -j))
    return last[g1[best][2]][1], scores[best]


def test_bm25_golden_zero_overlap(spark):
    ms = spark.createDataFrame([(0, "xyz")], "ord long, span string")
    r = lx.link_bm25(ms, _gaz(spark, ["dolor", "tos seca"])).first()
    assert (r["code"], r["nel_score"]) == ("C0", 0.0)


@pytest.mark.parametrize("first,growth", [(64, 8), (1, 2), (3, 4)])
def test_bm25_against_brute_force(spark, monkeypatch, first, growth):
    monkeypatch.setattr(lx, "FIRST_LEVEL", first)
    monkeypatch.setattr(lx, "GROWTH", growth)
    rnd = random.Random(5)
    vocab = ["dolor", "tos", "seca", "fiebre", "alta", "baja", "cabeza", "pecho"]
    terms = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 3))) for _ in range(30)]
    spans = [" ".join(rnd.choice(vocab + ["xx"]) for _ in range(rnd.randint(1, 4))) for _ in range(50)]
    ms = spark.createDataFrame([(i, s) for i, s in enumerate(spans)], "ord long, span string")
    got = {r["ord"]: (r["code"], r["nel_score"]) for r in lx.link_bm25(ms, _gaz(spark, terms)).collect()}
    for i, s in enumerate(spans):
        assert got[i] == _bm25_brute(s, terms), s


def test_bm25_many_terms_ties_and_repeated_tokens(spark, monkeypatch):
    """Frequent tokens, equal scores, tokens twice in a query or term, several levels."""
    monkeypatch.setattr(lx, "FIRST_LEVEL", 2)
    monkeypatch.setattr(lx, "GROWTH", 2)
    rnd = random.Random(11)
    vocab = ["left", "left", "left", "side", "side"] + ["w%d" % i for i in range(25)]
    terms = list(dict.fromkeys(" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 4))) for _ in range(300)))
    spans = ["left", "side", "left side", "left left", "left side w3 w4", "w1 w1 side zz", "zz", "", " "]
    spans += [" ".join(rnd.choice(vocab + ["zz"]) for _ in range(rnd.randint(1, 5))) for _ in range(60)]
    ms = spark.createDataFrame([(i, s) for i, s in enumerate(spans)], "ord long, span string")
    got = {r["ord"]: (r["code"], r["nel_score"]) for r in lx.link_bm25(ms, _gaz(spark, terms)).collect()}
    for i, s in enumerate(spans):
        assert got[i] == _bm25_brute(s, terms), s


def test_bm25_keys_and_negative_impacts(spark):
    """Each key by itself; in one of them the tokens are in more than half of the terms."""
    sets = {"x": ["a b", "a b c", "a c b", "b a"], "y": ["fever high", "cough", "a b", "dry cough", "pain in chest"]}
    rows = [(k, i, t, f"C{i}") for k, ts in sets.items() for i, t in enumerate(ts)]
    gaz = spark.createDataFrame(rows, "entity_type string, gaz_ord long, term string, code string")
    spans = ["a", "b c", "c", "a q", "high cough", "q", "chest b", "a b c d"]
    ms = spark.createDataFrame([(k, i, s) for k in sets for i, s in enumerate(spans)], "entity_type string, ord long, span string")
    got = {(r["entity_type"], r["ord"]): (r["code"], r["nel_score"]) for r in lx.link_bm25(ms, gaz).collect()}
    for k, ts in sets.items():
        for i, s in enumerate(spans):
            assert got[(k, i)] == _bm25_brute(s, ts), (k, s)


def test_bm25_reads_little_of_a_frequent_token(spark, monkeypatch):
    """A frequent token's list is read up to its best level only."""
    monkeypatch.setattr(lx, "FIRST_LEVEL", 4)
    monkeypatch.setattr(lx, "GROWTH", 4)
    n = 3000
    terms = spark.createDataFrame([(i, "common " + ("x%d " % i) * (1 + i % 7)) for i in range(n)] + [(n + i, "u%d" % i) for i in range(2 * n)],
                                  "gaz_ord long, norm string")
    read = []
    old = lx.checkpointed

    def spy(df):
        out = old(df)
        if "reads" in out.columns:
            read.append(out)
        return out

    monkeypatch.setattr(lx, "checkpointed", spy)
    q = spark.createDataFrame([("common",), ("common x5",)], "m string")
    got = {r.m: r.gaz_ord for r in lx.bm25_best(q, terms).collect()}
    assert got == {"common": 0, "common x5": 5}
    levels = [r.level for t in read for r in t.where("reads AND token = 'common'").collect()]
    assert levels and max(levels) <= 1


def test_numbered_is_the_order(spark):
    from pyspark.sql import functions as F

    from notelink.plans.materialize import numbered
    rnd = random.Random(3)
    rows = list({(rnd.randint(0, 20), "k%d" % rnd.randint(0, 999)) for _ in range(500)})
    df = spark.createDataFrame(rows, "a int, b string").repartition(7)
    got = {(r.a, r.b): r.n for r in numbered(df, [F.col("a").desc(), F.col("b")], "n").collect()}
    assert got == {x: i for i, x in enumerate(sorted(rows, key=lambda x: (-x[0], x[1])))}
    assert numbered(df.limit(0), [F.col("a")]).count() == 0
