import random

import pytest

from notelink.llm import jaccard as jc
from notelink.llm.common import broadcasts_bounded


def sets(t, k=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs):
    own = {i: sets(t) for i, t in docs}
    comp = {i: i for i in own}

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(own)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            o = len(own[a] & own[b])
            if o and 100 * o >= 75 * len(own[a] | own[b]):
                x, y = top(a), top(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(own[i]), top(i)) for i in ids}


def corpus(seed):
    """Near copies at all similarities around the threshold, chains, shared passages, short texts."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randint(0, 400)
    common = " ".join(word() for _ in range(30))
    docs = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([4, 8, 20, 60, 120]))]
        docs.append(" ".join(base))
        for _ in range(rng.randint(0, 9)):
            near = base[:]
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                near[rng.randrange(len(near))] = word()
            if rng.random() < 0.3:
                near += [word() for _ in range(rng.randint(1, 1 + len(base) // 5))]
            docs.append(" ".join(near))
            if rng.random() < 0.3:
                base = near  # a chain
    docs += [common + " " + " ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(25)]
    docs += ["a b", "A\tb", "a b c", "", " \n", "one", "one"]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, monkeypatch, seed):
    if seed == 2:  # many flushes
        monkeypatch.setattr(jc, "FLUSH", 100)
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_shingles int").repartition(5)
    got = jc.jaccard_join(df)
    rows = got.members.collect()
    want = brute(docs)
    assert len(rows) == len(docs) and len({c for _, c in want.values()}) < len(docs) - 20
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    classes = {r.doc_id: r.class_id for r in rows}
    text = dict(docs)
    for r in got.links.collect():
        assert classes[r.x] == r.x and classes[r.y] == r.y
        a, b = sets(text[r.x]), sets(text[r.y])
        assert 100 * len(a & b) >= 75 * len(a | b)


def test_threshold_is_exact(spark):
    # sets of 7 and 7 n-grams that share 6: 6 of 8 is 0.75; of 5 and 5 that share 4: 4 of 6 is less
    a, b = "a b c d e f g h i j k", "a b c d e f g h i j z"
    c, d = "p q r s t u v w x", "p q r s t u v w y"
    df = spark.createDataFrame([(4, a), (3, b), (2, c), (1, d)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jc.jaccard_join(df).members.collect()} == {4: 3, 3: 3, 2: 2, 1: 1}


def test_null_keys_null_texts_repeated_rows_and_empty_table(spark):
    t = "a b c d e f g"
    df = spark.createDataFrame([(None, t), (5, t), (5, t), (5, "other words in a row here"), (7, t), (8, None), (9, ""), (6, "hello")],
                               "doc_id long, text string")
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jc.jaccard_join(df).members.collect()), key=str)
    assert rows == sorted([(None, 3, None), (5, 3, 5), (5, 3, 5), (5, 2, 5), (7, 3, 5), (8, 0, 8), (9, 0, 9), (6, 1, 6)], key=str)
    assert jc.jaccard_join(df.limit(0)).members.count() == 0


def test_hot_groups_do_not_make_all_pairs(spark):
    """A large group of near copies and a passage in every document: candidates stay near the number of documents."""
    rng = random.Random(5)
    base = ["b%d" % i for i in range(100)]
    docs = []
    for _ in range(300):
        near = base[:]
        near[rng.randrange(100)] = "x%d" % rng.randrange(10**6)
        docs.append(" ".join(near))
    docs += [" ".join(base[:30] + ["y%d" % rng.randrange(10**6) for _ in range(60)]) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = jc.jaccard_join(df)
    assert got.links.count() < 2 * len(docs)
    assert {r.doc_id: r.component_id for r in got.members.collect()} == {i: c for i, (_, c) in brute(list(enumerate(docs))).items()}


def test_copies_of_classes_are_not_broadcast(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    docs = spark.createDataFrame([(i, f"{text} {i % 3}") for i in range(12)] + [(20, "q r s")], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    out = jc.jaccard_join(docs).members
    # each class is copied for every salt, which Spark's estimate of its size leaves out
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" in plan and "BroadcastHashJoin" not in plan
    assert {r.component_id for r in out.collect()} == {0, 20}
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before


def test_a_lower_threshold_of_the_session_stays(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    try:
        for given, held in (("-1", "-1"), ("1k", "1024"), ("100B", "100"), ("1g", str(256 * 1024)), ("10MB", str(256 * 1024))):
            spark.conf.set(name, given)
            with broadcasts_bounded(spark):
                assert spark.conf.get(name) == held
            assert spark.conf.get(name) == given
    finally:
        spark.conf.set(name, before)
