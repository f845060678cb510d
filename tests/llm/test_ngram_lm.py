import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from notelink.llm import ngram_lm as lm


def brute(train, texts):
    """Interpolated modified Kneser-Ney on Python strings."""
    def toks(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
        for c in "\t\n\v\f\r":
            low = low.replace(c, " ")
        return [*[w for w in low.split(" ") if w], "</end>"]

    c, big = Counter(), Counter()
    for t in train:
        w = toks(t)
        c.update(w)
        big.update(zip(["<begin>", *w], w))
    n, v, types = sum(c.values()), len(c), len(big)
    ctx, after, follow = Counter(), Counter(), defaultdict(Counter)
    for (a, b), k in big.items():
        ctx[a] += k
        after[b] += 1
        follow[a][min(k, 3)] += 1
    coc = lambda counts: [sum(x == k for x in counts.values()) for k in (1, 2, 3, 4)]
    d2, d1 = [0, *lm.discounts(coc(big))], [0, *lm.discounts(coc(after))]
    gamma1 = sum(d1[min(k, 3)] for k in after.values()) / types if types else 1.0
    out = []
    for t in texts:
        w = toks(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        total = 0.0
        for a, b in zip(["<begin>", *w], w):
            p = (after[b] - d1[min(after[b], 3)]) / max(types, 1) + gamma1 / (v + 1)
            if ctx[a]:
                k = big[a, b]
                p = (k - d2[min(k, 3)]) / ctx[a] + sum(d2[j] * m for j, m in follow[a].items()) / ctx[a] * p
            total += math.log10(p)
        out.append((len(w), sum(c[x] > 0 for x in w), base, total))
    return n, out


@pytest.mark.parametrize("small", [False, True])
def test_scores_equal_brute_force(spark, monkeypatch, small):
    if small:  # many files and flushes
        monkeypatch.setattr(lm, "SHARD_BYTES", 500)
        monkeypatch.setattr(lm, "FLUSH", 50)
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" if i % 7 else f"É{i}" for i in range(40)]
    texts = [" ".join(rng.choice(vocab, int(rng.integers(0, 30)), p=np.arange(40, 0, -1) / 820)) for _ in range(120)]
    texts += [None, "", " \t\n", "A a b\vA", texts[0], "the " * 5000, "Zz \x00 zz"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, SCORE string")
    model = lm.train(df.filter("id % 4 != 1"))
    got = {r.id: r for r in lm.score(df, model).collect()}
    n, want = brute([t for i, t in enumerate(texts) if i % 4 != 1], texts)
    assert model.tokens == n and len(got) == len(texts)
    for i, (k, known, base, total) in enumerate(want):
        r = got[i]
        assert (r.n_tokens, r.n_known) == (k, known)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(total)
        assert r.perplexity == pytest.approx(10 ** (-total / k))


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b")], "id long, text string")
    model = lm.train(df.limit(0))
    r = lm.score(df, model).first()
    assert (r.n_tokens, r.n_known, r.base_score, r.score) == (3, 0, 0.0, 0.0)
    assert lm.score(df.limit(0), lm.train(df)).count() == 0


def test_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([("a b a c",), ("b a a",), ("c c b d e",), (None,)], "text string")
    model = lm.train(df)
    lines = spark.createDataFrame([(f"{x}",) for x in ("a", "b", "c", "d", "e", "unseen", "")], "text string")
    # first token after the beginning: each word, a word never seen, the end
    firsts = lm.Scorer(model, lm._local(spark, model.path)[0])
    tok = np.concatenate([lm.tokens(__import__("pyarrow").array([r.text]))[0][:1] for r in lines.collect()])
    at = np.arange(len(tok) + 1)
    assert (10 ** firsts.score(tok, at)[2]).sum() == pytest.approx(1.0)


def test_query_beats_base_on_held_out_texts(spark):
    import __spark_entry__ as E
    from tests.conftest import SF

    rows = E.queries()["op3_lm_score"](spark, SF).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def brute_of_order(train, texts, order):
    """Interpolated modified Kneser-Ney by its recursion, on tuples of words."""
    toks = lambda t: ["<b>", *(t or "").split(), "</end>"]
    counts = {k: Counter() for k in range(1, order + 1)}
    for t in train:
        w = toks(t)
        for i in range(1, len(w)):
            counts[order].update([tuple(w[i - order + 1:i + 1])] if i >= order - 1 else [])
            for k in range(2, order):  # nothing stands before the beginning: plain counts
                counts[k].update([tuple(w[:k])] if i == k - 1 else [])
    for k in range(order - 1, 0, -1):
        counts[k].update(g[1:] for g in counts[k + 1])
    d = {k: [0, *lm.discounts([sum(x == j for x in counts[k].values()) for j in (1, 2, 3, 4)])] for k in counts}
    by = defaultdict(list)
    for k in range(1, order + 1):
        for g, n in counts[k].items():
            by[g[:-1]].append(n)
    v = len(counts[1])

    def p(g):
        k = len(g)
        if not k:
            return 1 / (v + 1)
        own = by.get(g[:-1])
        if not own:
            return p(g[1:])
        n, total = counts[k][g], sum(own)
        return (n - d[k][min(n, 3)]) / total + sum(d[k][min(x, 3)] for x in own) / total * p(g[1:])

    out = []
    for t in texts:
        w = toks(t)
        out.append(sum(math.log10(p(tuple(w[max(0, i - order + 1):i + 1]))) for i in range(1, len(w))))
    return out


@pytest.mark.parametrize("order", [3, 4])
def test_higher_orders_equal_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "SHARD_BYTES", 900)
    monkeypatch.setattr(lm, "FLUSH", 150)
    rng = np.random.default_rng(order)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 6, int(rng.integers(0, 25)))) for _ in range(100)] + [None, "", "w1 " * 300, "new w1 w2 new w3"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    model = lm.train(df.filter("id % 4 != 3"), order=order)
    got = {r.id: r.score for r in lm.score(df, model).collect()}
    for i, want in enumerate(brute_of_order([t for i, t in enumerate(texts) if i % 4 != 3], texts, order)):
        assert got[i] == pytest.approx(want)


def test_query_tells_texts_by_more_than_word_pairs(spark, tmp_path):
    import __spark_entry__ as E

    # c and d follow x equally often; only the word before it tells which
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    trained = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2][:120]
    rows = [(i, "a x c" if n % 2 else "b x d") for n, i in enumerate(trained)] + list(zip(held, ["a x c", "a x d"]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in E.queries()["op3_lm_score"](spark, str(tmp_path)).collect()}
    assert got[held[0]] > got[held[1]] + 0.5


def test_training_leaves_no_shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = manager.getAllFiles()
        names = (found.apply(i).getName() for i in range(found.size()))
        return {x for x in names if x.startswith("shuffle_") and x.endswith(".data")}

    df = spark.createDataFrame([(f"a b{i} c d{i % 7}",) for i in range(500)], "text string")
    before, setting = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    model = lm.train(df, order=3)
    assert model.tokens == 2500
    # what is left is the small sum of the files' totals
    after = [x for x in files() - before]
    assert sum(manager.getFile(x).length() for x in after) < 10_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_sent_ngrams_take_few_bytes():
    rng = np.random.default_rng(1)
    vocab = np.sort(rng.integers(0, 1 << 63, 3000).astype(np.uint64))
    tok = np.minimum(rng.zipf(1.3, 400_000), 3000) - 1
    vocab, number = lm._by_frequency(vocab, tok)
    own = np.array(lm.grams(number, np.array([0, len(tok)]), 3, 0, 1))
    sent = [r for b in lm._sends(0, vocab, own, [np.ones(len(tok), np.int32)], 4) for r in b.to_pylist()]
    back = [lm._unpacked(r["data"]) for r in sent]
    assert sum(f[0].sum() for _, _, f in back) == len(tok)
    assert sum(len(r["data"]) for r in sent) / sum(n.shape[1] for _, n, _ in back) < 3


def test_files_give_back_common_rare_and_large_fields():
    rng = np.random.default_rng(2)
    h = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    for top in (3, 1 << 11, 1 << 31, 1 << 40):
        fields = [rng.integers(0, top, len(h)) for _ in range(5)]
        f = lm.HashFile(np.frombuffer(lm.file_bytes(h, fields, 1), np.uint8), 1)
        row = f.find(h)
        assert (row >= 0).all() and (f.values(row, 5) == fields).all()
        assert (f.values(np.array([-1, row[7]]), 2) == [[0, fields[0][7]], [0, fields[1][7]]]).all()
    empty = lm.HashFile(np.frombuffer(lm.file_bytes(h[:0], [np.zeros(0, np.int64)], 1), np.uint8), 1)
    assert (empty.values(empty.find(h[:3]), 1) == 0).all()
