import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from notelink.llm import toxicity as tx


def test_word_sets_hold_words_and_beginnings():
    h, first = tx.word_sets(pa.array(["Idiot idiot, IDIOT!", None, "1 2", "idiotic"]))
    # a word of five bytes is its own beginnings; one of seven has two shorter ones
    assert np.diff(first).tolist() == [1, 0, 0, 3]
    assert len(np.intersect1d(h[first[0]:first[1]], h[first[3]:first[4]])) == 1


def data(spark, n=600):
    rng = np.random.default_rng(0)
    vocab = np.array([f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)])
    rows, labels = [], []
    for i in range(n):
        w = rng.choice(vocab, 30).tolist()
        spam, toxic = rng.random() < 0.4, rng.random() < 0.25
        w += ["buybuy"] * spam + ["idiot"] * toxic
        rows.append((i, " ".join(rng.permutation(w)), "old"))
        labels.append((i, int(spam), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, P_toxic string"), spark.createDataFrame(labels, "doc_id long, spam int, toxic int")


def test_chain_learns_and_scores_held_out_rows(spark):
    docs, labels = data(spark)
    chain = tx.learn(docs, labels.filter("doc_id >= 150"), {"spam": "spam", "toxic": "toxic"})
    assert [len(m.earlier) for m in chain] == [0, 1]
    out = tx.score(docs, chain, ["spam", "toxic"])
    assert out.columns == ["doc_id", "text", "p_spam", "p_toxic"]
    wrong = out.join(labels, "doc_id").filter("doc_id < 150 AND ((p_toxic >= 0.5) != (toxic = 1) OR (p_spam >= 0.5) != (spam = 1))").count()
    assert wrong <= 2


def test_later_models_use_earlier_probabilities():
    """A category that is just the earlier one, with words that do not tell it."""
    rng = np.random.default_rng(1)
    n = 400
    first_cat = (rng.random(n) < 0.5).astype(float)
    words = first_cat.astype(np.int64)  # word 0 or 1
    usable = np.ones((2, tx.FOLDS + 1, 2), bool)
    usable[1] = False
    usable[1, :, 0] = True
    s = tx.Sample(np.array([5, 9], np.uint64), words, np.arange(n + 1), np.arange(n) % tx.FOLDS,
                  np.column_stack([first_cat, first_cat]), usable)
    chain = tx.fit_chain(s)
    assert chain[1].earlier[0] > 1


def test_defined_cases(spark):
    docs, labels = data(spark, 60)
    names = {"spam": "spam", "toxic": "toxic"}
    odd = docs.unionByName(spark.createDataFrame([(None, "idiot", "n"), (900, None, "n"), (901, "", "n"), (902, "idiot " * 50_000, "n"), (1, "again", "n")], docs.schema))
    extra = labels.unionByName(spark.createDataFrame([(None, 1, 1), (900, 1, 1), (2, None, 1), (1, 0, 0)], labels.schema))
    out = tx.score(odd, tx.learn(odd, extra, names), list(names)).collect()
    assert len(out) == 65 and all(0 < r.p_toxic < 1 and 0 < r.p_spam < 1 for r in out)
    # no labels, or one class only: the smoothed share, for all alike
    none = tx.score(odd, tx.learn(odd, labels.limit(0), names), list(names))
    assert none.filter(F.col("p_toxic") > 0.01).count() == 0
    one = tx.score(odd, tx.learn(odd, labels.withColumn("toxic", F.lit(1)), names), list(names))
    assert one.filter(F.col("p_toxic") < 0.9).count() == 0
    assert tx.score(odd.limit(0), tx.learn(odd.limit(0), labels, names), list(names)).count() == 0


def test_query_finds_toxic_documents_and_leaves_clean_ones(spark):
    import __spark_entry__ as E

    sf = "/root/testdata/sf0.01"
    rows = E.queries()["op6_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    clean = [r for r in rows if r.toxic == 0]
    toxic = [r for r in rows if r.toxic == 1]
    assert sum(r.rejected for r in clean) <= 0.02 * len(clean) and sum(r.rejected for r in toxic) >= 0.75 * len(toxic)


def plain_chain(rows, m):
    """The chain in plain Python over (key, text, labels) rows: word choice, out-of-fold probabilities, fits."""
    texts = [set(tx.word_sets(pa.array([t]))[0].tolist()) for _, t, _ in rows]
    fold = [f for f, _, _ in rows]
    y = np.array([labels for _, _, labels in rows], float)

    def best(j, seen):
        n, pos = {}, {}
        for i in seen:
            for w in texts[i]:
                n[w] = n.get(w, 0) + 1
                pos[w] = pos.get(w, 0) + y[i, j]
        every = {}
        for t in texts:
            for w in t:
                every[w] = every.get(w, 0) + 1
        rate = y[seen, j].mean() if len(seen) else 0.0
        chi = {w: (pos[w] - c * rate) ** 2 / max(rate * (1 - rate), 1e-9) / c for w, c in n.items() if c >= tx.MIN_ROWS and every[w] >= tx.MIN_ROWS}
        signed = lambda w: w - 2**64 if w >= 2**63 else w
        return [w for w in sorted(chi, key=lambda w: (-chi[w], signed(w)))[:tx.FEATURES] if chi[w] > 0]

    def fit(j, seen, before):
        words, n, k = best(j, seen), len(seen), before.shape[1]
        prior = (y[seen, j].sum() + 0.5) / (n + 1)
        bias = np.log(prior / (1 - prior))
        if not words or len(set(y[seen, j])) == 1:
            return words[:0], np.zeros(0), np.zeros(k), bias
        x = np.array([[w in texts[i] for w in words] for i in seen], float)
        a = np.column_stack([x, before[seen], np.ones(n)])
        width = np.sqrt(x.sum(axis=1).max() + k + 1.0)
        own = np.concatenate([x.sum(0), (before[seen] ** 2).sum(0) + 1, [n]])
        step = 4 / (own * width + tx.RIDGE * n)
        ridge = np.append(np.full(len(words) + k, tx.RIDGE * n), 0)
        at = np.append(np.zeros(len(words) + k), bias)
        look, t = at.copy(), 1.0
        for _ in range(tx.STEPS):
            grad = a.T @ (1 / (1 + np.exp(-a @ look)) - y[seen, j]) + ridge * look
            new = look - step * grad
            t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
            look, at = new + (last - 1) / t * (new - at), new
        return words, at[:len(words)], at[len(words):-1], at[-1]

    def probability(model, words, before):
        known, w, earlier, bias = model
        z = sum(w[i] for i, x in enumerate(known) if x in words) + before @ earlier + bias
        return 1 / (1 + np.exp(-z))

    outside, chain = np.zeros((len(rows), 0)), []
    for j in range(m):
        chain.append(fit(j, list(range(len(rows))), outside))
        p = np.zeros(len(rows))
        for f in range(tx.FOLDS):
            model = fit(j, [i for i in range(len(rows)) if fold[i] != f], outside)
            for i in range(len(rows)):
                if fold[i] == f:
                    p[i] = probability(model, texts[i], outside[i])
        outside = np.column_stack([outside, p])

    def score(text):
        words, before = set(tx.word_sets(pa.array([text]))[0].tolist()), np.zeros(0)
        for model in chain:
            before = np.append(before, probability(model, words, before))
        return before

    return score


def test_chain_equals_plain_version(spark):
    docs, labels = data(spark, 160)
    text = {r.doc_id: r.text for r in docs.collect()}
    hashed = labels.select("doc_id", "spam", "toxic", F.xxhash64("doc_id").alias("h"), F.expr(f"pmod(floor(xxhash64(doc_id) / 7), {tx.FOLDS})").alias("f"))
    rows = [(r.f, text[r.doc_id], (r.spam, r.toxic)) for r in sorted(hashed.collect(), key=lambda r: r.h)]
    plain = plain_chain(rows, 2)
    got = tx.score(docs, tx.learn(docs, labels, {"spam": "spam", "toxic": "toxic"}), ["spam", "toxic"]).collect()
    for r in got:
        assert np.allclose([r.p_spam, r.p_toxic], plain(r.text), atol=1e-6)


def test_repeated_keys_stay_within_the_bound(spark):
    """One labelled key on very many rows, of one text and of many."""
    docs, labels = data(spark, 60)
    same = spark.range(30_000).selectExpr("5L AS doc_id", "'buybuy again' AS text", "'o' AS P_toxic")
    many = spark.range(3_000).selectExpr("6L AS doc_id", "concat('idiot number', id) AS text", "'o' AS P_toxic")
    seen = []
    old = tx.fit_chain
    try:
        tx.fit_chain = lambda s: seen.append(len(s.labels)) or old(s)
        more = labels.unionByName(spark.range(20_000).selectExpr("7L AS doc_id", "1 AS spam", "0 AS toxic"))
        tx.learn(docs.unionByName(same).unionByName(many), more, {"spam": "spam", "toxic": "toxic"})
    finally:
        tx.fit_chain = old
    assert seen[0] <= 60 + 2 * tx.KEY_TEXTS
