import random
import re

from notelink.llm import decontaminate as dc


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(text, items, n):
    w = words(text)
    hit, ids = set(), set()
    for item_id, t in items:
        x = words(t)
        for win in [x[i:i + n] for i in range(max(1, len(x) - n + 1))] if x else []:
            for i in range(len(w) - len(win) + 1):
                if w[i:i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    if item_id is not None:
                        ids.add(str(item_id))
    return len(w), len(hit), sorted(ids), len(hit) > 0 and 20 * len(hit) >= len(w)


def data(seed):
    rng = random.Random(seed)
    vocab = ["a", "b", "C", "é", "x1", "日本"]
    sep = [" ", ", ", "\n", "--", "!! "]
    text = lambda k: "".join(rng.choice(vocab) + rng.choice(sep) for _ in range(k))
    items = [(i, text(rng.randint(1, 9))) for i in range(12)] + [(3, "b b b"), (None, "C c C"), (50, None), (51, " ,"), (4, "b b b")]
    docs = [text(rng.randint(0, 60)) for _ in range(40)] + [None, "", "..", "q " * 4000 + items[0][1], items[1][1].upper()]
    return items, docs


def test_equals_brute_force_in_one_block_and_many(spark):
    for seed, block in ((1, 1 << 20), (2, 40)):
        items, docs = data(seed)
        b = spark.createDataFrame(items, "item_id long, text string")
        d = spark.createDataFrame([(i, t, "old") for i, t in enumerate(docs)] + [(None, docs[0], "n"), (0, docs[0], "again")],
                                  "doc_id long, text string, N_WORDS string")
        out = dc.find_contamination(d, b, n=4, block_bytes=block)
        assert out.columns == ["doc_id", "text", "n_words", "n_hit", "items", "spans", "contaminated"]
        rows = out.collect()
        assert len(rows) == len(docs) + 2
        for r in rows:
            assert (r.n_words, r.n_hit, r["items"], r.contaminated) == brute(r.text, items, 4)
            # the spans are the hit words in the original text
            assert sum(len(words(r.text[s.start:s.end])) for s in r.spans) == r.n_hit
            for s in r.spans:
                assert words(r.text[s.start:s.end])[0][0] == words(r.text[s.start])[0]


def test_threshold_and_empty_tables(spark):
    item = " ".join(f"w{i}" for i in range(13))
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    d = spark.createDataFrame([(0, item + " z" * 247), (1, item + " z" * 248), (2, item[:-4])], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.contaminated) for r in dc.find_contamination(d, b).collect()}
    assert got == {0: (13, True), 1: (13, False), 2: (0, False)}
    assert [r.contaminated for r in dc.find_contamination(d, b.limit(0)).collect()] == [False] * 3
    assert dc.find_contamination(d.limit(0), b).count() == 0
