import random

import numpy as np
import pytest

from notelink.llm import suffix_dedup as sd


@pytest.mark.parametrize("seed", range(30))
def test_deep_shallow_order_and_prefixes(seed):
    rng = random.Random(seed)
    m = rng.choice([5, 28, 50, 70])
    base = bytes(rng.choice(b"ab") for _ in range(m))
    rows = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, m))) for _ in range(40)]
    rows += [(base[:rng.randint(0, m)] + bytes([rng.choice(b"abc")]) + base)[:rng.randint(0, m)] for _ in range(40)] + rows[:5]
    text = np.zeros((len(rows), m), np.uint8)
    for i, s in enumerate(rows):
        text[i, :len(s)] = np.frombuffer(s, np.uint8)
    order, lcp = sd.deep_shallow(text, np.array([len(s) for s in rows]))
    got = [rows[i] for i in order]
    assert got == sorted(rows)
    for a, b, n in zip(got, got[1:], lcp[1:]):
        assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


@pytest.mark.parametrize("n,values", [(1, 3), (50, 2), (3000, 2), (3000, 50), (5000, 10**6)])
def test_multikey_partition_sorts_by_words(n, values):
    rng = np.random.default_rng(n + values)
    words = rng.integers(0, values, (n, 4)).astype(np.uint64) << np.uint64(40)
    order, group = sd._multikey(words)
    want = sorted(map(tuple, words.tolist()))
    assert [tuple(x) for x in words[order].tolist()] == want and sorted(order.tolist()) == list(range(n))
    assert group.tolist() == np.cumsum([0, *[a != b for a, b in zip(want, want[1:])]]).tolist()
    same = np.zeros((2000, 4), np.uint64)
    assert not sd._multikey(same)[1].any()


def brute(docs, length=50):
    least = {}
    for k, t in docs:
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            s = raw[i:i + length]
            if k is not None:
                least[s] = min(k, least.get(s, k))
    out = []
    for k, t in docs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if k is not None and least[raw[i:i + length]] < k:
                gone[i:i + length] = True
        step = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        out.append((k, len(raw), int(gone.sum()), [(int(a), int(b)) for a, b in step.reshape(-1, 2)],
                    bytes(np.frombuffer(raw, np.uint8)[~gone])))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé日") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randint(8, 40)) for _ in range(6)]
    docs = []
    for _ in range(60):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 2)
            parts += [p[cut:cut + rng.randint(20, 200)], text(rng.randint(0, 10))]
        docs.append("".join(parts))
    docs += ["a" * 300, "a" * 60, "ab" * 90, "For " * 80, docs[0], docs[0] + "x", docs[3][5:], "", None, "x" * 49, "x" * 49, "y" * 50, "y" * 50]
    docs += [passages[0]] * 5 + ["nul" + "\0" * 70, "\0" * 55 + "nul"]
    rng.shuffle(docs)
    keys = rng.sample(range(1000), len(docs))
    return list(zip(keys, docs))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, monkeypatch, seed):
    if seed > 1:  # many flushes and ranges
        monkeypatch.setattr(sd, "FLUSH", 40 * seed)
        monkeypatch.setattr(sd, "PENDING", 30 * seed)
        monkeypatch.setattr(sd, "SHARD_BYTES", 1500)
    docs = corpus(seed)
    if seed == 3:  # rows with one key, null keys
        docs += [(None, docs[0][1]), (docs[1][0], docs[1][1]), (docs[2][0], docs[5][1]), (None, None)]
    df = spark.createDataFrame([(k, t, "old") for k, t in docs], "doc_id long, text string, KEPT string").repartition(4)
    out = sd.remove_repeats(df)
    assert [c for c in out.columns if c in ("doc_id", "text", "KEPT")] == ["doc_id", "text"]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in out.collect()), key=str)
    assert got == sorted(brute(docs), key=str)
    for r in out.filter("n_removed > 0").collect():
        assert r.kept_text.encode() in (bytes(r.kept), r.kept_text.encode()) and len(r.kept_text) <= len(r.text)


def test_other_lengths_and_empty_table(spark):
    docs = corpus(7)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for length in (22, 80):
        got = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in sd.remove_repeats(df, length=length).collect()}
        assert got == {k: (n, kept) for k, _, n, _, kept in brute(docs, length)}
    assert sd.remove_repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sd.remove_repeats(df, length=10)
