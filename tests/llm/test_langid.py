import random

import numpy as np
import pytest

from notelink.llm import langid as li


def test_automaton_accepts_exactly_the_substrings():
    rng = random.Random(1)
    s = [rng.randrange(3) for _ in range(60)]
    t = li.suffix_automaton(s, 3)
    subs = {tuple(s[i:j]) for i in range(60) for j in range(i + 1, 61)}
    for _ in range(2000):
        x = [rng.randrange(3) for _ in range(rng.randint(1, 8))]
        state = 0
        for c in x:
            state = int(t[state, c]) if state >= 0 else -1
        assert (state >= 0) == (tuple(x) in subs)


def greedy(parser, text, whole):
    """Phrases of a text, each the longest that the sample has; a symbol that it lacks ends one."""
    x = parser.symbol[li.letters_of(text)].tobytes()
    n, begin = int(len(x) > 0), 0
    for at in range(len(x)):
        if x[begin:at + 1] not in whole:
            n, begin = n + 1, at
            if x[at:at + 1] not in whole:
                begin = at + 1
    return n


@pytest.mark.parametrize("block", [4, 37, 512])
def test_phrases_equal_greedy_parsing(monkeypatch, block):
    """Of whole texts, whatever the blocks; some phrases run over several blocks."""
    monkeypatch.setattr(li, "BLOCK", block)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    samples = {"x": [text(300)], "y": [text(200), text(100)], "z": ["ab" * 100]}
    parser = li.Parser(samples)
    texts = [text(n) for n in (0, 1, 5, 511, 512, 513, 2000)] + ["zzz", "a日b", samples["x"][0], "ab" * 90 + "c" + "ab" * 40, "日" * 1100]
    got = parser.phrases([li.letters_of(t) for t in texts])
    for j, lang in enumerate(parser.langs):
        parts = [np.concatenate([li.letters_of(t), [0]]) for t in samples[lang]]
        whole = parser.symbol[np.concatenate(parts)[:li.ALL_SYMBOLS]].tobytes()
        assert got[:, j].tolist() == [greedy(parser, t, whole) for t in texts]


def test_defined_cases(spark):
    rows = [(1, "the cat and the dog", "en", "s"), (2, "der hund und die katze", "de", "s"), (3, None, "en", "s"), (4, "123 !!", "de", "s"),
            (None, "the dog", None, None), (2, "der hund und die katze", "de", "s"), (5, "the the the " * 20_000, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, SCORE string")
    samples = li.learn(df)
    assert sorted(samples) == ["de", "en"]
    out = li.predict(df, samples)
    assert "SCORE" not in out.columns
    got = [(r.doc_id, r.lang_pred) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(1, "en"), (2, "de"), (2, "de"), (3, "und"), (4, "und"), (None, "en"), (5, "en")], key=str)
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert [r.lang_pred for r in li.predict(df, li.learn(df.limit(0))).collect()] == ["und"] * 7
    assert li.predict(df.limit(0), samples).count() == 0


def test_held_out_accuracy(spark):
    import __spark_entry__ as E
    from tests.conftest import SF

    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in E.queries()["op10_language_id"](spark, SF).collect() if r.held_out]
    assert len(rows) > 20 and sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.9 * len(rows)


def test_no_letter_of_the_samples_is_merged():
    rng = random.Random(5)
    # the first language has the 94 commonest letters; the others share no letter, and word lengths tell nothing
    text = lambda first, n, size: "".join(chr(first + rng.randrange(n)) if i % 5 else " " for i in range(size))
    scripts = {"han": (0x4E00, 94), "hangul": (0xAC00, 60), "georgian": (0x10D0, 30), "thai": (0x0E01, 40)}
    samples = {k: [text(*v, 9000 if k == "han" else 3000)] for k, v in scripts.items()}
    parser = li.Parser(samples)
    n = len({c for t in samples.values() for c in t[0]} - {" "})
    assert n > li.LETTERS and len(set(parser.symbol[[ord(c) for t in samples.values() for c in t[0]]].tolist())) == n + 1
    texts = [(k, text(*v, 400)) for k, v in scripts.items() for _ in range(5)]
    texts += [(k, samples[k][0][100:400]) for k in samples]
    got = parser.phrases([li.letters_of(t) for _, t in texts])
    for (k, t), row in zip(texts, got * parser.bits):
        assert parser.langs[int(np.argmin(row))] == k
    for (k, t), row in zip(texts, got):  # greedy parsing, letter by letter
        for j, lang in enumerate(parser.langs):
            whole, x, count, begin = samples[lang][0].lower(), "".join(chr(c) if c else " " for c in li.letters_of(t)), 1, 0
            for at in range(min(len(x), li.BLOCK)):
                if x[begin:at + 1] not in " ".join(whole.split()) + " ":
                    count, begin = count + 1, at if x[at] in whole else at + 1
            assert row[j] == count


def test_sample_is_of_texts_with_letters_from_all_over(spark):
    # the least-hashed documents of "xx" have no letter; a long text changes its letters half-way
    keys = [r.id for r in spark.range(200).selectExpr("id", "xxhash64(id) AS h").orderBy("h").collect()]
    rows = [(k, (None, "12 34", "")[i % 3] if i < 120 else "hund katze", "xx") for i, k in enumerate(keys)]
    rows += [(1000, "ab " * 1000 + "cd " * 1000, "yy"), (1001, "short text", "yy")]
    samples = li.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert samples["xx"] == ["hund katze"] * li.SAMPLE_DOCS
    long, short = samples["yy"]
    assert short == "short text" and len(long) == li.SAMPLE_CHARS + li.PIECES - 1
    assert long.count("ab") > 200 and long.count("cd") > 200


def test_symbols_are_shared_evenly():
    parts = [np.full(n, i) for i, n in enumerate([5, 100, 20, 100, 0])]
    assert [len(x) for x in li.evenly(parts, 100)] == [5, 37, 20, 37, 0]
    assert [len(x) for x in li.evenly(parts, 225)] == [len(x) for x in parts]
    parser = li.Parser({"x": [chr(0x4E00 + i) * 2000 for i in range(64)]})
    assert len(set(parser.symbol[0x4E00:0x4E00 + 64].tolist())) == 64


def test_repeated_keys_and_many_languages_stay_within_the_bound(spark, monkeypatch):
    monkeypatch.setattr(li, "SAMPLE_LANGS", 5)
    one = spark.range(30_000).selectExpr("1L AS doc_id", "'the cat' AS text", "'en' AS lang")
    texts = spark.range(5_000).selectExpr("2L AS doc_id", "concat('der hund ', CAST(id AS STRING)) AS text", "'de' AS lang")
    dirty = spark.range(300).selectExpr("id + 10 AS doc_id", "'some words' AS text", "concat('l', lpad(CAST(id AS STRING), 3, '0')) AS lang")
    samples = li.learn(one.unionByName(texts).unionByName(dirty))
    assert samples["en"] == ["the cat"] and len(samples["de"]) == li.SAMPLE_DOCS
    assert sorted(samples) == ["de", "en", "l000", "l001", "l002"]  # those of most documents, ties by name
