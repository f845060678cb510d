import unicodedata

from pyspark.sql import functions as F

from notelink.functions import text as tx


def test_normalize_golden(spark):
    df = spark.createDataFrame([("Ácido ÚRICO",)], ["t"])
    assert df.select(tx.normalize("t")).first()[0] == "acido urico"


def test_normalize_native_equals_python_for_latin_and_greek(spark):
    chars = [chr(c) for c in list(range(0x20, 0x7F)) + list(range(0xA0, 0x250)) + list(range(0x370, 0x3FF))
             if unicodedata.category(chr(c))[0] != "C"]
    rows = [("".join(chars[i:i + 40]),) for i in range(0, len(chars), 40)]
    df = spark.createDataFrame(rows, ["t"])
    got = [r[0] for r in df.select(tx.normalize("t")).collect()]
    assert got == [tx.normalize_py(r[0]) for r in rows]


def test_one_normal_form_for_every_letter(spark):
    """The native form, the one of Arrow batches and the plain rule, over all letters that decompose."""
    chars = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c))[0] in "LM"
             and (unicodedata.normalize("NFD", chr(c)) != chr(c) or unicodedata.category(chr(c)) == "Mn" and c < 0x3000)]
    rows = [("x" + "".join(chars[i:i + 60]) + " 한국 İ",) for i in range(0, len(chars), 60)] + [("édema",), ("한국",), (None,), ("",), ("ﬁn",)]
    got = spark.createDataFrame(rows, "t string").select("t", tx.normalize("t").alias("a"), tx.normalize_with_offsets("t").alias("b")).collect()
    for r in got:
        assert r["a"] == tx.normalize_py(r["t"]) == r["b"]["norm"], r["t"]


def test_offset_runs_lead_back(spark):
    import random

    from notelink.operators import textprep as tp

    rnd = random.Random(2)
    parts = ["a", "É", "e\u0301", "한", "국", "가", "ﬁ", "İ", " ", "\u0301", "日", "\U0001D15E", "x"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(80)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    normal = df.select("doc_id", "text", tx.normalize_with_offsets("text").alias("n")).select("doc_id", "text", "n.*")
    want, spans = set(), []
    for r in normal.collect():
        if r["text"] is None:
            assert r["norm"] is None and r["runs"] is None
            continue
        idx, at = [], 0
        for i, ch in enumerate(r["text"]):
            k = len(tx.normalize_py(ch))
            idx += [i] * k
        idx.append(len(r["text"]))
        for p in range(len(r["norm"]) + 1):
            run = [x for x in r["runs"] if x["norm_start"] <= p][-1]
            assert run["start"] + p - run["norm_start"] == idx[p]
        for _ in range(6):
            a, b = sorted((rnd.randint(0, len(r["norm"])), rnd.randint(0, len(r["norm"]))))
            spans.append((r["doc_id"], a, b, f"s{at}"))
            want.add((r["doc_id"], idx[a], idx[b], f"s{at}"))
            at += 1
    sp = spark.createDataFrame(spans + spans[:3], "doc_id long, start int, end int, name string")
    got = tp.original_offsets(sp, normal).collect()
    assert len(got) == len(spans) + 3 and {tuple(r) for r in got} == want


def test_pretokenize_golden(spark):
    df = spark.createDataFrame([("Nada, pues sí?",)], ["t"])
    r = df.select(tx.pretokenize("t").alias("p")).first()["p"]
    assert r["text"] == "Nada , pues sí ?"
    assert list(r["added"]) == [4, 14]


def test_pretokenize_goldens(spark):
    cases = {"a\x00b": ("a \x00 b", [1, 3]), "": ("", []), " ": (" ", []), "ab": ("ab", []), "é1.": ("é1 .", [2]), "..": (". .", [1]),
             "a, b": ("a , b", [1]), "(x)\n-y": ("( x )\n- y", [1, 3, 7]), "日本": ("日 本", [1])}
    rows = spark.createDataFrame([(t,) for t in cases], ["t"]).select("t", tx.pretokenize("t").alias("p")).collect()
    assert {r["t"]: (r["p"]["text"], list(r["p"]["added"])) for r in rows} == cases


def test_pretokenize_properties(spark):
    """Without the inserted spaces the text is the input; no two different tokens touch any more."""
    import random
    import re

    rnd = random.Random(7)
    alphabet = "ab é,.;-\n\t?!()12\x00"
    rows = [("".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))),) for _ in range(200)]
    word, other = f"[{tx.WORD_CHARS}]", f"[^{tx.WORD_CHARS}\\s]"
    touching = re.compile(f"{word}{other}|{other}{word}|{other}{other}")
    for r in spark.createDataFrame(rows, ["t"]).select("t", tx.pretokenize("t").alias("p")).collect():
        text, added = r["p"]["text"], set(r["p"]["added"])
        assert all(text[i] == " " for i in added)
        assert "".join(c for i, c in enumerate(text) if i not in added) == r["t"]
        assert not touching.search(text)
        assert all(text[i - 1] not in " \n\t" and text[i + 1] not in " \n\t" for i in added)


def test_canonical_lang(spark):
    df = spark.createDataFrame([("cz",), ("cs",), ("se",), ("xx",), ("ES",)], ["l"])
    got = [r[0] for r in df.select(tx.canonical_lang("l")).collect()]
    assert got == ["cs", "cs", "sv", None, "es"]


def test_sentence_goldens():
    from notelink.operators.textprep import sentence_spans

    assert sentence_spans("Fiebre alta. No tos.") == [(0, 0, 12), (1, 13, 20)]
    assert len(sentence_spans("Valor 3. mg dados.")) == 1
    assert len(sentence_spans("J. Perez llega. Sale.")) == 2
    assert len(sentence_spans("Bueno... Sigue.")) == 1


def test_chunk_goldens(spark):
    from notelink.operators import textprep as tp

    rows = [(0, " ".join(f"w{i}" for i in range(25))), (1, " ".join(f"w{i}" for i in range(20)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sents = tp.split_sentences(docs)
    for max_tokens, doc, sizes in ((10, 0, [10, 10, 5]), (4, 1, [8, 8, 4])):
        ch = tp.chunk_sentences(sents.where(f"doc_id = {doc}"), max_tokens).orderBy("chunk_id").collect()
        assert [len(c["text"].split()) for c in ch] == sizes
        assert [c["chunk_id"] for c in ch] == list(range(len(sizes)))
        text = rows[doc][1]
        assert all(text[c["start"]:c["end"]] == c["text"] for c in ch)


def test_long_sentence_is_cut_in_linear_time_and_loses_nothing(spark):
    from notelink.operators import textprep as tp

    text = "start " + " ".join(f"w{i},x" for i in range(3000))
    docs = spark.createDataFrame([("d1", text)], "doc_id string, text string")
    for tok in (None, lambda t: [(m.start(), m.end()) for m in __import__("re").finditer(r"\w+|[^\w\s]", t)]):
        rows = tp.build_chunks(docs, 100, tok).orderBy("chunk_id").collect()
        assert len(rows) == 91 and all(text[r["start"]:r["end"]] == r["text"] for r in rows)
        assert "".join("".join(r["text"].split()) for r in rows) == "".join(text.split())


def test_lines_end_where_python_ends_them(spark):
    from notelink.operators import textprep as tp

    text = "one\x0btwo\x0cthree\u2028four\x85five\r\nsix\rseven\n\neight"
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    rows = tp.split_lines_sentences(docs).orderBy("start").collect()
    assert [r["text"] for r in rows] == [x for x in text.splitlines() if x]
    assert all(text[r["start"]:r["end"]] == r["text"] for r in rows)


def test_sentences_equal_the_plain_rule(spark):
    """Column expressions against plain Python, over all mixes of what the rule looks at."""
    import random

    from notelink.operators import textprep as tp

    rnd = random.Random(13)
    parts = ["J", "Dr", "fiebre", "Alta", "3", "-1,5", "2.7", "é", "½", "x1", ".", "..", "...", "?", "!", ".?", "?.", '"', "'", ")", "]", "(", "[", "{",
             " ", " ", " ", "\n", "\t ", " ", " ", "\x00", "\x01", "\x01\x02", "日", "ª", "\U0001F600", "-", ","]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 24))) for _ in range(1500)]
    texts += ["", " ", "a", "A. b. C.", "J. Perez. 3. mg. (J.) b", "x.\x00 y. \x00z.", "w. " * 500, "." * 3000 + " a", "a" * 20000 + ". B"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(10**6, None)], "doc_id long, text string")
    got = {}
    for r in tp.split_sentences(df).collect():
        got.setdefault(r["doc_id"], []).append((r["sent_id"], r["start"], r["end"], r["text"]))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == [(n, a, b, t[a:b]) for n, a, b in tp.sentence_spans(t)], (t, got.get(i))
    assert 10**6 not in got


def test_no_python_in_sentences_and_chunks(spark):
    from notelink.operators import textprep as tp

    docs = spark.createDataFrame([(0, "a. b.")], "doc_id long, text string")
    plan = tp.build_chunks(docs, 64)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
