"""Steps that must not grow faster than their input: what plans hold, and texts that backtracking would not end on."""

from __future__ import annotations

from notelink.functions import text as tx
from notelink.operators import textprep as tp


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pretokenize_makes_nothing_for_each_character(spark):
    df = spark.createDataFrame([(1, "a,b \U0001F600\x00c"), (2, ""), (3, None)], "doc_id long, t string")
    out = df.select("doc_id", tx.pretokenize("t").alias("p"))
    assert "regexp_extract_all" not in _plan(out)
    got = {r["doc_id"]: (r["p"]["text"], r["p"]["added"]) for r in out.collect()}
    assert got == {1: ("a , b \U0001F600 \x00 c", [1, 3, 7, 9]), 2: ("", []), 3: (None, None)}


def test_runs_of_places_are_no_python_rows(spark):
    """The offset map leaves the worker as Arrow numbers; before, a batch held a dictionary for each run."""
    import pyarrow as pa

    got = tx.normalize_with_offsets.func(pa.array(["a\u0301b", None, "", "한 x", "İs"]))
    assert isinstance(got, pa.Array)
    assert got.to_pylist() == [
        {"norm": "ab", "runs": [{"norm_start": 0, "start": 0}, {"norm_start": 1, "start": 2}]}, {"norm": None, "runs": None},
        {"norm": "", "runs": [{"norm_start": 0, "start": 0}]},
        {"norm": "한 x", "runs": [{"norm_start": 0, "start": 0}, {"norm_start": 1, "start": 0}, {"norm_start": 2, "start": 0}]},
        {"norm": "is", "runs": [{"norm_start": 0, "start": 0}]}]


def test_sentences_of_long_runs_of_marks(spark):
    """Runs of marks that no white space follows, and white space inside texts, are read once."""
    texts = ["." * 20_000 + "y " + "?!" * 10_000 + "z b. C", "a." + " " * 50_000 + "B. c", "1" * 30_000 + ". a. B", "('" * 9_000 + "J. B. c"]
    rows = tp.split_sentences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for i, t in enumerate(texts):
        assert sorted((r["sent_id"], r["start"], r["end"]) for r in rows if r["doc_id"] == i) == tp.sentence_spans(t)


def test_chunks_split_texts_once(spark):
    docs = spark.createDataFrame([(0, "a. b.")], "doc_id long, text string")
    assert _plan(tp.build_chunks(docs, 64)).count("posexplode(split(") == 1


def test_spans_are_cut_once_for_a_document(spark):
    """Each span walked through its text from the beginning; one table of spans also had the whole text in each row."""
    text = "áé" * 3000 + " ends \U0001F600."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "ab")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 0, 2, "x"), (1, 6001, 6005, "y"), (1, 6006, 6007, "z"), (1, 6005, 9000, "far"), (2, 0, 1, "n"), (3, 0, 2, "a"), (4, 0, 1, "g")],
                                  "doc_id long, start int, end int, tag string")
    out = tp.cut_spans(spans, docs, "left")
    assert "substring(text" not in _plan(out)
    assert {r["tag"]: r["span"] for r in out.collect()} == {"x": "áé", "y": "ends", "z": "\U0001F600", "far": " \U0001F600.", "n": None, "a": "ab", "g": None}
    assert {r["tag"] for r in tp.cut_spans(spans, docs, within=True).collect()} == {"x", "y", "z", "a"}


def test_lookup_hands_on_candidates_before_a_batch_ends(spark, monkeypatch):
    import pandas as pd

    from notelink.operators import lookup as lk

    monkeypatch.setattr(lk, "MAX_FOUND", 10)
    held = type("Held", (), {"value": None})
    shapes, norms = held(), held()
    shapes.value, norms.value = {"ab": [1]}, frozenset(["ab"])
    batch = pd.DataFrame({"doc_id": [1, 2], "text": ["ab " * 25, "ab"]})
    got = list(lk._candidates_fn(shapes, norms, 1, False)(iter([batch])))
    assert [len(x) for x in got] == [10, 10, 6]
    assert pd.concat(got)["start"].tolist() == [*range(0, 75, 3), 0]


def test_no_row_holds_the_balls_of_its_key(spark, monkeypatch):
    """Every query row had an array of all balls; blocks of queries, terms and strips give the same search."""
    import numpy as np

    from notelink.operators import dense as dn

    for name, rows in (("QUERY_BLOCK_ROWS", 16), ("TERM_BLOCK_ROWS", 32), ("STRIP_ROWS", 5)):
        monkeypatch.setattr(dn, name, rows)
    rnd = np.random.default_rng(3)
    v = np.round(rnd.normal(size=(150, 6)), 2)
    v[20:60] = v[20]
    rows = [(int(i % 2), int(i), x.tolist()) for i, x in enumerate(v)]
    q = spark.createDataFrame(rows, "label int, q_id long, vec array<double>")
    t = spark.createDataFrame(rows, "label int, gaz_ord long, vec array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for keys in ([], ["label"]):
        top = dn.cosine_top_k(q, t, 3, keys=keys, prune=True)
        assert "collect_list" not in _plan(top) and not any("BroadcastNestedLoopJoin" in x for x in [top._jdf.queryExecution().toString()])
        got = {(r["q_id"], r["rank"]): (r["gaz_ord"], r["sim"]) for r in top.collect()}
        for i in range(len(v)):
            mine = [j for j in range(len(v)) if not keys or j % 2 == i % 2]
            best = sorted((-float(np.round(u[i] @ u[j], 6)), j) for j in mine)[:3]
            assert [(got[i, n][0], abs(got[i, n][1] + s) < 2e-6) for n, (s, _) in enumerate(best)] == [(j, True) for _, j in best]


def test_terms_are_counted_where_they_are_read(spark, tmp_path, monkeypatch):
    from notelink.plans import fixtures as fx

    monkeypatch.setattr(fx, "MIN_WORD_DOCS", 2)
    monkeypatch.setattr(fx, "MIN_PAIR_DOCS", 2)
    rows = [(1, "en", "ÀBcd, Word word\U0001F600tail KKelvin"), (2, "en", "àbcd word word tail"), (3, "en", None), (4, "en", "")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    g = fx.gaz_words(spark, str(tmp_path))
    assert [(r["gaz_ord"], r["term"]) for r in g.orderBy("gaz_ord").collect()] == [(1, "tail"), (2, "word"), (3, "word tail"), (4, "word word"), (5, "àbcd")]
    import pyarrow as pa

    monkeypatch.setattr(fx, "MAX_COUNTED", 3)
    parts = list(fx._counted_terms(iter([pa.RecordBatch.from_arrays([pa.array(["a b", "c d", "e f"])], names=["text"])])))
    assert [p.num_rows for p in parts] == [3, 3, 3, 0]


def test_ordinals_leave_no_shuffle_files(spark):
    from notelink.plans.materialize import numbered

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before = files()
    got = numbered(spark.range(500).selectExpr("id % 50 AS k").groupBy("k").count(), ["k"])
    assert not files() - before
    assert [(r["k"], r["ordinal"]) for r in got.orderBy("k").collect()] == [(i, i) for i in range(50)]


def test_folders_of_documents_are_put_in_place_by_tasks(spark, monkeypatch):
    """With one folder per document, the driver moved one after the other."""
    import pytest
    from pyspark.sql import DataFrameWriter

    from notelink.plans.queries import QUERIES

    for name in ("q_p6_annotate_dir", "q_p7_stream"):
        given = {}

        def options(self, _given=given, **o):
            _given.update(o)
            return self

        def text(self, path):
            raise InterruptedError

        monkeypatch.setattr(DataFrameWriter, "options", options)
        monkeypatch.setattr(DataFrameWriter, "text", text)
        with pytest.raises(InterruptedError):
            QUERIES[name](spark, "/root/testdata/sf0.001")
        assert given["mapreduce.fileoutputcommitter.algorithm.version"] == "2"
