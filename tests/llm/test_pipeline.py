"""The pipeline against brute force, stage by stage, over whole tables with planted cases."""

import os

import pytest

import corpus_pipeline as cp
from notelink.llm.common import written
from tests.conftest import SF
from tests.llm import test_bpe, test_decontaminate, test_jaccard, test_suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """sf0.001 with copies, near copies, benchmark passages, null ids and texts added."""
    d = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS)
    texts = [r.text for r in docs.orderBy("doc_id").limit(3).collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    extra = [(9001, texts[0]), (9002, texts[1] + " tail"), (9003, item), (9004, "clean words " + item), (9005, None), (9006, ""),
             (None, texts[2]), (None, None), (9008, texts[0]), (9008, texts[0]), (9009, "ok")]
    docs.unionByName(spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in extra], docs.schema)).write.parquet(f"{d}/documents.parquet")
    for t in ("labels", "benchmark"):
        os.symlink(f"{SF}/{t}.parquet", f"{d}/{t}.parquet")
    return d


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages_equal_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    given = rows(docs)
    out = []
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, tables), name)
        out.append(docs)
    toxic, joined, cut, clean, ids = out
    assert all(d.columns == COLUMNS for d in out[:4])

    # 1: what is labelled toxic goes, clean documents stay; no text changes
    kept = rows(toxic)
    assert set(kept) <= set(given) and (9009, "ok") in kept and len(kept) < len(given)
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {i for i, _ in given if i is not None} - {i for i, _ in kept}
    assert sum(label.get(i) == 0 for i in gone) <= 1

    # 2: one of each component
    keyed = [(i, t) for i, t in kept if i is not None]
    comp = test_jaccard.brute(sorted(set(keyed), key=str))
    want = [(i, t) for i, t in set(keyed) if comp[i][1] == i] + [(i, t) for i, t in kept if i is None]
    assert rows(joined) == sorted(want, key=str)

    # 3: repeated passages go, whole characters stay
    want = []
    for (i, t), (_, _, n, spans, _) in zip(rows(joined), test_suffix_dedup.brute(rows(joined))):
        raw, at, parts = (t or "").encode(), 0, []
        for a, b in [*spans, (len((t or "").encode()),) * 2]:
            parts.append(raw[at:a].decode("utf-8", "ignore"))
            at = b
        want.append((i, "".join(parts) if n else t))
    assert rows(cut) == sorted(want, key=str)
    assert all(r.n_chars == len(r.text) for r in cut.collect() if r.text is not None)

    # 4: contaminated documents go
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = [(i, t) for i, t in rows(cut) if not test_decontaminate.brute(t, items, 13)[3]]
    assert rows(clean) == want and len(want) < len(rows(cut))

    # 5: ids as the library has them
    text = dict(rows(clean))
    got = sorted(((r.doc_id, r.n_tokens, list(r.ids)) for r in ids.collect()), key=str)
    assert got == sorted(((i, len(x), x) for i, t in rows(clean) for x in [test_bpe.LIB.encode_ordinary(t or "")]), key=str)
    assert len(got) == len(rows(clean)) and 9009 in text


def test_clashing_columns_come_back_as_they_are(spark, tables):
    clash = ["_id", "_hash", "_text", "P_toxic", "spans", "kept", "n_removed", "items", "contaminated", "_word_runs", "class_id"]
    docs = spark.read.parquet(f"{tables}/documents.parquet").filter("doc_id > 9000 OR doc_id < 5")
    docs = docs.select("*", *[docs["doc_id"].cast("string").alias(c) for c in clash])
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == str(r.doc_id) for r in rows for c in clash), name


def test_run_over_empty_documents(spark, tables, tmp_path):
    spark.read.parquet(f"{tables}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        os.symlink(f"{SF}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_entry_works_without_the_subpackage(monkeypatch):
    """The other queries register when the subpackage is not there; other import errors are not hidden."""
    import sys

    import __spark_entry__ as E

    every = set(E.queries())
    assert {"pipeline", "op1_decontaminate", "op10_language_id"} <= every
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "notelink.llm.queries", raising=False)
    monkeypatch.setitem(sys.modules, "notelink.llm", None)
    assert {q for q in every if q.startswith("q_")} == set(E.queries())
