"""Test views derived from the driver tables (Spark side).

Each view here has a DuckDB twin in :mod:`notelink.plans.oracle` written
independently in SQL; both read whole tables and whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelink.functions.text import NON_WORD_RE, PRETOKEN_RE, WORD_RE
from notelink.plans.materialize import numbered

# Fixed values of the test views (FIXTURES.md §2).
SCOPE_WORDS = ["the", "that", "le", "la", "die", "der", "el", "que"]
MIN_WORD_DOCS = 20
MIN_PAIR_DOCS = 5
MIN_WORD_LEN = 4
# Terms that a worker counts before it hands them on.
MAX_COUNTED = 200_000
_SEPARATED = re.compile(f"({NON_WORD_RE}+)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def by_document(df: DataFrame) -> DataFrame:
    """Hash-partition by ``doc_id`` once; later per-document windows and the
    record build then need no further exchange.  (A table stored bucketed by
    ``doc_id`` makes this step free.)"""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "doc_id")


def docs_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_document(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


def gaz_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("gaz_ord"),
        F.col("p_name").alias("term"),
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("code"),
    )


def gaz_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gaz_part(spark, sf_dir)
    a = g.select((F.col("gaz_ord") * 2).alias("gaz_ord"), "term", "code")
    b = g.select((F.col("gaz_ord") * 2 + 1).alias("gaz_ord"), F.upper("term").alias("term"),
                 F.concat("code", F.lit("u")).alias("code"))
    return a.unionByName(b)


def noisy_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "part").select(F.col("p_name").alias("base")).distinct()
    w1 = F.split("base", " ").getItem(0)
    w2 = F.element_at(F.split("base", " "), 2)
    variants = F.array(
        F.struct(F.lit(0).alias("v"), F.col("base").alias("span")),
        F.struct(F.lit(1).alias("v"), F.upper("base").alias("span")),
        F.struct(F.lit(2).alias("v"), F.concat(F.substring("base", 1, 2), F.expr("substring(base, 4)")).alias("span")),
        F.struct(F.lit(3).alias("v"), F.concat_ws(" ", w2, w1).alias("span")),
        F.struct(F.lit(4).alias("v"), F.concat_ws(" ", w1, F.lit("thing")).alias("span")),
        F.struct(F.lit(5).alias("v"), F.lit("zzz qqq").alias("span")),
    )
    return base.select("base", F.explode(variants).alias("x")).select("base", "x.v", "x.span")


def tokens_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every T3 token of every document with its offsets (covers all characters)."""
    d = docs_fx(spark, sf_dir)
    t = d.select("doc_id", "lang", F.length("text").alias("doc_len"),
                 F.posexplode(F.regexp_extract_all("text", F.lit(PRETOKEN_RE), 1)).alias("pos", "tok"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("end", F.sum(F.length("tok")).over(w))
    return t.withColumn("start", F.col("end") - F.length("tok"))


def words_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_fx(spark, sf_dir).where(F.col("tok").rlike(f"^{WORD_RE}"))


def mentions_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words_fx(spark, sf_dir)
    n = F.length("tok")
    cls = F.when(n % 3 == 0, "A").when(n % 3 == 1, "B").otherwise("C")
    score = (F.lit(50) + (n * 7) % 50).cast("double") / 100
    return w.select("doc_id", F.col("pos").alias("ord"), "start", "end", F.col("tok").alias("span"),
                    cls.alias("ner_class"), score.alias("ner_score"))


def scopes_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words_fx(spark, sf_dir).where(F.lower("tok").isin(SCOPE_WORDS))
    short = F.col("pos") % 5 == 0
    start = F.when(short, F.col("start") + 1).otherwise(F.col("start"))
    end = F.when(short, F.col("start") + 2).otherwise(F.least(F.col("end") + 30, F.col("doc_len")))
    cls = F.when(F.col("pos") % 4 == 0, "USCO").otherwise("NSCO")
    score = (F.lit(60) + F.col("start") % 40).cast("double") / 100
    return w.select("doc_id", start.alias("start"), end.alias("end"), cls.alias("ner_class"), score.alias("ner_score"))


def _counted_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``words`` (1 or 2), ``term, n``: in how many of the texts read so far a word or pair occurs."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def taken() -> pa.RecordBatch:
        rows = [(k, t, n) for k, c in enumerate(counts, 1) for t, n in c.items()]
        for c in counts:
            c.clear()
        kinds = (pa.int32(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["words", "term", "n"])

    for batch in batches:
        for text in batch.column(0):
            parts = _SEPARATED.split(text.as_py() or "")  # word, other characters, word, ...
            words = parts[::2]
            # only A-Z and the letters from À to Þ change: the small ones are word characters of one letter too
            counts[0].update({w.lower() for w in set(words)})
            pairs = {f"{a} {b}" for a, sep, b in zip(words, parts[1::2], words[1:]) if len(sep) == 1 and a and b}
            counts[1].update({p.lower() for p in pairs})
            if len(counts[0]) + len(counts[1]) >= MAX_COUNTED:
                yield taken()
    yield taken()


def gaz_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word gazetteer mined from the corpus: frequent words and adjacent pairs.

    A pair is a word, one single-character token and a word. Workers count the documents of
    each term in their rows, so what is exchanged is terms with counts, not each occurrence.
    """
    d = docs_fx(spark, sf_dir).select("text")
    nd = d.mapInArrow(_counted_terms, "words int, term string, n long").groupBy("words", "term").agg(F.sum("n").alias("nd"))
    kept = nd.where(F.when(F.col("words") == 1, (F.length("term") >= MIN_WORD_LEN) & (F.col("nd") >= MIN_WORD_DOCS)).otherwise(F.col("nd") >= MIN_PAIR_DOCS))
    g = numbered(kept.select("term", "nd"), [F.col("nd").desc(), F.col("term")], "_o").withColumn("gaz_ord", F.col("_o") + 1)
    return g.select(F.lit("WORD").alias("entity_type"), "gaz_ord", "term",
                    F.concat(F.lit("W"), F.col("gaz_ord").cast("string")).alias("code"))


def vec_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
