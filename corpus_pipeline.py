"""A training corpus from raw documents: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. The first four return the columns of
``documents``; the last returns token ids. In every stage, rows with null texts
are empty texts, and rows with a null ``doc_id`` are handled as the stage says. Columns besides those of
``documents`` come back as they are, whatever their names (the last stage returns its own columns only).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelink.llm import bpe, decontaminate, jaccard, suffix_dedup, toxicity
from notelink.llm.common import table, unique_ids, written
from notelink.llm.queries import CATEGORIES, RANKS, REJECT


OWN = ("doc_id", "text", "lang", "source", "n_chars")


def aside(docs: DataFrame) -> tuple[DataFrame, list]:
    """``docs`` with its further columns under names that no stage uses, and how to select them all back.
    Without further columns it stays as it is: a plan that reads it twice then still shares one exchange."""
    if set(docs.columns) <= set(OWN):
        return docs, docs.columns
    names = [(c, c if c in OWN else f"given{i}_{c}") for i, c in enumerate(docs.columns)]
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names]), [F.col(f"`{n}`").alias(c) for c, n in names]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject, whatever their other categories.
    Documents without words get the base rates, and stay."""
    docs, back = aside(docs)
    chain = toxicity.learn(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    scored = toxicity.score(docs, chain, list(CATEGORIES))
    return scored.filter(F.col("p_toxic") < REJECT).select(*back)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near duplicates. Texts without
    words have no duplicates, rows with a null id stay, and of equal rows one stays."""
    docs, back = aside(docs)
    found = jaccard.jaccard_join(docs).members
    stay = found.filter("doc_id = component_id").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    keyed = docs.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_hash", F.xxhash64("text"))
    kept = keyed.filter("_id IS NOT NULL").join(stay, ["_id", "_hash"], "left_semi").select(*docs.columns)
    if not unique_ids(docs.filter("doc_id IS NOT NULL"), "doc_id"):
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.filter("doc_id IS NULL")).select(*back)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte passages that a document with a smaller id has; characters that
    a cut goes through go whole. No row goes; a text may be left empty, and null stays null."""
    docs, back = aside(docs)
    cut = suffix_dedup.remove_repeats(docs)
    return cut.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))).withColumn(
        "n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*back)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in passages of a benchmark item."""
    docs, back = aside(docs)
    return decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark")).filter(~F.col("contaminated")).select(*back)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids); the ids are decoded again, and a text that does not
    come back byte for byte would stop the job."""
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text"), RANKS), RANKS)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    checked = F.when(same, F.col("ids")).otherwise(F.raise_error(F.lit("a text did not come back from its ids")).cast("array<int>"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), checked.alias("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", keep_one_of_each_group),
    ("suffix_dedup", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("byte_bpe", encode),
]

# The first and the last stage learn from data and follow a rank file: SQL does not express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
