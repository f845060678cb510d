"""Gazetteer and vector storage: S3 read, S4 check, S5 vectors."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelink.plans.materialize import checkpointed, numbered

REQUIRED = ("term", "code")


def read_gazetteer(spark: SparkSession, path: str | list[str], lang: str | None = None, entity_type: str | None = None,
                   multi_line: bool = True) -> DataFrame:
    """S3: TSV (or CSV by extension) with a header; every value a string. ``path``: a file, folder, pattern or list.

    ``gaz_ord`` numbers the rows by file name, then place in the file, which all first-wins /
    last-wins / lowest-index rules need. Quoted values may have line ends; a very
    large file without any is read by several tasks with ``multi_line=False``. Extra columns are kept.
    """
    first = path if isinstance(path, str) else path[0]
    sep = "," if first.lower().endswith(".csv") else "\t"
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False, quote='"', escape='"', multiLine=multi_line)
    at = ["_metadata.file_path", "_metadata.file_block_start"]
    df = df.select(*df.columns, F.col(at[0]).alias("_file"), F.col(at[1]).alias("_block"), F.monotonically_increasing_id().alias("_row"))
    df = numbered(df, ["_file", "_block", "_row"], "gaz_ord").drop("_file", "_block", "_row")
    if lang is not None:
        df = df.withColumn("lang", F.lit(lang))
    if entity_type is not None:
        df = df.withColumn("entity_type", F.lit(entity_type))
    return df


def check_gazetteer(gaz: DataFrame) -> dict:
    """S4: required columns present; counts of rows, null terms and duplicated terms (one job)."""
    missing = [c for c in REQUIRED if c not in gaz.columns]
    if missing:
        raise ValueError(f"gazetteer lacks required columns: {missing}")
    r = gaz.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("term").isNull()).alias("null_terms"),
                (F.count("term") - F.count_distinct("term")).alias("duplicate_terms")).first()
    return {"rows": int(r["rows"]), "null_terms": int(r["null_terms"]), "duplicate_terms": int(r["duplicate_terms"])}


VECTOR_KEYS = ("lang", "entity_type", "model")


def write_vectors(vectors: DataFrame, path: str, mode: str = "merge") -> None:
    """S5: Parquet partitioned by ``lang, entity_type, model`` (partition pruning on read).

    ``merge`` writes the touched partitions anew: their terms stay, those that ``vectors`` has
    too are replaced, so a repeated or retried job doubles nothing. The new partitions
    are complete in a staging table before any is replaced. ``append`` and ``overwrite`` are Spark's.
    """
    parts = [c for c in VECTOR_KEYS if c in vectors.columns]
    if mode != "merge" or not parts:
        vectors.write.mode("overwrite" if mode == "merge" else mode).partitionBy(*parts).parquet(path)
        return
    new = checkpointed(vectors)
    old = stored_vectors(vectors.sparkSession, path)
    if old is not None:
        touched = new.select(*parts).distinct()
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in [*parts, "term"]]
        kept = old.select(*[F.col(c).cast(new.schema[c].dataType).alias(c) if c in old.columns else F.lit(None).cast(new.schema[c].dataType).alias(c)
                            for c in new.columns])
        kept = kept.alias("o").join(touched.alias("n"), [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in parts], "left_semi")
        kept = kept.alias("o").join(new.select(*parts, "term").alias("n"), same, "left_anti")
        new = checkpointed(new.unionByName(kept))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def stored_vectors(spark: SparkSession, path: str) -> DataFrame | None:
    """What the vector store has, or nothing if there is no store yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_vectors(spark: SparkSession, path: str, model: str | None = None, **keys) -> DataFrame:
    """S5: vectors for one model and key; the filters prune partitions."""
    df = spark.read.parquet(path)
    if model is not None:
        df = df.where(F.col("model") == model)
    for k, v in keys.items():
        df = df.where(F.col(k) == v)
    return df
