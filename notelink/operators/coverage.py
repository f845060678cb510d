"""Coverage and vector maintenance: R1 gaps, R2 stale vectors, R3 build vectors."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelink.operators import dense as dn
from notelink.operators.gazetteer import dedup_terms
from notelink.plans.materialize import checkpointed, with_constants
from notelink.sources import gazetteer as sg


def coverage_gaps(docs: DataFrame, gazetteer: DataFrame, vectors: DataFrame | None, entity_types: DataFrame) -> DataFrame:
    """R1: per (lang, entity type): documents, terms and vectors, and what is missing.

    ``entity_types``: ``entity_type`` rows, the caller's own list of what to check.  ``missing`` lists,
    in order, ``gazetteer`` and ``vectors`` when absent.
    """
    langs = docs.groupBy("lang").agg(F.count("*").alias("n_docs"))
    types = sorted(r["entity_type"] for r in entity_types.select("entity_type").distinct().collect())
    grid = langs.withColumn("entity_type", F.explode(F.array(*[F.lit(t) for t in types]).cast("array<string>")))
    keys = ["lang", "entity_type"]
    out = with_constants(grid, dedup_terms(gazetteer).groupBy(*keys).agg(F.count("*").alias("n_terms")), keys)
    if vectors is not None:
        out = with_constants(out, vectors.groupBy(*keys).agg(F.count("*").alias("n_vectors")), keys)
    else:
        out = out.withColumn("n_vectors", F.lit(None).cast("long"))
    n_terms = F.coalesce(F.col("n_terms"), F.lit(0))
    n_vec = F.coalesce(F.col("n_vectors"), F.lit(0))
    missing = F.array_compact(F.array(F.when(n_terms == 0, F.lit("gazetteer")),
                                      F.when((n_vec == 0) | (n_vec < n_terms), F.lit("vectors"))))
    return out.select("lang", "entity_type", F.col("n_docs").cast("long").alias("n_docs"),
                      n_terms.cast("long").alias("n_terms"), n_vec.cast("long").alias("n_vectors"),
                      missing.alias("missing"))


def unannotatable_docs(docs: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """R1: documents whose language has no gazetteer at all (anti-join)."""
    return docs.join(gazetteer.select("lang").distinct(), "lang", "left_anti")


def stale_vectors(gazetteer: DataFrame, vectors: DataFrame | None, model: str) -> DataFrame:
    """R2: G1 terms that have no vector for ``model`` yet (anti-join); embedding only these is incremental."""
    terms = dedup_terms(gazetteer)
    if vectors is None:
        return terms
    keys = [c for c in ("lang", "entity_type") if c in terms.columns]
    have = vectors.where(F.col("model") == model).select(*keys, "term").distinct()
    on = F.col("t.term") == F.col("h.term")
    for c in keys:
        on = on & F.col(f"t.{c}").eqNullSafe(F.col(f"h.{c}"))
    return terms.alias("t").join(have.alias("h"), on, "left_anti")


def build_vectors(gazetteer: DataFrame, path: str, model: str = "hashed-ngram", embed_fn=None,
                  existing: DataFrame | None = None) -> DataFrame:
    """R3: embed the stale terms (R2 -> D-1) and merge them into the vector store (S5).

    Every (lang, entity type) is a job of its own: one that fails is recorded, and the others
    go on. ``existing``: vectors that need no embedding (default: what the store has).
    Returns a status table: key, ``n_vectors`` in the store, ``written`` now, ``seconds``, ``error``.
    """
    spark = gazetteer.sparkSession
    keys = [c for c in ("lang", "entity_type") if c in gazetteer.columns]
    status = []
    for key in gazetteer.select(*keys).distinct().collect() if keys else [()]:
        begun, n, error = time.monotonic(), 0, None
        own = gazetteer
        for c in keys:
            own = own.where(F.col(c).eqNullSafe(F.lit(key[c])))
        try:
            have = existing if existing is not None else sg.stored_vectors(spark, path)
            todo = stale_vectors(own, have, model)
            vec = dn.embed_column(todo.select(*keys, "gaz_ord", "term", "code"), "term", embed_fn).withColumn("model", F.lit(model))
            vec = checkpointed(vec)
            n = vec.count()
            if n:
                sg.write_vectors(vec, path)
        except Exception as e:  # recorded: the other entries do not depend on this one
            n, error = 0, f"{type(e).__name__}: {str(e).strip().splitlines()[-1] if str(e).strip() else ''}"
        status.append((*key, n, time.monotonic() - begun, error))
    fields = ", ".join([*[f"{c} string" for c in keys], "written long, seconds double, error string"])
    table = spark.createDataFrame(status, fields)
    stored = sg.stored_vectors(spark, path)
    if stored is None:
        return table.withColumn("n_vectors", F.lit(0).cast("long"))
    total = stored.where(F.col("model") == model).groupBy(*keys).agg(F.count("*").alias("n_vectors"))
    return with_constants(table, total, keys).withColumn("n_vectors", F.coalesce("n_vectors", F.lit(0).cast("long")))
