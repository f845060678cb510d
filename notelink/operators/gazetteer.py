"""Gazetteer de-duplication (G1) and the normal-form index (G2).

A gazetteer is a DataFrame ``(gaz_ord, term, code)`` plus optional key columns
``lang`` and ``entity_type``.  ``gaz_ord`` is the row position in the source
file; both rules below depend on it, so it must be carried from the reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelink.functions.text import normalize

KEY_COLUMNS = ("lang", "entity_type")


def gaz_keys(gaz: DataFrame) -> list[str]:
    return [c for c in KEY_COLUMNS if c in gaz.columns]


def dedup_terms(gaz: DataFrame) -> DataFrame:
    """G1: one row per raw ``term`` (per key); the first row in file order wins."""
    keys = gaz_keys(gaz) + ["term"]
    others = [c for c in gaz.columns if c not in keys]
    first = F.min_by(F.struct(*others), "gaz_ord").alias("_r")
    return gaz.where(F.col("term").isNotNull()).groupBy(*keys).agg(first).select(*keys, "_r.*")


def norm_index(gaz: DataFrame, deduped: bool = False) -> DataFrame:
    """G2: normal form -> (term, code); among rows sharing a normal form the last wins.

    Returns ``keys, norm, term, code, gaz_ord`` with ``norm`` unique per key.
    """
    g = gaz if deduped else dedup_terms(gaz)
    keys = gaz_keys(g)
    g = g.select(*keys, normalize(F.col("term")).alias("norm"), "term", "code", "gaz_ord")
    last = F.max_by(F.struct("term", "code", "gaz_ord"), "gaz_ord").alias("_r")
    return g.groupBy(*keys, "norm").agg(last).select(*keys, "norm", "_r.*")


def normalized_terms(gaz: DataFrame, deduped: bool = False) -> DataFrame:
    """G1 rows with their normal form: the scoring universe of the linkers.

    Duplicated normal forms stay separate rows, as in the reference.
    """
    g = gaz if deduped else dedup_terms(gaz)
    keys = gaz_keys(g)
    return g.select(*keys, "gaz_ord", "term", "code", normalize(F.col("term")).alias("norm"))
