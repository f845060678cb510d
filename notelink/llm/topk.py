"""Operator 7: exact top-k search by a three-phase uniform threshold.

Vectors are cut into ``parts`` by dimension, and rows into blocks; a node holds
one part of one block. The score of a candidate is the sum of its parts'
partial scores.

1. Each node lists its best partial scores of each query. The candidates on
   any list are scored in full; the k-th best of these scores is a safe cutoff
   ``tau``: at least k candidates reach it.
2. The cutoff goes to all nodes. Each sends every entry with partial score of
   at least ``tau / parts``: a candidate with no such entry scores below tau.
   Summing what was sent, and less than ``tau / parts`` for what was not, gives
   an upper bound; candidates below tau go.
3. What is left and not complete is scored exactly, and the best k are kept.

Equal vectors are one candidate that carries its smallest ids, and equal
queries are one query; they are numbered, as an id can have several vectors. So a vector with very many copies costs what one does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelink.llm.common import broadcasts_bounded, written

CANDIDATES, QUERIES = 4096, 512  # rows of a block
# Queries of up to so many bytes are broadcast to the candidates' blocks; more are sent to each block by a shuffle.
QUERY_BYTES = 32 * 1024 * 1024


def scaled(vector: str = "embedding", scale: int = 256) -> Column:
    """floor(scale * x) of each component, as long; null if the vector is null, empty or
    has a component that is null or not finite."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    ok = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.when(ok & (F.size(v) > 0), F.transform(v, lambda x: F.floor(x * scale)))


def _block_counts(rows: DataFrame, size: int) -> Column:
    """How many blocks of about ``size`` rows the rows of each ``dim`` make."""
    out = F.lit(1)
    for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect():
        out = F.when(F.col("dim") == r.dim, F.lit(-(-r.n // size))).otherwise(out)
    return out


def _packed(rows: DataFrame, key: str, blocks: Column, parts: int) -> DataFrame:
    """Rows (``dim``, ``key``, ``v``) as blocks: (dim, block, part, ids, matrix), binary."""

    def pack(group, pdf):
        v = np.stack(pdf["v"].to_numpy()).astype(np.int64)
        cut = np.linspace(0, v.shape[1], parts + 1).astype(int)
        ids = pdf[key].to_numpy(np.int64).tobytes()
        return pd.DataFrame([(group[0], group[1], j, ids, np.ascontiguousarray(v[:, cut[j]:cut[j + 1]]).tobytes())
                             for j in range(parts)], columns=["dim", "block", "part", "ids", "matrix"])

    out = rows.withColumn("block", F.pmod(F.xxhash64(key), blocks).cast("int"))
    return out.groupBy("dim", "block").applyInPandas(pack, "dim int, block int, part int, ids binary, matrix binary")


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of all rows: in doubles while they hold every sum exactly."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def _nodes(pairs: DataFrame, emit: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Partial scores of joined blocks; ``emit(scores, cutoffs)`` says which entries leave the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = {n: batch.column(n)[r].as_py() for n in batch.schema.names}
                q, c = (np.frombuffer(one[x], np.int64) for x in ("q_ids", "ids"))
                score = _product(np.frombuffer(one["q_matrix"], np.int64).reshape(len(q), -1),
                                 np.frombuffer(one["matrix"], np.int64).reshape(len(c), -1))
                i, j = emit(score, np.frombuffer(one["tau"], np.int64) if one.get("tau") else None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q[i]), pa.array(c[j]), pa.array(np.full(len(i), one["part"], np.int32)), pa.array(score[i, j])],
                    names=["q", "c", "part", "score"])

    return pairs.mapInArrow(run, "q long, c long, part int, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "v", parts: int = 2) -> DataFrame:
    """The ``k`` best candidates of each query row: (query_id, rank, vec_id, score).

    ``vectors`` holds ``key`` (long) and ``vector`` (array of long); ``is_query``
    selects the query rows. Score: inner product, ties to the smaller id. A row
    with the query's own id is not its candidate; fewer than k candidates are all
    returned. Null keys, null and empty vectors take no part; only vectors of
    equal length are compared; rows with equal key and vector count once. Scores
    must fit in 64 bits.
    """
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"), is_query.alias("is_query"))
    rows = written(rows.filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").withColumn("dim", F.size("v")), "vectors")
    # One candidate per distinct vector, with the k + 1 smallest ids (one may be the query's own).
    nth = F.row_number().over(Window.partitionBy("dim", "v").orderBy("id"))
    few = rows.select("dim", "v", "id").distinct().withColumn("n", nth).filter(F.col("n") <= k + 1)
    cands = few.groupBy("dim", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    cands = written(cands.withColumn("c", F.monotonically_increasing_id()), "candidates")
    asked = rows.filter(F.coalesce("is_query", F.lit(False))).select("dim", "v", F.col("id").alias("query_id")).distinct()
    queries = written(asked.select("dim", "v").distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
    # A query's own id is on as many candidates as it has vectors.
    owned = rows.select("dim", "v", "id").distinct().join(asked.select(F.col("query_id").alias("id")).distinct(), "id", "left_semi")
    best = k + (owned.groupBy("dim", "id").count().agg(F.max("count")).first()[0] or 1)

    blocks = _block_counts(cands.select(F.size("v").alias("dim")), CANDIDATES)
    own = written(_packed(cands.select("dim", "c", "v"), "c", blocks, parts), "blocks")
    asking = written(_packed(queries.select("dim", "q", "v"), "q", _block_counts(queries, QUERIES), parts), "query_blocks")
    few = (asking.agg(F.sum(F.octet_length("matrix") + F.octet_length("ids"))).first()[0] or 0) <= QUERY_BYTES

    def met(asked: DataFrame) -> DataFrame:
        """Every node meets every block of queries of its length. Copies for each block are never broadcast:
        Spark does not count them when it estimates a size."""
        each = asked.withColumnsRenamed({"block": "q_block", "ids": "q_ids", "matrix": "q_matrix"})
        if few:
            return own.join(F.broadcast(each), ["dim", "part"])
        return each.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).hint("merge").join(own, ["dim", "block", "part"])

    def lists(score, _):
        n = min(best, score.shape[1])
        at = np.argpartition(-score, n - 1, axis=1)[:, :n]
        return np.repeat(np.arange(len(score)), n), at.ravel()

    def enough(score, tau):
        return np.nonzero(score * parts >= tau[:, None])

    with broadcasts_bounded(vectors.sparkSession):
        # Phase 1: lists, the best of each part, their full scores, the cutoff.
        listed = _nodes(met(asking), lists)
        by_part = F.row_number().over(Window.partitionBy("q", "part").orderBy(F.desc("score"), "c"))
        gathered = listed.withColumn("n", by_part).filter(F.col("n") <= best).select("q", "c").distinct()
        by_total = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))
        kth = exact_scores(gathered, queries, cands, few).withColumn("n", by_total).filter(F.col("n") <= best)
        tau = kth.groupBy("q").agg(F.when(F.count("*") == best, F.min("score")).alias("tau"))
        # Phase 2: the cutoff of every query travels with its block.
        tau = written(queries.select("q").join(tau, "q", "left").select("q", F.coalesce("tau", F.lit(-(1 << 61))).alias("tau")), "cutoffs")
        cut = written(asking.join(_cutoffs(asking, tau), ["dim", "block", "part"]), "cut_blocks")
        entries = _nodes(met(cut), enough)
        known = entries.groupBy("q", "c").agg(F.sum("score").alias("sum"), F.count("*").alias("n")).join(tau, "q")
        rest = F.ceil(F.col("tau") / parts) - 1  # the most that a part which was not sent can have
        upper = F.col("sum") + (parts - F.col("n")) * rest
        left = written(known.filter((F.col("n") == parts) | (upper >= F.col("tau"))), "survivors")
    # Phase 3: complete sums are exact already, the others are looked up.
    done = left.filter(F.col("n") == parts).select("q", "c", F.col("sum").alias("score"))
    scored = done.unionByName(exact_scores(left.filter(F.col("n") < parts).select("q", "c"), queries, cands, few))
    by_id = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "least", "c"))
    scored = scored.join(cands.select("c", F.col("ids")[0].alias("least")), "c")
    with broadcasts_bounded(vectors.sparkSession):
        top = written(scored.withColumn("n", by_id).filter(F.col("n") <= best).select("q", "c", "score"), "best")
    # Back to rows: each query row, the ids behind each candidate, without its own.
    answers = top.join(cands.select("c", "ids", F.size("v").alias("dim")), "c")
    answers = queries.join(answers, ["q", "dim"]).select("dim", "v", "score", F.explode("ids").alias("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id", "own").orderBy(F.desc("score"), "vec_id"))
    full = asked.withColumn("own", F.xxhash64("v")).join(answers, ["dim", "v"]).filter("query_id != vec_id")
    return full.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _cutoffs(asking: DataFrame, tau: DataFrame) -> DataFrame:
    """The cutoffs of each block of queries, packed in the order of its ids."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = {n: batch.column(n)[r].as_py() for n in ("dim", "block", "part", "ids")}
                q = np.frombuffer(one["ids"], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(np.full(len(q), one[n], np.int32)) for n in ("dim", "block", "part")],
                     pa.array(np.arange(len(q), dtype=np.int32)), pa.array(q)], names=["dim", "block", "part", "at", "q"])

    def pack(group, pdf):

        values = pdf.sort_values("at")["tau"].to_numpy(np.int64).tobytes()
        return pd.DataFrame([(*group, values)], columns=["dim", "block", "part", "tau"])

    slots = asking.select("dim", "block", "part", "ids").mapInArrow(unpack, "dim int, block int, part int, at int, q long")
    return slots.join(tau, "q").groupBy("dim", "block", "part").applyInPandas(pack, "dim int, block int, part int, tau binary")


def exact_scores(pairs: DataFrame, queries: DataFrame, cands: DataFrame, few: bool = False) -> DataFrame:
    """Full inner products of (q, c) pairs, by looking both vectors up. ``few`` queries are broadcast, last:
    then pairs are moved as two numbers."""
    a = queries.select("q", F.col("v").alias("qv"))
    b = cands.select("c", F.col("v").alias("cv"))
    dot = F.aggregate(F.zip_with("qv", "cv", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
    both = pairs.join(b, "c").join(F.broadcast(a), "q") if few else pairs.join(a, "q").join(b, "c")
    return both.filter(F.size("qv") == F.size("cv")).select("q", "c", dot.alias("score"))
