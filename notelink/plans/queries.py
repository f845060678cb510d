"""Registered queries: one per operator of the inventory, each with its SQL twin.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> str``
(DuckDB SQL over the driver tables).  Integer outputs are BIGINT and scores
DOUBLE on both sides; every computed column is aliased identically.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelink.functions import text as tx
from notelink.operators import coverage as cv
from notelink.operators import dense as dn
from notelink.operators import gazetteer as gz
from notelink.operators import lexical as lx
from notelink.operators import lookup as lk
from notelink.operators import mentions as mn
from notelink.operators import negation as ng
from notelink.operators import records as rc
from notelink.operators import tagging as tg
from notelink.operators import textprep as tp
from notelink.plans import fixtures as fx
from notelink.plans.materialize import checkpointed
from notelink.plans.oracle import with_views
from notelink.session import scratch_path
from notelink.sources import gazetteer as sg
from notelink.sources import notes as sn
from notelink.sources import sinks as sk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def _long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


# --- T1 normalise ----------------------------------------------------------

@register("q_t1_normalize", "SELECT doc_id, strip_accents(lower(text)) AS norm FROM documents")
def q_t1_normalize(spark: SparkSession, d: str) -> DataFrame:
    return fx.docs_fx(spark, d).select("doc_id", tx.normalize("text").alias("norm"))


# Texts with precomposed and combining accents, a ligature, Hangul and a letter that lower-cases to two.
_T2_SQL = """
WITH d AS (SELECT doc_id, replace(replace(replace(replace(text, 'the', '한국ﬁ'), 'an', chr(192) || 'n'), 'or', 'o' || chr(769) || 'r'), 'is', chr(304) || 's') AS text
           FROM documents),
c AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS ch, unnest(range(0, length(text))) AS i FROM d),
n AS (SELECT doc_id, i, CASE WHEN unicode(ch) BETWEEN 44032 AND 55203 THEN
        chr(4352 + (unicode(ch) - 44032) // 588) || chr(4449 + (unicode(ch) - 44032) % 588 // 28)
        || CASE WHEN (unicode(ch) - 44032) % 28 > 0 THEN chr(4519 + (unicode(ch) - 44032) % 28) ELSE '' END
      WHEN unicode(ch) = 304 THEN 'i' ELSE strip_accents(lower(ch)) END AS piece FROM c),
p AS (SELECT doc_id, i, piece, length(piece) AS k, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM n),
"""


@register("q_t2_normalize_with_offsets", _T2_SQL + """
place AS (SELECT doc_id, i, e - k + j AS q FROM p, unnest(range(0, k)) AS u(j)
       UNION ALL SELECT doc_id, max(i) + 1, max(e) FROM p GROUP BY doc_id),
runs AS (SELECT doc_id, q, i, i - q AS shift, lag(i - q) OVER (PARTITION BY doc_id ORDER BY q) AS was FROM place),
sig AS (SELECT doc_id, string_agg(CAST(q AS VARCHAR) || ':' || CAST(i AS VARCHAR), ';' ORDER BY q) AS runs FROM runs WHERE was IS NULL OR was <> shift GROUP BY doc_id),
norm AS (SELECT doc_id, string_agg(piece, '' ORDER BY i) AS norm FROM p GROUP BY doc_id)
SELECT doc_id, norm, runs FROM norm JOIN sig USING (doc_id)
""")
def q_t2_normalize_with_offsets(spark: SparkSession, d: str) -> DataFrame:
    n = _t2_docs(spark, d).select("doc_id", tx.normalize_with_offsets("text").alias("n")).select("doc_id", "n.*")
    sig = F.array_join(F.transform("runs", lambda r: F.concat(r["norm_start"].cast("string"), F.lit(":"), r["start"].cast("string"))), ";")
    return n.select("doc_id", "norm", sig.alias("runs"))


def _t2_docs(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    for a, b in (("the", "한국ﬁ"), ("an", "Àn"), ("or", "o\u0301r"), ("is", "\u0130s")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return fx.table(spark, d, "documents").select("doc_id", t.alias("text"))


@register("q_t2_original_offsets", _T2_SQL + """
words AS (SELECT doc_id, unnest(regexp_extract_all(norm, '[a-z]+|[^a-z]+')) AS w, unnest(range(0, len(regexp_extract_all(norm, '[a-z]+|[^a-z]+')))) AS o
          FROM (SELECT doc_id, string_agg(piece, '' ORDER BY i) AS norm FROM p GROUP BY doc_id)),
spans AS (SELECT doc_id, w, sum(length(w)) OVER (PARTITION BY doc_id ORDER BY o ROWS UNBOUNDED PRECEDING) AS z FROM words),
place AS (SELECT doc_id, i, e - k + j AS q FROM p, unnest(range(0, k)) AS u(j) UNION ALL SELECT doc_id, max(i) + 1, max(e) FROM p GROUP BY doc_id)
SELECT s.doc_id, s.w AS word, CAST(a.i AS BIGINT) AS start, CAST(b.i AS BIGINT) AS "end" FROM spans AS s
JOIN place AS a ON a.doc_id = s.doc_id AND a.q = s.z - length(s.w) JOIN place AS b ON b.doc_id = s.doc_id AND b.q = s.z
WHERE regexp_matches(s.w, '^[a-z]') AND length(s.w) > 9
""")
def q_t2_original_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Long words found in the normal form, with their places in the original text."""
    n = checkpointed(_t2_docs(spark, d).select("doc_id", tx.normalize_with_offsets("text").alias("n")).select("doc_id", "n.*"))
    w = Window.partitionBy("doc_id").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    t = n.select("doc_id", F.posexplode(F.regexp_extract_all("norm", F.lit("([a-z]+|[^a-z]+)"), 1)).alias("o", "word"))
    t = t.withColumn("end", F.sum(F.length("word")).over(w)).withColumn("start", F.col("end") - F.length("word"))
    t = t.where(F.col("word").rlike("^[a-z]") & (F.length("word") > 9)).select("doc_id", "word", "start", "end")
    return tp.original_offsets(t, n).select("doc_id", "word", *_long("start", "end"))


# --- G1 / G2 ---------------------------------------------------------------

@register("q_g1_dedup_terms", with_views(["gaz_case"], """
SELECT term, arg_min(code, gaz_ord) AS code, min(gaz_ord) AS gaz_ord FROM gaz_case GROUP BY term
"""))
def q_g1_dedup_terms(spark: SparkSession, d: str) -> DataFrame:
    return gz.dedup_terms(fx.gaz_case(spark, d)).select("term", "code", *_long("gaz_ord"))


@register("q_g2_norm_index", with_views(["gaz_case"], """
SELECT strip_accents(lower(term)) AS norm, arg_max(term, gaz_ord) AS term, arg_max(code, gaz_ord) AS code,
       max(gaz_ord) AS gaz_ord
FROM (SELECT term, arg_min(code, gaz_ord) AS code, min(gaz_ord) AS gaz_ord FROM gaz_case GROUP BY term)
GROUP BY 1
"""))
def q_g2_norm_index(spark: SparkSession, d: str) -> DataFrame:
    return gz.norm_index(fx.gaz_case(spark, d)).select("norm", "term", "code", *_long("gaz_ord"))


# --- L1-L3 / P1 dictionary lookup -------------------------------------------

@register("q_l1_lookup_candidates", with_views(["cand_fx"], """
SELECT doc_id, entity_type, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", code FROM cand_fx
"""))
def q_l1_lookup_candidates(spark: SparkSession, d: str) -> DataFrame:
    idx = checkpointed(gz.norm_index(fx.gaz_words(spark, d)))
    c = lk.lookup_candidates(fx.docs_fx(spark, d), idx)
    return c.select("doc_id", "entity_type", *_long("start", "end"), "code")


@register("q_p1_lookup", with_views(["lookup_fx"], "SELECT * FROM lookup_fx"))
def q_p1_lookup(spark: SparkSession, d: str) -> DataFrame:
    ann = lk.lookup_annotate(fx.docs_fx(spark, d), fx.gaz_words(spark, d))
    return ann.select("doc_id", "entity_type", *_long("start", "end"), "span", "ner_class", "ner_score",
                      "code", "term", "nel_score")


# --- N3 / N5 / N6 mentions -------------------------------------------------

MENTION_COLS = ["doc_id", "ord", "start", "end", "span", "ner_class", "ner_score"]


@register("q_n5_merge_mean", with_views(["mentions_fx"], """
, l AS (
  SELECT *, lag("end") OVER w AS pe, lag(ner_class) OVER w AS pc FROM mentions_fx
  WINDOW w AS (PARTITION BY doc_id ORDER BY start, "end", ord)
), g AS (
  SELECT *, sum(CASE WHEN pe IS NOT NULL AND ner_class = pc AND (start = pe OR start = pe + 1) THEN 0 ELSE 1 END)
            OVER (PARTITION BY doc_id ORDER BY start, "end", ord ROWS UNBOUNDED PRECEDING) AS grp FROM l
)
SELECT g.doc_id, arg_min(ord, start) AS ord, min(start) AS start, max("end") AS "end",
       substring(any_value(d.text), min(start) + 1, max("end") - min(start)) AS span,
       arg_min(ner_class, start) AS ner_class, round(avg(ner_score), 6) AS ner_score
FROM g JOIN documents d ON d.doc_id = g.doc_id GROUP BY g.doc_id, grp
"""))
def q_n5_merge_mean(spark: SparkSession, d: str) -> DataFrame:
    m = mn.merge_contiguous(fx.mentions_fx(spark, d), fx.docs_fx(spark, d), "mean")
    return m.select("doc_id", *_long("ord", "start", "end"), "span", "ner_class", "ner_score")


@register("q_n5_merge_max", with_views(["mentions_fx"], """
, l AS (
  SELECT *, lag("end") OVER w AS pe, lag(ner_class) OVER w AS pc FROM mentions_fx
  WINDOW w AS (PARTITION BY doc_id ORDER BY start, "end", ord)
), g AS (
  SELECT *, sum(CASE WHEN pe IS NOT NULL AND ner_class = pc AND pe + 1 >= start AND start >= pe THEN 0 ELSE 1 END)
            OVER (PARTITION BY doc_id ORDER BY start, "end", ord ROWS UNBOUNDED PRECEDING) AS grp FROM l
)
SELECT doc_id, min(start) AS start, max("end") AS "end", arg_min(ner_class, start) AS ner_class,
       max(ner_score) AS ner_score, count(*) AS n_rows
FROM g GROUP BY doc_id, grp
"""))
def q_n5_merge_max(spark: SparkSession, d: str) -> DataFrame:
    m = mn.merge_contiguous(fx.mentions_fx(spark, d), None, "max", with_count=True)
    return m.select("doc_id", *_long("start", "end"), "ner_class", "ner_score", "n_rows")


@register("q_n3_group_tags", with_views(["words_fx"], """
, t AS (
  SELECT doc_id, pos AS tok_idx, start, "end",
         CASE length(tok) % 4 WHEN 0 THEN 'O' WHEN 1 THEN 'B-X' WHEN 2 THEN 'I-X' ELSE 'I-Y' END AS tag,
         CAST(40 + (length(tok) * 13) % 60 AS DOUBLE) / 100 AS score FROM words_fx
), t2 AS (
  SELECT *, CASE WHEN tag LIKE 'B-%' THEN 'B' ELSE 'I' END AS bi,
         CASE WHEN tag LIKE 'B-%' OR tag LIKE 'I-%' THEN substring(tag, 3) ELSE tag END AS typ FROM t
), t3 AS (
  SELECT *, lag(typ) OVER (PARTITION BY doc_id ORDER BY tok_idx) AS pt FROM t2
), t4 AS (
  SELECT *, sum(CASE WHEN pt IS NULL OR typ <> pt OR bi = 'B' THEN 1 ELSE 0 END)
            OVER (PARTITION BY doc_id ORDER BY tok_idx ROWS UNBOUNDED PRECEDING) AS grp FROM t3
)
SELECT doc_id, min(tok_idx) AS ord, min(start) AS start, max("end") AS "end", arg_min(typ, tok_idx) AS ner_class,
       round(avg(score), 6) AS ner_score
FROM t4 GROUP BY doc_id, grp HAVING arg_min(typ, tok_idx) <> 'O'
"""))
def q_n3_group_tags(spark: SparkSession, d: str) -> DataFrame:
    w = fx.words_fx(spark, d)
    n = F.length("tok")
    tag = F.when(n % 4 == 0, "O").when(n % 4 == 1, "B-X").when(n % 4 == 2, "I-X").otherwise("I-Y")
    score = (F.lit(40) + (n * 13) % 60).cast("double") / 100
    toks = w.select("doc_id", F.col("pos").alias("tok_idx"), "start", "end", tag.alias("tag"), score.alias("score"))
    g = mn.group_token_tags(toks, ("doc_id",), "simple")
    return g.select("doc_id", *_long("ord", "start", "end"), "ner_class", "ner_score")


@register("q_n6_join_all", with_views(["mentions_fx", "lookup_fx"], """
, u AS (
  SELECT doc_id, 'TOKEN' AS entity_type, ord, start, "end" FROM mentions_fx
  UNION ALL SELECT doc_id, entity_type, start AS ord, start, "end" FROM lookup_fx
)
SELECT doc_id, entity_type, start, "end",
       row_number() OVER (PARTITION BY doc_id ORDER BY start, "end" DESC,
                          CASE entity_type WHEN 'WORD' THEN 0 WHEN 'TOKEN' THEN 1 ELSE 2 END, entity_type, ord) - 1 AS rank
FROM u
"""))
def q_n6_join_all(spark: SparkSession, d: str) -> DataFrame:
    tok = fx.mentions_fx(spark, d).select("doc_id", F.lit("TOKEN").alias("entity_type"), "ord", "start", "end")
    look = lk.lookup_annotate(fx.docs_fx(spark, d), fx.gaz_words(spark, d))
    look = look.select("doc_id", "entity_type", F.col("start").alias("ord"), "start", "end")
    r = mn.join_all(tok.unionByName(look), ["WORD", "TOKEN"])
    return r.select("doc_id", "entity_type", *_long("start", "end", "rank"))


# --- X1-X4 negation ---------------------------------------------------------

@register("q_x4_scope_attributes", with_views(["mentions_fx", "scopes_fx"], """
SELECT m.doc_id, m.ord, m.start, m."end", m.span, m.ner_class, m.ner_score,
       count(s.doc_id) FILTER (WHERE s.ner_class = 'NSCO') AS neg_count,
       count(s.doc_id) FILTER (WHERE s.ner_class = 'NSCO') > 0 AS is_negated,
       max(s.ner_score) FILTER (WHERE s.ner_class = 'NSCO') AS negation_score,
       count(s.doc_id) FILTER (WHERE s.ner_class = 'USCO') AS unc_count,
       count(s.doc_id) FILTER (WHERE s.ner_class = 'USCO') > 0 AS is_uncertain,
       max(s.ner_score) FILTER (WHERE s.ner_class = 'USCO') AS uncertainty_score
FROM mentions_fx m LEFT JOIN scopes_fx s ON s.doc_id = m.doc_id
  AND ((s.start <= m.start AND m.start < s."end") OR (s.start < m."end" AND m."end" <= s."end"))
GROUP BY ALL
"""))
def q_x4_scope_attributes(spark: SparkSession, d: str) -> DataFrame:
    out = ng.scope_attributes(fx.mentions_fx(spark, d), fx.scopes_fx(spark, d), ["doc_id", "ord"])
    return out.select("doc_id", *_long("ord", "start", "end"), "span", "ner_class", "ner_score", "neg_count",
                      "is_negated", "negation_score", "unc_count", "is_uncertain", "uncertainty_score")


@register("q_x3_overlap_pairs", with_views(["mentions_fx", "scopes_fx"], """
, mb AS (SELECT doc_id, ord, start, "end", unnest(list_distinct([start // 500, ("end" - 1) // 500])) AS bin FROM mentions_fx)
, sb AS (SELECT doc_id, ner_class, ner_score, start, "end", unnest(range(start // 500, ("end" - 1) // 500 + 1)) AS bin
         FROM scopes_fx WHERE "end" > start)
SELECT m.doc_id, m.ord, s.ner_class AS s_class, s.ner_score AS s_score
FROM mb m JOIN sb s ON s.doc_id = m.doc_id AND s.bin = m.bin
WHERE CASE WHEN s.start <= m.start AND m.start < s."end" THEN m.start // 500 = m.bin
           WHEN s.start < m."end" AND m."end" <= s."end" THEN (m."end" - 1) // 500 = m.bin ELSE false END
""", materialized=True))
def q_x3_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = ng.overlap_pairs(fx.mentions_fx(spark, d), ng.select_scopes(fx.scopes_fx(spark, d)), ["doc_id", "ord"])
    return p.select("doc_id", *_long("ord"), "s_class", "s_score")


# --- O1 / O2 records --------------------------------------------------------

@register("q_o2_records", with_views(["lookup_fx"], """
SELECT d.doc_id, count(l.doc_id) AS n_ann,
       coalesce(string_agg(l.start || ':' || l."end" || ':' || l.code, ';' ORDER BY l.start, l."end" DESC), '') AS ann_sig,
       d.text AS meta_text, true AS processing_success
FROM documents d LEFT JOIN lookup_fx l ON l.doc_id = d.doc_id GROUP BY d.doc_id, d.text
"""))
def q_o2_records(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.docs_fx(spark, d)
    ann = lk.lookup_annotate(docs, fx.gaz_words(spark, d))
    return rc.annotation_signature(rc.build_records(docs, ann))


@register("q_o1_metadata", """
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 1 ELSE 4 END AS n_keys,
       d.text AS meta_text, CAST(l.quality AS VARCHAR) AS meta_quality
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
""")
def q_o1_metadata(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.docs_fx(spark, d)
    lab = fx.table(spark, d, "labels")
    meta = F.create_map(F.lit("doc_id"), F.col("l_id").cast("string"), F.lit("quality"), F.col("quality").cast("string"),
                        F.lit("toxic"), F.col("toxic").cast("string"))
    j = docs.join(lab.withColumnRenamed("doc_id", "l_id"), F.col("doc_id") == F.col("l_id"), "left")
    j = j.withColumn("metadata", F.when(F.col("l_id").isNotNull(), meta))
    m = rc.build_metadata(F.col("text"), F.col("metadata"))
    return j.select("doc_id", F.size(m).cast("long").alias("n_keys"), m["text"].alias("meta_text"),
                    m["quality"].alias("meta_quality"))


# --- F1-F6 fuzzy linking, B1-B3 BM25 (noisy part names vs the part gazetteer) ---

_LINK_BASE = """
, g1 AS (SELECT term, arg_min(code, gaz_ord) AS code, min(gaz_ord) AS gaz_ord FROM gaz_part GROUP BY term)
, t AS (SELECT gaz_ord, term, code, strip_accents(lower(term)) AS norm FROM g1)
, g2 AS (SELECT norm, arg_max(term, gaz_ord) AS term, arg_max(code, gaz_ord) AS code FROM t GROUP BY norm)
, mm AS (SELECT base, v, span, strip_accents(lower(span)) AS m FROM noisy_fx)
, q AS (SELECT DISTINCT m FROM mm WHERE m NOT IN (SELECT norm FROM g2))
"""


def _fuzzy_sql(score: str, threshold: float = 0.7, scored: str | None = None) -> str:
    """Links by the best term; ``score`` compares q.m and t.norm, or ``scored`` gives sc(m, gaz_ord, norm, raw, score)."""
    scored = scored or f", sc AS (SELECT q.m, t.gaz_ord, t.norm, {score} AS raw, round({score}, 6) AS score FROM q, t)"
    return with_views(["gaz_part", "noisy_fx"], _LINK_BASE + scored + f"""
, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY score DESC, gaz_ord) AS rn FROM sc) WHERE rn = 1)
, links AS (
  SELECT g2.norm AS m, g2.term, g2.code, CAST(1 AS DOUBLE) AS nel_score FROM g2
  UNION ALL
  SELECT b.m, CASE WHEN b.raw >= {threshold} THEN g2.term END AS term,
         CASE WHEN b.raw >= {threshold} THEN g2.code ELSE 'NO_MAP' END AS code, b.score AS nel_score
  FROM best b JOIN g2 ON g2.norm = b.norm
)
SELECT mm.base, CAST(mm.v AS BIGINT) AS v, mm.span, coalesce(l.code, 'NO_MAP') AS code,
       coalesce(l.term, mm.span) AS term, l.nel_score
FROM mm LEFT JOIN links l ON l.m = mm.m
""")


def _noisy_mentions(spark: SparkSession, d: str) -> DataFrame:
    return fx.noisy_fx(spark, d).select("base", F.col("v").cast("long").alias("v"), "span")


def _fuzzy_query(method: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = lx.link_fuzzy(_noisy_mentions(spark, d), fx.gaz_part(spark, d), method, 0.7)
        return out.select("base", "v", "span", "code", "term", "nel_score")

    return run


_LEV = "CASE WHEN greatest(length(q.m), length(t.norm)) = 0 THEN 1.0 ELSE 1 - levenshtein(q.m, t.norm) / greatest(length(q.m), length(t.norm)) END"
register("q_f2_link_levenshtein", _fuzzy_sql(_LEV))(_fuzzy_query("levenshtein"))
register("q_f3_link_jaro_winkler", _fuzzy_sql("jaro_winkler_similarity(q.m, t.norm)"))(_fuzzy_query("jaro-winkler"))

# Longest common subsequences of the distinct pairs (a, b) of pr, by the dynamic programme: a row a step, and
# each row is the running maximum of what the row above allows.
_LCS = """
, ab AS (SELECT DISTINCT a, b FROM pr)
, lcs AS (
  SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda x: CAST(0 AS BIGINT)) AS r FROM ab
  UNION ALL
  SELECT a, b, i + 1, list_transform(range(0, length(b) + 1), lambda j: list_max(list_transform(range(0, j + 1), lambda k:
    CASE WHEN k = 0 THEN CAST(0 AS BIGINT) WHEN substring(a, i + 1, 1) = substring(b, CAST(k AS INTEGER), 1)
         THEN greatest(r[k + 1], r[k] + 1) ELSE r[k + 1] END)))
  FROM lcs WHERE i < length(a)
)
, common AS (SELECT a, b, r[length(b) + 1] AS c FROM lcs WHERE i = length(a))
"""
_TOK = "list_filter(string_split_regex({0}, '\\s+'), lambda x: x <> '')"
_SORT_SQL = f"""
, pr AS (SELECT m, gaz_ord, norm, array_to_string(list_sort({_TOK.format('m')}), ' ') AS a,
                array_to_string(list_sort({_TOK.format('norm')}), ' ') AS b FROM q, t)
{_LCS}
, raw AS (SELECT m, gaz_ord, norm, CASE WHEN length(a) + length(b) = 0 THEN 1.0
    ELSE 1 - (length(a) + length(b) - 2 * c) / (length(a) + length(b)) END AS raw FROM pr JOIN common USING (a, b))
, sc AS (SELECT *, round(raw, 6) AS score FROM raw)
"""
_SET_SQL = f"""
, sets AS (SELECT m, gaz_ord, norm, list_distinct({_TOK.format('m')}) AS x, list_distinct({_TOK.format('norm')}) AS y FROM q, t)
, pr AS (SELECT *, list_intersect(x, y) AS common_, array_to_string(list_sort(list_filter(x, lambda w: NOT list_contains(y, w))), ' ') AS a,
                array_to_string(list_sort(list_filter(y, lambda w: NOT list_contains(x, w))), ' ') AS b FROM sets)
{_LCS}
, parts AS (SELECT *, length(array_to_string(common_, ' ')) AS s, CASE WHEN len(common_) > 0 THEN 1 ELSE 0 END AS gap,
                   length(a) AS la, length(b) AS lb FROM pr JOIN common USING (a, b))
, raw AS (SELECT m, gaz_ord, norm, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0
    WHEN len(common_) > 0 AND (a = '' OR b = '') THEN 1.0
    ELSE greatest(1 - (la + lb - 2 * c) / (2 * s + 2 * gap + la + lb),
                  CASE WHEN gap = 1 THEN greatest(1 - (1 + la) / (2 * s + 1 + la), 1 - (1 + lb) / (2 * s + 1 + lb)) ELSE 0 END) END AS raw FROM parts)
, sc AS (SELECT *, round(raw, 6) AS score FROM raw)
"""
register("q_f4_link_token_sort", _fuzzy_sql("", scored=_SORT_SQL))(_fuzzy_query("token-sort-ratio"))
register("q_f5_link_token_set", _fuzzy_sql("", scored=_SET_SQL))(_fuzzy_query("token-set-ratio"))


@register("q_f6_threshold_levenshtein_09", _fuzzy_sql(_LEV, 0.9))
def q_f6_threshold_levenshtein_09(spark: SparkSession, d: str) -> DataFrame:
    out = lx.link_fuzzy(_noisy_mentions(spark, d), fx.gaz_part(spark, d), "levenshtein", 0.9)
    return out.select("base", "v", "span", "code", "term", "nel_score")


@register("q_f1_exact_link", with_views(["gaz_part", "noisy_fx"], _LINK_BASE + """
SELECT mm.base, CAST(mm.v AS BIGINT) AS v, g2.term, g2.code FROM mm JOIN g2 ON g2.norm = mm.m
"""))
def q_f1_exact_link(spark: SparkSession, d: str) -> DataFrame:
    idx = gz.norm_index(fx.gaz_part(spark, d))
    m = _noisy_mentions(spark, d).withColumn("norm", tx.normalize("span"))
    return m.join(idx, "norm").select("base", "v", "term", "code")


_BM25_SQL = with_views(["gaz_part", "noisy_fx"], _LINK_BASE + """
, toks AS (SELECT gaz_ord, list_filter(string_split_regex(norm, '\\s+'), lambda x: x <> '') AS tk FROM t)
, tf AS (SELECT gaz_ord, token, count(*) AS tf FROM (SELECT gaz_ord, unnest(tk) AS token FROM toks) GROUP BY ALL)
, dl AS (SELECT gaz_ord, len(tk) AS dl FROM toks)
, corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl)
, df AS (SELECT token, count(*) AS df FROM tf GROUP BY token)
, idf0 AS (SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS idf_raw FROM df, corpus)
, idf AS (SELECT token, CASE WHEN idf_raw < 0 THEN 0.25 * (SELECT avg(idf_raw) FROM idf0) ELSE idf_raw END AS idf FROM idf0)
, qt AS (SELECT m, token, count(*) AS qtf FROM (
    SELECT m, unnest(list_filter(string_split_regex(m, '\\s+'), lambda x: x <> '')) AS token FROM q) GROUP BY ALL)
, pos AS (
  SELECT qt.m, tf.gaz_ord, sum(qt.qtf * idf.idf * (tf.tf * 2.5) / (tf.tf + 1.5 * (0.25 + 0.75 * dl.dl / corpus.avgdl))) AS raw
  FROM qt JOIN tf USING (token) JOIN idf USING (token) JOIN dl USING (gaz_ord), corpus GROUP BY ALL)
, sc AS (SELECT q.m, t.gaz_ord, t.norm, round(coalesce(pos.raw, 0), 6) AS score
         FROM q CROSS JOIN t LEFT JOIN pos ON pos.m = q.m AND pos.gaz_ord = t.gaz_ord)
, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY score DESC, gaz_ord) AS rn FROM sc) WHERE rn = 1)
, links AS (
  SELECT g2.norm AS m, g2.term, g2.code, CAST(1 AS DOUBLE) AS nel_score FROM g2
  UNION ALL
  SELECT b.m, g2.term, g2.code, b.score AS nel_score FROM best b JOIN g2 ON g2.norm = b.norm
)
SELECT mm.base, CAST(mm.v AS BIGINT) AS v, mm.span, coalesce(l.code, 'NO_MAP') AS code,
       coalesce(l.term, mm.span) AS term, l.nel_score
FROM mm LEFT JOIN links l ON l.m = mm.m
""")


@register("q_b3_link_bm25", _BM25_SQL)
def q_b3_link_bm25(spark: SparkSession, d: str) -> DataFrame:
    out = lx.link_bm25(_noisy_mentions(spark, d), fx.gaz_part(spark, d))
    return out.select("base", "v", "span", "code", "term", "nel_score")


@register("q_b1_bm25_postings", with_views(["gaz_part"], """
, g1 AS (SELECT term, min(gaz_ord) AS gaz_ord FROM gaz_part GROUP BY term)
, toks AS (SELECT gaz_ord, list_filter(string_split_regex(strip_accents(lower(term)), '\\s+'), lambda x: x <> '') AS tk FROM g1)
, tf AS (SELECT gaz_ord, token, count(*) AS tf FROM (SELECT gaz_ord, unnest(tk) AS token FROM toks) GROUP BY ALL)
, dl AS (SELECT gaz_ord, len(tk) AS dl FROM toks)
, corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl)
, df AS (SELECT token, count(*) AS df FROM tf GROUP BY token)
, idf0 AS (SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS idf_raw FROM df, corpus)
SELECT tf.token, tf.gaz_ord, tf.tf, dl.dl,
       round(CASE WHEN idf_raw < 0 THEN 0.25 * (SELECT avg(idf_raw) FROM idf0) ELSE idf_raw END, 6) AS idf
FROM tf JOIN dl USING (gaz_ord) JOIN idf0 USING (token)
"""))
def q_b1_bm25_postings(spark: SparkSession, d: str) -> DataFrame:
    g = fx.gaz_part(spark, d).withColumn("entity_type", F.lit(""))
    p = lx.bm25_postings(gz.normalized_terms(g))
    return p.select("token", *_long("gaz_ord", "tf", "dl"), F.round("idf", 6).alias("idf"))


# --- D-1..D-7 dense retrieval -------------------------------------------------

_NORM_SQL = """
, v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
, n AS (SELECT vec_id, label, CASE WHEN nrm = 0 THEN e ELSE list_transform(e, lambda x: x / nrm) END AS u
        FROM (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS nrm FROM v))
"""


@register("q_d3_lp_normalize", "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)" + """
, m AS (SELECT vec_id, e, list_sum(list_transform(e, lambda x: abs(x))) AS n1,
               sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n2,
               list_max(list_transform(e, lambda x: abs(x))) AS ninf FROM v)
SELECT vec_id,
  round(list_sum(CASE WHEN n1 = 0 THEN e ELSE list_transform(e, lambda x: x / n1) END), 6) AS s1,
  round(list_sum(list_transform(CASE WHEN n2 = 0 THEN e ELSE list_transform(e, lambda x: x / n2) END, lambda x: x * x)), 6) AS s2,
  round(list_max(CASE WHEN ninf = 0 THEN e ELSE list_transform(e, lambda x: x / ninf) END), 6) AS sinf
FROM m
""")
def q_d3_lp_normalize(spark: SparkSession, d: str) -> DataFrame:
    e = fx.vec_fx(spark, d)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return e.select(
        "vec_id",
        F.round(total(dn.lp_normalize("embedding", 1)), 6).alias("s1"),
        F.round(total(F.transform(dn.lp_normalize("embedding", 2), lambda x: x * x)), 6).alias("s2"),
        F.round(F.array_max(dn.lp_normalize("embedding", float("inf"))), 6).alias("sinf"))


@register("q_d5_cosine_top10", "WITH " + _NORM_SQL.strip().lstrip(",") + """
, sc AS (SELECT a.vec_id AS q_id, b.vec_id AS gaz_ord, round(list_dot_product(a.u, b.u), 6) AS sim FROM n a, n b)
SELECT q_id, rank, gaz_ord, sim FROM (
  SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, gaz_ord) - 1 AS rank FROM sc) WHERE rank < 10
""")
def q_d5_cosine_top10(spark: SparkSession, d: str) -> DataFrame:
    e = fx.vec_fx(spark, d)
    return dn.cosine_top_k(e.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("vec")),
                           e.select(F.col("vec_id").alias("gaz_ord"), F.col("embedding").alias("vec")), 10)


@register("q_d5_balls_top10", ORACLE["q_d5_cosine_top10"])
def q_d5_balls_top10(spark: SparkSession, d: str) -> DataFrame:
    """The same search pruned by balls, as it is for term tables of more than one block."""
    e = fx.vec_fx(spark, d)
    return dn.cosine_top_k(e.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("vec")),
                           e.select(F.col("vec_id").alias("gaz_ord"), F.col("embedding").alias("vec")), 10, prune=True)


@register("q_d6_retrieve_by_label", "WITH " + _NORM_SQL.strip().lstrip(",") + """
, sc AS (SELECT a.label, a.vec_id AS q_id, b.vec_id AS gaz_ord, round(list_dot_product(a.u, b.u), 6) AS sim
         FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT label, q_id, rank, gaz_ord, sim, 'L' || CAST(label AS VARCHAR) || ':' || CAST(gaz_ord AS VARCHAR) AS code FROM (
  SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, gaz_ord) - 1 AS rank FROM sc) WHERE rank < 3
""")
def q_d6_retrieve_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Top-3 neighbours within the same label (key-partitioned retrieval), self excluded by key of the term side."""
    e = fx.vec_fx(spark, d)
    q = e.select("label", F.col("vec_id").alias("q_id"), F.col("embedding").alias("vec"))
    t = e.select("label", F.col("vec_id").alias("gaz_ord"), F.col("embedding").alias("vec"))
    top = dn.cosine_top_k(q, t, 4, keys=["label"], prune=True)
    top = top.where(F.col("q_id") != F.col("gaz_ord"))
    w = Window.partitionBy("q_id").orderBy(F.col("sim").desc(), F.col("gaz_ord"))
    top = top.withColumn("rank", (F.row_number().over(w) - 1).cast("long")).where(F.col("rank") < 3)
    code = F.concat(F.lit("L"), F.col("label").cast("string"), F.lit(":"), F.col("gaz_ord").cast("string"))
    return top.select("label", "q_id", "rank", "gaz_ord", "sim", code.alias("code"))


@register("q_p4_link_dense")
def q_p4_link_dense(spark: SparkSession, d: str) -> DataFrame:
    """P4 linking with the hashed n-gram embedder: noisy part names against the part gazetteer."""
    model = dn.hashed_ngram_embedder()
    vecs = checkpointed(dn.embed_terms(fx.gaz_part(spark, d), model))
    out = dn.link_dense(_noisy_mentions(spark, d), vecs, model)
    return out.select("base", "v", "span", "code", "term", "nel_score")


# An embedder that SQL can follow: how often each letter from a to z occurs in the normal form.
def _letter_embedder():
    def embed(texts: list[str]) -> np.ndarray:
        norms = [tx.normalize_py(t or "") for t in texts]
        return np.array([[t.count(chr(97 + i)) for i in range(26)] for t in norms], np.float32).reshape(len(texts), 26)

    return embed


def _letters_sql(col: str) -> str:
    norm = f"strip_accents(lower({col}))"
    return f"list_transform(range(0, 26), lambda i: CAST(length({norm}) - length(replace({norm}, chr(CAST(97 + i AS INTEGER)), '')) AS DOUBLE))"


_LETTER_LINKS = f"""
, g1 AS (SELECT term, arg_min(code, gaz_ord) AS code, min(gaz_ord) AS gaz_ord FROM gaz_part GROUP BY term)
, tv AS (SELECT *, {_letters_sql('term')} AS e FROM g1)
, sv AS (SELECT span, {_letters_sql('span')} AS e FROM (SELECT DISTINCT span FROM ment))
, tu AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM tv), su AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM sv)
, sc AS (SELECT su.span, tu.term, tu.code, tu.gaz_ord,
                round(CASE WHEN su.n = 0 OR tu.n = 0 THEN 0.0 ELSE list_dot_product(list_transform(su.e, lambda x: x / su.n), list_transform(tu.e, lambda x: x / tu.n)) END, 6) AS sim
         FROM su, tu)
, link AS (SELECT span, term, code, CAST(round(CAST(sim AS DECIMAL(18, 6)), 4) AS DOUBLE) AS nel_score FROM sc QUALIFY row_number() OVER (PARTITION BY span ORDER BY sim DESC, gaz_ord) = 1)
"""


@register("q_p4_link_letters", with_views(["gaz_part", "noisy_fx"], ", ment AS (SELECT base, v, span FROM noisy_fx)" + _LETTER_LINKS + """
SELECT base, CAST(v AS BIGINT) AS v, span, code, term, nel_score FROM ment JOIN link USING (span)
"""))
def q_p4_link_letters(spark: SparkSession, d: str) -> DataFrame:
    """P4 linking (D-1, D-2, D-4, D-5, D-7): noisy part names against embedded part names."""
    model = _letter_embedder()
    vecs = checkpointed(dn.embed_terms(fx.gaz_part(spark, d), model, "letters"))
    out = dn.link_dense(_noisy_mentions(spark, d), vecs, model)
    return out.select("base", "v", "span", "code", "term", "nel_score")


@register("q_p5_link_letters_scopes", with_views(["words_fx", "scopes_fx", "gaz_part"], """
, ment AS (SELECT doc_id, pos, start, "end", tok AS span FROM words_fx WHERE length(tok) >= 12)""" + _LETTER_LINKS + """
SELECT m.doc_id, m.pos AS ord, m.span, l.code, l.nel_score, count(s.doc_id) FILTER (WHERE s.ner_class = 'NSCO') AS neg_count,
       max(s.ner_score) FILTER (WHERE s.ner_class = 'USCO') AS uncertainty_score
FROM ment m JOIN link l ON l.span = m.span LEFT JOIN scopes_fx s ON s.doc_id = m.doc_id
  AND ((s.start <= m.start AND m.start < s."end") OR (s.start < m."end" AND m."end" <= s."end"))
GROUP BY ALL
""", materialized=True))
def q_p5_link_letters_scopes(spark: SparkSession, d: str) -> DataFrame:
    """P5: dense links of long words, with the scopes over them."""
    model = _letter_embedder()
    vecs = checkpointed(dn.embed_terms(fx.gaz_part(spark, d), model, "letters"))
    w = fx.words_fx(spark, d).where(F.length("tok") >= 12)
    m = checkpointed(w.select("doc_id", F.col("pos").alias("ord"), "start", "end", F.col("tok").alias("span"), F.lit("DIS").alias("ner_class")))
    out = ng.scope_attributes(dn.link_dense(m, vecs, model), fx.scopes_fx(spark, d), ["doc_id", "ord"])
    return out.select("doc_id", *_long("ord"), "span", "code", "nel_score", "neg_count", "uncertainty_score")


# --- T3-T10 text preparation, N1/N2/N4 tagging, P2/P3/P5 pipelines --------------

@register("q_t3_pretokenize", with_views(["tokens_fx"], """
, t AS (
  SELECT doc_id, pos, tok, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM tokens_fx
), a AS (
  SELECT doc_id, pos, tok,
         CASE WHEN nxt IS NOT NULL AND NOT regexp_matches(tok, '^\\s$') AND NOT regexp_matches(nxt, '^\\s$')
              THEN 1 ELSE 0 END AS add FROM t
), b AS (
  SELECT *, sum(length(tok) + add) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS e FROM a
)
SELECT doc_id, string_agg(tok || CASE WHEN add = 1 THEN ' ' ELSE '' END, '' ORDER BY pos) AS pretok,
       coalesce(string_agg(CASE WHEN add = 1 THEN CAST(e - 1 AS VARCHAR) END, ',' ORDER BY pos), '') AS added
FROM b GROUP BY doc_id
"""))
def q_t3_pretokenize(spark: SparkSession, d: str) -> DataFrame:
    p = fx.docs_fx(spark, d).select("doc_id", tx.pretokenize("text").alias("p"))
    return p.select("doc_id", F.col("p.text").alias("pretok"),
                    F.concat_ws(",", F.transform("p.added", lambda x: x.cast("string"))).alias("added"))


@register("q_t10_canonical_lang", """
SELECT doc_id, CASE lower(lang) WHEN 'es' THEN 'es' WHEN 'en' THEN 'en' WHEN 'it' THEN 'it' WHEN 'ro' THEN 'ro'
  WHEN 'cz' THEN 'cs' WHEN 'cs' THEN 'cs' WHEN 'se' THEN 'sv' WHEN 'sv' THEN 'sv' WHEN 'nl' THEN 'nl' END AS lang_v1
FROM documents
""")
def q_t10_canonical_lang(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "documents").select("doc_id", tx.canonical_lang("lang").alias("lang_v1"))


# The rules of T4 token by token: a break may follow a token that ends in sentence marks and closing signs.
_SENT_SQL = """
WITH tk AS (
  SELECT doc_id, pos, tok, CAST(e - length(tok) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM (
    SELECT doc_id, pos, tok, sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS e FROM (
      SELECT doc_id, unnest(toks) AS tok, unnest(range(0, len(toks))) AS pos
      FROM (SELECT doc_id, regexp_extract_all(text, '\\s+|\\S+') AS toks FROM documents)))
), nt AS (SELECT *, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM tk WHERE regexp_matches(tok, '\\S'))
, ru AS (SELECT *, regexp_extract(tok, '([.?!]+)["'')\\]}]*$', 1) AS run,
                ltrim(regexp_replace(tok, '[.?!]+["'')\\]}]*$', ''), '"''([{') AS word FROM nt)
, br AS (SELECT *, CASE WHEN run <> '' AND next IS NOT NULL AND length(run) - length(replace(run, '.', '')) < 2
    AND NOT (run[1] = '.' AND regexp_full_match(word, '[\\pL\\p{Nl}\\p{No}]') AND regexp_matches(next, '^\\pL'))
    AND NOT (run[1] = '.' AND regexp_full_match(word, '-?[.,]?\\d[\\d,.\\-]*') AND regexp_matches(next, '^\\p{Ll}')) THEN 1 ELSE 0 END AS brk FROM ru)
, gr AS (SELECT *, coalesce(sum(brk) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent_id FROM br)
, se AS (SELECT g.doc_id, CAST(sent_id AS BIGINT) AS sent_id, CASE WHEN sent_id = 0 THEN 0 ELSE min(s) END AS start, max(e) AS "end",
                substring(any_value(d.text), CAST(CASE WHEN sent_id = 0 THEN 0 ELSE min(s) END AS INTEGER) + 1,
                          CAST(max(e) - CASE WHEN sent_id = 0 THEN 0 ELSE min(s) END AS INTEGER)) AS text
         FROM gr AS g JOIN documents AS d ON d.doc_id = g.doc_id GROUP BY g.doc_id, sent_id)
"""


@register("q_t4_split_sentences", _SENT_SQL + 'SELECT doc_id, sent_id, start, "end", text FROM se')
def q_t4_split_sentences(spark: SparkSession, d: str) -> DataFrame:
    return tp.split_sentences(fx.docs_fx(spark, d)).select("doc_id", *_long("sent_id", "start", "end"), "text")


# Over-long sentences are cut behind every 64th word or sign; offsets of these by running lengths again.
@register("q_t7_build_chunks", _SENT_SQL + """
, pt AS (SELECT doc_id, sent_id, start, text, regexp_extract_all(text, '[\\pL\\pM\\p{Nd}\\p{Nl}\\p{Pc}]+|\\s+|[^\\pL\\pM\\p{Nd}\\p{Nl}\\p{Pc}\\s]') AS toks FROM se)
, ex AS (SELECT doc_id, sent_id, start AS s0, pos, tok, sum(length(tok)) OVER (PARTITION BY doc_id, sent_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS e
         FROM (SELECT doc_id, sent_id, start, unnest(toks) AS tok, unnest(range(0, len(toks))) AS pos FROM pt))
, ts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY doc_id, sent_id) AS n
         FROM ex WHERE regexp_matches(tok, '\\S'))
, ch AS (
  SELECT doc_id, sent_id, min(s0 + e - length(tok)) AS start, max(s0 + e) AS "end" FROM ts WHERE n > 64 GROUP BY doc_id, sent_id, i // 64
  UNION ALL SELECT se.doc_id, se.sent_id, se.start, se."end" FROM se
  WHERE NOT EXISTS (SELECT 1 FROM ts WHERE ts.doc_id = se.doc_id AND ts.sent_id = se.sent_id AND n > 64)
)
SELECT ch.doc_id, row_number() OVER (PARTITION BY ch.doc_id ORDER BY start, "end") - 1 AS chunk_id, sent_id, CAST(start AS BIGINT) AS start,
       CAST("end" AS BIGINT) AS "end", substring(d.text, CAST(start AS INTEGER) + 1, CAST("end" - start AS INTEGER)) AS text
FROM ch JOIN documents AS d ON d.doc_id = ch.doc_id
""")
def q_t7_build_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = tp.build_chunks(fx.docs_fx(spark, d), max_tokens=64)
    return c.select("doc_id", *_long("chunk_id", "sent_id", "start", "end"), "text")


# deterministic stand-in model: words of seven or more word characters, scored by length
LONG_WORD_RE = f"[{tx.WORD_CHARS}]{{7,}}"


def _long_word_tagger():
    return tg.regex_tagger(LONG_WORD_RE, "LONG", lambda s: len(s) / 100)


_LONG_SQL = """
, lw AS (SELECT doc_id, pos, start, "end", tok, CAST(length(tok) AS DOUBLE) / 100 AS ner_score
         FROM words_fx WHERE length(tok) >= 7)
"""


@register("q_n2_tag_v1", with_views(["words_fx"], _LONG_SQL + """
SELECT doc_id, start, "end", tok AS span, 'LONG' AS ner_class, ner_score FROM lw
"""))
def q_n2_tag_v1(spark: SparkSession, d: str) -> DataFrame:
    m = tg.tag_sentences_v1(fx.docs_fx(spark, d), _long_word_tagger())
    return m.select("doc_id", *_long("start", "end"), "span", "ner_class", "ner_score")


_MERGED_LONG_SQL = _LONG_SQL + """
, l1 AS (SELECT *, lag("end") OVER (PARTITION BY doc_id ORDER BY start) AS pe FROM lw)
, l2 AS (SELECT *, sum(CASE WHEN pe IS NOT NULL AND (start = pe OR start = pe + 1) THEN 0 ELSE 1 END)
                   OVER (PARTITION BY doc_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS grp FROM l1)
, merged AS (SELECT l2.doc_id, min(start) AS start, max("end") AS "end",
                    substring(any_value(d.text), min(start) + 1, max("end") - min(start)) AS span,
                    round(avg(ner_score), 6) AS ner_score
             FROM l2 JOIN documents d ON d.doc_id = l2.doc_id GROUP BY l2.doc_id, grp)
"""


@register("q_n1_detect_merge", with_views(["words_fx"], _MERGED_LONG_SQL + """
SELECT doc_id, start, "end", span, 'LONG' AS ner_class, ner_score FROM merged
"""))
def q_n1_detect_merge(spark: SparkSession, d: str) -> DataFrame:
    m = tg.detect_mentions(fx.docs_fx(spark, d), _long_word_tagger(), max_tokens=64)
    return m.select("doc_id", *_long("start", "end"), "span", "ner_class", "ner_score")


def _pipeline_records(spark: SparkSession, d: str, link) -> DataFrame:
    docs = fx.docs_fx(spark, d)
    chunks = checkpointed(tp.build_chunks(docs, 64))  # of both taggers
    ments = checkpointed(tg.tag_all(docs, {"PART": _long_word_tagger()}, chunks=chunks))
    linked = link(ments.drop("entity_type"), fx.gaz_part(spark, d)).withColumn("entity_type", F.lit("PART"))
    return rc.annotation_signature(rc.build_records(docs, linked, ["PART"]))


def _pipeline_sql(link_sql: str) -> str:
    return with_views(["words_fx", "gaz_part"], _MERGED_LONG_SQL + """
, g1 AS (SELECT term, arg_min(code, gaz_ord) AS code, min(gaz_ord) AS gaz_ord FROM gaz_part GROUP BY term)
, t AS (SELECT gaz_ord, term, code, strip_accents(lower(term)) AS norm FROM g1)
, g2 AS (SELECT norm, arg_max(term, gaz_ord) AS term, arg_max(code, gaz_ord) AS code FROM t GROUP BY norm)
, mm AS (SELECT doc_id, start, "end", span, strip_accents(lower(span)) AS m FROM merged)
, q AS (SELECT DISTINCT m FROM mm WHERE m NOT IN (SELECT norm FROM g2))
""" + link_sql + """
, ann AS (SELECT mm.doc_id, mm.start, mm."end", coalesce(l.code, 'NO_MAP') AS code FROM mm LEFT JOIN links l ON l.m = mm.m)
SELECT d.doc_id, count(a.doc_id) AS n_ann,
       coalesce(string_agg(a.start || ':' || a."end" || ':' || a.code, ';' ORDER BY a.start, a."end" DESC), '') AS ann_sig,
       d.text AS meta_text, true AS processing_success
FROM documents d LEFT JOIN ann a ON a.doc_id = d.doc_id GROUP BY d.doc_id, d.text
""")


_P2_LINK = f"""
, sc AS (SELECT q.m, t.gaz_ord, t.norm, round({_LEV}, 6) AS score FROM q, t)
, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY score DESC, gaz_ord) AS rn FROM sc) WHERE rn = 1)
, links AS (
  SELECT g2.norm AS m, g2.code FROM g2
  UNION ALL
  SELECT b.m, CASE WHEN b.score >= 0.7 THEN g2.code ELSE 'NO_MAP' END AS code FROM best b JOIN g2 ON g2.norm = b.norm
)
"""


@register("q_p2_pipeline_levenshtein", _pipeline_sql(_P2_LINK))
def q_p2_pipeline_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    return _pipeline_records(spark, d, lambda m, g: lx.link_fuzzy(m, g, "levenshtein", 0.7))


_P3_LINK = """
, toks AS (SELECT gaz_ord, list_filter(string_split_regex(norm, '\\s+'), lambda x: x <> '') AS tk FROM t)
, tf AS (SELECT gaz_ord, token, count(*) AS tf FROM (SELECT gaz_ord, unnest(tk) AS token FROM toks) GROUP BY ALL)
, dl AS (SELECT gaz_ord, len(tk) AS dl FROM toks)
, corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl)
, df AS (SELECT token, count(*) AS df FROM tf GROUP BY token)
, idf0 AS (SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS idf_raw FROM df, corpus)
, idf AS (SELECT token, CASE WHEN idf_raw < 0 THEN 0.25 * (SELECT avg(idf_raw) FROM idf0) ELSE idf_raw END AS idf FROM idf0)
, qt AS (SELECT m, token, count(*) AS qtf FROM (
    SELECT m, unnest(list_filter(string_split_regex(m, '\\s+'), lambda x: x <> '')) AS token FROM q) GROUP BY ALL)
, pos AS (
  SELECT qt.m, tf.gaz_ord, sum(qt.qtf * idf.idf * (tf.tf * 2.5) / (tf.tf + 1.5 * (0.25 + 0.75 * dl.dl / corpus.avgdl))) AS raw
  FROM qt JOIN tf USING (token) JOIN idf USING (token) JOIN dl USING (gaz_ord), corpus GROUP BY ALL)
, sc AS (SELECT q.m, t.gaz_ord, t.norm, round(coalesce(pos.raw, 0), 6) AS score
         FROM q CROSS JOIN t LEFT JOIN pos ON pos.m = q.m AND pos.gaz_ord = t.gaz_ord)
, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY score DESC, gaz_ord) AS rn FROM sc) WHERE rn = 1)
, links AS (SELECT g2.norm AS m, g2.code FROM g2 UNION ALL SELECT b.m, g2.code FROM best b JOIN g2 ON g2.norm = b.norm)
"""


@register("q_p3_pipeline_bm25", _pipeline_sql(_P3_LINK))
def q_p3_pipeline_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _pipeline_records(spark, d, lx.link_bm25)


@register("q_p5_pipeline_dense_negation")
def q_p5_pipeline_dense_negation(spark: SparkSession, d: str) -> DataFrame:
    """P5: long-word mentions, dense links (hashed embedder) and scopes from a second tagger."""
    docs = fx.docs_fx(spark, d)
    chunks = checkpointed(tp.build_chunks(docs, 64))  # of both taggers
    ments = checkpointed(tg.tag_all(docs, {"PART": _long_word_tagger()}, chunks=chunks))
    scope_tagger = tg.regex_tagger(r"\b(?:[Nn]ot?|[Pp]as|[Kk]ein|[Ss]in)\b[^.\n]{0,40}", "NSCO", lambda s: 0.9)
    scopes = tg.detect_mentions(docs, scope_tagger, merge_mode=None, chunks=chunks)
    model = dn.hashed_ngram_embedder()
    vecs = checkpointed(dn.embed_terms(fx.gaz_part(spark, d).withColumn("entity_type", F.lit("PART")), model))
    linked = dn.link_dense(ments, vecs, model)
    neg = ng.scope_attributes(linked, scopes, ["doc_id", "entity_type", "ord"])
    return rc.annotation_signature(rc.build_records(docs, neg, ["PART"]))


# --- S1/S2/S6-S8 sources and sinks, P6 job, V1 checks, R1/R2 coverage ----------

# Tasks move their own files to their places: the driver would move one folder after the other.
MANY_FILES = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}

@register("q_s2_docs_from_table", """
SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS doc_id, text, role AS meta_role,
       CAST(turn AS VARCHAR) AS meta_turn FROM conversations
""")
def q_s2_docs_from_table(spark: SparkSession, d: str) -> DataFrame:
    c = fx.table(spark, d, "conversations").withColumn(
        "key", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    docs = sn.docs_from_table(c, "key", "text", ["role", "turn"])
    return docs.select("doc_id", "text", F.col("metadata")["role"].alias("meta_role"),
                       F.col("metadata")["turn"].alias("meta_turn"))


@register("q_v1_quarantine", """
SELECT conv_id, turn, text IS NOT NULL AS valid, CASE WHEN text IS NULL THEN 'text must be a string' END AS reason
FROM conversations
""")
def q_v1_quarantine(spark: SparkSession, d: str) -> DataFrame:
    c = fx.table(spark, d, "conversations")
    valid, rejected = sn.quarantine_docs(c)
    return valid.select("conv_id", "turn", F.lit(True).alias("valid"), F.lit(None).cast("string").alias("reason")) \
        .unionByName(rejected.select("conv_id", "turn", F.lit(False).alias("valid"), "reason"))


@register("q_s3_read_gazetteer", """
SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS gaz_ord,
       CASE WHEN p_partkey % 7 = 0 THEN p_name || chr(10) || 'or "' || p_name || '"' ELSE p_name END AS term, 'P' || CAST(p_partkey AS VARCHAR) AS code
FROM part
""")
def q_s3_read_gazetteer(spark: SparkSession, d: str) -> DataFrame:
    """A gazetteer of several files, with line ends and quotes inside values, in the order of its rows."""
    path = scratch_path(spark, f"s3-{uuid.uuid4().hex}")
    g = fx.table(spark, d, "part").withColumn("term", F.when(F.col("p_partkey") % 7 == 0, F.concat(
        "p_name", F.lit("\nor \""), "p_name", F.lit("\""))).otherwise(F.col("p_name")))
    g = g.repartitionByRange(5, "p_partkey").sortWithinPartitions("p_partkey")
    g.select("term", F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("code")).write.csv(path, sep="\t", header=True, quote='"', escape='"')
    return sg.read_gazetteer(spark, path).select("gaz_ord", "term", "code")


@register("q_s4_check_gazetteer", """
SELECT count(*) AS rows, count(*) FILTER (WHERE text IS NULL) AS null_terms, count(text) - count(DISTINCT text) AS duplicate_terms FROM conversations
""")
def q_s4_check_gazetteer(spark: SparkSession, d: str) -> DataFrame:
    g = fx.table(spark, d, "conversations").select(F.col("text").alias("term"), F.col("conv_id").cast("string").alias("code"))
    found = sg.check_gazetteer(g)
    return spark.createDataFrame([(found["rows"], found["null_terms"], found["duplicate_terms"])], "rows long, null_terms long, duplicate_terms long")


@register("q_s5_vectors", """
SELECT vec_id, label % 3 AS model_no, CAST(round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS DOUBLE) AS total FROM embeddings
""")
def q_s5_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written twice, the second time by a retried job, and read back by model."""
    path = scratch_path(spark, f"s5-{uuid.uuid4().hex}")
    e = fx.vec_fx(spark, d).select(F.lit("en").alias("lang"), F.lit("word").alias("entity_type"), F.col("vec_id").cast("string").alias("term"),
                                   F.col("vec_id").alias("gaz_ord"), F.concat(F.lit("m"), F.col("label") % 3).alias("model"), F.col("embedding").alias("vec"))
    sg.write_vectors(e.where("gaz_ord % 2 = 0"), path)
    sg.write_vectors(e, path)
    sg.write_vectors(e.where("gaz_ord % 3 = 0"), path)
    out = None
    for m in range(3):
        part = sg.read_vectors(spark, path, f"m{m}", lang="en")
        total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
        part = part.select(F.col("gaz_ord").alias("vec_id"), F.lit(m).alias("model_no"), F.round(total, 4).alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


@register("q_s7_manifest", """
SELECT 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) || '.json' AS file, text AS meta_text FROM conversations
""")
def q_s7_manifest(spark: SparkSession, d: str) -> DataFrame:
    """One committed JSON file per document (S6), its manifest (S7), and each file read back."""
    path = scratch_path(spark, f"s7-{uuid.uuid4().hex}")
    c = fx.table(spark, d, "conversations")
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    recs = c.select(name.alias("doc_id"), F.struct(F.col("text")).alias("metadata"))
    files = sk.write_records(recs, path, per_document=True)
    back = spark.read.schema("doc_id string, metadata struct<text:string>").json(path, multiLine=True)
    back = back.select(F.concat("doc_id", F.lit(".json")).alias("file"), F.col("metadata.text").alias("meta_text"))
    return files.select("file").join(back, "file")


@register("q_s8_records_by_file", """
SELECT source || '-' || CAST(doc_id AS VARCHAR) || '.txt' AS file_key, text AS meta_text FROM documents
""")
def q_s8_records_by_file(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.table(spark, d, "documents")
    path = F.concat(F.lit("/notes/"), "lang", F.lit("/"), "source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    meta = F.create_map(F.lit("source_file"), path, F.lit("text"), F.col("text"))
    return sk.records_by_file(docs.select("doc_id", meta.alias("metadata"))).select("file_key", F.col("metadata")["text"].alias("meta_text"))


def _catalogue_gaz(spark: SparkSession, d: str) -> DataFrame:
    a = fx.gaz_part(spark, d).select(F.lit("en").alias("lang"), F.lit("disease").alias("entity_type"), "gaz_ord", "term", "code")
    b = fx.gaz_words(spark, d).select(F.lit("es").alias("lang"), F.lit("symptoms").alias("entity_type"), "gaz_ord", "term", "code")
    return a.unionByName(b)


def _catalogue_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = fx.vec_fx(spark, d)
    return e.select(F.lit("en").alias("lang"), F.lit("disease").alias("entity_type"), F.col("vec_id").alias("gaz_ord"),
                    F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("term"), F.lit("m1").alias("model"))


@register("q_r1_coverage_gaps", with_views(["gaz_part", "gaz_words"], """
, langs AS (SELECT lang, count(*) AS n_docs FROM documents GROUP BY lang)
, et AS (SELECT 'disease' AS entity_type UNION ALL SELECT 'symptoms')
, gz AS (SELECT 'en' AS lang, 'disease' AS entity_type, term FROM gaz_part
         UNION ALL SELECT 'es', 'symptoms', term FROM gaz_words)
, terms AS (SELECT lang, entity_type, count(DISTINCT term) AS n_terms FROM gz GROUP BY ALL)
, vec AS (SELECT 'en' AS lang, 'disease' AS entity_type, count(*) AS n_vectors FROM embeddings)
, g AS (SELECT l.lang, e.entity_type, l.n_docs, coalesce(t.n_terms, 0) AS n_terms, coalesce(v.n_vectors, 0) AS n_vectors
        FROM langs l CROSS JOIN et e LEFT JOIN terms t ON t.lang = l.lang AND t.entity_type = e.entity_type
        LEFT JOIN vec v ON v.lang = l.lang AND v.entity_type = e.entity_type)
SELECT lang, entity_type, n_docs, n_terms, n_vectors,
       concat_ws(',', CASE WHEN n_terms = 0 THEN 'gazetteer' END,
                      CASE WHEN n_vectors = 0 OR n_vectors < n_terms THEN 'vectors' END) AS missing
FROM g
"""))
def q_r1_coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    et = spark.createDataFrame([("disease",), ("symptoms",)], "entity_type string")
    out = cv.coverage_gaps(fx.table(spark, d, "documents"), _catalogue_gaz(spark, d), _catalogue_vectors(spark, d), et)
    return out.withColumn("missing", F.array_join("missing", ","))


@register("q_r2_stale_vectors", with_views(["gaz_part"], """
, g1 AS (SELECT term, arg_min(code, gaz_ord) AS code, min(gaz_ord) AS gaz_ord FROM gaz_part GROUP BY term)
SELECT 'en' AS lang, 'disease' AS entity_type, term, code, gaz_ord FROM g1
WHERE term NOT IN (SELECT p_name FROM part WHERE p_name LIKE 's%')
"""))
def q_r2_stale_vectors(spark: SparkSession, d: str) -> DataFrame:
    g = _catalogue_gaz(spark, d).where(F.col("entity_type") == "disease")
    have = g.where(F.col("term").startswith("s")).select("lang", "entity_type", "term").withColumn("model", F.lit("m1"))
    return cv.stale_vectors(g, have, "m1").select("lang", "entity_type", "term", "code", *_long("gaz_ord"))


@register("q_r3_build_vectors", with_views(["gaz_part", "gaz_words"], """
, gz AS (SELECT 'en' AS lang, 'disease' AS entity_type, term FROM gaz_part UNION ALL SELECT 'es', 'symptoms', term FROM gaz_words)
SELECT lang, entity_type, count(DISTINCT term) AS n_vectors, count(DISTINCT term) FILTER (WHERE NOT starts_with(term, 's')) AS written,
       CAST(0 AS BIGINT) AS written_again FROM gz GROUP BY lang, entity_type
"""))
def q_r3_build_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Some terms are embedded first; the build adds the others, and a second build has nothing to do."""
    path = scratch_path(spark, f"r3-{uuid.uuid4().hex}")
    gaz = checkpointed(_catalogue_gaz(spark, d))
    model = _letter_embedder()
    cv.build_vectors(gaz.where(F.col("term").startswith("s")), path, "letters", model)
    first = cv.build_vectors(gaz, path, "letters", model).select("lang", "entity_type", "written")
    again = cv.build_vectors(gaz, path, "letters", model).select("lang", "entity_type", F.col("written").alias("written_again"), "n_vectors")
    return first.join(again, ["lang", "entity_type"]).select("lang", "entity_type", "n_vectors", "written", "written_again")


@register("q_o3_shape", with_views(["scopes_fx"], """
SELECT d.doc_id, count(s.doc_id) AS n_ann, coalesce(string_agg(s.start || ':' || lower(s.ner_class), ';' ORDER BY s.start, s."end" DESC), '') AS sig
FROM documents d LEFT JOIN scopes_fx s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""))
def q_o3_shape(spark: SparkSession, d: str) -> DataFrame:
    """Records whose annotations a caller's function has reshaped."""
    ann = fx.scopes_fx(spark, d).withColumn("entity_type", F.lit("scope"))
    recs = rc.build_records(fx.table(spark, d, "documents"), ann, with_date=False,
                            shape=lambda a: F.struct(a["start"].alias("begin"), F.lower(a["ner_class"]).alias("kind")))
    sig = F.array_join(F.transform("annotations", lambda a: F.concat(a["begin"].cast("string"), F.lit(":"), a["kind"])), ";")
    return recs.select("doc_id", F.size("annotations").cast("long").alias("n_ann"), sig.alias("sig"))


@register("q_p6_annotate_dir", with_views(["lookup_fx"], """
SELECT d.doc_id, count(l.doc_id) AS n_ann,
       coalesce(string_agg(l.start || ':' || l."end" || ':' || l.code, ';' ORDER BY l.start, l."end" DESC), '') AS ann_sig
FROM documents d LEFT JOIN lookup_fx l ON l.doc_id = d.doc_id GROUP BY d.doc_id
"""))
def q_p6_annotate_dir(spark: SparkSession, d: str) -> DataFrame:
    """P6 end to end: every document written as its own text file, read back (S1), annotated, written as JSON (S6)."""
    base = scratch_path(spark, f"p6-{uuid.uuid4().hex}")
    fx.docs_fx(spark, d).select("doc_id", "text").write.options(**MANY_FILES).partitionBy("doc_id").text(f"{base}/notes")
    notes = sn.read_notes(spark, f"{base}/notes", id_source="partition")
    from notelink.plans import jobs

    recs = jobs.annotate(checkpointed(fx.by_document(notes)), "lookup", ["WORD"], checkpointed(fx.gaz_words(spark, d)), lang="und")
    sk.write_records(recs, f"{base}/records")
    back = spark.read.schema(recs.schema).json(f"{base}/records")
    return rc.annotation_signature(back).select(F.col("doc_id").cast("long").alias("doc_id"), "n_ann", "ann_sig")


@register("q_p7_stream", ORACLE["q_p6_annotate_dir"])
def q_p7_stream(spark: SparkSession, d: str) -> DataFrame:
    """P7 end to end: text files of all documents, annotated as a stream in several micro-batches."""
    from notelink.streaming.annotate_stream import annotate_stream

    base = scratch_path(spark, f"p7-{uuid.uuid4().hex}")
    docs = fx.table(spark, d, "documents").select("doc_id", "text")
    docs.write.options(**MANY_FILES).partitionBy("doc_id").text(f"{base}/notes")
    annotate_stream(spark, f"{base}/notes", f"{base}/records", f"{base}/progress", max_files_per_trigger=max(1, docs.count() // 2 + 1),
                    id_source="partition", method="lookup", lang="und", entities=["WORD"], gazetteer=checkpointed(fx.gaz_words(spark, d)), with_date=False)
    back = spark.read.schema("doc_id string, annotations array<struct<start:int,`end`:int,code:string>>").json(f"{base}/records")
    sig = F.concat_ws(";", F.transform("annotations", lambda a: F.concat_ws(":", a["start"].cast("string"), a["end"].cast("string"), a["code"])))
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.size("annotations").cast("long").alias("n_ann"), sig.alias("ann_sig"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.docs_fx(spark, d)
    ann = lk.lookup_annotate(docs, fx.gaz_words(spark, d))
    return rc.build_records(docs, ann, ["WORD"])
