"""DuckDB SQL for the correctness oracle.

Independent re-statements of each query in plain SQL over the driver tables
(``documents``, ``part``, ``embeddings``, ...).  Shared views are CTE bodies
composed with :func:`with_views`.  RE2 has no look-around, so offsets come
from ``unnest`` + window sums here, while the Spark side uses other routes.
"""

from __future__ import annotations

from notelink.functions.text import WORD_CHARS

W = WORD_CHARS
KW = "0-9A-Za-z_"

VIEWS: dict[str, str] = {}

VIEWS["gaz_part"] = """
SELECT p_partkey AS gaz_ord, p_name AS term, 'P' || CAST(p_partkey AS VARCHAR) AS code FROM part
"""

VIEWS["gaz_case"] = """
SELECT gaz_ord * 2 AS gaz_ord, term, code FROM gaz_part
UNION ALL
SELECT gaz_ord * 2 + 1 AS gaz_ord, upper(term) AS term, code || 'u' AS code FROM gaz_part
"""

VIEWS["noisy_fx"] = """
SELECT base, v, span FROM (
  SELECT DISTINCT p_name AS base FROM part
) b, (
  SELECT 0 AS v UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5
) vv, LATERAL (SELECT CASE v
    WHEN 0 THEN base
    WHEN 1 THEN upper(base)
    WHEN 2 THEN substring(base, 1, 2) || substring(base, 4)
    WHEN 3 THEN split_part(base, ' ', 2) || ' ' || split_part(base, ' ', 1)
    WHEN 4 THEN split_part(base, ' ', 1) || ' thing'
    ELSE 'zzz qqq' END AS span)
"""

VIEWS["tokens_fx"] = f"""
SELECT doc_id, lang, doc_len, pos, tok, CAST(e - length(tok) AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM (
  SELECT doc_id, lang, doc_len, pos, tok,
         sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS e
  FROM (
    SELECT doc_id, lang, doc_len, unnest(toks) AS tok, unnest(range(0, len(toks))) AS pos
    FROM (SELECT doc_id, lang, length(text) AS doc_len,
                 regexp_extract_all(text, '([{W}]+|[^{W}])', 1) AS toks FROM documents)
  )
)
"""

VIEWS["words_fx"] = f"""
SELECT * FROM tokens_fx WHERE regexp_matches(tok, '^[{W}]')
"""

VIEWS["mentions_fx"] = """
SELECT doc_id, pos AS ord, start, "end", tok AS span,
       CASE length(tok) % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS ner_class,
       CAST(50 + (length(tok) * 7) % 50 AS DOUBLE) / 100 AS ner_score
FROM words_fx
"""

VIEWS["scopes_fx"] = """
SELECT doc_id,
       CASE WHEN pos % 5 = 0 THEN start + 1 ELSE start END AS start,
       CASE WHEN pos % 5 = 0 THEN start + 2 ELSE least("end" + 30, doc_len) END AS "end",
       CASE WHEN pos % 4 = 0 THEN 'USCO' ELSE 'NSCO' END AS ner_class,
       CAST(60 + start % 40 AS DOUBLE) / 100 AS ner_score
FROM words_fx WHERE lower(tok) IN ('the', 'that', 'le', 'la', 'die', 'der', 'el', 'que')
"""

VIEWS["gaz_words"] = """
SELECT 'WORD' AS entity_type, CAST(row_number() OVER (ORDER BY nd DESC, term) AS BIGINT) AS gaz_ord, term,
       'W' || CAST(row_number() OVER (ORDER BY nd DESC, term) AS VARCHAR) AS code
FROM (
  SELECT lower(tok) AS term, count(DISTINCT doc_id) AS nd FROM words_fx
  WHERE length(tok) >= 4 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 20
  UNION ALL
  SELECT lower(a.tok) || ' ' || lower(b.tok) AS term, count(DISTINCT a.doc_id) AS nd
  FROM words_fx a JOIN words_fx b ON a.doc_id = b.doc_id AND b.pos = a.pos + 2
  GROUP BY 1 HAVING count(DISTINCT a.doc_id) >= 5
)
"""

# Pieces of the normalised documents as lookup reads them: keyword tokens (with the
# keyword token after them) and single other characters.
VIEWS["ktok_fx"] = f"""
SELECT doc_id, tok, CAST(e - length(tok) AS BIGINT) AS s, CAST(e AS BIGINT) AS e,
       lead(tok) OVER (PARTITION BY doc_id, regexp_matches(tok, '^[{KW}]') ORDER BY pos) AS next_tok FROM (
  SELECT doc_id, pos, tok, sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS e
  FROM (
    SELECT doc_id, unnest(toks) AS tok, unnest(range(0, len(toks))) AS pos
    FROM (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '([{KW}]+|[^{KW}])', 1) AS toks FROM documents)
  )
)
"""

# Occurrences of gaz_words in the documents (L1), independent form: by first piece, then a
# substring test; no keyword character may follow.
VIEWS["cand_fx"] = f"""
WITH g1 AS (
  SELECT entity_type, term, arg_min(code, gaz_ord) AS code, min(gaz_ord) AS gaz_ord FROM gaz_words GROUP BY ALL
), g2 AS (
  SELECT entity_type, strip_accents(lower(term)) AS norm, arg_max(term, gaz_ord) AS term,
         arg_max(code, gaz_ord) AS code FROM g1 GROUP BY ALL
), shp AS (
  SELECT *, regexp_extract(norm, '^([{KW}]+|[^{KW}])', 1) AS first_tok,
         regexp_extract(norm, '^[{KW}]+[^{KW}]+([{KW}]+)', 1) AS second_tok FROM g2 WHERE norm <> ''
)
SELECT t.doc_id, g.entity_type, t.s AS start, t.s + length(g.norm) AS "end", g.term, g.code
FROM ktok_fx t JOIN shp g ON g.first_tok = t.tok AND (g.second_tok = '' OR g.second_tok = t.next_tok)
JOIN (SELECT doc_id, strip_accents(lower(text)) AS norm FROM documents) n ON n.doc_id = t.doc_id
WHERE starts_with(substring(n.norm, t.s + 1, length(g.norm) + 1), g.norm)
  AND NOT regexp_matches(substring(n.norm, t.s + length(g.norm) + 1, 1), '[{KW}]')
"""

# L2 and L3: islands and a recursive chain of "next start at or after the previous end".
VIEWS["lookup_fx"] = f"""
WITH RECURSIVE nt AS (
  SELECT doc_id, text FROM documents
), cand2 AS (
  SELECT * FROM cand_fx
), ordd AS (
  SELECT *, max("end") OVER (PARTITION BY doc_id, entity_type ORDER BY start, "end" DESC
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM cand2
), isl AS (
  SELECT *, sum(CASE WHEN pe IS NULL OR start >= pe THEN 1 ELSE 0 END)
            OVER (PARTITION BY doc_id, entity_type ORDER BY start, "end" DESC ROWS UNBOUNDED PRECEDING) AS island
  FROM ordd
), lng AS (
  SELECT doc_id, entity_type, island, start, max("end") AS "end" FROM isl GROUP BY ALL
), nx AS (
  SELECT a.doc_id, a.entity_type, a.island, a.start, a."end",
         (SELECT min(b.start) FROM lng b WHERE b.doc_id = a.doc_id AND b.entity_type = a.entity_type
            AND b.island = a.island AND b.start >= a."end") AS nstart
  FROM lng a
), chain AS (
  SELECT * FROM (
    SELECT nx.* FROM nx JOIN (SELECT doc_id, entity_type, island, min(start) AS start FROM lng GROUP BY ALL) f
      USING (doc_id, entity_type, island, start)
  )
  UNION ALL
  SELECT n.* FROM chain c JOIN nx n ON n.doc_id = c.doc_id AND n.entity_type = c.entity_type
     AND n.island = c.island AND n.start = c.nstart
)
SELECT c.doc_id, c.entity_type, CAST(c.start AS BIGINT) AS start, CAST(c."end" AS BIGINT) AS "end",
       substring(n.text, c.start + 1, c."end" - c.start) AS span,
       'LOOKUP' AS ner_class, CAST(1 AS DOUBLE) AS ner_score, k.code, k.term, CAST(1 AS DOUBLE) AS nel_score
FROM chain c JOIN cand2 k ON k.doc_id = c.doc_id AND k.entity_type = c.entity_type AND k.start = c.start AND k."end" = c."end"
JOIN nt n ON n.doc_id = c.doc_id
"""

_DEPS = {
    "gaz_case": ["gaz_part"],
    "words_fx": ["tokens_fx"],
    "mentions_fx": ["words_fx"],
    "scopes_fx": ["words_fx"],
    "gaz_words": ["words_fx"],
    "cand_fx": ["gaz_words", "ktok_fx"],
    "lookup_fx": ["cand_fx"],
}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for d in _DEPS.get(n, []):
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(names: list[str], body: str, materialized: bool = False) -> str:
    """``WITH RECURSIVE`` prefix holding the listed views (and their inputs), each computed once if ``materialized``."""
    kind = "AS MATERIALIZED" if materialized else "AS"
    parts = [f"{n} {kind} ({VIEWS[n].strip()})" for n in _closure(names)]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
