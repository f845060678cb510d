"""Thin queries over the operators: each derives the contract's columns from real outputs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelink.llm import bpe, chat
from notelink.llm import decontaminate as dc
from notelink.llm import hard_negatives as hn
from notelink.llm import jaccard as jc
from notelink.llm import langid as li
from notelink.llm import minhash as mh
from notelink.llm import ngram_lm as lm
from notelink.llm import phrases as ph
from notelink.llm import suffix_dedup as sd
from notelink.llm import topk as tk
from notelink.llm import toxicity as tx
from notelink.llm import training_order as to
from notelink.llm.common import table
from notelink.llm.registry import register

_DOC_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@register("op1_decontaminate", rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce({_DOC_WORDS}, []) AS w FROM documents),
b AS MATERIALIZED (SELECT item_id, {_DOC_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
win AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS win
  FROM b, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM win),
pos AS MATERIALIZED (
  SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win
  FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS u(i) WHERE len(w) >= size),
hit AS MATERIALIZED (SELECT doc_id, item_id, pos.size AS size, i FROM pos JOIN win ON pos.win = win.win AND pos.size = win.size),
cov AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hit, unnest(range(i, i + size)) AS u(j) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
        FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN own USING (doc_id)
""")
def op1_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    out = dc.find_contamination(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_ESC = "{0}"
for _c in ["\\", *chat.CONTROL]:
    _ESC = f"replace({_ESC}, '{_c}', '{_c[0]}\\{_c[1:]}')" if len(_c) > 1 else f"replace({_ESC}, '\\', '\\\\')"


@register("op8_chat_format", f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat.START + chat.SEP + chat.END)} + length({_ESC.format('role')}) + length({_ESC.format('text')})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
""")
def op8_chat_format(spark: SparkSession, d: str) -> DataFrame:
    probe = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")],
                                  "conv_id long, turn long, role string, text string")
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    back = chat.read_chat(chat.format_chat(chat.conversations(turns)).drop("messages"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.char_length(F.array_join("loss_texts", "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join("loss_texts", ""), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


@register("op10_language_id")
def op10_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    held = li.fold_of("doc_id", 5) == 0
    samples = li.learn(docs.select("doc_id", "text", "lang").filter(~held))
    return li.predict(docs.select("doc_id", "text"), samples).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@register("op4_byte_bpe")
def op4_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    coded = bpe.encode(table(spark, d, "documents").select("doc_id", "text"), RANKS)
    # the text is no longer needed: it comes back from the ids
    return bpe.decode(coded.drop("text"), RANKS).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_digest().alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


# The labels that the tables have, in the order of the chain.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}
REJECT = 0.65  # probability from which a document is rejected


@register("op6_toxicity")
def op6_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    held = F.coalesce(li.fold_of("doc_id", 5) == 0, F.lit(False))
    chain = tx.learn(docs, table(spark, d, "labels").filter(~held), CATEGORIES)
    return tx.score(docs, chain, list(CATEGORIES)).select(
        "doc_id", held.alias("held_out"), "p_low_quality", "p_toxic", (F.col("p_toxic") >= REJECT).alias("rejected"))


@register("op7_top_k", """
WITH e AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e AS q JOIN e AS c ON q.vec_id % 50 = 0 AND q.vec_id != c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""")
def op7_top_k(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", tk.scaled("embedding").alias("v"))
    return tk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


@register("op5_jaccard_join", r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, i, i + 4), ' ')) AS g
  FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
f AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
s AS MATERIALIZED (SELECT doc_id, g FROM g SEMI JOIN f USING (g)),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (
  SELECT x, y FROM o JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * o >= 75 * (nx.n + ny.n - o)),
e AS MATERIALIZED (SELECT x AS a, y AS b FROM link UNION ALL SELECT y, x FROM link),
reach(doc_id, to_id) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM reach AS r JOIN e ON e.a = r.to_id)
SELECT doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, CAST(min(to_id) AS BIGINT) AS component_id
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
""")
def op5_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jc.jaccard_join(table(spark, d, "documents")).members.select("doc_id", "n_shingles", "component_id")


@register("op9_suffix_dedup", """
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(hex(encode(text)), '') AS h, strlen(coalesce(text, '')) AS n FROM documents),
p AS MATERIALIZED (SELECT doc_id, n, j, substr(h, 400 * j + 1, 498) AS h FROM d, unnest(range(0, (n - 50) // 200 + 1)) AS u(j) WHERE n >= 50),
w AS MATERIALIZED (SELECT doc_id, 200 * j + i AS i, hash(substr(h, 2 * i + 1, 100)) AS s
  FROM p, unnest(range(0, least(200, n - 49 - 200 * j))) AS u(i)),
m AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING count(*) > 1),
f AS (SELECT doc_id, i FROM w JOIN m USING (s) WHERE m < doc_id),
b AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS b FROM f),
g AS (SELECT doc_id, i, sum(b) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM b),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, g),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM r),
c AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
        string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS kept
      FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
""")
def op9_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = sd.remove_repeats(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


@register("op3_lm_score")
def op3_lm_score(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    held = F.coalesce(li.fold_of("doc_id", 7) == 2, F.lit(False))
    model = lm.train(docs.filter(~held), order=3)
    return lm.score(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known",
                                        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@register("op2_training_order")
def op2_training_order(spark: SparkSession, d: str) -> DataFrame:
    shards = to.write_shards(table(spark, d, "documents").select("doc_id", "text"), rank_file=RANKS)
    return to.read_shards(spark, shards).select(
        "slot", "shard", F.col("key").alias("doc_id"), "part", "n_ids", F.sha2("ids", 256).alias("ids_sha256"))


def _linked_sql(k: int, percent: int, extra: str = "") -> str:
    """Components of documents whose sets of k-word n-grams reach the similarity."""
    return rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, i, i + {k - 1}), ' ')) AS g
  FROM d, unnest(range(1, greatest(len(w) - {k - 1}, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
f AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
s AS MATERIALIZED (SELECT doc_id, g FROM g SEMI JOIN f USING (g)),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (
  SELECT x, y FROM o JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * o >= {percent} * (nx.n + ny.n - o)),
e AS MATERIALIZED (SELECT x AS a, y AS b FROM link UNION ALL SELECT y, x FROM link),
reach(doc_id, to_id) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM reach AS r JOIN e ON e.a = r.to_id)
SELECT doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, CAST(min(to_id) AS BIGINT) AS component_id{extra}
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


@register("op13_minhash_dedup", _linked_sql(4, 80, ", min(to_id) = doc_id AS kept"))
def op13_minhash_dedup(spark: SparkSession, d: str) -> DataFrame:
    return mh.minhash_dedup(table(spark, d, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@register("op11_phrases", r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS MATERIALIZED (
  SELECT lang, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase, count(*) AS f
  FROM w, unnest([1, 2, 3]) AS s(size), unnest(range(1, len(w) - size + 2)) AS u(i) WHERE len(w) >= size
  GROUP BY ALL HAVING count(*) >= 10),
c AS MATERIALIZED (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE size > 1),
cut AS (SELECT lang, size, phrase, a, k, array_to_string(w[:k], ' ') AS p, array_to_string(w[k + 1:], ' ') AS q
  FROM c, unnest(range(1, size)) AS u(k)),
s AS (
  SELECT cut.lang, cut.size, cut.phrase, a, x.f AS l, y.f AS r, k,
    CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cut JOIN g AS x ON x.lang = cut.lang AND x.phrase = p JOIN g AS y ON y.lang = cut.lang AND y.phrase = q),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, array_to_string(list_slice(w, i, i + 1), ' ') AS phrase, max(a) AS longer
  FROM c, unnest([1, 2]) AS u(i) WHERE size = 3 GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN inner_ AS i ON i.lang = b.lang AND i.phrase = b.phrase AND b.size = 2
  WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
""")
def op11_phrases(spark: SparkSession, d: str) -> DataFrame:
    return ph.mine_phrases(table(spark, d, "documents")).drop("k")


@register("op12_hard_negatives", """
WITH e AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = len(embedding)),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM e AS a JOIN e AS c ON a.vec_id % 50 = 0 AND a.vec_id != c.vec_id AND len(a.v) = len(c.v)),
p AS MATERIALIZED (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
""")
def op12_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, d, "embeddings").select("vec_id", label.alias("label"), tk.scaled("embedding").alias("v"))
    return hn.hard_negatives(vectors, F.col("vec_id") % 50 == 0)
