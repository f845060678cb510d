"""Lexical linking: F1 exact, F2-F5 fuzzy best match, F6 threshold, B1-B3 BM25.

Linking works on the **distinct normal forms** of the mention spans per
gazetteer key, then joins back to the mentions.

Fuzzy best match is exact without scoring every (mention, term) pair:

1. a few seeds per mention (terms that share its rarest bigrams or a token, and a
   term of each of the most promising character signatures) are scored: the best is ``s0``;
2. a term can only do better if it shares enough bigrams (a prefix of the rarest
   ones is joined), or, where that says nothing, enough characters: signatures (counts
   of characters by class) bound how many, first for whole classes of
   terms of one length, then term by term in the join condition;
3. what is left is scored exactly, in Arrow batches; the best per mention is kept
   (score desc, lowest ``gaz_ord`` on ties). It is the true argmax, including
   the best *sub-threshold* score reported with NO_MAP.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelink.functions.similarity import JW_BOOST_THRESHOLD, JW_MAX_PREFIX, JW_PREFIX_WEIGHT, PAIR_UDFS
from notelink.functions.text import SPACE_CLASS, normalize
from notelink.operators.gazetteer import gaz_keys, norm_index, normalized_terms
from notelink.plans.materialize import checkpointed, numbered, with_constants

METHODS = ("levenshtein", "jaro-winkler", "token-sort-ratio", "token-set-ratio")
NO_MAP = "NO_MAP"
SCORE_DIGITS = 6
# Fixed values of BM25 Okapi.
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25


def with_type_key(mentions: DataFrame, gaz: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Give both sides an ``entity_type`` column (empty when the gazetteer has none)."""
    if "entity_type" not in gaz.columns:
        gaz = gaz.withColumn("entity_type", F.lit(""))
        mentions = mentions.withColumn("entity_type", F.lit(""))
    return mentions, gaz


def canonical_method(method: str) -> str:
    m = method.strip().lower().replace("_", "-")
    if m not in METHODS:
        raise ValueError(f"{method!r} is no fuzzy method; there are {', '.join(METHODS)}")
    return m


def check_threshold(threshold: float) -> float:
    if threshold is None or not 0 <= float(threshold) <= 1:
        raise ValueError(f"the least score must be a number from 0 to 1, not {threshold!r}")
    return float(threshold)


# --- per-method candidate keys and bounds ------------------------------------

def _tokens(s: Column) -> Column:
    return F.filter(F.split(s, f"[{SPACE_CLASS}]+"), lambda t: t != "")


def sorted_form(s: Column) -> Column:
    return F.array_join(F.array_sort(_tokens(s)), " ")


def sorted_set_form(s: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(_tokens(s))), " ")


def _form(method: str, s: Column) -> Column:
    """The string whose length the bound uses."""
    if method == "token-sort-ratio":
        return sorted_form(s)
    if method == "token-set-ratio":
        return sorted_set_form(s)
    return s


def _length_bound(la: Column, lb: Column) -> Column:
    """Highest Levenshtein score of strings of these lengths that share no bigram."""
    big = F.greatest(la, lb)
    return F.when(big == 0, 1.0).otherwise(1 - F.greatest(F.abs(la - lb), F.ceil((big - 1) / 2)) / big)


# Classes of characters in a signature; coarse ones join three, three and two of them.
SIGNATURE = 8


def signature(s: Column) -> Column:
    """How many characters of a string are in each class."""
    at = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.pmod(F.ascii(F.substring(s, i, 1)), F.lit(SIGNATURE)))
    at = F.when(F.length(s) > 0, at).otherwise(F.array().cast("array<int>"))
    return F.transform(F.array(*[F.lit(g) for g in range(SIGNATURE)]), lambda g: F.size(F.filter(at, lambda x: x == g)))


def _shared(a: list, b: list) -> Column:
    """The most characters that two strings with these counts share."""
    out = F.lit(0)
    for x, y in zip(a, b):
        out = out + F.least(x, y)
    return out


def _counts(vec: str) -> list:
    return [F.col(vec)[g] for g in range(SIGNATURE)]


def _coarse(vec: Column) -> list:
    return [vec[0] + vec[1] + vec[2], vec[3] + vec[4] + vec[5], vec[6] + vec[7]]


def _score_bound(method: str, la: Column, lb: Column, shared: Column, prefix) -> Column:
    """Highest score of strings of these lengths that share at most ``shared`` characters
    (and begin with ``prefix`` equal ones, which Jaro-Winkler rewards)."""
    m = F.least(shared, la, lb)
    empty = (la == 0) & (lb == 0)
    if method == "jaro-winkler":
        j = F.when(m == 0, 0.0).otherwise((m / la + m / lb + 1) / 3)
        return F.when(empty, 1.0).when(j > JW_BOOST_THRESHOLD, j + JW_PREFIX_WEIGHT * prefix * (1 - j)).otherwise(j)
    return F.when(empty, 1.0).when(m == 0, 0.0).otherwise(2 * m / (la + lb))


def _raw_score(method: str, m: Column, t: Column) -> Column:
    if method == "levenshtein":
        big = F.greatest(F.length(m), F.length(t))
        return F.when(big == 0, 1.0).otherwise(1 - F.levenshtein(m, t) / big)
    return PAIR_UDFS[method](m, t)


def _score(method: str, m: Column, t: Column) -> Column:
    """The score that is reported and compared: rounded, so that ties are ties."""
    return F.round(_raw_score(method, m, t), SCORE_DIGITS)


def _best(df: DataFrame, group: list[str]) -> DataFrame:
    """Best row per group: highest score, lowest ``gaz_ord``."""
    pick = F.max_by(F.struct("gaz_ord", "norm", "score"), F.struct(F.col("score"), -F.col("gaz_ord")))
    return df.groupBy(*group).agg(pick.alias("_b")).select(*group, "_b.gaz_ord", "_b.norm", "_b.score")


def _exploded_occurrence_bigrams(df: DataFrame, cols: list[str], text: str) -> DataFrame:
    """One row per bigram, numbered by occurrence (``ab#1``, ``ab#2``) so that set
    overlap equals multiset overlap.  Numbering is a window per (string, bigram):
    linear in the string length, also for very long spans."""
    n = F.length(text)
    grams = F.when(n < 2, F.array(F.col(text))).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, 2)))
    e = df.select(*cols, F.posexplode(grams).alias("_p", "_g"))
    w = Window.partitionBy(*cols, "_g").orderBy("_p")
    return e.select(*cols, F.concat("_g", F.lit("#"), F.row_number().over(w).cast("string")).alias("g"))


def _levenshtein_best(queries: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """Exact best Levenshtein match with prefix filtering on rare bigrams.

    1. seeds: terms sharing one of the query's two rarest bigrams (global
       order: document frequency in the gazetteer, then the gram) -> best s0;
    2. a term scoring >= s0 has at most ``d = floor((1 - s0) L)`` edits, so it
       shares at least ``a = L - 1 - 2d`` occurrence-numbered bigrams with the
       query (q-gram lemma); any such term shares one of the query's
       ``|X| - a + 1`` rarest bigrams (prefix lemma), so only those are joined;
    3. term lengths where ``a <= 0`` cannot be filtered this way and are
       scanned by length, when the length bound still reaches s0.
    Frequent bigrams therefore only enter the join for queries that need them.
    """
    group = [*keys, "m"]
    tg_ = _exploded_occurrence_bigrams(terms, [*keys, "gaz_ord", "norm"], "norm")
    gdf = tg_.groupBy(*keys, "g").agg(F.count("*").alias("df"))
    qg = _exploded_occurrence_bigrams(queries, group, "m")
    qg = qg.join(gdf, [*keys, "g"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    wq = Window.partitionBy(*group)
    qg = qg.withColumn("nq", F.count("*").over(wq)).withColumn("rk", F.row_number().over(wq.orderBy("df", "g")))
    # 1. seeds from the two rarest grams that occur in the gazetteer
    seeds_g = qg.where(F.col("df") > 0).withColumn("rk0", F.row_number().over(wq.orderBy("df", "g"))).where(F.col("rk0") <= 2)
    seeds = seeds_g.select(*keys, "m", "g").join(tg_, [*keys, "g"]).select(*group, "gaz_ord", "norm").distinct()
    seeds = seeds.withColumn("score", _score("levenshtein", F.col("m"), F.col("norm")))
    s0 = _best(seeds, group).select(*group, F.col("score").alias("s0"))
    # 2. per query: required overlap per term length, prefix size, residual lengths
    lens = terms.groupBy(*keys).agg(F.array_sort(F.collect_set(F.length("norm"))).alias("lbs"))
    q = queries.join(s0, group, "left").withColumn("s0", F.coalesce("s0", F.lit(0.0)))
    q = with_constants(q.withColumn("la", F.length("m")), lens, keys)
    big = lambda lb: F.greatest(F.col("la"), lb)
    alpha = lambda lb: big(lb) - 1 - 2 * F.floor((F.lit(1.0) - F.col("s0") + F.lit(1e-6)) * big(lb))
    ub = lambda lb: F.round(_length_bound(F.col("la"), lb), SCORE_DIGITS)
    q = q.withColumn("a_min", F.array_min(F.filter(F.transform("lbs", alpha), lambda a: a > 0)))
    q = q.withColumn("scan", F.filter("lbs", lambda lb: (alpha(lb) <= 0) & (ub(lb) >= F.col("s0"))))
    q = q.join(qg.groupBy(*group).agg(F.first("nq").alias("nq")), group, "left")
    q = q.withColumn("p", F.when(F.col("a_min").isNotNull(), F.col("nq") - F.col("a_min") + 1))
    q = checkpointed(q.select(*group, "p", "scan"))
    pref = qg.join(q.select(*group, "p"), group).where(F.col("rk") <= F.col("p")).select(*keys, "m", "g")
    cand = pref.join(tg_, [*keys, "g"]).select(*group, "gaz_ord", "norm").distinct()
    cand = cand.withColumn("score", _score("levenshtein", F.col("m"), F.col("norm")))
    # 3. unfilterable lengths
    tl = terms.select(*keys, "gaz_ord", "norm", F.length("norm").alias("lb"))
    rest = q.select(*group, F.explode("scan").alias("lb")).join(tl, [*keys, "lb"]).select(*group, "gaz_ord", "norm")
    rest = rest.withColumn("score", _score("levenshtein", F.col("m"), F.col("norm")))
    return _best(seeds.unionByName(cand).unionByName(rest), group)


def _rare_bigrams(queries: DataFrame, terms: DataFrame, keys: list[str], form: str, term_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Occurrence-numbered bigrams: the terms', and the queries' with their rank by document frequency (rarest first)."""
    group = [*keys, "m"]
    tg_ = _exploded_occurrence_bigrams(terms, [*keys, *term_cols], form)
    gdf = tg_.groupBy(*keys, "g").agg(F.count("*").alias("df"))
    qg = _exploded_occurrence_bigrams(queries, [*group, form] if form != "m" else group, form)
    qg = qg.join(gdf, [*keys, "g"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    w = Window.partitionBy(*group).orderBy("df", "g")
    return tg_, qg.withColumn("rk", F.row_number().over(w))


# Seeds: rarest bigrams that are looked up, and signature classes of which a term is tried.
SEED_BIGRAMS, SEED_CLASSES = 2, 4


def _filtered_best(queries: DataFrame, terms: DataFrame, keys: list[str], method: str) -> DataFrame:
    """Exact best match for Jaro-Winkler and the token ratios; see the module's docstring."""
    group = [*keys, "m"]
    jaro = method == "jaro-winkler"
    t = terms.select(*keys, "gaz_ord", "norm", _form(method, F.col("norm")).alias("f"))
    t = checkpointed(t.withColumn("lb", F.length("f")).withColumn("vec", signature(F.col("f"))))
    k0, k1, _ = _coarse(F.col("vec"))
    t = t.withColumn("k0", k0).withColumn("k1", k1)
    q = queries.select(*group, _form(method, F.col("m")).alias("f"))
    q = checkpointed(q.withColumn("la", F.length("f")).withColumn("qvec", signature(F.col("f"))))

    def scored(pairs: DataFrame) -> DataFrame:
        return pairs.select(*group, "gaz_ord", "norm").distinct().withColumn("score", _score(method, F.col("m"), F.col("norm")))

    # 1. signature classes of each term length: few, whatever the gazetteer's size (three counts that add up to the length)
    some = t.groupBy(*keys, "lb", "k0", "k1").agg(F.min_by(F.struct("gaz_ord", "norm"), "gaz_ord").alias("one"))
    classes = checkpointed(some.groupBy(*keys, "lb").agg(F.collect_list(F.struct("k0", "k1", "one")).alias("classes")))
    lens = classes.groupBy(*keys).agg(F.array_sort(F.collect_list("lb")).alias("lbs"))

    def lengths(df: DataFrame, prefix: int) -> DataFrame:
        """One row for each term length at which the best score so far can be reached."""
        e = with_constants(df, lens, keys).withColumn("lb", F.explode("lbs")).drop("lbs")
        bound = F.round(_score_bound(method, F.col("la"), F.col("lb"), F.least("la", "lb"), F.lit(prefix)) + 1e-9, SCORE_DIGITS)
        return e.where((bound >= F.col("s0")) & (bound > 0))

    def class_bound(x) -> Column:
        most = _shared(_coarse(F.col("qvec")), [x["k0"], x["k1"], F.col("lb") - x["k0"] - x["k1"]])
        return F.round(_score_bound(method, F.col("la"), F.col("lb"), most, F.lit(0)) + 1e-9, SCORE_DIGITS)

    # 2. seeds: the first term (it wins where all score 0), rare bigrams, shared tokens, a term of each of the best classes
    tg_, qg = _rare_bigrams(q, t, keys, "f", ["gaz_ord", "norm"])
    qg = qg if jaro else checkpointed(qg)
    first = t.groupBy(*keys).agg(F.min_by(F.struct("gaz_ord", "norm"), "gaz_ord").alias("_f"))
    seeds = with_constants(q.select(*group), first, keys).select(*group, "_f.gaz_ord", "_f.norm")
    rare = qg.where(F.col("df") > 0).withColumn("rk0", F.row_number().over(Window.partitionBy(*group).orderBy("df", "g")))
    rare = rare.where(F.col("rk0") <= SEED_BIGRAMS).select(*group, "g")
    seeds = seeds.unionByName(rare.join(tg_, [*keys, "g"]).select(*group, "gaz_ord", "norm"))
    if method == "token-set-ratio":
        mine = q.select(*group, F.explode(F.array_distinct(_tokens(F.col("m")))).alias("tok"))
        theirs = t.select(*keys, "gaz_ord", "norm", F.explode(F.array_distinct(_tokens(F.col("norm")))).alias("tok"))
        seeds = seeds.unionByName(mine.join(theirs, [*keys, "tok"]).select(*group, "gaz_ord", "norm"))
    every = lengths(q.withColumn("s0", F.lit(0.0)), 0).join(classes, [*keys, "lb"])
    tops = F.slice(F.sort_array(F.transform("classes", lambda x: F.struct(class_bound(x).alias("b"), x["one"].alias("one"))), asc=False), 1, SEED_CLASSES)
    every = every.select(*group, F.explode(tops).alias("x")).where("x.b > 0")
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("x.b"), "x.one.gaz_ord"))
    every = every.withColumn("n", nth).where(F.col("n") <= SEED_CLASSES).select(*group, "x.one.gaz_ord", "x.one.norm")
    best = checkpointed(_best(scored(seeds.unionByName(every)), group))

    # 3. terms that can still do better
    open_ = q.join(best.select(*group, F.col("score").alias("s0")), group)
    found = []
    scan = lengths(open_, 0)
    if not jaro:
        # A common subsequence of k characters leaves 3k - la - lb - 1 bigrams in common at least; where that
        # is more than none, a term has one of the query's rarest bigrams up to a prefix.
        k = F.ceil((F.col("s0") - 1e-6) * (F.col("la") + F.col("lb")) / 2)
        scan = scan.withColumn("alpha", 3 * k - F.col("la") - F.col("lb") - 1)
        size = qg.groupBy(*group).agg(F.max("rk").alias("nq"))
        prefix = scan.where("alpha > 0").groupBy(*group).agg(F.min("alpha").alias("alpha")).join(size, group)
        prefix = prefix.select(*group, (F.col("nq") - F.col("alpha") + 1).alias("p"))
        found.append(qg.join(prefix, group).where(F.col("rk") <= F.col("p")).select(*group, "g").join(tg_, [*keys, "g"]))
        scan = scan.where("alpha <= 0").drop("alpha")
    # classes of a length that share enough characters, then their terms that do, by the finer signature
    able = scan.join(classes, [*keys, "lb"])
    able = able.withColumn("x", F.explode(F.filter("classes", lambda x: (class_bound(x) >= F.col("s0")) & (class_bound(x) > 0))))
    able = able.select(*group, "la", "qvec", "s0", "lb", "x.k0", "x.k1")
    fine = F.round(_score_bound(method, F.col("la"), F.col("lb"), _shared(_counts("qvec"), _counts("vec")), F.lit(0)) + 1e-9, SCORE_DIGITS)
    found.append(able.join(t.select(*keys, "lb", "k0", "k1", "gaz_ord", "norm", "vec"), [*keys, "lb", "k0", "k1"]).where(fine >= F.col("s0")))
    if jaro:
        # terms with the same first character: the prefix counts
        near = lengths(open_, JW_MAX_PREFIX).withColumn("c1", F.substring("f", 1, 1)).withColumnRenamed("f", "qf")
        same = F.lit(0)
        for i in range(JW_MAX_PREFIX, 0, -1):
            same = F.when((F.length("qf") >= i) & (F.substring("qf", 1, i) == F.substring("f", 1, i)), F.greatest(same, F.lit(i))).otherwise(same)
        fine = F.round(_score_bound(method, F.col("la"), F.col("lb"), _shared(_counts("qvec"), _counts("vec")), same) + 1e-9, SCORE_DIGITS)
        theirs = t.select(*keys, "lb", F.substring("f", 1, 1).alias("c1"), "gaz_ord", "norm", "vec", "f")
        found.append(near.join(theirs, [*keys, "c1", "lb"]).where(fine >= F.col("s0")))
    left = found[0].select(*group, "gaz_ord", "norm")
    for more in found[1:]:
        left = left.unionByName(more.select(*group, "gaz_ord", "norm"))
    return _best(best.unionByName(scored(left)), group)


def fuzzy_best(queries: DataFrame, terms: DataFrame, method: str) -> DataFrame:
    """Best term for each distinct query ``m`` (per key); exact over all terms.

    ``queries``: ``keys, m``; ``terms``: ``keys, gaz_ord, norm`` (G1 rows).
    Returns ``keys, m, gaz_ord, norm, score``.
    """
    method = canonical_method(method)
    keys = gaz_keys(terms)
    if method == "levenshtein":
        return _levenshtein_best(queries, terms, keys)
    return _filtered_best(queries, terms, keys, method)


def link_fuzzy(mentions: DataFrame, gaz: DataFrame, method: str = "levenshtein", threshold: float = 0.7,
               with_class: bool = False) -> DataFrame:
    """P2 linking (F1 -> F2..F5 -> F6) of ``mentions`` (needs ``span`` and the gazetteer keys).

    Adds ``code, term, nel_score``: exact normal form -> 1.0; otherwise the
    best term; below ``threshold`` -> ``NO_MAP`` with the raw span as term and
    the best score kept.
    """
    method = canonical_method(method)
    threshold = check_threshold(threshold)
    drop_type = "entity_type" not in gaz.columns
    mentions, gaz = with_type_key(mentions, gaz)
    keys = gaz_keys(gaz)
    # gazetteer-sized tables used by several branches: materialise once
    terms = checkpointed(normalized_terms(gaz))
    index = checkpointed(norm_index(terms.select(*keys, "gaz_ord", "term", "code"), deduped=True))
    m = mentions.withColumn("_m", normalize(F.col("span")))
    queries = checkpointed(m.select(*keys, F.col("_m").alias("m")).distinct())
    exact = queries.join(index.select(*keys, F.col("norm").alias("m"), "term", "code"), [*keys, "m"])
    exact = exact.select(*keys, "m", "term", "code", F.lit(1.0).alias("nel_score"))
    rest = queries.join(index.select(*keys, F.col("norm").alias("m")), [*keys, "m"], "left_anti")
    best = fuzzy_best(rest, terms, method)
    best = best.join(index.select(*keys, "norm", F.col("term").alias("_t"), F.col("code").alias("_c")), [*keys, "norm"])
    # the threshold is for the score itself, before rounding
    best = best.withColumn("_raw", _raw_score(method, F.col("m"), F.col("norm")))
    linked = best.select(*keys, "m",
                         F.when(F.col("_raw") >= threshold, F.col("_t")).alias("term"),
                         F.when(F.col("_raw") >= threshold, F.col("_c")).otherwise(F.lit(NO_MAP)).alias("code"),
                         F.col("score").alias("nel_score"))
    links = exact.unionByName(linked)
    out = m.join(links.withColumnRenamed("m", "_m"), [*keys, "_m"], "left")
    out = out.withColumn("code", F.coalesce("code", F.lit(NO_MAP)))
    out = out.withColumn("term", F.coalesce("term", F.col("span")))
    if with_class:
        out = out.withColumn("nel_class", F.lit(f"FUZZYMATCH_{method.upper()}"))
    out = out.drop("_m")
    return out.drop("entity_type") if drop_type else out


# --- BM25 --------------------------------------------------------------------

def bm25_postings(terms: DataFrame) -> DataFrame:
    """B1: ``keys, token, gaz_ord, tf, dl`` plus ``idf`` after the negative-idf floor.

    Every G1 row is a document of the BM25 corpus (duplicate normal forms
    count separately); tokens come from ``split()`` on white space.
    """
    keys = gaz_keys(terms)
    toks = terms.select(*keys, "gaz_ord", F.explode(_tokens(F.col("norm"))).alias("token"))
    tf = toks.groupBy(*keys, "gaz_ord", "token").agg(F.count("*").alias("tf"))
    dl = terms.select(*keys, "gaz_ord", F.size(_tokens(F.col("norm"))).alias("dl"))
    corpus = dl.groupBy(*keys).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    df_ = tf.groupBy(*keys, "token").agg(F.count("*").alias("df"))
    idf = with_constants(df_, corpus, keys)
    idf = idf.withColumn("idf_raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    idf = with_constants(idf, idf.groupBy(*keys).agg(F.avg("idf_raw").alias("avg_idf")), keys)
    idf = idf.withColumn("idf", F.when(F.col("idf_raw") < 0, BM25_EPSILON * F.col("avg_idf")).otherwise(F.col("idf_raw")))
    post = tf.join(dl, [*keys, "gaz_ord"]).join(idf.select(*keys, "token", "df", "idf", "avgdl"), [*keys, "token"])
    return post


# Postings of a token's first level; each further level has so many times as many. Postings of a row of a level.
FIRST_LEVEL, GROWTH, LEVEL_ROW = 64, 8, 1024


def _impact() -> Column:
    """What a posting adds to the score of a query that has its token once."""
    return F.col("idf") * (F.col("tf") * (BM25_K1 + 1)) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl")))


def impact_levels(post: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Postings (``keys, token, gaz_ord, w``) in the order of their impact, cut into levels that grow.

    Returns the levels (``keys, token, level, top, first_ord``: the largest impact, and the first
    ``gaz_ord`` of those that have it) and their postings (``keys, token, level, ords``).
    """
    order = [*[F.col(k) for k in keys], F.col("token"), F.round("w", SCORE_DIGITS).desc(), F.col("gaz_ord")]
    p = numbered(post, order, "_o")
    begin = p.groupBy(*keys, "token").agg(F.min("_o").alias("_b"))
    p = p.join(begin, [*keys, "token"]).withColumn("_r", F.col("_o") - F.col("_b"))
    level = F.floor(F.log(float(GROWTH), (GROWTH - 1) * F.col("_r") / FIRST_LEVEL + 1)).cast("int")
    p = p.withColumn("level", level)
    levels = p.groupBy(*keys, "token", "level").agg(F.max("w").alias("top"), F.min_by("gaz_ord", "_o").alias("first_ord"))
    rows = p.groupBy(*keys, "token", "level", F.floor(F.col("_r") / LEVEL_ROW).alias("_c")).agg(F.collect_list("gaz_ord").alias("ords")).drop("_c")
    return checkpointed(levels), checkpointed(rows)


def bm25_best(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """B2 + B3: each query's term of the highest Okapi score (ties: lowest ``gaz_ord``), exact.

    Postings are read in the order of their impact, level by level. A term that no
    level read so far has shown scores at most the sum of what the next levels of the
    query's tokens begin with: once that is below the best score found, the query
    is done. Tokens whose next levels together stay below the best score are not
    read at all, so the long lists of frequent tokens are hardly touched. Terms that
    are shown are scored in full from their own tokens. Terms without a token of the query score 0.
    """
    keys = gaz_keys(terms)
    group = [*keys, "m"]
    post = checkpointed(bm25_postings(terms).withColumn("w", _impact()))
    qt = queries.select(*group, F.explode(_tokens(F.col("m"))).alias("token")).groupBy(*group, "token").agg(F.count("*").alias("qtf"))
    # Impacts are negative only where the mean idf is (tokens in more than half of the terms): no bound holds there
    below = post.where("w < 0").select(*keys).distinct()
    spread = queries
    odd = None
    if post.where("w < 0").limit(1).count():
        if keys:
            odd, spread = queries.join(below, keys, "left_semi"), queries.join(below, keys, "left_anti")
            qt = qt.join(below, keys, "left_anti")
        else:
            odd, spread, qt = queries, queries.limit(0), qt.limit(0)
    levels, rows = impact_levels(post.where("w > 0").select(*keys, "token", "gaz_ord", "w"), keys)
    vectors = checkpointed(post.where("w > 0").groupBy(*keys, "gaz_ord").agg(F.map_from_entries(F.collect_list(F.struct("token", "w"))).alias("ws")))
    # every query's tokens that some term has, with the next level to read
    todo = qt.join(levels.where("level = 0"), [*keys, "token"])
    todo = checkpointed(todo.withColumn("matched", F.count("*").over(Window.partitionBy(*group))))
    asked = todo.groupBy(*group).agg(F.collect_list(F.struct("token", "qtf")).alias("toks"))
    best = None
    while todo.limit(1).count():
        u = F.col("qtf") * F.col("top")
        if best is None:  # the most telling token first
            nth = F.row_number().over(Window.partitionBy(*group).orderBy(u.desc(), "token"))
            t = todo.withColumn("reads", nth == 1)
        else:
            t = todo.join(best.select(*group, F.col("gaz_ord").alias("best_ord"), "score"), group, "left")
            floor = F.coalesce("score", F.lit(0.0))
            reach = F.round(F.sum(u).over(Window.partitionBy(*group).orderBy(u, "token").rowsBetween(Window.unboundedPreceding, 0)) + 1e-9, SCORE_DIGITS)
            # of one token alone, postings of one impact come in the order of gaz_ord
            tied = (F.col("matched") == 1) & (F.col("qtf") == 1) & (F.round("top", SCORE_DIGITS) == floor) & (F.col("first_ord") > F.col("best_ord"))
            t = t.withColumn("reads", (reach >= floor) & ~F.coalesce(tied, F.lit(False)))
        t = t.withColumn("open", F.max("reads").over(Window.partitionBy(*group))).where("open")
        t = checkpointed(t.select(*group, "token", "qtf", "matched", "level", "top", "first_ord", "reads"))
        shown = t.where("reads").join(rows, [*keys, "token", "level"]).select(*group, F.explode("ords").alias("gaz_ord")).distinct()
        dot = F.aggregate("toks", F.lit(0.0), lambda s, x: s + x["qtf"] * F.coalesce(F.try_element_at("ws", x["token"]), F.lit(0.0)))
        scored = shown.join(vectors, [*keys, "gaz_ord"]).join(asked, group).select(*group, "gaz_ord", F.round(dot, SCORE_DIGITS).alias("score"))
        if best is not None:
            scored = scored.unionByName(best)
        pick = F.max_by(F.struct("gaz_ord", "score"), F.struct(F.col("score"), -F.col("gaz_ord"))).alias("_b")
        best = checkpointed(scored.groupBy(*group).agg(pick).select(*group, "_b.gaz_ord", "_b.score"))
        read = t.where("reads").select(*group, "token", "qtf", "matched", (F.col("level") + 1).alias("level")).join(levels, [*keys, "token", "level"])
        todo = checkpointed(t.where("NOT reads").drop("reads").unionByName(read.select(*group, "token", "qtf", "matched", "level", "top", "first_ord")))
    # no token in common: every term scores 0, the first one is taken
    first = terms.groupBy(*keys).agg(F.min("gaz_ord").alias("_first"))
    none = spread.select(*group) if best is None else spread.select(*group).join(best.where("score > 0"), group, "left_anti")
    zero = with_constants(none, first, keys).select(*group, F.col("_first").alias("gaz_ord"), F.lit(0.0).alias("score"))
    out = zero if best is None else best.where("score > 0").unionByName(zero)
    out = out.join(terms.select(*keys, "gaz_ord", "norm"), [*keys, "gaz_ord"])
    return out if odd is None else out.unionByName(_bm25_best_full(odd, terms, post))


def _bm25_best_full(queries: DataFrame, terms: DataFrame, post: DataFrame) -> DataFrame:
    """The same where impacts can be negative: every term that shares a token is scored.

    Every other term scores exactly 0, and the lowest such ``gaz_ord`` is found as the first
    gap in the sorted list of overlapping terms.  Returns ``keys, m, gaz_ord,
    norm, score`` with the score rounded to 6 places.
    """
    keys = gaz_keys(terms)
    group = [*keys, "m"]
    qt = queries.select(*group, F.explode(_tokens(F.col("m"))).alias("token")).groupBy(*group, "token").agg(
        F.count("*").alias("qtf"))
    scores = qt.join(post, [*keys, "token"]).groupBy(*group, "gaz_ord").agg(F.sum(F.col("qtf") * F.col("w")).alias("raw"))
    scores = scores.withColumn("score", F.round("raw", SCORE_DIGITS))
    # place of every term in file order, to find the first term that shares no token
    ranked = numbered(terms.select(*keys, "gaz_ord", "norm"), [*[F.col(k) for k in keys], F.col("gaz_ord")], "_o")
    ranked = with_constants(ranked, ranked.groupBy(*keys).agg(F.min("_o").alias("_b")), keys)
    ranked = ranked.withColumn("r", F.col("_o") - F.col("_b")).drop("_o", "_b")
    s = scores.join(ranked.select(*keys, "gaz_ord", "r"), [*keys, "gaz_ord"])
    agg = s.groupBy(*group).agg(
        F.max_by(F.struct("gaz_ord", "score"), F.struct(F.col("score"), -F.col("gaz_ord"))).alias("_pos"),
        F.count("*").alias("_n"),
        F.min(F.when(F.col("score") == 0, F.col("gaz_ord"))).alias("_zero_ord"))
    sizes = ranked.groupBy(*keys).agg(F.count("*").alias("_total"))
    q = queries.select(*group).join(agg, group, "left").join(_first_missing_rank(s, group), group, "left")
    q = with_constants(q, sizes, keys)
    n = F.coalesce(F.col("_n"), F.lit(0))
    # first term (in file order) sharing no token: the first gap in the ranks, else rank n when n < N
    q = q.withColumn("_free_r", F.coalesce(F.col("_gap_idx"), F.when(n < F.col("_total"), n)))
    q = q.join(ranked.select(*keys, F.col("r").alias("_free_r"), F.col("gaz_ord").alias("_free_ord")),
               [*keys, "_free_r"], "left")
    zero_ord = F.least(F.col("_zero_ord"), F.col("_free_ord"))
    pos_score = F.col("_pos.score")
    # below zero only if every term shares a token and loses by it
    use_pos = pos_score.isNotNull() & ((pos_score > 0) | zero_ord.isNull())
    best_ord = F.when(use_pos, F.col("_pos.gaz_ord")).otherwise(zero_ord)
    best_score = F.when(use_pos, pos_score).otherwise(F.lit(0.0))
    out = q.select(*group, best_ord.alias("gaz_ord"), best_score.alias("score"))
    return out.join(terms.select(*keys, "gaz_ord", "norm"), [*keys, "gaz_ord"])


def _first_missing_rank(s: DataFrame, group: list[str]) -> DataFrame:
    """Smallest rank missing from each group's overlap set (``_gap_idx``), if any gap."""
    w = Window.partitionBy(*group).orderBy("r")
    idx = s.select(*group, "r", (F.row_number().over(w) - 1).alias("i"))
    return idx.where(F.col("r") != F.col("i")).groupBy(*group).agg(F.min("i").alias("_gap_idx"))


def link_bm25(mentions: DataFrame, gaz: DataFrame, with_class: bool = False) -> DataFrame:
    """P3 linking (F1 -> B1..B3): exact normal form -> 1.0, else the BM25 argmax (no threshold)."""
    drop_type = "entity_type" not in gaz.columns
    mentions, gaz = with_type_key(mentions, gaz)
    keys = gaz_keys(gaz)
    terms = checkpointed(normalized_terms(gaz))
    index = checkpointed(norm_index(terms.select(*keys, "gaz_ord", "term", "code"), deduped=True))
    m = mentions.withColumn("_m", normalize(F.col("span")))
    queries = checkpointed(m.select(*keys, F.col("_m").alias("m")).distinct())
    exact = queries.join(index.select(*keys, F.col("norm").alias("m"), "term", "code"), [*keys, "m"])
    exact = exact.select(*keys, "m", "term", "code", F.lit(1.0).alias("nel_score"))
    rest = queries.join(index.select(*keys, F.col("norm").alias("m")), [*keys, "m"], "left_anti")
    best = bm25_best(rest, terms)
    best = best.join(index.select(*keys, "norm", "term", "code"), [*keys, "norm"])
    links = exact.unionByName(best.select(*keys, "m", "term", "code", F.col("score").alias("nel_score")))
    out = m.join(links.withColumnRenamed("m", "_m"), [*keys, "_m"], "left")
    out = out.withColumn("code", F.coalesce("code", F.lit(NO_MAP))).withColumn("term", F.coalesce("term", F.col("span")))
    if with_class:
        out = out.withColumn("nel_class", F.lit("BM25OKAPI"))
    out = out.drop("_m")
    return out.drop("entity_type") if drop_type else out
