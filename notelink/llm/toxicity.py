"""Operator 6: toxicity by classifier chains.

The categories are predicted in a fixed order. Each has a linear model over the
presence of words and the probabilities of the categories before it. While
training, those earlier probabilities are out of fold: each row's come from a
model that has not seen the row, so a later model learns how far to trust them.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from notelink.llm.common import append_columns, text_buffers, word_hashes, written

# The bounded sample that is learned from: labelled keys in order of their hash, and texts of a key in
# order of theirs. At most TRAIN_ROWS * KEY_TEXTS rows come to the driver, as word numbers.
TRAIN_ROWS, KEY_TEXTS = 10_000, 4
# Beginnings of words, in bytes, that count as words too: inflected and compound forms.
PREFIXES = (5, 6, 7)
# Words of a model (those that tell its category best), and the rows a word must be in.
FEATURES, MIN_ROWS = 1024, 5
FOLDS, STEPS, RIDGE = 4, 120, 1e-4

_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[65:91] = _NOT_LETTER[97:123] = _NOT_LETTER[128:] = False


def word_sets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words (runs of letters, A-Z lower-cased) and beginnings of words of
    each text, and where each text's begin."""
    h, first = word_hashes(*text_buffers(col), blank=_NOT_LETTER, prefixes=PREFIXES)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first) * (1 + len(PREFIXES)))
    h = h.ravel()
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(first)))


@dataclass
class Linear:
    """A logistic model: sorted word hashes with weights, weights of earlier categories, a bias."""

    words: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def margins(self, h: np.ndarray, first: np.ndarray, before: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.words, h)
        at[at == len(self.words)] = 0
        w = np.where(self.words[at] == h, self.weights[at], 0.0) if len(self.words) else np.zeros(len(h))
        total = np.concatenate([[0.0], np.cumsum(w)])
        return total[first[1:]] - total[first[:-1]] + before @ self.earlier + self.bias

    def probability(self, h, first, before) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(h, first, before), -30, 30)))


@dataclass
class Sample:
    """The labelled rows: their words as numbers in ``vocabulary`` (CSR), folds and labels, and
    which words each category may use, without each fold (the last: without none)."""

    vocabulary: np.ndarray
    words: np.ndarray
    first: np.ndarray
    fold: np.ndarray
    labels: np.ndarray
    usable: np.ndarray  # (categories, FOLDS + 1, vocabulary)


def fit_linear(s: Sample, rows: np.ndarray, before: np.ndarray, y: np.ndarray, usable: np.ndarray) -> Linear:
    """Logistic regression by accelerated gradient steps. With one class only, no rows or
    no words, the model is the smoothed share of the category."""
    n, k = len(rows), before.shape[1]
    prior = (y.sum() + 0.5) / (n + 1) if n else 1e-6
    bias = float(np.log(prior / (1 - prior)))
    vocabulary = np.flatnonzero(usable)
    if n == 0 or y.min() == y.max() or not len(vocabulary):
        return Linear(np.zeros(0, np.uint64), np.zeros(0), np.zeros(k), bias)
    number = np.full(len(usable), -1)
    number[vocabulary] = np.arange(len(vocabulary))
    w, first = _rows(s.words, s.first, rows)
    row, col = np.repeat(np.arange(n), np.diff(first)), number[w]
    row, col = row[col >= 0], col[col >= 0]
    m = len(vocabulary)
    # A diagonal bound of the curvature: each coordinate steps by its own, over the features that a row has at most.
    width = np.sqrt(np.bincount(row, minlength=n).max() + k + 1.0)
    own = np.concatenate([np.bincount(col, minlength=m), (before**2).sum(0) + 1, [n]])
    size = 4 / (own * width + RIDGE * n)
    x = np.concatenate([np.zeros(m + k), [bias]])
    look, t = x.copy(), 1.0
    for _ in range(STEPS):
        z = np.bincount(row, weights=look[col], minlength=n) + before @ look[m:-1] + look[-1]
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.concatenate([np.bincount(col, weights=err[row], minlength=m), before.T @ err, [err.sum()]])
        grad[:-1] += RIDGE * n * look[:-1]
        new = look - size * grad
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        look, x = new + (last - 1) / t * (new - x), new
    order = np.argsort(s.vocabulary[vocabulary])
    return Linear(s.vocabulary[vocabulary][order], x[:m][order], x[m:-1], float(x[-1]))


def fit_chain(s: Sample) -> list[Linear]:
    """A model per category; later ones are fitted on out-of-fold probabilities of earlier ones."""
    n, m = s.labels.shape
    outside = np.zeros((n, 0))
    chain = []
    for j in range(m):
        chain.append(fit_linear(s, np.arange(n), outside, s.labels[:, j], s.usable[j, FOLDS]))
        if j + 1 < m:
            p = np.zeros(n)
            for f in range(FOLDS):
                seen, unseen = np.flatnonzero(s.fold != f), np.flatnonzero(s.fold == f)
                model = fit_linear(s, seen, outside[seen], s.labels[seen, j], s.usable[j, f])
                w, first = _rows(s.words, s.first, unseen)
                p[unseen] = model.probability(s.vocabulary[w], first, outside[unseen])
            outside = np.column_stack([outside, p])
    return chain


def _rows(h: np.ndarray, first: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(first)[keep]
    at = np.concatenate([[0], np.cumsum(size)])
    return h[np.arange(at[-1]) + np.repeat(first[keep] - at[:-1], size)], at


def _usable(stats: pa.Table, fold: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each category, without each fold and without none, the words that tell it best (chi-squared)."""
    m = y.shape[1]
    out = np.zeros((m, FOLDS + 1, stats.num_rows), bool)
    n = np.column_stack([stats.column(f"n{f}").to_numpy() for f in range(FOLDS)]).astype(float)
    for j in range(m):
        pos = np.column_stack([stats.column(f"p{j}_{f}").to_numpy() for f in range(FOLDS)]).astype(float)
        for f in range(FOLDS + 1):
            seen = [g for g in range(FOLDS) if g != f]
            n_f, pos_f, rows = n[:, seen].sum(1), pos[:, seen].sum(1), fold != f
            rate = y[rows, j].mean() if rows.any() else 0.0
            chi = (pos_f - n_f * rate) ** 2 / max(rate * (1 - rate), 1e-9) / np.maximum(n_f, 1)
            chi[n_f < MIN_ROWS] = 0
            best = np.argsort(-chi, kind="stable")[:FEATURES]
            out[j, f, best[chi[best] > 0]] = True
    return out


def learn(docs: DataFrame, labels: DataFrame, categories: dict[str, str], key: str = "doc_id",
          text: str = "text", rows: int = TRAIN_ROWS) -> list[Linear]:
    """Fit the chain on at most ``rows`` labels, each with at most ``KEY_TEXTS`` texts.

    ``categories``: name to a 0/1 SQL expression over ``labels``, in the order of the
    chain. Null keys, texts and labels are left out. Equal rows count once; a key with several
    labels or texts counts with each label and the ``KEY_TEXTS`` texts of the least
    hash. Words are counted in Spark; the driver
    gets the counts of words in MIN_ROWS rows or more, and the numbers of chosen words.
    """
    m, spark = len(categories), docs.sparkSession
    y_cols = [f"y{j}" for j in range(m)]
    pick = labels.select(F.col(key).alias("k"), *[F.expr(c).cast("int").alias(y) for c, y in zip(categories.values(), y_cols)])
    pick = pick.dropna().distinct().withColumn("h", F.xxhash64("k")).orderBy("h", "k", *y_cols).limit(rows)
    fold = F.pmod(F.floor(F.col("h") / 7), F.lit(FOLDS)).cast("int").alias("fold")
    chosen = F.broadcast(spark.createDataFrame([tuple(r) for r in pick.collect()], pick.schema))
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).dropna().join(chosen.select("k").distinct(), "k", "left_semi")
    # first which texts, by hashes alone, then these
    texts = texts.withColumn("o", F.xxhash64("t"))
    nth = F.row_number().over(Window.partitionBy("k").orderBy("o"))
    some = texts.groupBy("k", "o").agg(F.count("*").alias("c")).withColumn("n", nth).filter(F.col("n") <= KEY_TEXTS)
    some = written(some.select("k", "o", "c"), "sample")
    sample = texts.join(F.broadcast(some.select("k", "o")), ["k", "o"])
    if some.filter("c > 1").limit(1).count():  # texts are moved only where rows repeat
        sample = sample.dropDuplicates(["k", "o"])
    sample = sample.join(chosen, "k")
    found = append_columns(sample, [T.StructField("words", T.ArrayType(T.LongType()))], _word_arrays).drop("t")
    found = written(found.select("h", "k", "o", fold, *y_cols, "words"), "sample-words")
    counts = [F.sum((F.col("fold") == f).cast("int")).alias(f"n{f}") for f in range(FOLDS)]
    counts += [F.sum(F.when(F.col("fold") == f, F.col(y)).otherwise(0)).alias(f"p{j}_{f}") for j, y in enumerate(y_cols) for f in range(FOLDS)]
    stats = found.withColumn("w", F.explode("words")).groupBy("w").agg(F.count("*").alias("n"), *counts)
    stats = stats.filter(F.col("n") >= MIN_ROWS).toArrow().combine_chunks().sort_by("w")
    known = found.select("fold", *y_cols).toArrow()
    y_all = np.column_stack([known.column(y).to_numpy() for y in y_cols]).astype(float)
    usable = _usable(stats, known.column("fold").to_numpy(), y_all)
    kept = usable.any((0, 1))
    vocabulary = stats.column("w").to_numpy()[kept]
    payload = spark.sparkContext.broadcast(vocabulary.tobytes())

    def numbers():
        words = np.frombuffer(payload.value, np.int64)

        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            col = batch.column("words")
            h, size = col.flatten().to_numpy(), np.diff(np.asarray(col.offsets))
            at = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0))
            hit = words[at] == h if len(words) else np.zeros(len(h), bool)
            row = np.repeat(np.arange(len(size)), size)[hit]
            first = np.searchsorted(row, np.arange(len(size) + 1))
            return [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(at[hit], pa.int32()))]

        return each

    data = append_columns(found, [T.StructField("numbers", T.ArrayType(T.IntegerType()))], numbers).drop("words")
    data = data.toArrow().combine_chunks().sort_by([("h", "ascending"), ("k", "ascending"), ("o", "ascending"), *[(y, "ascending") for y in y_cols]])
    got = data.column("numbers").combine_chunks() if data.num_rows else pa.array([], pa.list_(pa.int32()))
    first = np.concatenate([[0], np.cumsum(np.diff(np.asarray(got.offsets)))]).astype(np.int64)
    y = np.column_stack([data.column(c).to_numpy() for c in y_cols]).astype(float)
    return fit_chain(Sample(vocabulary.view(np.uint64), got.flatten().to_numpy(zero_copy_only=False), first,
                            data.column("fold").to_numpy(), y, usable[:, :, kept]))


def _word_arrays():
    def each(batch: pa.RecordBatch) -> list[pa.Array]:
        h, first = word_sets(batch.column("t"))
        return [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(h.view(np.int64)))]

    return each


def score(docs: DataFrame, chain: list[Linear], names: list[str], text: str = "text") -> DataFrame:
    """``docs`` with a probability ``p_<name>`` for each category, over the whole text.

    A null or empty text has no words and gets the models' base rates; columns
    with these names are replaced.
    """
    payload = docs.sparkSession.sparkContext.broadcast(pickle.dumps(chain))

    def build():
        models = pickle.loads(payload.value)

        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            h, first = word_sets(batch.column(text))
            p = np.zeros((len(batch), 0))
            for m in models:
                p = np.column_stack([p, m.probability(h, first, p)])
            return [pa.array(p[:, j]) for j in range(len(models))]

        return each

    return append_columns(docs, [T.StructField(f"p_{n}", T.DoubleType()) for n in names], build)
