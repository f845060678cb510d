"""Operator 10: language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded, labelled sample is built. A
text is cut greedily into the longest stretches that occur in the sample; the
language that needs the fewest phrases, each weighted with the bits of a
pointer into its sample (log2 of the sample's length), wins.

Texts are read as symbols: letters in lower case, and one blank for each run of
anything else. Whole texts are parsed. So that array operations can walk all parts of
a batch side by side, texts are cut into blocks of ``BLOCK`` symbols, each of which is first
parsed as if a phrase began there. Then the phrase that really runs over a block's
edge is followed on, until both parses are in the same state: from there on they are the
same. The result is the parse of the whole text.
"""

from __future__ import annotations

import hashlib
import pickle
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from notelink.llm.common import append_columns, written

# The sample that is learned from: at most so many languages (those of most documents), documents of a
# language, characters of each, and symbols of a language and of all languages together.
SAMPLE_LANGS, SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_SYMBOLS, ALL_SYMBOLS = 256, 64, 2048, 32_768, 1 << 19
PIECES = 16  # of a text longer than that, from all over it
BLOCK = 512
LETTERS = 94  # the commonest letters of the samples have columns in a table, the others are looked up

UNKNOWN = "und"
_LOWER: np.ndarray | None = None


def lower_letters() -> np.ndarray:
    """For each code point: 0 unless it is a letter, else its lower case (itself, if that is longer)."""
    global _LOWER
    if _LOWER is None:
        t = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if unicodedata.category(ch := chr(c))[0] == "L":
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _LOWER = t
    return _LOWER


def letters_of(text: str) -> np.ndarray:
    """Lower-case letters with 0 for each run of other characters, none at the ends."""
    x = lower_letters()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    keep = x != 0
    keep[1:] |= x[:-1] != 0
    x = x[keep]
    return x[:-1] if len(x) and x[-1] == 0 else x


def transitions(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence, by state."""
    link, size, to = [-1], [0], [{}]
    last = 0
    for c in symbols:
        cur = len(to)
        to.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = cur
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                copy = len(to)
                to.append(dict(to[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return to


def _flat(to: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State, symbol and next state of all transitions."""
    state = np.repeat(np.arange(len(to)), [len(x) for x in to])
    symbol = np.fromiter((c for x in to for c in x), np.int64, len(state))
    return state, symbol, np.fromiter((n for x in to for n in x.values()), np.int64, len(state))


def suffix_automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transitions of the suffix automaton of a sequence: (states, width), -1 where there is none."""
    to = transitions(symbols)
    state, symbol, nxt = _flat(to)
    out = np.full((len(to), width), -1, np.int32)
    out[state, symbol] = nxt
    return out


def evenly(parts: list[np.ndarray], total: int) -> list[np.ndarray]:
    """The parts cut to one size, the largest with which all together have at most ``total`` items."""
    size = np.sort([len(p) for p in parts])
    rest = total - np.concatenate([[0], np.cumsum(size)[:-1]])  # for the parts from each on, if those before stay whole
    each = rest // np.arange(len(size), 0, -1)
    over = np.flatnonzero(each < size)
    cut = max(0, int(each[over[0]])) if len(over) else None
    return [p[:cut] for p in parts]


class Parser:
    """Automata of all languages side by side: a table for the commonest letters, sorted
    (state, symbol) pairs for the others. Only letters that no sample has share a symbol."""

    def __init__(self, samples: dict[str, list[str]]):
        own = {}
        share = min(SAMPLE_SYMBOLS, ALL_SYMBOLS // max(1, len(samples)))
        for lang in sorted(samples):
            parts = [letters_of(t) for t in samples[lang]]
            parts = [np.concatenate([p, [0]]) for p in parts if len(p)]
            if parts:
                own[lang] = np.concatenate(evenly(parts, share)).astype(np.int64)
        self.langs = sorted(own)
        seen, count = np.unique(np.concatenate([*own.values(), [0]]), return_counts=True)
        letters = seen[seen > 0][np.argsort(-count[seen > 0], kind="stable")]
        letters = np.concatenate([np.sort(letters[:LETTERS]), letters[LETTERS:]])
        self.width = min(len(letters), LETTERS) + 1  # columns: blanks and the commonest letters
        self.other = len(letters) + 1
        self.symbol = np.full(0x110000, self.other, np.min_scalar_type(self.other))
        self.symbol[0] = 0
        self.symbol[letters] = np.arange(1, len(letters) + 1)
        tables, keys, values, base, self.root = [], [], [], 0, []
        for lang in self.langs:
            to = transitions(self.symbol[own[lang]].tolist())
            state, symbol, nxt = _flat(to)
            table, dense = np.full((len(to), self.width), -1, np.int32), symbol < self.width
            table[state[dense], symbol[dense]] = nxt[dense] + base
            key = (state[~dense] + base) * (self.other + 1) + symbol[~dense]
            order = np.argsort(key)  # states of later languages are greater: all stay sorted
            tables.append(table)
            keys.append(key[order])
            values.append((nxt[~dense] + base)[order])
            self.root.append(base)
            base += len(to)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.keys = np.concatenate([*keys, np.zeros(0, np.int64)])
        self.values = np.concatenate([*values, np.zeros(0, np.int64)]).astype(np.int32)
        self.bits = np.array([np.log2(len(own[x]) + 1) for x in self.langs])

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next states, -1 where there is none; ``symbol`` goes along the last axis of ``state``."""
        symbol = np.broadcast_to(symbol, state.shape)
        nxt = np.where(symbol < self.width, self.table[state * self.width + np.minimum(symbol, self.width - 1)], -1)
        rare = symbol >= self.width
        if len(self.keys) and rare.any():
            key = state[rare].astype(np.int64) * (self.other + 1) + symbol[rare]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            nxt[rare] = np.where(self.keys[at] == key, self.values[at], -1)
        return nxt

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases that each text needs in each language: (texts, languages)."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        size = np.array([len(t) for t in texts], np.int64)
        if not len(self.langs) or not size.sum():
            return out
        flat = self.symbol[np.concatenate(texts)]
        blocks = -(-size // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = (np.cumsum(size) - size)[owner] + nth * BLOCK
        length = np.minimum(size[owner] - nth * BLOCK, BLOCK)
        order = np.argsort(-length, kind="stable")
        begin, length, owner = begin[order], length[order], owner[order]
        before = np.argsort(order, kind="stable")  # where each block went
        prev = np.where(nth[order] > 0, before[np.maximum(order - 1, 0)], -1)
        root = np.array(self.root, np.int32)
        state = np.repeat(root[:, None], len(owner), axis=1)
        count = np.zeros(state.shape, np.int32)
        active = np.searchsorted(-length, -np.arange(BLOCK), "left")  # blocks longer than each step
        for step in range(int(length[0])):
            k = active[step]
            state[:, :k], miss = self.advance(state[:, :k], flat[begin[:k] + step], root[:, None])
            count[:, :k] += miss
        self._rejoin(flat, begin, length, prev, root, state, count)
        for j in range(len(self.langs)):
            out[:, j] = np.bincount(owner, weights=count[j], minlength=len(texts)).astype(np.int64)
        return out + (size > 0)[:, None]

    def advance(self, state: np.ndarray, symbol: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase began. A symbol that the language doesn't have is a phrase by itself."""
        c, root = np.broadcast_to(symbol.astype(np.int32), state.shape), np.broadcast_to(root, state.shape)
        nxt = self.step(state, c)
        miss = nxt < 0
        if miss.any():
            again = self.step(root[miss], c[miss])
            nxt[miss] = np.where(again < 0, root[miss], again)
        return nxt, miss

    def _rejoin(self, flat, begin, length, prev, root, state, count) -> None:
        """Correct ``count`` (and the last states) of blocks that a phrase runs into; ``prev`` is the block before, or -1."""
        alone, alone_count = state.copy(), count.copy()
        after = np.full(len(prev), -1)
        after[prev[prev >= 0]] = np.flatnonzero(prev >= 0)
        block, lang = (x.ravel() for x in np.meshgrid(np.flatnonzero(prev >= 0), np.arange(len(root)), indexing="ij"))
        while len(block):
            true, new = state[lang, prev[block]], root[lang]
            more, end = np.zeros(len(block), np.int32), np.full(len(block), -1, np.int64)
            open_, step = np.arange(len(block)), 0
            while len(open_):
                met, over = true == new, step >= length[block[open_]]
                end[open_[over & ~met]] = true[over & ~met]
                go = ~met & ~over
                open_, true, new = open_[go], true[go], new[go]
                if not len(open_):
                    break
                c, r = flat[begin[block[open_]] + step], root[lang[open_]]
                true, a = self.advance(true, c, r)
                new, b = self.advance(new, c, r)
                more[open_] += a.astype(np.int32) - b
                step += 1
            count[lang, block] = alone_count[lang, block] + more
            last = np.where(end >= 0, end, alone[lang, block]).astype(state.dtype)
            changed = (last != state[lang, block]) & (after[block] >= 0)
            state[lang, block] = last
            # only where another state goes on than was thought does the next block change
            block, lang = after[block[changed]], lang[changed]


_BUILT: dict[str, Parser] = {}


def _parser(payload: bytes) -> Parser:
    """One parser per worker, kept by its content."""
    key = hashlib.sha256(payload).hexdigest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Parser(pickle.loads(payload))
    return _BUILT[key]


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, list[str]]:
    """The labelled sample, by language: of each language the ``SAMPLE_DOCS`` documents with
    the smallest hash of their key, ``SAMPLE_CHARS`` characters of each. Of a longer text these are
    ``PIECES`` pieces, one from each equal part of it at a place by hash, in the order of a hash.

    Equal rows count once; rows with one key and several texts or labels are documents of
    their own. Of more than ``SAMPLE_LANGS`` labels those of most documents are learned (ties by
    name), so at most ``SAMPLE_LANGS * SAMPLE_DOCS`` texts come to the driver. The ranking moves keys,
    hashes and labels alone and keeps that many rows per task;
    null keys and labels and texts without a letter are left out.
    """
    docs = docs.select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("t"))
    docs = docs.filter(F.col("k").isNotNull() & F.col("lang").isNotNull() & F.col("t").rlike(r"\p{L}"))
    docs = docs.withColumn("o", F.xxhash64("t"))
    most = docs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE_LANGS).select("lang")
    rank = Window.partitionBy("lang").orderBy("h", "k", "o")
    keys = docs.select("k", "lang", "o", F.xxhash64("k").alias("h")).distinct().join(F.broadcast(most), "lang", "left_semi")
    keys = keys.withColumn("rn", F.row_number().over(rank)).filter(F.col("rn") <= SAMPLE_DOCS).select("k", "lang", "o")
    chosen = F.broadcast(written(keys, "sample"))
    size, each = F.char_length("t"), SAMPLE_CHARS // PIECES

    def piece(i: Column) -> Column:
        part = F.floor(size / PIECES)
        at = i * part + F.pmod(F.xxhash64("k", i), part - each + 1)
        return F.struct(F.xxhash64("k", i, F.lit(1)).alias("h"), F.substring("t", (at + 1).cast("int"), F.lit(each)).alias("t"))

    pieces = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), piece))
    some = F.when(size <= SAMPLE_CHARS, F.col("t")).otherwise(F.array_join(F.transform(pieces, lambda x: x["t"]), " "))
    rows = docs.join(chosen, ["k", "lang", "o"]).select("k", "lang", "o", some.alias("t")).dropDuplicates(["k", "lang", "o"]).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, str(r.k), r.t)):
        out.setdefault(r.lang, []).append(r.t)
    return out


def predict(docs: DataFrame, samples: dict[str, list[str]], text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``phrases`` (by language, over the whole text).

    Null texts and texts without a letter are ``und`` with score 0, as is every
    text if nothing was learned. The score is the second-best cost's share of
    the two best costs (0.5: a tie, which the first language by name wins; 1:
    only one language is known). Columns with these names are replaced.
    """
    payload = docs.sparkSession.sparkContext.broadcast(pickle.dumps(samples))

    def build():
        parser = _parser(payload.value)

        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            read = [letters_of(t) if t else np.zeros(0, np.uint32) for t in batch.column(text).to_pylist()]
            count = parser.phrases(read)
            pred, score, phrases = [], [], []
            for x, n in zip(read, count):
                if not len(x) or not parser.langs:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    phrases.append([])
                    continue
                cost = n * parser.bits
                best = int(np.argmin(cost))
                rest = np.delete(cost, best)
                pred.append(parser.langs[best])
                score.append(float(rest.min() / (rest.min() + cost[best])) if len(rest) else 1.0)
                phrases.append(list(zip(parser.langs, n.tolist())))
            return [pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                    pa.array(phrases, pa.map_(pa.string(), pa.int64()))]

        return each

    return append_columns(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                                 T.StructField("phrases", T.MapType(T.StringType(), T.LongType()))], build)


def fold_of(key: str, n: int) -> Column:
    return F.crc32(F.col(key).cast("string")) % n
