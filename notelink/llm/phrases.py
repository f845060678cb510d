"""Operator 11: phrase collocations by Toivonen's sampling algorithm.

A phrase is frequent when it occurs ``min_count`` times in a language, and then
so are all phrases inside it. So:

1. A *sample* of the documents proposes phrases, by a threshold below its share.
2. A *full pass* counts all words, and every longer phrase of which both phrases
   that are shorter by a word are proposed: these are the proposals and
   their negative border (the least phrases not proposed). The counts are exact.
3. A frequent phrase that was not proposed is a *failure of the border*: longer
   phrases that contain it were not counted. Failures join the proposals, and an expansion
   pass counts what that adds: phrases whose parts are proposed now, or are
   counted for the first time in the same pass. So it closes the border in one pass
   over the documents, whatever the length; without failures there is none.

Tasks look proposals up in bit arrays of a fixed size (``FILTER_BITS`` for each length),
the only thing that is broadcast. A phrase that seems proposed by chance is counted
too, which costs a little and changes nothing: counts decide. Phrases
are counted as text; hashes only choose what is counted in which pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelink.llm.common import LOWER, bounded_batches, fold, mix, slabs, squeeze, text_buffers, unsqueeze, word_hashes, written

# One document in so many is in the sample; phrases are proposed from this part of the count that
# a phrase at the threshold is expected to have there.
SAMPLE_ONE_IN, LOWERED = 4, 0.8
# Bits by which proposed phrases of one length are looked up (2^26 bits: 8 MB), and looks at each.
FILTER_BITS, LOOKS = 1 << 26, 2
# Words that a task gathers before it counts them, and rows of a batch it sends on.
FLUSH_WORDS, SEND_ROWS = 2_000_000, 200_000
# Candidates of one language that a task ranks at first.
RANKED = 500_000

_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?\n\x0b\x0c\r"]] = True
_SPLIT = _PIECE.copy()
_SPLIT[[9, 32]] = True
_COUNTED = "lang string, phrase string, size int, c long"


def _cut(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, the text of each, and whether the next word follows it in one piece."""
    word = ~_SPLIT[data]
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    edge = off[:-1][off[:-1] < len(data)]
    begin[edge] = word[edge]
    edge = off[1:][off[1:] > 0] - 1
    end[edge] = word[edge]
    a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
    row = np.searchsorted(off, a, "right") - 1
    piece = np.cumsum(_PIECE[data], dtype=np.int32)
    follows = np.zeros(len(a), bool)
    follows[:-1] = (row[1:] == row[:-1]) & (piece[a[1:]] == piece[b[:-1] - 1])
    return a, b, row, follows


def _lang_hash(langs: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x.encode()) for x in langs], np.uint64)


def _places(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The bits of a filter that stand for each hash: (looks, hashes)."""
    shift = np.uint64(64 - (64 * len(bits)).bit_length() + 1)
    return np.stack([(h if look == 0 else mix(h ^ np.uint64(look))) >> shift for look in range(LOOKS)])


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for at in _places(h, bits):
        out &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def _longer(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words that begin at each word (where there are as many)."""
    out = h[:max(0, len(h) - size + 1)]
    for j in range(1, size):
        out = fold(out, h[j:j + len(out)])
    return out


def _joined(follows: np.ndarray, size: int) -> np.ndarray:
    """Whether the run of ``size`` words that begins at each word lies in one piece."""
    n = max(0, len(follows) - size + 1)
    ok = np.ones(n, bool)
    for j in range(size - 1):
        ok &= follows[j:j + n]
    return ok


def _chosen(h: np.ndarray, follows: np.ndarray, sizes: list[int], now: dict | None, before: dict | None) -> Iterator[tuple[int, np.ndarray]]:
    """For each size, whether the phrase that begins at each word is counted in this pass.

    ``now`` has the proposals: without it all phrases are counted; without ``before`` all words, and phrases
    whose parts are proposed. ``before`` has the proposals of the pass before, whose phrases are left out.
    """
    new = None  # of the size before: counted for the first time now
    for s in sizes:
        ok = _joined(follows, s)
        if now is not None and s > 1 and len(ok):
            part = _longer(h, s - 1)
            could = _has(now[s - 1], part)
            if new is not None:
                could |= new
            ok &= could[:-1] & could[1:]
            if before is not None:
                was = _has(before[s - 1], part)
                ok &= ~(was[:-1] & was[1:])
                new = ok
        yield s, ok


def _distinct(word: np.ndarray, i: np.ndarray, size: int, known: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct runs of ``size`` words that begin at ``i``, as word numbers by place, and how often each occurs."""
    if known**size < 1 << 63:  # a run is one number
        key = word[i].copy()
        for j in range(1, size):
            key *= known
            key += word[i + j]
        key.sort()
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        one, n = key[edge], np.diff(np.concatenate([edge, [len(key)]]))
        places = []
        for _ in range(size):
            places.append(one % known)
            one = one // known
        return places[::-1], n
    key = word[i]
    for j in range(1, size):
        key = np.unique(key, return_inverse=True)[1].astype(np.int64) * known + word[i + j]
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return [word[i[first] + j] for j in range(size)], n


class _Gathered:
    """Words of a task since the last flush."""

    def __init__(self):
        self.parts, self.langs, self.n = [], {}, 0

    def add(self, data: np.ndarray, off: np.ndarray, lang: pa.Array) -> None:
        a, b, row, follows = _cut(data, off)
        if not len(a):
            return
        coded = lang.fill_null("und").dictionary_encode()
        names = coded.dictionary.to_pylist()
        code = np.array([self.langs.setdefault(x, len(self.langs)) for x in names], np.int32)[coded.indices.to_numpy(zero_copy_only=False)][row]
        h = mix(word_hashes(data, off, _SPLIT)[0] ^ _lang_hash(list(self.langs))[code])
        size = b - a
        at = np.concatenate([[0], np.cumsum(size)])
        # only the words themselves are held, without what is between them
        held = LOWER[data[~_SPLIT[data]]]
        self.parts.append((h, follows, code, size, held))
        assert len(held) == at[-1]
        self.n += len(a)

    def rows(self, sizes: list[int], now: dict | None, before: dict | None, total: bool) -> Iterator[pa.RecordBatch]:
        """Counts of the phrases that ``now`` chooses and ``before`` did not, and of all words of each language."""
        if not self.parts:
            return
        h, follows, code, size, held = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = []
        langs = pa.array(list(self.langs), pa.string())
        if total:
            yield from _sent(langs, pa.array([""] * len(langs)), 0, np.bincount(code, minlength=len(langs)))
        word, known = pd.factorize(h)
        word = word.astype(np.int64)
        first = np.empty(len(known), np.int64)
        first[word[::-1]] = np.arange(len(word) - 1, -1, -1)
        span = size[first]
        begin = (np.cumsum(size) - size)[first]
        at = np.concatenate([[0], np.cumsum(span)])
        take = np.repeat(begin - at[:-1], span) + np.arange(at[-1])
        text = pa.LargeStringArray.from_buffers(len(known), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(held[take])).cast(pa.string())
        lang_of = code[first]
        for s, ok in _chosen(h, follows, sizes, now, before):
            i = np.flatnonzero(ok)
            if not len(i):
                continue
            places, n = _distinct(word, i, s, len(known))
            for a in range(0, len(n), SEND_ROWS):
                ids = [x[a:a + SEND_ROWS] for x in places]
                words = [text.take(pa.array(x)) for x in ids]
                phrase = words[0] if s == 1 else pc.binary_join_element_wise(*words, " ")
                yield from _sent(langs.take(pa.array(lang_of[ids[0]])), phrase, s, n[a:a + SEND_ROWS])


def _sent(lang: pa.Array, phrase: pa.Array, size: int, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.full(len(n), size, np.int32)), pa.array(n.astype(np.int64))],
                                     names=["lang", "phrase", "size", "c"])


class Proposals:
    """Proposed phrases of each length, as bits; ``grow`` adds phrases and says whether any is new."""

    def __init__(self, lengths: list[int]):
        self.bits = {s: np.zeros(FILTER_BITS // 64, np.uint64) for s in lengths}

    def packed(self) -> dict[int, bytes]:
        return {s: squeeze(b) for s, b in self.bits.items()}

    def grow(self, phrases: DataFrame) -> tuple[Proposals, bool]:
        """With ``phrases`` (lang, phrase, size). At most ``FILTER_BITS / 64`` rows a length come to the driver."""
        old = phrases.sparkSession.sparkContext.broadcast(self.packed())

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = _unpacked(old.value)
            for batch in batches:
                if not batch.num_rows:
                    continue
                names = batch.column("lang").dictionary_encode()
                lang = _lang_hash(names.dictionary.to_pylist())[names.indices.to_numpy()]
                data, off = text_buffers(batch.column("phrase"))
                h, first = word_hashes(data, off, _SPACE)
                size = np.diff(first)
                for s in bits:
                    some = np.flatnonzero(size == s)
                    if not len(some):
                        continue
                    whole = mix(h[first[some]] ^ lang[some])
                    for j in range(1, s):
                        whole = fold(whole, mix(h[first[some] + j] ^ lang[some]))
                    at = _places(whole[~_has(bits[s], whole)], bits[s]).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), s, np.int32)), pa.array((at >> np.uint64(6)).astype(np.int32)),
                         pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["size", "at", "mask"])

        found = phrases.select("lang", "phrase").mapInArrow(places, "size int, at int, mask long")
        found = found.groupBy("size", "at").agg(F.bit_or("mask").alias("mask")).toArrow()
        out = Proposals(list(self.bits))
        for s in out.bits:
            own = found.filter(pc.field("size") == s)
            out.bits[s][:] = self.bits[s]
            out.bits[s][own.column("at").to_numpy()] |= own.column("mask").to_numpy().view(np.uint64)
        old.unpersist()
        return out, found.num_rows > 0


_SPACE = np.zeros(256, bool)
_SPACE[32] = True


def _unpacked(packed: dict[int, bytes]) -> dict[int, np.ndarray]:
    return {s: unsqueeze(b, np.uint64) for s, b in packed.items()}


def _counted(docs: DataFrame, sizes: list[int], now: Proposals | None, before: Proposals | None, total: bool) -> DataFrame:
    """(lang, phrase, size, c): counts by task of the phrases of these sizes that a pass chooses (see
    ``_chosen``). The empty phrase stands for all words."""
    spark = docs.sparkSession
    sent = [None if x is None else spark.sparkContext.broadcast(x.packed()) for x in (now, before)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, done = (None if x is None else _unpacked(x.value) for x in sent)
        got = _Gathered()
        for batch in batches:
            for part in slabs(batch):
                got.add(*text_buffers(part.column("text")), part.column("lang"))
                if got.n >= FLUSH_WORDS:
                    yield from got.rows(sizes, chosen, done, total)
                    got = _Gathered()
        yield from got.rows(sizes, chosen, done, total)

    return docs.select("text", "lang").mapInArrow(run, _COUNTED)


def frequent_phrases(docs: DataFrame, min_count: int, longest: int, sample_one_in: int = SAMPLE_ONE_IN) -> tuple[DataFrame, int]:
    """((lang, phrase, size, f) of every phrase of 1 to ``longest`` words with f of at least ``min_count``,
    and the number of all words under the empty phrase; passes over all documents)."""
    short = list(range(1, longest))
    part = docs.filter(F.pmod(F.xxhash64("key", "text"), F.lit(sample_one_in)) == 0)
    least = max(1, int(min_count * LOWERED / sample_one_in))
    now, _ = Proposals(short).grow(_summed(_counted(part, short, None, None, False)).filter(F.col("f") >= least))

    def counted(sizes: list[int], now: Proposals, before: Proposals | None) -> DataFrame:
        f = _summed(_counted(docs, sizes, now, before, before is None))
        return written(f.filter((F.col("f") >= min_count) | (F.col("size") == 0)), "phrase-counts")

    found = counted(list(range(1, longest + 1)), now, None)
    grown, failed = now.grow(found.filter(F.col("size").between(1, longest - 1)))
    if not failed:
        return found, 1
    return found.unionByName(counted(list(range(2, longest + 1)), grown, now)), 2


def _summed(counts: DataFrame) -> DataFrame:
    """Counts over all tasks. Tasks have summed their own rows, so these are dealt out before Spark sums anything."""
    keys = ["lang", "phrase", "size"]
    return counts.repartition(*keys).groupBy(*keys).agg(F.sum("c").alias("f"))


def mine_phrases(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", min_count: int = 10, longest: int = 3,
                 top: int = 2000, inside: int = 50, sample_one_in: int = SAMPLE_ONE_IN) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``longest`` words: (lang, rank, phrase, a, l, r, n, score, k).

    Texts, A-Z lower-cased, are split at ``.,;:!?`` and line ends into pieces, and these at
    blanks and tabs into words. ``a`` counts a phrase's occurrences inside pieces (overlapping ones
    too), ``n`` the language's words. A phrase with ``a >= min_count`` is cut in two
    where ``floor(1000000 * a * a / (l * r))`` is least (``l``, ``r``: counts of its first ``k`` words and
    of its rest; ties to the smaller k): its score. A phrase that lies in a longer frequent one
    of at least ``inside`` percent of its count is left out. Order: score, a (both descending), phrase
    (by bytes). Null texts are empty, a null language is ``und``; repeated rows count each;
    ``key`` only chooses the sample, and other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    found, _ = frequent_phrases(rows, min_count, longest, sample_one_in)
    words = F.split("phrase", " ")

    def part(first, count):
        return F.array_join(F.slice(words, first, count), " ")

    cand = found.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    # the scores of all cuts, the least one
    ways = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(
        k.alias("k"), part(F.lit(1), k).alias("left"), part(k + 1, F.col("size") - k).alias("right")))
    cuts = cand.select("lang", "phrase", "size", "a", F.explode(ways).alias("w")).select("lang", "phrase", "size", "a", "w.*")
    parts = found.filter(f"size BETWEEN 1 AND {longest - 1}")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("(CAST(1000000 AS DECIMAL(38,0)) * a * a) DIV (CAST(l AS DECIMAL(20,0)) * r)")
    scored = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    scored = scored.select("lang", "phrase", "size", "a", "cut.*")
    # phrases inside longer ones
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda s: F.transform(
        F.sequence(F.lit(1), F.col("size") - s + 1), lambda i: part(i, s))))
    longer = cand.filter("size > 2").select("lang", F.col("a").alias("b"), F.explode(inner).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("b").isNull() | (100 * F.col("b") < inside * F.col("a")))
    # the best of each language: first of its parts, then of these
    kept = written(kept.drop("b"), "phrases")
    spread = max(64, -(-kept.count() // RANKED))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(spread)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    n = found.filter("size = 0").select("lang", F.col("f").alias("n"))
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "k")
