"""Operator 3: scoring with an interpolated modified Kneser-Ney model of any order from two.

*Counting.* Tasks count the n-grams of the top order in their documents and send
them, by ranges of the n-gram hash, to tasks that add them up and store each range
in the shared folder, after which Spark removes what was sent. Ranges know each
n-gram once, and pass on what it adds to the order below: one to the continuation
count of its suffix, and its own count to the context that it begins. That order's
ranges add these up and do the same, down to single words. N-grams that begin a
text have nothing before them and keep their counts at every order. No count
is cut off and nothing is pruned.

*Storing.* Each range becomes one file of sorted hashes and counts in the shared
folder, written by Spark's writer. A hash is kept as its place in
a bucket table and 32 more bits; as files grow in number with the corpus, not in
size, a wrong hit stays as unlikely (some 10^-8) at any size.

*Scoring.* Workers map the files into memory and look up the n-grams of each text
with binary searches over whole arrays. Where the shared folder is not a file
system path, Spark first brings the files to the executors.
"""

from __future__ import annotations

import os
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelink.llm.common import (append_columns, bounded_batches, fold, mix, shard_of, shared_path, shuffles_removed, slabs, squeeze, text_buffers, unsqueeze,
                                 word_hashes, written)

# Bigrams that a task counts before it sends them, and text per file of the model (at higher
# orders fewer, as each n-gram is longer).
FLUSH, SHARD_BYTES, WORD_SHARE = 3_750_000, 32 * 1024 * 1024, 4
# The byte of fields that a file lists apart.
LISTED = 255
# The end of a text; the context of its first token; what stands before that to fill an n-gram up.
END, BEGIN, PAD = mix(np.array([0x454E44, 0x424547, 0x504144], np.uint64))


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and one end, and where each text's begin."""
    w, first = word_hashes(*text_buffers(col))
    n = len(first) - 1
    out = np.empty(len(w) + n, np.uint64)
    at = first + np.arange(n + 1)
    ends = at[1:] - 1
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word] = w
    out[ends] = END
    return out, at


def grams(tok: np.ndarray, at: np.ndarray, order: int, pad: int = PAD, begin: int = BEGIN) -> list[np.ndarray]:
    """The n-gram that ends at each token, oldest word first."""
    out = [tok]
    nth = np.arange(len(tok)) - np.repeat(at[:-1], np.diff(at))
    for j in range(1, order):
        before = np.full_like(tok, pad)
        before[nth == j - 1] = begin
        inside = np.flatnonzero(nth >= j)
        before[inside] = tok[inside - j]
        out.insert(0, before)
    return out


def gram_hash(words: list[np.ndarray]) -> np.ndarray:
    h = words[0]
    for w in words[1:]:
        h = fold(h, w)
    return h


# --- files of sorted hashes --------------------------------------------------

def _place(h: np.ndarray, n_files: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket within the file, and the 32 bits that are kept."""
    inside = ((h >> np.uint64(32)) * np.uint64(n_files)) & np.uint64(0xFFFFFFFF)
    return (inside >> np.uint64(32 - bits)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _padded(x: np.ndarray) -> bytes:
    raw = x.tobytes()
    return raw + bytes(-len(raw) % 8)


def file_bytes(h: np.ndarray, fields: list[np.ndarray], n_files: int) -> bytes:
    """A file: sizes, where buckets begin, sorted hashes, one byte for each hash's fields, then the fields that
    these bytes stand for; fields that are too rare for a byte (``LISTED``) are in a list of their own."""
    bits = max(0, int(len(h) // 16).bit_length())
    bucket, rest = _place(h, n_files, bits)
    order = np.lexsort((rest, bucket))
    begin = np.searchsorted(bucket[order], np.arange((1 << bits) + 1)).astype(np.uint32)
    values = np.array([f[order] for f in fields], np.int64)
    wide = 64 // len(fields)
    small = np.flatnonzero((values < 1 << min(wide, 62)).all(axis=0))  # all fields as one number
    joined = np.zeros(len(small), np.uint64)
    for k, f in enumerate(values):
        joined |= f[small].astype(np.uint64) << np.uint64(k * wide)
    _, at, number, times = np.unique(joined, return_index=True, return_inverse=True, return_counts=True)
    often = np.argsort(-times, kind="stable")[:LISTED]
    code = np.full(len(at), LISTED, np.uint8)
    code[often] = np.arange(len(often))
    byte = np.full(len(h), LISTED, np.uint8)
    byte[small] = code[number]
    listed = np.flatnonzero(byte == LISTED)
    kind = np.uint32 if values[:, listed].max(initial=0) < 1 << 32 else np.int64
    head = np.array([len(h), bits, len(fields), len(often), len(listed), np.dtype(kind).itemsize], np.int64)
    return b"".join([head.tobytes(), _padded(begin), _padded(rest[order]), _padded(byte), _padded(values[:, small[at[often]]]),
                     _padded(listed.astype(np.uint32)), _padded(values[:, listed].astype(kind))])


class HashFile:
    """One file, mapped into memory."""

    def __init__(self, buf: np.ndarray, n_files: int):
        self.n_files = n_files
        n, self.bits, k, often, listed, wide = (int(x) for x in buf[:48].view(np.int64))
        self.n, at = n, 48

        def part(count: int, kind) -> np.ndarray:
            nonlocal at
            size = count * np.dtype(kind).itemsize
            x = buf[at:at + size].view(kind)
            at += size + -size % 8
            return x

        self.begin, self.hash, self.byte = part((1 << self.bits) + 1, np.uint32), part(n, np.uint32), part(n, np.uint8)
        self.book = np.zeros((k, LISTED + 1), np.int64)
        self.book[:, :often] = part(k * often, np.int64).reshape(k, often)
        self.listed = part(listed, np.uint32)
        self.rare = part(k * listed, np.uint32 if wide == 4 else np.int64).reshape(k, listed)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        bucket, want = _place(h, self.n_files, self.bits)
        low, end = self.begin[bucket].astype(np.int64), self.begin[bucket + 1].astype(np.int64)
        high = end.copy()
        for _ in range(int((end - low).max(initial=0)).bit_length()):
            mid = (low + high) >> 1
            less = (low < high) & (self.hash[np.minimum(mid, max(self.n - 1, 0))] < want)
            high = np.where((low < high) & ~less, mid, high)
            low = np.where(less, mid + 1, low)
        hit = low < end
        hit[hit] = self.hash[low[hit]] == want[hit]
        return np.where(hit, low, -1)

    def values(self, row: np.ndarray, n_fields: int) -> np.ndarray:
        """The first fields of each row: (fields, rows); 0 for row -1."""
        out = np.zeros((n_fields, len(row)), np.int64)
        ok = np.flatnonzero(row >= 0)
        byte = self.byte[row[ok]]
        out[:, ok] = self.book[:n_fields, byte]
        rare = ok[byte == LISTED]
        out[:, rare] = self.rare[:n_fields, np.searchsorted(self.listed, row[rare])]
        return out


class HashTable:
    """All files of a table; a file is mapped when it is first needed."""

    def __init__(self, root: str, n_files: int):
        self.root, self.n_files, self.files = root, n_files, {}

    def file(self, s: int) -> HashFile | None:
        if s not in self.files:
            d = os.path.join(self.root, f"file={s}")
            names = [x for x in os.listdir(d) if x.startswith("part-")] if os.path.isdir(d) else []
            self.files[s] = HashFile(np.memmap(os.path.join(d, names[0]), np.uint8, "r"), self.n_files) if names else None
        return self.files[s]

    def lookup(self, h: np.ndarray, n_fields: int) -> np.ndarray:
        """The fields of each hash, 0 if it isn't there: (fields, hashes)."""
        out = np.zeros((n_fields, len(h)), np.int64)
        shard = shard_of(h, self.n_files).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        which, at = np.unique(shard[order], return_index=True)
        for s, a, b in zip(which.tolist(), at, [*at[1:], len(h)]):
            f = self.file(s)
            if f is not None:
                out[:, order[a:b]] = f.values(f.find(h[order[a:b]]), n_fields)
        return out


# --- counting ----------------------------------------------------------------

# Rows that are sent: to a range, what n-grams are as suffixes (0) or as contexts (1), packed.
_SENT = "shard int, kind int, data binary"
# Of an n-gram as a suffix: how often it occurs, and its count at its order (of continuations, below
# the top). As a context: the sum of the counts that it begins, and how many are one, two, more.
AS_SUFFIX, AS_CONTEXT = 2, 4
# Sums of a file: counts of one to four; tokens, distinct tokens, sum of counts.
N_SUMS = 7


def _by_frequency(vocab: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted words, those of about equal frequency together and the common ones first, and the numbers that they get."""
    order = np.lexsort((vocab, -np.frexp(np.bincount(numbers.ravel(), minlength=len(vocab)))[1]))
    place = np.empty(len(vocab), np.int32)
    place[order] = np.arange(len(vocab), dtype=np.int32)
    return vocab[order], place[numbers]


def _added(numbers: np.ndarray, fields: list[np.ndarray], n_vocab: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Equal n-grams added up, in the order of their words' numbers."""
    bits = max(1, n_vocab.bit_length())
    if bits * len(numbers) <= 64:
        key = numbers[0].astype(np.uint64)
        for x in numbers[1:]:
            key = key << np.uint64(bits) | x.astype(np.uint64)
        order = np.argsort(key)
        del key
    else:
        order = np.lexsort(numbers[::-1])
    numbers = numbers[:, order]
    begin = np.flatnonzero(np.concatenate([[True], (numbers[:, 1:] != numbers[:, :-1]).any(axis=0)]))
    return numbers[:, begin], [np.add.reduceat(f[order], begin, dtype=np.int64) for f in fields]


def _packed(vocab: np.ndarray, numbers: np.ndarray, fields: list[np.ndarray]) -> bytes:
    """N-grams in the order of their words' numbers, which leaves little to store: the first hardly grow, and
    those of common words are small."""
    used, own = np.unique(numbers, return_inverse=True)
    own = own.astype(np.int32).reshape(len(numbers), -1)
    return pickle.dumps([squeeze(vocab[used], True), [squeeze(x, not k) for k, x in enumerate(own)], [squeeze(f) for f in fields]])


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    vocab, numbers, fields = pickle.loads(data)
    return (unsqueeze(vocab, np.uint64, True), np.array([unsqueeze(x, np.int32, not k) for k, x in enumerate(numbers)]),
            [unsqueeze(f, np.int64) for f in fields])


def _row(shard: int, kind: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([kind], pa.int32()), pa.array([data], pa.binary())],
                                      names=["shard", "kind", "data"])


def _sends(kind: int, vocab: np.ndarray, numbers: np.ndarray, fields: list[np.ndarray], n_files: int) -> Iterator[pa.RecordBatch]:
    """N-grams added up and cut by ranges of their hash."""
    numbers, fields = _added(numbers, fields, len(vocab))
    shard = shard_of(gram_hash([vocab[x] for x in numbers]), n_files)
    by = np.argsort(shard.astype(np.min_scalar_type(n_files)), kind="stable")
    cut = np.searchsorted(shard[by], np.arange(n_files + 1))
    for s, (p, q) in enumerate(zip(cut, cut[1:])):
        if q > p:
            yield _row(s, kind, _packed(vocab, numbers[:, by[p:q]], [f[by[p:q]] for f in fields]))


def _count(docs: DataFrame, order: int, n_files: int) -> DataFrame:
    """Counts of top-order n-grams in parts of the corpus."""
    most = max(1, 2 * FLUSH // order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for part in slabs(batch):
                held.append(tokens(part.column("text")))
                total += len(held[-1][0])
                if total >= most:
                    yield from flush(held)
                    held, total = [], 0
        if held:
            yield from flush(held)

    def flush(held) -> Iterator[pa.RecordBatch]:
        first = np.cumsum([0, *[len(tok) for tok, _ in held]])
        at = np.concatenate([[0], *[at[1:] + a for (_, at), a in zip(held, first)]])
        vocab, number = np.unique(np.concatenate([*[tok for tok, _ in held], [PAD, BEGIN]]), return_inverse=True)
        held.clear()
        vocab, number = _by_frequency(vocab, number)
        own = np.array(grams(number[:-2], at, order, *number[-2:]))
        yield from _sends(0, vocab, own, [np.ones(own.shape[1], np.int32)], n_files)

    return docs.mapInArrow(run, _SENT).repartitionById(n_files, "shard")


def _ranges(sent: DataFrame, n_fields: int) -> DataFrame:
    """Each range's n-grams added up: one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, shard = [], None
        for batch in batches:
            for r in batch.to_pylist():
                shard = r["shard"]
                vocab, numbers, fields = _unpacked(r["data"])
                fields = [f.astype(np.int32) if f.max() < 1 << 31 else f for f in fields]
                other = [np.zeros(numbers.shape[1], np.int32)] * (n_fields - len(fields))
                parts.append((vocab, numbers, [*other, *fields] if r["kind"] else [*fields, *other]))
        if shard is None:
            return
        vocab, number = np.unique(np.concatenate([v for v, _, _ in parts]), return_inverse=True)
        first = np.cumsum([0, *[len(v) for v, _, _ in parts]])
        numbers = np.concatenate([number[a:][n] for (_, n, _), a in zip(parts, first)], axis=1)
        fields = [np.concatenate(f) for f in zip(*[f for _, _, f in parts])]
        parts.clear()
        vocab, numbers = _by_frequency(vocab, numbers)
        yield _row(shard, 0, _packed(vocab, *_added(numbers, fields, len(vocab))))

    return sent.mapInArrow(run, _SENT)


def _lower(ranges: DataFrame, n_files: int) -> DataFrame:
    """What the n-grams of one order add to those of the order below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                vocab, numbers, fields = _unpacked(data.as_py())
                times, count = fields[0], fields[min(1, len(fields) - 1)]
                del fields
                real = vocab[numbers[0]] != PAD
                yield from _sends(0, vocab, numbers[1:], [times, np.where(real, 1, count)], n_files)
                numbers, n = numbers[:-1, real], count[real]
                if len(n):
                    yield from _sends(1, vocab, numbers, [n, *[x.astype(np.int64) for x in (n == 1, n == 2, n > 2)]], n_files)

    return ranges.mapInArrow(run, _SENT).repartitionById(n_files, "shard")


# Fields in files of words: occurrences, continuation count, and as a context; in files between words and the
# top order all but the first, in those of the top order the count alone.
WORD_FIELDS = AS_SUFFIX + AS_CONTEXT
_BLOB = "kind string, file int, data binary"


def _file(ranges: DataFrame, level: int, order: int, n_files: int) -> DataFrame:
    """Each range's file, and its sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("data")):
                vocab, numbers, fields = _unpacked(data.as_py())
                real = vocab[numbers[0]] != PAD
                h, fields = gram_hash([vocab[x[real]] for x in numbers]), [f[real] for f in fields]
                times, count = fields[0], fields[min(1, len(fields) - 1)]
                yield blob(f"g{level}", shard, file_bytes(h, fields[level != 1 and level != order:], n_files))
                sums = [level, *[(count == k).sum() for k in (1, 2, 3, 4)], times.sum(), (times > 0).sum(), count.sum()]
                yield blob("sums", level << 24 | shard, np.array(sums, np.int64).tobytes())

    return ranges.mapInArrow(run, _BLOB)


def blob(kind: str, file: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([file], pa.int32()), pa.array([data], pa.binary())], names=["kind", "file", "data"])


def _as_files(blobs: DataFrame, path: str) -> None:
    """One file per row, by Spark's writer (its bytes, then a line end): it commits whole files only,
    also when a task is run again."""
    blobs.select("kind", "file", F.col("data").cast("string").alias("value")).write.partitionBy("kind", "file").text(path)


@dataclass
class Model:
    """A trained model: where its files are, and its totals."""

    path: str
    order: int
    n_grams: int  # files of each order from two
    n_words: int
    tokens: int
    distinct: int
    types: int
    discounts: list[list[float]]  # of each order from one
    rest: float  # what the lowest order's discounts leave for the uniform distribution


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more, from how many
    n-grams occur one to four times; where these are too few to tell, half the count."""
    out = []
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else k / 2
        out.append(float(min(max(d, 0.0), k)))
    return out


def train(docs: DataFrame, text: str = "text", order: int = 2) -> Model:
    """Count the corpus and store the model of n-grams up to ``order`` in a new folder of the
    shared ``spark.checkpoint.dir``.

    Every row is a text; null is empty (its end is still a token). An empty table
    gives a model that knows no token.
    """
    if order < 2:
        raise ValueError("the order is two or more")
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_files = max(1, -(-size * order // (2 * SHARD_BYTES)))
    n_words = max(1, n_files // WORD_SHARE)
    path = shared_path(spark, "ngrams")
    if docs.isEmpty():
        return Model(path, order, n_files, n_words, 0, 0, 0, [discounts([0] * 4)] * order, 1.0)
    # An order's ranges are stored before the order below is counted from them: what was sent for them can go then.
    with shuffles_removed(spark):
        sent, blobs = _count(docs, order, n_files), None
        for level in range(order, 0, -1):
            ranges = written(_ranges(sent, AS_SUFFIX + AS_CONTEXT if level < order else 1), f"ngrams-{level}", "uncompressed")
            files = _file(ranges, level, order, n_files if level > 1 else n_words)
            blobs = files if blobs is None else blobs.unionByName(files)
            if level > 1:
                sent = _lower(ranges, n_files if level > 2 else n_words)
    _as_files(blobs, path)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(x, np.int64, 1 + N_SUMS) for x in batch.column("content").to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.array(rows).T], names=["level", *names])

    names = [f"s{j}" for j in range(N_SUMS)]
    heads = spark.read.format("binaryFile").load(f"{path}/kind=sums").select("content")
    heads = heads.mapInArrow(add, ", ".join(f"{n} long" for n in ["level", *names]))
    s = {r.level: [int(r[n]) for n in names] for r in heads.groupBy("level").agg(*[F.sum(n).alias(n) for n in names]).collect()}
    d = [discounts(s[k][:4]) if k in s else discounts([0] * 4) for k in range(1, order + 1)]
    once, twice, _, _, n, distinct, types = s[1]
    rest = (d[0][0] * once + d[0][1] * twice + d[0][2] * (distinct - once - twice)) / types
    return Model(path, order, n_files, n_words, n, distinct, types, d, rest)


# --- scoring -----------------------------------------------------------------

def _local(spark, path: str) -> tuple[str, bool]:
    """The model's folder as the workers see it, and whether Spark has to bring it to them."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return url.path, False
    spark.sparkContext.addFile(path, recursive=True)
    return os.path.basename(path.rstrip("/")), True


class Scorer:
    def __init__(self, model: Model, root: str):
        self.m = model
        self.tables = [HashTable(os.path.join(root, f"kind=g{k}"), model.n_grams if k > 1 else model.n_words) for k in range(1, model.order + 1)]

    def score(self, tok: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: known tokens, base score, model score (log10)."""
        m = self.m
        own = grams(tok, at, m.order)
        words, number = np.unique(np.concatenate(own[-2:]), return_inverse=True)
        count, after, *context = self.tables[0].lookup(words, WORD_FIELDS)
        left, right = number[:len(tok)], number[len(tok):]
        base = np.log10((count + 1) / (m.tokens + m.distinct + 1))
        lower = (after - np.choose(np.minimum(after, 3), [0.0, *m.discounts[0]])) / max(m.types, 1) + m.rest / (m.distinct + 1)
        p, context = lower[right], [x[left] for x in context]
        for level in range(2, m.order + 1):
            d = m.discounts[level - 1]
            before = gram_hash(own[m.order - level:-1])
            if level > 2:
                context = self.tables[level - 2].lookup(before, 1 + AS_CONTEXT)[1:]
            n = self.tables[level - 1].lookup(fold(before, tok), 1)[0]
            total, once, twice, more = context
            seen = total > 0  # else the order below is all there is
            total = np.where(seen, total, 1).astype(float)
            free = np.where(seen, (d[0] * once + d[1] * twice + d[2] * more) / total, 1.0)
            p = (n - np.choose(np.minimum(n, 3), [0.0, *d])) * seen / total + free * p
        known = count[right] > 0
        return (np.add.reduceat(known.astype(np.int64), at[:-1]), np.add.reduceat(base[right], at[:-1]),
                np.add.reduceat(np.log10(p), at[:-1]))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens, n_known, base_score, score, perplexity``, over the whole text.

    ``score`` is the model's log10 probability of the words and the end, ``base_score`` that of
    add-one unigrams. Null text is empty: one token, the end. Columns with these names are replaced.
    """
    root, brought = _local(docs.sparkSession, model.path)

    def build():
        scorer = Scorer(model, SparkFiles.get(root) if brought else root)

        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            tok, at = tokens(batch.column(text))
            known, base, own = scorer.score(tok, at)
            n = np.diff(at)
            return [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(own), pa.array(10 ** (-own / n))]

        return each

    return append_columns(docs, [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
                                 T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
                                 T.StructField("perplexity", T.DoubleType())], build)
