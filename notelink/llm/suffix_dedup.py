"""Operator 9: exact substring deduplication with deep-shallow suffix sorting.

Every byte covered by a string of ``length`` bytes that also starts in a document
with a smaller key is removed. To compare strings of all documents without
moving them all:

1. *Anchors.* Each window of ``length`` bytes has an anchor: the leftmost of its
   GRAM-byte strings with the least hash. Equal windows have equal anchors at
   equal places, so only windows whose anchor other documents have can repeat.
   Anchors travel to ranges of the hash order, which tell which are shared.
2. *Contexts.* Around each shared anchor, the bytes of all windows that have it
   are one short context; equal contexts of a task are sent once (documents after
   the first are settled on the spot, so a passage that very many documents
   share stays a few rows).
3. *Suffix sorting.* In each range, what follows the anchors, and what stands
   before them read backwards, is sorted deep-shallow: multikey quicksort on words
   of eight bytes to a shallow depth, then blind tries for groups that still agree.
   Longest common prefixes of neighbours split the order into classes of
   equal windows, and a window is removed if its class has a smaller key.
4. Documents are cut as the windows found in them say.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelink.llm.common import (BYTE_VALUES, append_columns, bounded_batches, mix, released, shard_of, slabs, squeeze, text_buffers, unsqueeze, without)

# Bytes of an anchor; a window of 50 bytes has 29 of them to choose from.
GRAM = 22
# What bounds a task's memory: text per array step, anchors gathered before they are sent, contexts
# (by occurrences and by bytes), and text per range of the hash order.
STEP_BYTES, FLUSH, PENDING, CONTEXT_BYTES, SHARD_BYTES = 512 * 1024, 400_000, 100_000, 4 * 1024 * 1024, 6 * 1024 * 1024
SHALLOW = 4  # words of eight bytes that the multikey pass sorts by


# --- sorting -----------------------------------------------------------------

def deep_shallow(text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``text`` (n, m bytes, zero-padded; ``size`` bytes count), and for each
    row in that order the longest common prefix with the row before it.

    Shallow: a multikey quicksort by words of eight bytes. Deep: groups that agree on
    ``SHALLOW`` words, if not all equal, are put in order by a blind trie.
    """
    n, m = text.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = -(-max(m, 1) // 8) * 8
    padded = np.zeros((n, width), np.uint8)
    padded[:, :m] = text
    padded[np.arange(width) >= size[:, None]] = 0
    words = padded.view(">u8").astype(np.uint64)
    order, group = _multikey(words[:, :SHALLOW])
    open_ = _in_group(group)
    if open_.any() and (words.shape[1] > SHALLOW or size.min() < size.max()):
        at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        raw = padded.tobytes()
        for a, b in zip(at, np.concatenate([at[1:], [n]])):
            if b - a > 1:
                rows = order[a:b]
                keyed: dict[bytes, list[int]] = {}
                for r in rows.tolist():
                    keyed.setdefault(raw[r * width:r * width + int(size[r])], []).append(r)
                if len(keyed) > 1:
                    order[a:b] = [r for s in _trie_order(list(keyed)) for r in keyed[s]]
    lcp = np.zeros(n, np.int64)
    if n > 1:
        differ = padded[order[1:]] != padded[order[:-1]]
        first = np.where(differ.any(1), differ.argmax(1), width)
        lcp[1:] = np.minimum(first, np.minimum(size[order[1:]], size[order[:-1]]))
    return order, lcp


# Rows from which on a group is parted by a pivot; smaller ones are sorted at once.
PARTED = 24


def _multikey(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``words``, and the number of each place's group of equal rows.

    Multikey quicksort, all groups side by side: each large group takes the median of three of
    its rows as pivot and is parted three ways by the word at its depth. What is less or
    greater stays at that depth, what is equal goes on to the next word. Small groups
    are finished by a sort from their depth on.
    """
    n, depth_end = words.shape
    order = np.arange(n)
    start, end, depth = np.zeros(1, np.int64), np.full(1, n), np.zeros(1, np.int64)
    small: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(start):
        large = (end - start >= PARTED) & (depth < depth_end)
        rest = ~large & (depth < depth_end) & (end - start > 1)
        small.append((start[rest], end[rest], depth[rest]))
        start, end, depth = start[large], end[large], depth[large]
        if not len(start):
            break
        size = end - start
        own = np.repeat(np.arange(len(start)), size)
        first = np.cumsum(size) - size
        place = np.arange(len(own)) - first[own] + start[own]
        rows = order[place]
        at = words[rows, depth[own]]
        three = np.sort(np.stack([at[first], at[first + size // 2], at[first + size - 1]]), axis=0)
        pivot = three[1][own]
        part = (at >= pivot).astype(np.int64) + (at > pivot)  # 0: less, 1: equal, 2: greater
        count = np.bincount(own * 3 + part, minlength=3 * len(start)).reshape(-1, 3)
        begin = start[:, None] + np.cumsum(count, axis=1) - count
        for k in range(3):  # to where each part begins, in the order that rows had
            mine = np.flatnonzero(part == k)
            if len(mine):
                before = np.arange(len(mine)) - np.repeat(np.cumsum(count[:, k]) - count[:, k], count[:, k])
                order[begin[own[mine], k] + before] = rows[mine]
        start, end, depth = begin.ravel(), (begin + count).ravel(), (depth[:, None] + np.array([0, 1, 0])).ravel()
        keep = end - start > 1
        start, end, depth = start[keep], end[keep], depth[keep]
    start, end, depth = (np.concatenate(x) for x in zip(*small))
    if len(start):
        own = np.repeat(np.arange(len(start)), end - start)
        place = np.arange(len(own)) - (np.cumsum(end - start) - (end - start))[own] + start[own]
        rows = order[place]
        by = np.lexsort((*[words[rows, w] for w in range(depth_end - 1, -1, -1)], own))
        order[place] = rows[by]
    differ = (words[order[1:]] != words[order[:-1]]).any(axis=1)
    return order, np.cumsum(np.concatenate([[False], differ]))


def _in_group(group: np.ndarray) -> np.ndarray:
    same = group[1:] == group[:-1]
    return np.concatenate([same, [False]]) | np.concatenate([[False], same])


def _trie_order(strings: list[bytes]) -> list[bytes]:
    """Distinct strings sorted by a blind trie: inner nodes know a depth and branch on the byte
    there (-1: the string ends); a string goes down blind, and one comparison with the leaf
    it meets says where it really leaves the tree."""
    root: list | bytes = strings[0]
    for s in strings[1:]:
        node = root
        while isinstance(node, list):
            depth, kids = node
            node = kids.get(s[depth] if depth < len(s) else -1) or next(iter(kids.values()))
        low, most = 0, min(len(s), len(node))
        while low < most and s[low] == node[low]:
            low += 1
        mine = s[low] if low < len(s) else -1
        theirs = node[low] if low < len(node) else -1
        parent, key, here = None, None, root
        while isinstance(here, list) and here[0] < low:
            parent, key = here, s[here[0]] if here[0] < len(s) else -1
            here = here[1][key]
        if isinstance(here, list) and here[0] == low:
            here[1][mine] = s
        else:
            new = [low, {theirs: here, mine: s}]
            if parent is None:
                root = new
            else:
                parent[1][key] = new
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack.extend(node[1][k] for k in sorted(node[1], reverse=True))
        else:
            out.append(node)
    return out


# --- 1. anchors --------------------------------------------------------------

_MUL = np.uint64(0x9FB21C651E98DF25)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all strings of GRAM bytes: longer ones put together from shorter ones."""
    cur, size, step = BYTE_VALUES[data], 1, _MUL
    acc, acc_size, left = None, 0, GRAM
    while True:
        if left & 1:
            if acc is None:
                acc, acc_size = cur, size
            else:
                m = len(cur) - acc_size
                acc, acc_size = acc[:m] * step + cur[acc_size:acc_size + m], acc_size + size
        left >>= 1
        if not left:
            return mix(acc)
        cur = cur[:-size] * step + cur[size:]
        size, step = size * 2, step * step


def anchors(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of all windows of each text: (hash, text, start of the first window that has it,
    the anchor's place in that window, number of windows)."""
    n = len(data) - length + 1
    span = length - GRAM + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.astype(np.uint64), none, none, none, none
    h = gram_hashes(data)
    low, at, size = h, np.arange(len(h), dtype=np.int32), 1

    def less(shift: int, keep: int):
        a, b = low[:keep], low[shift:shift + keep]
        left = a <= b
        return np.where(left, a, b), np.where(left, at[:keep], at[shift:shift + keep])

    while size * 2 <= span:
        low, at = less(size, len(low) - size)
        size *= 2
    if size < span:
        low, at = less(span - size, len(low) - (span - size))
    ok = np.zeros(len(data) + 1, np.int8)  # +1 where the windows of a text begin, -1 after the last
    long = np.flatnonzero(np.diff(off) >= length)
    np.add.at(ok, off[long], 1)
    np.add.at(ok, off[long + 1] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(ok[:n], dtype=np.int8))
    if not len(start):
        return none.astype(np.uint64), none, none, none, none
    place = at[start]
    edge = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)]))
    first, place = start[edge], place[edge]
    row = np.searchsorted(off, first, "right") - 1
    # Least hashes lie low in their order; hashed once more, they spread evenly over its ranges.
    return mix(h[place]), row, first - off[row], place - first, np.diff(np.concatenate([edge, [len(start)]]))


_MOVED = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("batch", T.LongType()), T.StructField("kind", T.IntegerType()),
                       *[T.StructField(c, T.BinaryType()) for c in "abcdef"]])
_KINDS = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 6]
_INFO, _SENT, _BACK = 0, 1, 2


def _moved(*row) -> pa.RecordBatch:
    row = [*row, *[b""] * (9 - len(row))]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _KINDS)], names=_MOVED.names)


def _same(*cols: np.ndarray) -> np.ndarray:
    """For sorted columns, the number of the run of equal rows that each row is in."""
    if not len(cols[0]):
        return np.zeros(0, np.int64)
    return np.cumsum(np.concatenate([[0], np.any([c[1:] != c[:-1] for c in cols], axis=0)]))


class _Anchors:
    """Anchors of a task since the last flush."""

    def __init__(self):
        self.docs, self.found, self.n_docs, self.n = [], [], 0, 0

    def add(self, key: np.ndarray, v: np.ndarray, data: np.ndarray, off: np.ndarray, length: int) -> None:
        h, row, first, place, count = anchors(data, off, length)
        self.docs.append((key, v))
        self.found.append((h, (row + self.n_docs).astype(np.int32), first.astype(np.int32), place.astype(np.uint8), count.astype(np.uint8)))
        self.n_docs += len(key)
        self.n += len(h)

    def flush(self, batch: int, n_shards: int) -> Iterator[pa.RecordBatch]:
        key, v = (np.concatenate(x) for x in zip(*self.docs))
        h, row, *rest = (np.concatenate(x) for x in zip(*self.found))
        order = np.lexsort((key[row], h))
        h, row, rest = h[order], row[order], [x[order] for x in rest]
        run = _same(h)
        several = np.bincount(run, weights=np.concatenate([[0], (np.diff(run) == 0) & (np.diff(key[row]) != 0)]) if len(run) else None)
        shared = several[run] > 0 if len(run) else np.zeros(0, bool)
        yield _moved(batch % n_shards, batch, _INFO, squeeze(key), squeeze(v), *_pack_found(row, rest, shared))
        # of shared ones one goes out, without a document; of the others all
        lead = np.concatenate([[True], run[1:] != run[:-1]]) if len(run) else shared
        out_row = np.where(shared, np.int32(-1), row)
        keep = ~shared | lead
        h, out_row, rest = h[keep], out_row[keep], [x[keep] for x in rest]
        at = np.searchsorted(shard_of(h, n_shards), np.arange(n_shards + 1))
        for s, (a, b) in enumerate(zip(at, at[1:])):
            if b > a:
                yield _moved(s, batch, _SENT, squeeze(h[a:b], True), squeeze(out_row[a:b]), *[squeeze(x[a:b]) for x in rest])
        self.__init__()


def _pack_found(row, rest, keep) -> tuple[bytes, bytes, bytes]:
    """The anchors to keep, by document and place: document, first window, and place and count together."""
    row, first, place, count = (x[keep] for x in (row, *rest))
    order = np.lexsort((first, row))
    both = np.stack([place, count], 1).view(np.uint16).ravel()
    return squeeze(row[order], True), squeeze(first[order], True), squeeze(both[order])


def _pack_document(first: np.ndarray, both: np.ndarray) -> bytes:
    """One document's anchors, as byte planes of differences (Spark's shuffle compresses them)."""
    step = np.diff(first, prepend=np.int32(0))
    return np.ascontiguousarray(step.view(np.uint8).reshape(-1, 4).T).tobytes() + both.tobytes()


def _unpack_document(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(data, np.uint8, 4 * n).reshape(4, n)
    first = np.cumsum(np.ascontiguousarray(planes.T).view(np.int32).ravel(), dtype=np.int32)
    return first, np.frombuffer(data, np.uint8, 2 * n, 4 * n).reshape(n, 2)


def _shared_anchors(docs: DataFrame, length: int, n_shards: int) -> DataFrame:
    """(key, v, found): the anchors of each document that other documents have."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, got = TaskContext.get().partitionId(), 0, _Anchors()
        for batch in released(batches):
            for part in slabs(batch, STEP_BYTES):
                got.add(part.column("key").to_numpy(), part.column("v").to_numpy(), *text_buffers(part.column("text")), length)
                if got.n >= FLUSH:
                    yield from got.flush((task << 24) + done, n_shards)
                    done += 1
        if got.n_docs:
            yield from got.flush((task << 24) + done, n_shards)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of, cols = [], []
        for batch in released(batches):
            for r in batch.to_pylist():
                if r["kind"] == _INFO:
                    yield _moved(*r.values())
                else:
                    batch_of.append(r["batch"])
                    cols.append((unsqueeze(r["a"], np.uint64, True), unsqueeze(r["b"], np.int32), unsqueeze(r["c"], np.int32),
                                 unsqueeze(r["d"], np.uint8), unsqueeze(r["e"], np.uint8)))
        if not cols:
            return
        cut = np.concatenate([[0], np.cumsum([len(c[0]) for c in cols])])
        h, row, *rest = (np.concatenate(x) for x in zip(*cols))
        del cols
        sender = np.repeat(np.arange(len(batch_of), dtype=np.int32), np.diff(cut))
        order = np.argsort(h, kind="stable")
        run = _same(h[order])
        # a row without a document, or rows of two documents
        doc = sender[order].astype(np.int64) << 32 | row[order].astype(np.int64) + 1
        other = np.concatenate([[False], (np.diff(run) == 0) & (np.diff(doc) != 0)])
        shared = np.zeros(len(h), bool)
        shared[order] = np.bincount(run, weights=other)[run] > 0
        shared &= row >= 0
        for s, (a, b) in enumerate(zip(cut, cut[1:])):
            keep = shared[a:b]
            if keep.any():
                yield _moved(0, batch_of[s], _BACK, b"", b"", *_pack_found(row[a:b], [x[a:b] for x in rest], keep))

    def settle(group: tuple, t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        info = next(r for r in rows if r["kind"] == _INFO)
        key, v = unsqueeze(info["a"], np.int64), unsqueeze(info["b"], np.int64)
        row = np.concatenate([unsqueeze(r["c"], np.int32, True) for r in rows])
        first = np.concatenate([unsqueeze(r["d"], np.int32, True) for r in rows])
        both = np.concatenate([unsqueeze(r["e"], np.uint16) for r in rows])
        order = np.lexsort((first, row))
        row, first, both = row[order], first[order], both[order]
        docs_, at = np.unique(row, return_index=True)
        cut = [*at.tolist(), len(row)]
        packed = [_pack_document(first[a:b], both[a:b]) for a, b in zip(cut, cut[1:])]
        return pa.table({"key": key[docs_], "v": v[docs_], "n": np.diff(cut).astype(np.int32), "found": pa.array(packed, pa.binary())})

    sent = docs.mapInArrow(gather, _MOVED).repartitionById(n_shards, "shard")
    return sent.mapInArrow(match, _MOVED).groupBy("batch").applyInArrow(settle, "key long, v long, n int, found binary")


# --- 2. and 3. contexts ------------------------------------------------------

class _Contexts:
    """Contexts of a task since the last flush: each distinct one, with the smallest key that has it."""

    def __init__(self):
        self.docs, self.ids, self.contexts, self.owner = [], {}, [], []
        self.pending, self.bytes = [], 0

    def add(self, key: int, v: int, text: bytes, grams: np.ndarray, first: np.ndarray, both: np.ndarray, length: int) -> None:
        """``grams``: hashes of the text's strings of GRAM bytes."""
        doc = len(self.docs)
        self.docs.append((key, v))
        h = mix(grams[first.astype(np.int64) + both[:, 0]])
        for hash_, a, place, count in zip(h.tolist(), first.tolist(), both[:, 0].tolist(), both[:, 1].tolist()):
            ctx = (text[a:a + count - 1 + length], place)
            i = self.ids.get(ctx)
            if i is None:
                self.ids[ctx] = i = len(self.contexts)
                self.contexts.append((hash_, ctx[0], place, count))
                self.owner.append(key)
                self.bytes += len(ctx[0])
            elif key < self.owner[i]:
                self.owner[i] = key
            self.pending.append((i, doc, a))

    def flush(self, batch: int, n_shards: int) -> Iterator[pa.RecordBatch]:
        key, v = (np.array(x, np.int64) for x in zip(*self.docs))
        least = np.array(self.owner, np.int64)
        ctx, doc, at = np.array(self.pending, np.int64).reshape(-1, 3).T
        known = least[ctx] < key[doc]  # an earlier document of this task has all windows of this context
        count = np.array([c[3] for c in self.contexts], np.int64)
        spans = np.stack([doc, at, count[ctx]], 1)[known].astype(np.int32)
        wait = np.stack([doc, at, ctx], 1)[~known].astype(np.int32)
        yield _moved(batch % n_shards, batch, _INFO, squeeze(key), squeeze(v), squeeze(spans.T.ravel()), squeeze(wait.T.ravel()))
        h = np.array([c[0] for c in self.contexts], np.uint64)
        shard = shard_of(h, n_shards).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(n_shards + 1))
        for s, (a, b) in enumerate(zip(cut, cut[1:])):
            if b > a:
                mine = order[a:b]
                yield _moved(s, batch, _SENT, squeeze(mine.astype(np.int32), True), squeeze(least[mine]),
                             _squeeze_bytes(b"".join([self.contexts[i][1] for i in mine.tolist()])),
                             squeeze(np.array([(self.contexts[i][2], self.contexts[i][3]) for i in mine.tolist()], np.uint8).view(np.uint16).ravel()))
        self.__init__()


def _squeeze_bytes(data: bytes) -> bytes:
    return squeeze(np.frombuffer(data, np.uint8))


def repeated_windows(text: np.ndarray, at: np.ndarray, size: np.ndarray, place: np.ndarray, count: np.ndarray,
                     key: np.ndarray, length: int) -> np.ndarray:
    """For each context (``size`` bytes of ``text`` from ``at``; its anchor at ``place``; its first
    ``count`` windows count) the windows that a smaller key has too, as bits."""
    n = len(at)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    pad = np.concatenate([text, np.zeros(2 * length, np.uint8)])
    after, before = np.empty((n, length), np.uint8), np.empty((n, length - GRAM), np.uint8)
    for a in range(0, n, 8192):  # index arrays are eight times the bytes: a few rows at a time
        anchor = (at + place)[a:a + 8192, None]
        after[a:a + 8192] = pad[anchor + np.arange(length)]
        before[a:a + 8192] = pad[np.maximum(anchor - 1 - np.arange(length - GRAM), 0)]
    r_order, r_lcp = deep_shallow(after, np.minimum(size - place, length))
    l_order, l_lcp = deep_shallow(before, np.minimum(place, length - GRAM))
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(length - GRAM + 1):  # the anchor's place in a window
        mine = np.flatnonzero((place >= d) & (place - d < count))
        if not len(mine):
            continue
        r_class[r_order] = np.cumsum(r_lcp < length - d)
        l_class[l_order] = np.cumsum(l_lcp < d) if d else 0
        both = l_class[mine] << 32 | r_class[mine]
        order = np.lexsort((key[mine], both))
        b, k = both[order], key[mine][order]
        begin = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        least = np.repeat(k[begin], np.diff(np.concatenate([begin, [len(b)]])))
        hit = mine[order[least < k]]
        out[hit] |= np.int64(1) << (place[hit] - d)
    return out


def _spans(docs: DataFrame, text: str, length: int, n_shards: int) -> DataFrame:
    """(key, v, spans): the byte ranges to remove, as int32 starts and ends."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, got = TaskContext.get().partitionId(), 0, _Contexts()
        for batch in released(batches):
            for part in slabs(batch, STEP_BYTES):
                data, off = text_buffers(part.column(text))
                raw, grams = data.tobytes(), gram_hashes(data)
                for j, (k, v, n, f) in enumerate(zip(*[part.column(c).to_pylist() for c in ("_key", "_v", "_n", "_found")])):
                    got.add(k, v, raw[off[j]:off[j + 1]], grams[off[j]:off[j + 1]], *_unpack_document(n, f), length)
                    if len(got.pending) >= PENDING or got.bytes >= CONTEXT_BYTES:
                        yield from got.flush((task << 24) + done, n_shards)
                        done += 1
        if got.docs:
            yield from got.flush((task << 24) + done, n_shards)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of, cols = [], []
        for batch in released(batches):
            for r in batch.to_pylist():
                if r["kind"] == _INFO:
                    yield _moved(*r.values())
                else:
                    batch_of.append(r["batch"])
                    cols.append((unsqueeze(r["a"], np.int32, True), unsqueeze(r["b"], np.int64), unsqueeze(r["c"], np.uint8),
                                 unsqueeze(r["d"], np.uint16)))
        if not cols:
            return
        cut = np.concatenate([[0], np.cumsum([len(c[0]) for c in cols])])
        ctx, key, text, both = (np.concatenate(x) for x in zip(*cols))
        place, count = both.view(np.uint8).reshape(-1, 2).astype(np.int64).T
        size = count - 1 + length
        bits = repeated_windows(text, np.cumsum(size) - size, size, place, count, key, length)
        for s, (a, b) in enumerate(zip(cut, cut[1:])):
            hit = bits[a:b] != 0
            if hit.any():
                yield _moved(0, batch_of[s], _BACK, squeeze(ctx[a:b][hit], True), squeeze(bits[a:b][hit]))

    def settle(group: tuple, t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        info = next(r for r in rows if r["kind"] == _INFO)
        key, v = unsqueeze(info["a"], np.int64), unsqueeze(info["b"], np.int64)
        doc, at, count = unsqueeze(info["c"], np.int32).reshape(3, -1)
        w_doc, w_at, w_ctx = unsqueeze(info["d"], np.int32).reshape(3, -1)
        back = [r for r in rows if r["kind"] == _BACK]
        bits = np.zeros(int(w_ctx.max()) + 1 if len(w_ctx) else 0, np.int64)
        for r in back:
            ids, b = unsqueeze(r["a"], np.int32, True), unsqueeze(r["b"], np.int64)
            inside = ids < len(bits)
            bits[ids[inside]] = b[inside]
        d, a, e = [doc], [at], [at + count - 1 + length]
        for j in range(length - GRAM + 1):
            hit = (bits[w_ctx] >> j) & 1 > 0
            d.append(w_doc[hit])
            a.append(w_at[hit] + j)
            e.append(w_at[hit] + j + length)
        d, a, e = np.concatenate(d), np.concatenate(a), np.concatenate(e)
        order = np.lexsort((a, d))
        d, a, e = d[order], a[order], e[order]
        keys, vs, out = [], [], []
        docs_, first = np.unique(d, return_index=True)
        for x, p, q in zip(docs_.tolist(), first.tolist(), [*first[1:].tolist(), len(d)]):
            end = np.maximum.accumulate(e[p:q])
            new = np.flatnonzero(np.concatenate([[True], a[p + 1:q] > end[:-1]]))
            out.append(np.stack([a[p:q][new], end[np.concatenate([new[1:] - 1, [q - p - 1]])]], 1).astype(np.int32).tobytes())
            keys.append(key[x])
            vs.append(v[x])
        return pa.table({"key": pa.array(keys, pa.int64()), "v": pa.array(vs, pa.int64()), "spans": pa.array(out, pa.binary())})

    sent = docs.mapInArrow(gather, _MOVED).repartitionById(n_shards, "shard")
    return sent.mapInArrow(sort, _MOVED).groupBy("batch").applyInArrow(settle, "key long, v long, spans binary")


# --- 4. cutting --------------------------------------------------------------

_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FIELDS = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", _SPAN),
          T.StructField("kept", T.BinaryType()), T.StructField("kept_text", T.StringType())]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """``docs`` with ``n_bytes, n_removed, spans`` (maximal removed byte ranges), ``kept`` (the
    remaining UTF-8 bytes; a cut may go through a character) and ``kept_text`` (where anything
    was removed, the same without parts of characters that were cut through, else null).

    A byte goes if a string of ``length`` bytes that covers it also starts in a document
    with a smaller ``key`` (long); strings are judged on the input, and none crosses
    documents. Null text is empty. A row with a null key is kept whole and is
    never an earlier document; rows with one key do not judge one another, so the
    first document of each passage keeps it. Columns named like the new ones, or
    ``_key``, ``_v``, ``_n`` and ``_found``, are replaced, all others stay.
    """
    if not GRAM <= length <= GRAM + 60:
        raise ValueError(f"length must be from {GRAM} to {GRAM + 60}")
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = without(docs, [f.name for f in FIELDS if f.name not in (key, text)] + ["_key", "_v", "_n", "_found"])
    rows = docs.withColumn("_key", F.col(f"`{key}`").cast("long")).withColumn("_v", F.xxhash64(F.col(f"`{text}`")))
    known = rows.filter("_key IS NOT NULL")
    size = known.agg(F.sum(F.octet_length(f"`{text}`"))).first()[0] or 0
    n_shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    plain = known.select(F.col("_key").alias("key"), F.col("_v").alias("v"), F.col(f"`{text}`").alias("text"))
    shared = _shared_anchors(plain, length, n_shards).dropDuplicates(["key", "v"]).toDF("_key", "_v", "_n", "_found")
    # Both joins below take all columns of ``known`` by the same keys: its text is shuffled once.
    spans = _spans(known.join(shared, ["_key", "_v"]), text, length, n_shards).dropDuplicates(["key", "v"]).toDF("_key", "_v", "_found")
    found = known.join(spans, ["_key", "_v"], "left")
    found = found.unionByName(rows.filter("_key IS NULL").withColumn("_found", F.lit(None).cast("binary")))

    def build():
        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            data, off = text_buffers(batch.column(text))
            n = np.diff(off)
            kept, whole, ranges, removed = [], [], [], []
            for j, f in enumerate(batch.column("_found").to_pylist()):
                own = data[off[j]:off[j + 1]]
                cuts = np.frombuffer(f, np.int32).reshape(-1, 2).tolist() if f else []
                at, left = 0, []
                for a, b in cuts:
                    left.append(own[at:a])
                    at = b
                left.append(own[at:])
                left = [x.tobytes() for x in left]
                kept.append(b"".join(left))
                whole.append("".join([x.decode("utf-8", "ignore") for x in left]) if cuts else None)
                ranges.append([{"start": a, "end": b} for a, b in cuts])
                removed.append(sum(b - a for a, b in cuts))
            return [pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array(ranges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()),
                    pa.array(whole, pa.string())]

        return each

    return append_columns(found, FIELDS, build).drop("_key", "_v", "_found")
