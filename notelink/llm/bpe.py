"""Operator 4: byte-level BPE encoding and decoding.

Pieces are found without a regular expression. Every character becomes a symbol
(its class, with what the next characters decide); the symbol before it tells the
lexer's state at all positions at once, with contractions put right. A piece starts
where the state and the symbol say so. Equal pieces of a slab are found by hashes and
compared by their bytes; those that differ are merged together, one pair of each a round; the byte end of every token is kept, and decoding uses it.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelink.llm.common import append_columns, fold, mix, text_buffers

# Bytes of a piece from which it is merged alone.
PIECE_BYTES = 64
# Bytes of text that are encoded at once: some seventy bytes of memory are needed for each.
SLAB_BYTES = 1024 * 1024
# A rank file above this is refused: it is broadcast.
MAX_RANK_BYTES = 64 * 1024 * 1024
# Pieces that are merged side by side: rows of these widths, and bytes held at once.
WIDTHS, MERGED_BYTES = (8, 16, 32, PIECE_BYTES), 1 << 17
NO_RANK, _NO_KEY = np.int32((1 << 31) - 1), np.uint64(0xFFFFFFFFFFFFFFFF)
# Numbers whose first so many bytes are all ones.
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

# --- piece boundaries --------------------------------------------------------
# Classes of code points, and symbols: LETTER, NUMBER, OTHER; an apostrophe that begins a
# contraction of two or three characters; a blank or other white space before a
# non-space; white space before more of it or the end; the end of a text.
LETTER, NUMBER, OTHER, SHORT, LONG, BLANK_LAST, SPACE_LAST, SPACE_MORE, STOP = range(9)
_BLANK, _SPACE = BLANK_LAST, SPACE_LAST
# States: nothing open; in letters, in numbers, in others; after a blank that joins what
# follows; in white space; one or two characters of a contraction to come.
NONE, IN_LETTER, IN_NUMBER, IN_OTHER, JOIN, IN_SPACE, ONE, TWO = range(8)

_CLASS: np.ndarray | None = None


def _lexer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece starts, by symbol and state."""
    nxt, cut = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for sym, inside in ((LETTER, IN_LETTER), (NUMBER, IN_NUMBER), (OTHER, IN_OTHER)):
        nxt[sym] = inside
        cut[sym, [inside, JOIN]] = False
    nxt[LETTER, TWO], nxt[LETTER, ONE] = ONE, NONE
    cut[LETTER, [ONE, TWO]] = False
    for sym, opened in ((SHORT, ONE), (LONG, TWO)):
        nxt[sym] = opened
        nxt[sym, [IN_OTHER, JOIN]] = IN_OTHER
        cut[sym, [IN_OTHER, JOIN]] = False
    nxt[BLANK_LAST], nxt[SPACE_LAST], nxt[STOP] = JOIN, NONE, NONE
    nxt[SPACE_MORE] = IN_SPACE
    cut[SPACE_MORE, IN_SPACE] = False
    return nxt, cut


_NEXT, _CUT = _lexer()


def classes() -> np.ndarray:
    """The class of every code point, from Python's Unicode database (characters that it lacks are OTHER)."""
    global _CLASS
    if _CLASS is None:
        t = np.full(0x110000, OTHER, np.uint8)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))
            if kind[0] == "L":
                t[c] = LETTER
            elif kind[0] == "N":
                t[c] = NUMBER
            elif kind[0] == "Z" or 9 <= c <= 13 or c == 0x85:
                t[c] = _SPACE
        t[32] = _BLANK
        _CLASS = t
    return _CLASS


def symbols(points: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Symbols of texts that lie one after another, each ended by a stop."""
    sym = classes()[points]
    space = sym >= _BLANK
    open_end = np.ones(len(sym), bool)  # white space, or nothing, comes next
    open_end[:-1] = space[1:]
    open_end[stops[stops > 0] - 1] = True
    sym[space & open_end] = SPACE_MORE
    quote = np.flatnonzero(points == 39)
    if len(quote):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        a, b = padded[quote + 1], padded[quote + 2]
        sym[quote[np.isin(a, [ord(c) for c in "stmd"])]] = SHORT
        pair = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        sym[quote[pair]] = LONG
    sym[stops] = STOP
    return sym


def piece_starts(sym: np.ndarray) -> np.ndarray:
    """Positions where pieces start. The state before a symbol follows from the symbol before it; only a
    contraction reaches further, by its one or two letters, and begins where no other sign is open."""
    before = np.concatenate([[STOP], sym[:-1]]).astype(np.uint8)
    state = _NEXT[:, NONE][before]
    quote = np.flatnonzero((sym == SHORT) | (sym == LONG))
    joins = np.isin(before[quote], [OTHER, BLANK_LAST])
    for q, known in ((quote[joins], (IN_OTHER,)), (quote[~joins & (sym[quote] == SHORT)], (ONE, NONE)), (quote[~joins & (sym[quote] == LONG)], (TWO, ONE, NONE))):
        for k, x in enumerate(known, 1):
            at = q + k
            state[at[at < len(sym)]] = x
    return np.flatnonzero(_CUT.ravel()[sym * np.uint8(8) + state])


# --- merging -----------------------------------------------------------------

class Pairs:
    """The rank of every pair of tokens that makes a token, in an open hash table."""

    def __init__(self, ranks: dict[bytes, int]):
        found = []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a = ranks.get(token[:k])
                if a is not None:
                    b = ranks.get(token[k:])
                    if b is not None:
                        found.append((a << 32 | b, rank))
        key, rank = np.array(found, np.uint64).reshape(-1, 2).T
        bits = max(4, (4 * len(key)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.rank = np.full(1 << bits, _NO_KEY), np.full(1 << bits, NO_RANK, np.int32)
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = left[self.key[slot[left]] == _NO_KEY]
            self.key[slot[free]] = key[free]
            left = left[self.key[slot[left]] != key[left]]
            slot[left] = (slot[left] + 1) & self.last
        self.rank[slot] = rank.astype(np.int32)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.first = self.find(np.repeat(self.single, 256), np.tile(self.single, 256))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; NO_RANK if it makes no token, or if ``b`` is -1."""
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint32)
        slot = self._slot(key)
        met = self.key[slot]
        left = np.flatnonzero((met != key) & (met != _NO_KEY))
        while len(left):
            slot[left] = (slot[left] + 1) & self.last
            met = self.key[slot[left]]
            left = left[(met != key[left]) & (met != _NO_KEY)]
        return self.rank[slot]

    def merged(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of bytes, of which the first ``size`` (one at least) are a piece, merged like ``merge``: how many
        ids each has, and which. A round merges the leftmost of the lowest pairs of every row, so all grow
        shorter together."""
        ids = np.concatenate([self.single[raw], np.full((len(raw), 1), -1, np.int32)], axis=1)
        ids[np.arange(ids.shape[1]) >= size[:, None]] = -1
        pair = np.full(raw.shape, NO_RANK)
        pair[:, :-1] = self.first[raw[:, :-1].astype(np.int32) << 8 | raw[:, 1:]]
        pair[ids[:, 1:] < 0] = NO_RANK
        n, out, row = np.zeros(len(ids), np.int64), np.zeros(raw.shape, np.int32), np.arange(len(ids))
        while len(row):
            i = pair.argmin(axis=1)
            low = pair[np.arange(len(row)), i]
            done = low == NO_RANK
            if done.any():
                n[row[done]] = (ids[done] >= 0).sum(axis=1)
                out[row[done], :ids.shape[1] - 1] = ids[done, :-1]
                go = ~done
                row, ids, pair, i, low = row[go], ids[go], pair[go], i[go], low[go]
            # one column less; the last ones are always empty: -1, no rank
            nth, at = np.arange(len(row)), np.arange(pair.shape[1])
            ids = np.where(at <= i[:, None], ids[:, :-1], ids[:, 1:])
            ids[nth, i] = low
            pair = np.where(at[:-1] < i[:, None], pair[:, :-1], pair[:, 1:])
            after = np.flatnonzero(i < pair.shape[1])
            pair[after, i[after]] = self.find(low[after], ids[after, i[after] + 1])
            before = np.flatnonzero(i > 0)
            pair[before, i[before] - 1] = self.find(ids[before, i[before] - 1], low[before])
        return n, out


class Lanes:
    """Pieces of at most ``width`` bytes: eight bytes to a number, filled up with 0, and a hash of these and of the size."""

    def __init__(self, at_byte: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int):
        self.size = size
        self.lanes = np.empty((len(begin), width // 8), np.uint64)
        self.hash = mix(size.astype(np.uint64))
        for j in range(width // 8):
            self.lanes[:, j] = at_byte[begin + 8 * j] & _FIRST_BYTES[np.clip(size - 8 * j, 0, 8)]
            self.hash = fold(self.hash, self.lanes[:, j])

    def equal(self, rows, other: Lanes, others) -> np.ndarray:
        return (self.size[rows] == other.size[others]) & (self.lanes[rows] == other.lanes[others]).all(axis=1)


def _at_byte(raw: bytes) -> np.ndarray:
    """The eight bytes from each byte on."""
    padded = np.frombuffer(raw + bytes(PIECE_BYTES + 8), np.uint8)
    return np.ndarray((len(padded) - 8,), "<u8", padded, strides=(1,))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the adjacent pair of lowest rank (leftmost of equals) until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > PIECE_BYTES:
        return _merge_long(piece, ranks)
    none = len(ranks) + 1
    cut = list(range(len(piece) + 1))
    get = ranks.get
    pair = [get(piece[i:i + 2], none) for i in range(len(piece) - 1)]
    while pair:
        low = min(pair)
        if low == none:
            break
        i = pair.index(low)
        del cut[i + 1]
        del pair[i]
        if i < len(pair):
            pair[i] = get(piece[cut[i]:cut[i + 2]], none)
        if i:
            pair[i - 1] = get(piece[cut[i - 1]:cut[i + 1]], none)
    return [ranks[piece[a:b]] for a, b in zip(cut, cut[1:])]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap over linked parts, for pieces without a length limit."""
    n = len(piece)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = []

    def offer(i: int) -> None:
        if end[i] < n:
            rank = ranks.get(piece[i:end[end[i]]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[end[i]]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, to = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != to:
            continue
        alive[end[i]] = False
        end[i] = to
        if to < n:
            before[to] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[piece[i:end[i]]] for i in range(n) if alive[i]]


class Codec:
    def __init__(self, payload: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, payload.splitlines())}
        lost = [b for b in range(256) if bytes([b]) not in self.ranks]
        if lost:
            raise ValueError(f"the rank file lacks single bytes: {lost[:5]}")
        size = max(self.ranks.values()) + 1
        self.length = np.full(size, -1, np.int64)
        by_id = sorted((i, t) for t, i in self.ranks.items())
        for i, t in by_id:
            self.length[i] = len(t)
        self.bytes = np.frombuffer(b"".join(t for _, t in by_id), np.uint8)
        self.at = np.cumsum(np.maximum(self.length, 0)) - np.maximum(self.length, 0)

    # What only encoding needs is built when it is first asked for.
    @functools.cached_property
    def pairs(self) -> Pairs:
        return Pairs(self.ranks)

    @functools.cached_property
    def tokens(self) -> dict[int, tuple[Lanes, np.ndarray]]:
        """Tokens by their hash, for pieces that are one token."""
        found, least, at_byte = {}, 0, _at_byte(self.bytes.tobytes())
        for width in WIDTHS:
            own = np.flatnonzero((self.length > least) & (self.length <= width))
            of = Lanes(at_byte, self.at[own], self.length[own], width)
            order = np.argsort(of.hash)
            of.hash, of.lanes, of.size = of.hash[order], of.lanes[order], of.size[order]
            found[width], least = (of, own[order]), width
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts one after another, and where each text's begin."""
        joined = "\n".join([*texts, ""])
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        stops = np.cumsum(size + 1) - 1
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sym = symbols(points, stops)
        starts = piece_starts(sym)
        ends = np.concatenate([starts[1:], [len(sym)]]) if len(starts) else starts
        real = sym[starts] != STOP
        starts, ends = starts[real], ends[real]
        raw, begin, end = joined.encode(), starts, ends
        if len(raw) > len(points):  # from characters to bytes
            wide = np.zeros(len(points) + 1, np.int32)
            np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), out=wide[1:])
            begin, end = wide[starts].astype(np.int64), wide[ends].astype(np.int64)
        ids, count = self.piece_ids(raw, begin, end - begin)
        return ids, count[np.concatenate([np.searchsorted(starts, stops - size), [len(starts)]])]

    def piece_ids(self, raw: bytes, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the pieces one after another, and where each piece's begin. Equal pieces are
        merged once; they are found by hashes and compared by their bytes."""
        n, found, at_byte = np.zeros(len(begin), np.int64), [], _at_byte(raw)
        alone, least = [np.flatnonzero(size > WIDTHS[-1])], 0
        for width in WIDTHS:
            own = np.flatnonzero((size > least) & (size <= width))
            least = width
            if not len(own):
                continue
            pieces = Lanes(at_byte, begin[own], size[own], width)
            _, head, number = np.unique(pieces.hash, return_index=True, return_inverse=True)
            same = pieces.equal(slice(None), pieces, head[number])
            count, ids, known = self._distinct(pieces, head, width)
            same &= known[number]
            alone.append(own[~same])
            own, number = own[same], number[same]
            n[own] = count[number]
            found.append((own, number, ids))
        alone = np.concatenate(alone)
        merged = [np.array(merge(raw[a:a + k], self.ranks), np.int32) for a, k in zip(begin[alone].tolist(), size[alone].tolist())]
        n[alone] = np.fromiter(map(len, merged), np.int64, len(merged))
        count = np.concatenate([[0], np.cumsum(n)])
        out = np.empty(int(count[-1]), np.int32)
        for own, number, ids in found:
            for j in range(ids.shape[1]):
                more = n[own] > j
                if not more.any():
                    break
                own, number = own[more], number[more]
                out[count[own] + j] = ids[number, j]
        for p, x in zip(alone.tolist(), merged):
            out[count[p]:count[p + 1]] = x
        return out, count

    def _distinct(self, pieces: Lanes, head: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pieces that differ: how many ids, which, and whether that is known (else their hash is another token's)."""
        tokens, rank = self.tokens[width]
        count, ids, known = np.ones(len(head), np.int64), np.zeros((len(head), width), np.int32), np.ones(len(head), bool)
        at = np.searchsorted(tokens.hash, pieces.hash[head])
        hit = at < len(rank)
        hit[hit] = tokens.hash[at[hit]] == pieces.hash[head[hit]]
        known[hit] = pieces.equal(head[hit], tokens, at[hit])
        ids[hit, 0] = rank[at[hit]]
        rest, size = np.flatnonzero(~hit), pieces.size[head]
        rest = rest[np.argsort(size[rest], kind="stable")]
        for a in range(0, len(rest), MERGED_BYTES // width):
            some = rest[a:a + MERGED_BYTES // width]
            longest = size[some[-1]]
            raw = pieces.lanes[head[some]].astype("<u8").view(np.uint8)[:, :longest]
            count[some], ids[some, :longest] = self.pairs.merged(raw, size[some])
        return count, ids, known

    def ends(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where each token ends, in bytes of its text."""
        total = np.concatenate([[0], np.cumsum(self.length[ids])])
        return (total[1:] - np.repeat(total[first[:-1]], np.diff(first))).astype(np.int32)

    def decode(self, ids: np.ndarray, first: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts one after another, and where each begins."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.length) or (self.length[ids] < 0).any()):
            raise ValueError("a token id is not in the rank file")
        begin = np.zeros_like(ends)
        begin[1:] = ends[:-1]
        begin[first[:-1][np.diff(first) > 0]] = 0
        size = (ends - begin).astype(np.int64)
        if (size != self.length[ids]).any():
            raise ValueError("the offsets do not belong to these ids")
        text_end = np.concatenate([[0], np.cumsum(size)])[first]
        shift = self.at[ids] - (np.cumsum(size) - size)
        return self.bytes[np.arange(int(text_end[-1])) + np.repeat(shift, size)], text_end


_CODECS: dict[str, Codec] = {}


def _codec(payload: bytes) -> Codec:
    """One codec per worker, kept by the rank file's content."""
    key = hashlib.sha256(payload).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(payload)
    return _CODECS[key]


def _payload(spark, rank_file: str):
    with open(rank_file, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{rank_file} is larger than {MAX_RANK_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


_INTS = T.ArrayType(T.IntegerType())


def encode(docs: DataFrame, rank_file: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and ``token_ends`` (byte offset in the text where each token ends).

    No special tokens: their strings are ordinary text. Null and empty texts
    have no ids; columns with these names are replaced; texts are encoded whole,
    however long.
    """
    payload = _payload(docs.sparkSession, rank_file)

    def build():
        codec = _codec(payload.value)

        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            ids, first = codec.encode([t or "" for t in batch.column(text).to_pylist()])
            at = pa.array(first, pa.int32())
            return [pa.ListArray.from_arrays(at, pa.array(ids, pa.int32())),
                    pa.ListArray.from_arrays(at, pa.array(codec.ends(ids, first), pa.int32()))]

        return each

    return append_columns(docs, [T.StructField("ids", _INTS), T.StructField("token_ends", _INTS)], build, slab=SLAB_BYTES)


def id_type(rank_file: str) -> np.dtype:
    """The narrowest unsigned little-endian type that holds every id of the rank file."""
    with open(rank_file, "rb") as f:
        return np.min_scalar_type(max(int(line.split()[1]) for line in f if line.strip())).newbyteorder("<")


def encode_packed(docs: DataFrame, rank_file: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_ids`` and ``packed_ids`` (the ids as ``id_type`` one after another); otherwise like ``encode``."""
    payload, kind = _payload(docs.sparkSession, rank_file), id_type(rank_file)

    def build():
        codec = _codec(payload.value)

        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            ids, first = codec.encode([t or "" for t in batch.column(text).to_pylist()])
            packed = pa.Array.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(first * kind.itemsize), pa.py_buffer(ids.astype(kind))])
            return [pa.array(np.diff(first), pa.int64()), packed.cast(pa.binary())]

        return each

    return append_columns(docs, [T.StructField("n_ids", T.LongType()), T.StructField("packed_ids", T.BinaryType())], build, slab=SLAB_BYTES)


def decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """``encoded`` (``ids`` and ``token_ends``) with ``decoded``, the text's bytes; null ids are empty.
    Ids that the rank file does not have, or offsets of other ids, are an error."""
    payload = _payload(encoded.sparkSession, rank_file)

    def build():
        codec = _codec(payload.value)

        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            ids, first = _ints(batch.column("ids"))
            ends, _ = _ints(batch.column("token_ends"))
            data, at = codec.decode(ids, first, ends)
            return [pa.Array.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(at), pa.py_buffer(data)]).cast(pa.binary())]

        return each

    return append_columns(encoded, [T.StructField("decoded", T.BinaryType())], build)


def _ints(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(np.asarray(col.offsets, np.int64))
    if col.null_count:
        size = np.where(np.asarray(col.is_null()), 0, size)
    return col.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def ids_digest(ids: str = "ids"):
    """SHA-256 of the decimal ids joined by blanks, in hex."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256)


__all__ = ["Codec", "decode", "encode", "encode_packed", "id_type", "ids_digest", "merge", "piece_starts", "symbols", "text_buffers"]
