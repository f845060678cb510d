"""String similarities of the fuzzy linkers: of one pair, and of a whole Arrow batch of pairs.

Batches run in 64-bit lanes, one pair to a lane: a row of a matching matrix is
a machine word, so a step of all pairs is a few numpy operations
(``lcs_lengths``, ``jaro_winkler_batch``). Strings of more than 64
characters take the same recurrences over Python integers. The pairs are produced and
reduced by Spark joins and aggregates. Semantics:

* Levenshtein: ``1 - dist / max(len)`` (native ``levenshtein`` in Spark).
* Jaro-Winkler: match window ``max(len) // 2 - 1``, transpositions halved
  with integer division, prefix weight 0.1 over at most 4 characters, boost
  only when the Jaro similarity is above 0.7.
* token sort: tokens from ``split()`` sorted and re-joined by one space, then
  the insert/delete similarity ``1 - indel / (len1 + len2)``.
* token set: 1.0 when one token set contains the other (and they share a
  token); otherwise the best of the difference strings and the
  intersection-padded lengths.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the Jaro-Winkler rule.
JW_PREFIX_WEIGHT = 0.1
JW_MAX_PREFIX = 4
JW_BOOST_THRESHOLD = 0.7


def levenshtein(a: str, b: str) -> int:
    if len(a) < len(b):
        a, b = b, a
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def levenshtein_sim(a: str, b: str) -> float:
    m = max(len(a), len(b))
    return 1.0 if m == 0 else 1.0 - levenshtein(a, b) / m


def jaro(a: str, b: str) -> float:
    la, lb = len(a), len(b)
    if la == 0 and lb == 0:
        return 1.0
    if la == 0 or lb == 0:
        return 0.0
    window = max(max(la, lb) // 2 - 1, 0)
    fa = [False] * la
    fb = [False] * lb
    m = 0
    for i, c in enumerate(a):
        lo, hi = max(0, i - window), min(lb, i + window + 1)
        for j in range(lo, hi):
            if not fb[j] and b[j] == c:
                fa[i] = fb[j] = True
                m += 1
                break
    if m == 0:
        return 0.0
    t = 0
    k = 0
    for i in range(la):
        if fa[i]:
            while not fb[k]:
                k += 1
            if a[i] != b[k]:
                t += 1
            k += 1
    t //= 2
    return (m / la + m / lb + (m - t) / m) / 3.0


def jaro_winkler(a: str, b: str) -> float:
    sim = jaro(a, b)
    if sim > JW_BOOST_THRESHOLD:
        p = 0
        for x, y in zip(a[:JW_MAX_PREFIX], b[:JW_MAX_PREFIX]):
            if x != y:
                break
            p += 1
        sim += p * JW_PREFIX_WEIGHT * (1.0 - sim)
    return sim


def lcs_len(a: str, b: str) -> int:
    if len(a) < len(b):
        a, b = b, a
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if ca == cb else max(prev[j], cur[j - 1]))
        prev = cur
    return prev[-1]


def indel_sim(a: str, b: str) -> float:
    total = len(a) + len(b)
    if total == 0:
        return 1.0
    return 1.0 - (total - 2 * lcs_len(a, b)) / total


def sorted_tokens(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_sort(a: str, b: str) -> float:
    return indel_sim(sorted_tokens(a), sorted_tokens(b))


def token_set(a: str, b: str) -> float:
    ta, tb = set(a.split()), set(b.split())
    if not ta or not tb:
        return 0.0
    inter = ta & tb
    dab, dba = ta - tb, tb - ta
    if inter and (not dab or not dba):
        return 1.0
    ab = " ".join(sorted(dab))
    ba = " ".join(sorted(dba))
    sect = len(" ".join(inter))
    sab = sect + (1 if sect else 0) + len(ab)
    sba = sect + (1 if sect else 0) + len(ba)
    total = sab + sba
    dist = len(ab) + len(ba) - 2 * lcs_len(ab, ba)
    result = 1.0 - dist / total if total else 0.0
    if not sect:
        return result
    r_ab = 1.0 - (1 + len(ab)) / (sect + sab)
    r_ba = 1.0 - (1 + len(ba)) / (sect + sba)
    return max(result, r_ab, r_ba)


SCORERS = {
    "levenshtein": levenshtein_sim,
    "jaro-winkler": jaro_winkler,
    "token-sort-ratio": token_sort,
    "token-set-ratio": token_set,
}


# --- batches -----------------------------------------------------------------

LANE, CHUNK = 64, 4096


def lcs_bits(a: str, b: str) -> int:
    """Length of the longest common subsequence by the bit-vector recurrence, of strings of any length."""
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & places.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _codes(xs: list[str], width: int) -> np.ndarray:
    """Code points, a row for each string, zeros behind its end."""
    return np.array(xs, dtype=f"U{max(1, width)}").view(np.uint32).reshape(len(xs), -1)


def _word(equal: np.ndarray) -> np.ndarray:
    """Rows of at most 64 truth values as one number each, the first one lowest."""
    wide = np.zeros((len(equal), LANE), bool)
    wide[:, :equal.shape[1]] = equal
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64).ravel()


def _ones(n: np.ndarray) -> np.ndarray:
    """Words with the lowest ``n`` bits set (64 at most)."""
    return np.where(n < LANE, (np.uint64(1) << np.minimum(n, LANE - 1).astype(np.uint64)) - np.uint64(1), ~np.uint64(0))


def _in_chunks(a: list[str], b: list[str], lanes, single, size) -> np.ndarray:
    """``lanes`` over chunks of pairs of like size, ``single`` for pairs that fit no lane."""
    out = np.zeros(len(a), np.float64)
    span = np.array([size(len(x), len(y)) for x, y in zip(a, b)], np.int64)
    for i in np.flatnonzero(span > LANE).tolist():
        out[i] = single(a[i], b[i])
    fit = np.flatnonzero(span <= LANE)
    longest = np.array([max(len(a[i]), len(b[i])) for i in fit.tolist()], np.int64)
    fit = fit[np.argsort(longest, kind="stable")]
    for at in range(0, len(fit), CHUNK):
        some = fit[at:at + CHUNK]
        out[some] = lanes([a[i] for i in some.tolist()], [b[i] for i in some.tolist()])
    return out


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of every pair."""

    def lanes(xs: list[str], ys: list[str]) -> np.ndarray:
        swap = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(xs, ys)]
        la, lb = (np.array([len(p[i]) for p in swap], np.int64) for i in (0, 1))
        short, long = _codes([p[0] for p in swap], la.max()), _codes([p[1] for p in swap], lb.max())
        v = np.full(len(xs), ~np.uint64(0))
        for j in range(int(lb.max())):
            u = v & np.where(j < lb, _word(short == long[:, j:j + 1]), np.uint64(0))
            v = (v + u) | (v - u)
        return np.bitwise_count(~v & _ones(la))

    return _in_chunks(a, b, lanes, lcs_bits, min).astype(np.int64)


def jaro_winkler_batch(a: list[str], b: list[str]) -> np.ndarray:
    """``jaro_winkler`` of every pair."""

    def lanes(xs: list[str], ys: list[str]) -> np.ndarray:
        la, lb = (np.array([len(x) for x in side], np.int64) for side in (xs, ys))
        x, y = _codes(xs, la.max()), _codes(ys, lb.max())
        window = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
        used, matched = np.zeros(len(xs), np.uint64), np.zeros(x.shape, bool)
        for i in range(int(la.max())):
            near = _ones(np.minimum(lb, i + window + 1)) & ~_ones(np.minimum(np.maximum(i - window, 0), lb))
            free = np.where(i < la, _word(y == x[:, i:i + 1]) & near & ~used, np.uint64(0))
            first = free & (~free + np.uint64(1))
            used |= first
            matched[:, i] = first != 0
        m = matched.sum(axis=1)
        other = np.unpackbits(used.view(np.uint8).reshape(len(xs), 8), axis=1, bitorder="little")[:, :y.shape[1]].astype(bool)
        left = np.take_along_axis(x, np.argsort(~matched, axis=1, kind="stable"), axis=1)
        right = np.take_along_axis(y, np.argsort(~other, axis=1, kind="stable"), axis=1)
        width = min(left.shape[1], right.shape[1])
        moved = ((left[:, :width] != right[:, :width]) & (np.arange(width) < m[:, None])).sum(axis=1) // 2
        with np.errstate(divide="ignore", invalid="ignore"):
            sim = np.where(m > 0, (m / la + m / lb + (m - moved) / m) / 3.0, np.where((la == 0) & (lb == 0), 1.0, 0.0))
        width = min(JW_MAX_PREFIX, x.shape[1], y.shape[1])
        same = (x[:, :width] == y[:, :width]) & (np.arange(width) < np.minimum(la, lb)[:, None])
        p = np.cumprod(same, axis=1).sum(axis=1)
        return np.where(sim > JW_BOOST_THRESHOLD, sim + p * JW_PREFIX_WEIGHT * (1.0 - sim), sim)

    return _in_chunks(a, b, lanes, jaro_winkler, max)


def token_sort_batch(a: list[str], b: list[str]) -> np.ndarray:
    """``token_sort`` of every pair."""
    x, y = [sorted_tokens(s) for s in a], [sorted_tokens(s) for s in b]
    total = np.array([len(p) + len(q) for p, q in zip(x, y)], np.int64)
    with np.errstate(invalid="ignore"):
        return np.where(total > 0, 1.0 - (total - 2 * lcs_lengths(x, y)) / total, 1.0)


def token_set_batch(a: list[str], b: list[str]) -> np.ndarray:
    """``token_set`` of every pair: the token sets pair by pair, their difference strings in lanes."""
    out = np.zeros(len(a))
    rest, ab, ba, sects = [], [], [], []
    for i, (x, y) in enumerate(zip(a, b)):
        ta, tb = set(x.split()), set(y.split())
        inter = ta & tb
        if not ta or not tb:
            continue
        if inter and (ta <= tb or tb <= ta):
            out[i] = 1.0
            continue
        rest.append(i)
        ab.append(" ".join(sorted(ta - inter)))
        ba.append(" ".join(sorted(tb - inter)))
        sects.append(sum(map(len, inter)) + max(0, len(inter) - 1))
    if rest:
        la, lb, sect = np.array([len(x) for x in ab]), np.array([len(x) for x in ba]), np.array(sects)
        sab, sba = sect + (sect > 0) + la, sect + (sect > 0) + lb
        result = 1.0 - (la + lb - 2 * lcs_lengths(ab, ba)) / (sab + sba)
        padded = np.maximum(1.0 - (1 + la) / (sect + sab), 1.0 - (1 + lb) / (sect + sba))
        out[rest] = np.where(sect > 0, np.maximum(result, padded), result)
    return out


BATCHES = {"jaro-winkler": jaro_winkler_batch, "token-sort-ratio": token_sort_batch, "token-set-ratio": token_set_batch}


def _batch_udf(fn):
    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(fn(a.tolist(), b.tolist()), dtype="float64")

    return score


PAIR_UDFS = {name: _batch_udf(fn) for name, fn in BATCHES.items()}
