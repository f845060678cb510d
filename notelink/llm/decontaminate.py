"""Operator 1: benchmark decontamination with an Aho-Corasick automaton.

The automaton runs over word numbers, not characters: every word that occurs in
a benchmark item has a number, every other word of a document is 0, and a
window is a sequence of numbers. Documents are normalised and scanned once, and
hits are mapped back to character offsets of the original text.
"""

from __future__ import annotations

import pickle

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from notelink.llm.common import append_columns

# Bytes of item text in one automaton. A larger benchmark is cut into blocks of
# this size; each is a pass of its own that adds to the spans found so far.
BLOCK_BYTES = 512 * 1024

# Fixed value: the separators of words, and A-Z in lower case.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("contaminated", T.BooleanType()),
]
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def words(text: str | None) -> list[bytes]:
    """Normalised words, as UTF-8."""
    return text.encode().translate(_NORMAL).split() if text else []


def windows(item: list[bytes], n: int) -> list[tuple[bytes, ...]]:
    """All runs of ``n`` words; a shorter item, unless empty, is one window."""
    return [tuple(item[i:i + n]) for i in range(max(1, len(item) - n + 1))] if item else []


class Matcher:
    """One automaton over the windows of a block of items."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        self.number: dict[bytes, int] = {}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        owners: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            for w in windows(words(text), n):
                key = tuple(self.number.setdefault(x, len(self.number) + 1) for x in w)
                owners.setdefault(key, set()).update(() if item_id is None else (item_id,))
        for key, ids in owners.items():
            self.machine.add_word(key, (len(key), frozenset(ids)))
        self.empty = not owners
        if owners:
            self.machine.make_automaton()

    def scan(self, text_words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges of all windows that occur, and the items they belong to."""
        if self.empty or not text_words:
            return [], set()
        get = self.number.get
        seq = tuple([get(w, 0) for w in text_words])
        if not any(seq):
            return [], set()
        found, items = [], set()
        for end, (size, ids) in self.machine.iter(seq):
            found.append((end + 1 - size, end + 1))
            items |= ids
        return found, items


def _char_spans(text: str, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Character offsets of runs of words in the original text."""
    raw = text.encode()
    flat = np.frombuffer(raw.translate(_NORMAL), np.uint8) != 32
    step = np.diff(np.concatenate([[0], flat.view(np.int8), [0]]))
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    char = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # characters up to and with each byte
    return [{"start": int(char[begin[a]] - 1), "end": int(char[end[b - 1] - 1])} for a, b in runs]


def merge_runs(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, limit: int):
    """Blocks of items of at most ``limit`` bytes, one at a time through the driver
    (an item longer than that is a block of its own)."""
    block, size = [], 0
    for i, t in benchmark.selectExpr(f"cast(`{item_id}` as string)", f"cast(`{item_text}` as string)").toLocalIterator():
        n = len((t or "").encode())
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((i, t))
        size += n
    yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                       item_text: str = "text", n: int = 13, share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words, n_hit, items, spans, contaminated``.

    A word is hit if any occurrence of an item's window covers it; ``items``
    are the ids (as sorted strings) of items with an occurring window, ``spans``
    the hit stretches as character offsets of the original text, and a document
    is contaminated when ``n_hit > 0 and share * n_hit >= n_words``.

    Defined cases: null or empty text has no words and is clean; a null item text
    has no windows; an item with a null id can hit but is not listed; repeated
    items count once, repeated documents each for themselves; an empty benchmark
    leaves all documents clean; input columns named like the new ones are
    replaced, a column ``_word_runs`` goes, all others stay as they are.
    """
    blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    block, out = next(blocks), None
    while block is not None:
        following = next(blocks, None)
        payload = docs.sparkSession.sparkContext.broadcast(pickle.dumps((block, n)))
        out = _scan(docs if out is None else out, text, payload, share, out is not None)
        if following is not None:
            out = out.checkpoint()
        block = following
    return out.drop("_word_runs")


def _scan(docs: DataFrame, text: str, payload, share: int, more: bool) -> DataFrame:
    def build():
        matcher = Matcher(*pickle.loads(payload.value))

        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column(text).cast(pa.string()).to_pylist()
            before = [batch.column(f).to_pylist() for f in ("_word_runs", "items")] if more else None
            n_words, n_hit, items, spans, dirty, kept = [], [], [], [], [], []
            for k, t in enumerate(texts):
                w = words(t)
                found, ids = matcher.scan(w)
                if before:
                    found += [(x["start"], x["end"]) for x in before[0][k]]
                    ids |= set(before[1][k])
                runs = merge_runs(found)
                hit = sum(b - a for a, b in runs)
                n_words.append(len(w))
                n_hit.append(hit)
                items.append(sorted(ids))
                spans.append(_char_spans(t, runs) if runs else [])
                kept.append([{"start": a, "end": b} for a, b in runs])
                dirty.append(hit > 0 and share * hit >= len(w))
            return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())),
                    pa.array(spans, pa.list_(_SPAN)), pa.array(dirty, pa.bool_()), pa.array(kept, pa.list_(_SPAN))]

        return each

    return append_columns(docs, [*FIELDS, T.StructField("_word_runs", FIELDS[3].dataType)], build)
