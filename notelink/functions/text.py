"""Column functions for text: normalisation (T1), pretokenisation (T3), language codes (T10).

Everything here returns a ``Column`` built from JVM-side functions. The Python
versions beside them (``normalize_py``, ``fold``) follow the same rules inside Arrow batches.
Where places in a text are counted (T2, T3), the column is an Arrow function of the text.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# Word characters of the v1 pretokeniser: ASCII letters and digits plus the
# Latin-1 letter ranges.
WORD_CHARS = "0-9A-Za-zÀ-ÖØ-öø-ÿ"
# Word characters of the keyword matcher used by dictionary lookup: ASCII
# digits, ASCII letters and underscore.  Everything else is a boundary.
KEYWORD_CHARS = "0-9A-Za-z_"
# Language codes accepted by the v1 tagger and their canonical form.
LANG_CODES = {"es": "es", "en": "en", "it": "it", "ro": "ro", "cz": "cs", "cs": "cs", "se": "sv", "sv": "sv", "nl": "nl"}
# ---------------------------------------------------------------------------

WORD_RE = f"[{WORD_CHARS}]"
NON_WORD_RE = f"[^{WORD_CHARS}]"
PRETOKEN_RE = f"([{WORD_CHARS}]+|[^{WORD_CHARS}])"
KEYWORD_RE = f"[{KEYWORD_CHARS}]+"


def _strip_marks(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")


def normalize_py(s: str | None) -> str | None:
    """Reference rule: lower-case, canonical decomposition, drop nonspacing marks."""
    if s is None:
        return None
    return _strip_marks(s.lower())


@functools.lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Characters whose decomposition leaves exactly one base character.

    Built by rule from the Unicode database over the Basic Multilingual Plane,
    so ``translate`` + dropping ``\\p{Mn}`` equals NFD + dropping marks for them.
    """
    src, dst = [], []
    for cp in range(0x80, 0x10000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        if unicodedata.category(ch) == "Mn":
            continue
        folded = _strip_marks(ch)
        if folded != ch and len(folded) == 1:
            src.append(ch)
            dst.append(folded)
    return "".join(src), "".join(dst)


@functools.lru_cache(maxsize=1)
def _spelled_table() -> dict[str, str]:
    """The other characters whose decomposition differs: several base characters, or none of the Basic
    Multilingual Plane. Hangul syllables are spelled by arithmetic."""
    out = {}
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp <= 0xDFFF or FIRST_HANGUL <= cp <= LAST_HANGUL:
            continue
        ch = chr(cp)
        if unicodedata.category(ch) != "Mn" and (folded := _strip_marks(ch)) != ch and (cp > 0xFFFF or len(folded) != 1):
            out[ch] = folded
    return out


# Fixed values of the Unicode standard: syllables are leading, vowel and trailing letters in order.
FIRST_HANGUL, LAST_HANGUL = 0xAC00, 0xD7A3
LEADING, VOWELS, TRAILING = 19, 21, 28


def _hangul(ch: Column) -> Column:
    """The letters of a Hangul syllable."""
    i = F.ascii(ch) - FIRST_HANGUL
    leading = "".join(chr(0x1100 + n) for n in range(LEADING))
    vowels = "".join(chr(0x1161 + n) for n in range(VOWELS))
    trailing = "".join(chr(0x11A7 + n) for n in range(1, TRAILING))
    pick = lambda letters, n: F.substring(F.lit(letters), n.cast("int"), 1)
    tail = F.pmod(i, F.lit(TRAILING))
    return F.concat(pick(leading, F.floor(i / (VOWELS * TRAILING)) + 1), pick(vowels, F.floor(F.pmod(i, F.lit(VOWELS * TRAILING)) / TRAILING) + 1),
                    F.when(tail > 0, pick(trailing, tail)).otherwise(""))


@functools.lru_cache(maxsize=1)
def _mark_class() -> str:
    """The nonspacing marks of Python's Unicode database as ranges: in Java's, which may be of another
    version, these are marks or not assigned."""
    marks = [cp for cp in range(0x110000) if unicodedata.category(chr(cp)) == "Mn"]
    ranges: list[list[int]] = []
    for cp in marks:
        if ranges and ranges[-1][1] == cp - 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


def normalize(col: Column | str) -> Column:
    """T1 as a native expression: ``lower`` -> fold precomposed letters -> drop marks.

    Equals :func:`normalize_py`. Characters that decompose into several letters (Hangul syllables and a few
    others) are spelled one by one, in texts that have any.
    """
    c = F.col(col) if isinstance(col, str) else col
    src, dst = _fold_table()
    low = F.translate(F.lower(c), src, dst)
    spelled = _spelled_table()
    table = F.create_map(*[F.lit(x) for kv in spelled.items() for x in kv])
    one = lambda ch: F.when(ch.between(chr(FIRST_HANGUL), chr(LAST_HANGUL)), _hangul(ch)).otherwise(
        F.coalesce(F.try_element_at(table, ch), ch))
    long = F.array_join(F.transform(F.regexp_extract_all(low, F.lit("(?s)(.)"), 1), one), "")
    rare = low.rlike(f"[{chr(FIRST_HANGUL)}-{chr(LAST_HANGUL)}{''.join(c for c in spelled if ord(c) < 0x10000)}\\x{{10000}}-\\x{{10FFFF}}]")
    return F.regexp_replace(F.when(rare, long).otherwise(low), f"[[\\p{{M}}\\p{{Cn}}]&&[{_mark_class()}]]+", "")


def fold(text: str) -> tuple[str, np.ndarray | None]:
    """T1 of one text, and where each of its characters comes from.

    ``idx[p]`` is the place in ``text`` of the normal form's character ``p``
    (``len(norm) + 1`` places, the last is ``len(text)``); ``None`` when no place changes.
    """
    if text.isascii():
        return text.lower(), None
    low = text.replace("\u0130", "i").lower()  # the only letter that two take the place of; its second one is a mark
    table, moved = {}, False
    for ch in set(low):
        if ch > "\x7f" and (piece := _strip_marks(ch)) != ch:
            table[ord(ch)] = piece
            moved |= len(piece) != 1
    norm = low.translate(table)
    if not moved:
        return norm, None
    codes, lens = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32), np.ones(len(low), np.int64)
    for cp, piece in table.items():
        if len(piece) != 1:
            lens[codes == cp] = len(piece)
    return norm, np.append(np.repeat(np.arange(len(low)), lens), len(low))


OFFSETS = T.StructType([
    T.StructField("norm", T.StringType()),
    T.StructField("runs", T.ArrayType(T.StructType([T.StructField("norm_start", T.IntegerType()), T.StructField("start", T.IntegerType())])))])


def list_array(sizes: list[int], values: pa.Array, missing: list[bool] | None = None) -> pa.Array:
    """``values`` as lists of these sizes, one after the other; null where ``missing``."""
    mask = pa.array(missing, pa.bool_()) if missing else None
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values, mask=mask)


@F.arrow_udf(OFFSETS)
def normalize_with_offsets(s: pa.Array) -> pa.Array:
    """T2: the normal form with its offset map, as runs (normalised start, original start) within which places move together."""
    norms, sizes, norm_starts, starts, missing = [], [], [], [], []
    for text in s:
        text = text.as_py()
        missing.append(text is None)
        if text is None:
            norms.append(None)
            sizes.append(0)
            continue
        norm, idx = fold(text)
        at = np.zeros(1, np.int64)
        if idx is not None:
            at = np.flatnonzero(np.diff(idx - np.arange(len(idx)), prepend=1 << 40))
        norms.append(norm)
        sizes.append(len(at))
        norm_starts.append(at)
        starts.append(idx[at] if idx is not None else at)
    whole = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)).cast(pa.int32())
    runs = pa.StructArray.from_arrays([whole(norm_starts), whole(starts)], names=["norm_start", "start"])
    lists = list_array(sizes, runs, missing)
    return pa.StructArray.from_arrays([pa.array(norms, pa.string()), lists], names=["norm", "runs"])


SPACES = "".join(chr(cp) for cp in range(0x10000) if not 0xD800 <= cp <= 0xDFFF and chr(cp).isspace())


def _space_class() -> str:
    chars = [ord(c) for c in SPACES]
    firsts, lasts = ([cp for cp in chars if cp + step not in chars] for step in (-1, 1))
    return "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in zip(firsts, lasts))


SPACE_CLASS = _space_class()


# Where a space is inserted: between adjacent tokens of which neither is white space.
_BOUNDARY = re.compile(rf"(?<=[^{WORD_CHARS}\s])(?=\S)|(?<=[{WORD_CHARS}])(?=[^{WORD_CHARS}\s])")
PRETOKENS = T.StructType([T.StructField("text", T.StringType()), T.StructField("added", T.ArrayType(T.IntegerType()))])


@F.arrow_udf(PRETOKENS)
def _pretokenized(s: pa.Array) -> pa.Array:
    texts, sizes, places, missing = [], [], [], []
    for text in s:
        text = text.as_py()
        missing.append(text is None)
        if text is None:
            texts.append(None)
            sizes.append(0)
            continue
        cuts = [m.start() for m in _BOUNDARY.finditer(text)]
        texts.append(" ".join([text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]))
        sizes.append(len(cuts))
        places.append(np.array(cuts, np.int32) + np.arange(len(cuts), dtype=np.int32))
    added = pa.array(np.concatenate(places) if places else np.zeros(0, np.int32))
    lists = list_array(sizes, added, missing)
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), lists], names=["text", "added"])


def pretokenize(col: Column | str) -> Column:
    """T3: struct(text, added) -- a space between adjacent non-space tokens.

    Tokens are runs of word characters or single other characters.  A space is
    inserted after every token that is followed by another token when neither
    is white space; ``added`` holds the positions of the inserted spaces in the
    new text.  One look-around pass in an Arrow function: nothing is made for each character.
    """
    return _pretokenized(F.col(col) if isinstance(col, str) else col)


def canonical_lang(col: Column | str) -> Column:
    """T10: canonical language code, null when not accepted."""
    c = F.col(col) if isinstance(col, str) else col
    m = F.create_map(*[F.lit(x) for kv in LANG_CODES.items() for x in kv])
    return F.try_element_at(m, F.lower(c))


def strip_text(col: Column | str) -> Column:
    """Python ``str.strip()`` equivalent (white space as Python defines it)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(c, F.lit(SPACES))


def is_blank(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return ~c.rlike(f"[^{SPACE_CLASS}]")
