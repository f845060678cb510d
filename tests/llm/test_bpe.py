import base64
import hashlib
import unicodedata

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from notelink.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")
PAYLOAD = open(RANKS, "rb").read()
RANK = {base64.b64decode(a): int(b) for a, b in map(bytes.split, PAYLOAD.splitlines())}
LIB = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANK, special_tokens={})
CODEC = bpe.Codec(PAYLOAD)
PAT = regex.compile(P.PATTERN)

HARD = ["", " ", "  ", "\n", " \n ", "a", "a  b", "a \n b", "it's we'll I'VE they've 'd'", "'s's 's", "''s", "!'s", " 're", "\n'll",
        "x y   z", "naïve ÀÉ ñ 日本語 ١٢٣ ² Ⅷ", "a\x1cb\x1f c", "😀 👩‍👩‍👧 $%^ &*()", "\x00\x00 \x00", "<|endoftext|>", "don't", "x'", "x''ll",
        "a" * 300, " " * 300, "ab" * 5000, "'" * 70 + "s", "\t\t x\t\ty", "1a1 1 a1", "x 's", "end  "]


def pieces(texts):
    joined = "\n".join([*texts, ""])
    size = np.array([len(t) for t in texts], np.int64)
    stops = np.cumsum(size + 1) - 1
    sym = bpe.symbols(np.frombuffer(joined.encode("utf-32-le"), np.uint32), stops)
    starts = bpe.piece_starts(sym)
    cuts = [*starts.tolist(), len(sym)]
    out, at = [[] for _ in texts], 0
    for a, b in zip(cuts, cuts[1:]):
        if sym[a] == bpe.STOP:
            at += 1
        else:
            out[at].append(joined[a:b])
    return out


def test_pieces_equal_the_pattern():
    assert pieces(HARD) == [PAT.findall(t) for t in HARD]


ALPHABET = st.text(alphabet="aesltrvmd' \n\t1!é日 \x1c", max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(ALPHABET, st.text(max_size=30)), max_size=6))
def test_pieces_and_ids_of_random_texts(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    if texts:
        # the libraries' Unicode databases differ in age: classes of characters that ours lacks may differ
        known = ["".join(c for c in t if unicodedata.category(c) != "Cn") for t in texts]
        assert pieces(known) == [PAT.findall(t) for t in known]
        ids, first = CODEC.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [LIB.encode_ordinary(t) for t in texts]


def test_long_pieces_equal_short_merging():
    rng = np.random.default_rng(3)
    for _ in range(50):
        raw = bytes(rng.choice(list(b"abcethion"), int(rng.integers(65, 400))))
        assert bpe._merge_long(raw, RANK) == LIB._encode_single_piece(raw)


def test_columns_round_trip_and_defined_cases(spark):
    rows = [(i, t, "x") for i, t in enumerate(HARD)] + [(None, "null key", None), (7, None, "n"), (0, HARD[7], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    out = bpe.decode(bpe.encode(df, RANKS), RANKS)
    assert out.columns == ["doc_id", "text", "ids", "token_ends", "decoded"]
    got = out.withColumn("sha", bpe.ids_digest()).collect()
    assert len(got) == len(rows)
    for r in got:
        t = r.text or ""
        want = LIB.encode_ordinary(t)
        assert list(r.ids) == want and bytes(r.decoded).decode() == t
        assert list(r.token_ends) == np.cumsum([len(LIB.decode_single_token_bytes(i)) for i in want]).tolist()
        assert r.sha == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert bpe.decode(bpe.encode(df.limit(0), RANKS), RANKS).count() == 0


def test_wrong_ids_are_an_error():
    with pytest.raises(ValueError):
        CODEC.decode(np.array([50_300]), np.array([0, 1]), np.array([1], np.int32))
    with pytest.raises(ValueError):
        CODEC.decode(np.array([64]), np.array([0, 1]), np.array([5], np.int32))


def test_query_equals_the_library(spark):
    import __spark_entry__ as E
    from tests.conftest import SF

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in E.queries()["op4_byte_bpe"](spark, SF).collect():
        ids = LIB.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_equal_pieces_are_merged_once_and_side_by_side(monkeypatch):
    rows = []
    old = bpe.Pairs.merged
    monkeypatch.setattr(bpe.Pairs, "merged", lambda self, raw, size: rows.append(len(raw)) or old(self, raw, size))
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("qxzjvkéß日"), int(n))) for n in rng.integers(1, 50, 300)]
    text = " ".join(rng.choice(words, 5000)) + " \0 a\0 a a\0\0 aaaaaaaa aaaaaaa\0"
    ids, first = CODEC.encode([text, "", text])
    assert ids[:first[1]].tolist() == LIB.encode_ordinary(text) == ids[first[2]:].tolist()
    assert 0 < sum(rows) <= 2 * len(words) and len(rows) < 20


def test_pieces_with_one_hash_are_told_apart(monkeypatch):
    """Where hashes clash, bytes decide."""
    monkeypatch.setattr(bpe, "fold", lambda h, x: h & np.uint64(3))
    codec = bpe.Codec(PAYLOAD)
    text = "the theqx qxthe an anqx \u00e9t\u00e9qx " * 5
    assert codec.encode([text])[0].tolist() == LIB.encode_ordinary(text)


def test_decoding_builds_nothing_for_encoding():
    codec = bpe.Codec(PAYLOAD)
    ids = np.array([RANK[b"a"], RANK[b"b"]], np.int32)
    first = np.array([0, 2])
    data, at = codec.decode(ids, first, codec.ends(ids, first))
    assert data.tobytes() == b"ab" and at.tolist() == [0, 2]
    assert not {"pairs", "tokens"} & set(vars(codec))
    assert codec.encode(["qzxjkv"])[0].tolist() == LIB.encode_ordinary("qzxjkv") and {"pairs", "tokens"} <= set(vars(codec))


def test_texts_are_encoded_in_small_slabs(spark):
    from pyspark.sql import types as T

    from notelink.llm.common import append_columns

    def build():
        return lambda part: [pa.array([part.num_rows] * part.num_rows, pa.int64())]

    docs = spark.range(0, 40, 1, 1).selectExpr("id", "repeat('one two ', 12500) AS text")
    got = append_columns(docs, [T.StructField("together", T.LongType())], build, slab=bpe.SLAB_BYTES).collect()
    assert len(got) == 40 and max(r.together for r in got) <= 10  # of 100,000 bytes each
    assert all(r.ids == LIB.encode_ordinary("one two " * 12500) for r in bpe.encode(docs.limit(15), RANKS).collect())


def test_freed_memory_is_given_back():
    import re

    from notelink.llm.common import give_back

    def held():
        with open("/proc/self/smaps_rollup") as f:
            return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", f.read()))) // 1024

    blocks = [np.ones(100_000, np.uint8) for _ in range(1500)]
    last, before = blocks[-1], held()
    del blocks
    give_back()
    assert before - held() > 100 and last[0] == 1
