import os

import numpy as np
import pytest

from notelink.llm import training_order as to
from notelink.llm.common import written


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 1000, 65_537])
def test_permutation_is_one_to_one_and_keyed(n):
    p = to.Permutation(n, 7)
    s = p.slots(np.arange(n))
    assert sorted(s.tolist()) == list(range(n))
    assert (p.numbers(s) == np.arange(n)).all()
    if n >= 100:
        assert (s != to.Permutation(n, 8).slots(np.arange(n))).any()
        assert abs(np.corrcoef(s, np.arange(n))[0, 1]) < 0.3


ROWS = [(1, "a" * 10), (2, "b" * 25), (2, "b" * 25), (3, None), (4, ""), (None, "né" * 9), (5, "x"), (6, "long " * 3000), (7, "nul\0 and\nline")]


def test_every_sequence_once_in_fixed_places(spark):
    df = written(spark.createDataFrame(ROWS, "doc_id long, text string").withColumnRenamed("text", "t"), "t").repartition(3)
    df = written(df, "t2")
    shards = to.write_shards(df, text="t", ids=8, per_shard=100)
    rows = to.read_shards(spark, shards).orderBy("slot").collect()
    want = sorted((k or -1, i, t.encode()[a:a + 8]) for k, t in ROWS if t for i, a in enumerate(range(0, len(t.encode()), 8)))
    assert sorted((r.key or -1, r.part, bytes(r.ids)) for r in rows) == want
    assert [r.slot for r in rows] == list(range(len(want))) and shards.sequences == len(want)
    assert all(r.shard == r.slot // 100 and r.n_ids == len(r.ids) for r in rows)
    # resumable: any range by Spark, and by seeking
    assert [r.slot for r in to.read_shards(spark, shards, 95, 120).orderBy("slot").collect()] == list(range(95, 215))
    for first in (0, 99, 100, len(want) - 1, len(want)):
        got = list(to.iterate(shards, first))
        assert got == [(r.slot, bytes(r.ids)) for r in rows[first:]]


def test_same_seed_same_order_other_seed_another(spark):
    df = written(spark.createDataFrame(ROWS, "doc_id long, text string"), "t")
    read = lambda s: [(r.slot, r.key, r.part) for r in to.read_shards(spark, to.write_shards(df, ids=8, seed=s)).orderBy("slot").collect()]
    assert read(1) == read(1) != read(2)


def test_empty_and_unstable_inputs(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    shards = to.write_shards(df)
    assert shards.sequences == 0 and to.read_shards(spark, shards).count() == 0 and list(to.iterate(shards)) == []
    def changing(batches):
        for b in batches:
            yield b.assign(text=["a" * int.from_bytes(os.urandom(2), "big") for _ in range(len(b))])

    other = spark.range(50).withColumnRenamed("id", "doc_id").mapInPandas(changing, "doc_id long, text string")
    with pytest.raises(Exception, match="differ between two runs|not complete"):
        to.write_shards(other)
    with pytest.raises(ValueError):
        to.write_shards(df, ids=1 << 16)


def test_query_returns_all_texts(spark):
    """The query's sequences are the ids that the tiktoken library gives by the same rank file, 512 to a sequence."""
    import hashlib

    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    import __spark_entry__ as E
    from notelink.llm.queries import RANKS
    from tests.conftest import SF

    library = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(RANKS), special_tokens={})
    got = sorted((r.doc_id, r.part, r.ids_sha256) for r in E.queries()["op2_training_order"](spark, SF).collect())
    texts = [(r.doc_id, np.array(library.encode_ordinary(r.text), "<u2")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got == sorted((k, i, hashlib.sha256(t[a:a + 512].tobytes()).hexdigest()) for k, t in texts for i, a in enumerate(range(0, len(t), 512)))


def test_reading_by_ranges_and_whole_files_agree(spark, monkeypatch):
    """Small ranges, and a store in which workers cannot seek."""
    df = written(spark.createDataFrame(ROWS, "doc_id long, text string"), "t")
    shards = to.write_shards(df, ids=8, per_shard=100)
    want = list(to.iterate(shards))
    monkeypatch.setattr(to, "READ_RECORDS", 7)
    for seekable in (True, False):
        monkeypatch.setattr(to, "_seekable", lambda path, ok=seekable: ok)
        for first, count in ((0, None), (93, 240), (99, 1), (len(want) - 1, 5)):
            rows = to.read_shards(spark, shards, first, count).orderBy("slot").collect()
            assert [(r.slot, bytes(r.ids)) for r in rows] == want[first:None if count is None else first + count]


def test_shards_too_large_for_one_buffer_are_refused(spark):
    with pytest.raises(ValueError):
        to.write_shards(spark.createDataFrame(ROWS, "doc_id long, text string"), ids=60_000, per_shard=65_536)


def test_shards_hold_ids_of_the_rank_file(spark):
    import hashlib

    import __spark_entry__ as E
    from notelink.llm import bpe
    from notelink.llm.queries import RANKS
    from tests.conftest import SF

    with open(RANKS, "rb") as f:
        codec = bpe.Codec(f.read())
    pieces = {i: t for t, i in codec.ranks.items()}
    cut = lambda t, n: [x[a:a + n] for x in [codec.encode([t or ""])[0]] for a in range(0, len(x), n)]
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    shards = to.write_shards(df, ids=8, per_shard=100, rank_file=RANKS)
    rows = to.read_shards(spark, shards).orderBy("slot").collect()
    assert shards.width == 2 and [r.slot for r in rows] == list(range(shards.sequences))
    ids = [np.frombuffer(r.ids, "<u2") for r in rows]
    assert max(x.max() for x in ids) > 255 and all(len(x) == r.n_ids for x, r in zip(ids, rows))
    got = sorted((r.key or -1, r.part, x.tolist()) for r, x in zip(rows, ids))
    assert got == sorted((k or -1, i, x.tolist()) for k, t in ROWS for i, x in enumerate(cut(t, 8)))
    assert b"".join(pieces[i] for k, _, x in got if k == 6 for i in x) == ROWS[7][1].encode()
    assert list(to.iterate(shards, 99)) == [(r.slot, bytes(r.ids)) for r in rows[99:]]
    # the query
    got = sorted((r.doc_id, r.part, r.n_ids, r.ids_sha256) for r in E.queries()["op2_training_order"](spark, SF).collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert got == sorted((r.doc_id, i, len(x), hashlib.sha256(x.astype("<u2").tobytes()).hexdigest()) for r in docs for i, x in enumerate(cut(r.text, 512)))


def test_moved_ids_are_compressed_together(spark):
    """One row for each shard, which gives every sequence back, and takes less than sequences that are compressed alone."""
    import zstandard

    rng = np.random.default_rng(5)
    size = rng.integers(1, 513, 600)
    ids = (rng.zipf(1.3, int(size.sum())) * 37 % 50_257).astype("<u2")
    head = np.zeros(600, to.HEAD)
    head["slot"], head["n"], head["key"] = rng.permutation(600), size, np.arange(600)
    begin = np.cumsum(size) - size
    book = np.argsort(-np.bincount(ids, minlength=1 << 16), kind="stable")
    half = int(begin[300])
    held = [(head[:300], begin[:300], ids[:half]), (head[300:], begin[300:] - half, ids[half:])]
    got, moved = {}, 0
    rows = [b for b in to._sends(held, 200, 2, np.argsort(book))]
    assert sorted(b.column("shard")[0].as_py() for b in rows) == [0, 1, 2]
    for b in rows:
        packed, data = (b.column(n)[0].as_py() for n in ("head", "data"))
        moved += len(packed) + len(data)
        own, flat = to.unsqueeze(packed, to.HEAD), to._swapped(to.unsqueeze(data, "<u2"), book)
        end = np.cumsum(own["n"].astype(int))
        for h, a, z in zip(own, [0, *end[:-1]], end):
            assert h["slot"] // 200 == b.column("shard")[0].as_py()
            got[int(h["key"])] = (int(h["slot"]), flat[a:z].tolist())
    assert got == {i: (int(head["slot"][i]), ids[a:a + n].tolist()) for i, (a, n) in enumerate(zip(begin, size))}
    alone = sum(len(zstandard.ZstdCompressor(level=1).compress(ids[a:a + n].tobytes())) for a, n in zip(begin, size))
    assert moved < 0.85 * alone
