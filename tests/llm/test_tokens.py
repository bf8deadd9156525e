import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strata.llm import tokens

TOKENIZER = tokens.default_tokenizer()
TEXTS = [None, "", " ", "  a", "a  b c", "tail ", "line\n next\nand", "\n \t x", "café naïve ñ 日本語 🙂", "a" * 3000, "word " * 2000, "<|endoftext|> x", "a <|endoftext|> b<|endoftext|>", " <|endoftext|>  ", "don't  it's", "x\r\n y", " wide  space", "it's, 's. dogs' 1,2.3%%% a\u0301, x.\nThe end.\n\nNew ...dots a.b,c,", "½, Ⅷ. ª! ²? __x__ $5 #tag##"]


def plain(texts):
    t = Tokenizer.from_file(TOKENIZER)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_cached_words_give_the_tokenizers_ids(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    cache = tokens.WordCache(TOKENIZER)
    for _ in range(3):
        ids, n = cache.encode(pa.array([x or "" for x in TEXTS]))
        got = np.split(ids, np.cumsum(n)[:-1])
        assert [g.tolist() for g in got] == plain(TEXTS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" ab'\n\t é1.%,\u0301²s", max_size=30), min_size=1, max_size=5))
def test_cached_words_on_odd_white_space(texts):
    import pyarrow as pa

    ids, n = tokens.WordCache(TOKENIZER).encode(pa.array(texts))
    assert [g.tolist() for g in np.split(ids, np.cumsum(n)[:-1])] == plain(texts)


def test_the_tokenizer_sees_each_part_once():
    import pyarrow as pa

    asked = []

    class Counting:
        def __init__(self, real):
            self.real = real

        def __getattr__(self, name):
            return getattr(self.real, name)

        def encode_batch_fast(self, texts, **options):
            asked.append(sum(map(len, texts)))
            return self.real.encode_batch_fast(texts, **options)

    cache = tokens.WordCache(TOKENIZER)
    cache.tokenizer = Counting(cache.tokenizer)
    words = [f"w{chr(97 + i)}orɛ́d"[:5] for i in range(26)]
    texts = [f"{'  '.join(words[i:])}, {words[i]}?\n{words[-i]}: x" for i in range(26)]
    for limit in (1000, 0):  # at first the distinct parts, not the texts; then nothing
        asked.clear()
        ids, n = cache.encode(pa.array(texts))
        assert [g.tolist() for g in np.split(ids, np.cumsum(n)[:-1])] == plain(texts)
        assert sum(asked) <= limit < sum(map(len, texts))


def test_kept_parts_stay_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "CACHE_WORDS", 40)
    cache = tokens.WordCache(TOKENIZER)
    often = [f"often{i}" for i in range(10)]
    for k in range(20):
        texts = [" ".join([*often, *(f"rare{k}x{i}" for i in range(9)), "z" * 100 + str(k)])]
        ids, n = cache.encode(pa.array(texts))
        assert ids.tolist() == plain(texts)[0]
        assert len(cache.known) == len(cache.n) == len(cache.at) == len(cache.uses) <= 40 and len(cache.store) < 1000
        assert all(" " + w in cache.known for w in often[1:])
        assert not any("zzz" in w for w in cache.known)


def test_a_worker_holds_one_shard_and_bounded_parts():
    import pyarrow as pa

    words = np.char.add("w", np.random.default_rng(3).integers(0, 1 << 40, 450_000).astype(str))  # next to none of them twice
    texts = [" ".join(words[i : i + 300]) for i in range(0, len(words), 300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array([0] * len(texts), pa.int32())], names=["doc_id", "text", "part"])
    tokens.release_caches()
    tracemalloc.start()
    try:
        got = [b.num_rows for b in tokens.shard_rows(iter([batch]), TOKENIZER, 16, tokens.SHARD_TOKENS)]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        tokens.release_caches()
    assert got == [1] and batch.nbytes > 6e6
    assert most < 130e6


def test_packing_holds_a_plane_at_a_time():
    ids = np.random.default_rng(5).integers(0, 1 << 16, 1 << 22).astype(np.uint16)
    tracemalloc.start()
    try:
        payload = tokens.pack([1], np.array([len(ids)]), ids, 16)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (tokens.unpack(payload)[2].decode() == ids).all()
    assert most < 4.2 * ids.nbytes  # of ids that don't compress


def test_cuts_are_places_where_the_splitter_cuts():
    text = "ab, c  d\nE\n\nf\u00a0 g\u3000 h\u00d7. \u00e9. 1,2 it's".encode()
    where = np.flatnonzero(tokens.cut_flags(np.frombuffer(text, np.uint8))).tolist()
    assert [text[a:b].decode() for a, b in zip([0, *where], [*where, len(text)])] == ["ab", ",", " c", "  d", "\n", "E", "\n\nf\u00a0 g\u3000 h\u00d7.", " \u00e9", ".", " 1", ",2", " it", "'s"]


@pytest.mark.parametrize("n, bits", [(0, 16), (1, 16), (777, 3), (5000, 16), (70000, 17), (65536, 5), (200000, 6)])
def test_wavelet_matrix(n, bits, monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT", 512)
    a = np.random.default_rng(n).integers(0, min(1 << bits, 40), n).astype(np.uint16 if bits <= 16 else np.uint32)
    owners, lengths, wm = tokens.unpack(tokens.pack([3, None], np.array([n, 0]), a, bits))
    assert owners == [3, None] and lengths.tolist() == [n, 0]
    assert (wm.decode() == a).all() and (wm.access(np.arange(n)) == a).all()
    for t in (0, 5, 39, (1 << bits) - 1):
        where = np.flatnonzero(a == t)
        assert wm.occurrences(t).tolist() == where.tolist()
        assert wm.count(t) == len(where) and wm.rank(t, n // 2) == (a[: n // 2] == t).sum()
        assert wm.select(t, 0) == (where[0] if len(where) else -1)
    assert wm.count(1 << bits) == 0 and wm.select(-1, 0) == -1
    with pytest.raises(ValueError):
        tokens.unpack(b"none")


def test_a_count_unpacks_a_part_of_the_file(monkeypatch):
    a = np.random.default_rng(1).integers(0, 50000, 1_000_000).astype(np.uint16)
    payload = tokens.pack([1], np.array([len(a)]), a, 16)
    asked = []
    real = tokens.zstandard.ZstdDecompressor

    class Counting:
        def __init__(self):
            self.z = real()

        def decompress(self, data):
            asked.append(len(data))
            return self.z.decompress(data)

    monkeypatch.setattr(tokens.zstandard, "ZstdDecompressor", Counting)
    wm = tokens.unpack(payload)[2]
    tables = len(asked)
    assert wm.count(777, 1000, 900_000) == (a[1000:900_000] == 777).sum()
    assert len(asked) - tables <= 2 * 16 and sum(asked[tables:]) < 0.2 * len(payload)
    assert int(wm.access(123_456)[0]) == a[123_456]


def test_shards_round_trip(spark, tmp_path):
    rows = [(i * 3 % 17, TEXTS[i % len(TEXTS)], "x") for i in range(40)] + [(None, "no id", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    path = f"file://{tmp_path}/shards"
    tokens.write_shards(df, path, TOKENIZER, shard_tokens=700)
    shards = tokens.read_shards(spark, path)
    assert shards.count() > 3
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.start, r.n_tokens, r.ids_crc32) for r in tokens.shard_documents(shards).collect())
    start = 0
    want = []
    for (doc, text, _), ids in zip(rows, plain([t for _, t, _ in rows])):
        raw = np.array([*ids, 0], "<u4").tobytes()
        want.append(((doc is not None, doc or 0), len(ids) + 1, zlib.crc32(raw)))
    assert sorted((k, n, c) for k, _, n, c in got) == sorted(want)
    for _, s, n, _ in sorted(got, key=lambda r: r[1]):
        assert s == start
        start += n
    assert [k for k, *_ in sorted(got, key=lambda r: r[1])] == sorted(k for k, *_ in got)
    zeros = len(rows) + sum(ids.count(0) for ids in plain([t for _, t, _ in rows]))  # "!" has id 0 too
    assert sum(r.n for r in tokens.token_counts(shards, [0]).collect()) == zeros
    assert tokens.token_occurrences(shards, 0).count() == zeros


def test_empty_table(spark):
    assert tokens.tokenized(spark.createDataFrame([], "doc_id long, text string")).count() == 0
