import hashlib
import zlib

import numpy as np
import pytest

from strata.llm import sharding

SF = "/root/testdata/sf0.001"


def walk(key, shards):
    """The published walk, in whole numbers."""
    at, step = -1, 0
    while step < shards:
        at = step
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        step = int((at + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return at


def key_of(doc_id):
    return int(hashlib.sha256(("\0" if doc_id is None else str(doc_id)).encode()).hexdigest()[:16], 16)


@pytest.mark.parametrize("shards", [1, 2, 7, 24, 1000])
def test_walk_equals_the_published_one(shards):
    keys = np.random.default_rng(shards).integers(0, 1 << 64, 2000, dtype=np.uint64)
    now, grown = sharding.jump(keys, shards)
    assert now.tolist() == [walk(int(k), shards) for k in keys]
    assert grown.tolist() == [walk(int(k), shards + 1) for k in keys]


def test_one_more_shard_takes_its_share_into_itself():
    keys = np.random.default_rng(0).integers(0, 1 << 64, 100_000, dtype=np.uint64)
    now, grown = sharding.jump(keys, 24)
    assert set(grown[now != grown].tolist()) == {24}
    assert abs((now != grown).mean() - 1 / 25) < 0.003
    assert np.bincount(now, minlength=24).min() > 0.9 * len(keys) / 24


def check(rows, got, shards=24):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), walk(key_of(i), shards), walk(key_of(i), shards + 1)) for i, t in rows
    )
    for s in {r.shard for r in got}:
        inside = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in inside] == list(range(len(inside)))
        assert [r.doc_id for r in inside if r.doc_id is not None] == sorted(r.doc_id for r in inside if r.doc_id is not None)


def test_query_equals_the_plain_walk(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sharding.op13_sharding(spark, SF)
    assert {r.law for r in got.collect()} == {"key"}
    check([(r.doc_id, r.text) for r in docs.collect()], got.collect())


def test_nulls_repeats_long_texts_and_extra_columns(spark):
    rows = [(i % 40, f"text {i % 7}") for i in range(300)] + [(None, None), (None, "x"), (-5, ""), (1 << 62, "é" * 200_000)]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, shard string, slot int").repartition(4)
    check(rows, sharding.placements(df, 5).collect(), 5)
    assert sharding.placements(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_written_shards_hold_every_row(spark, tmp_path):
    df = spark.range(2000).selectExpr("id as doc_id", "concat('t', id) as text")
    sharding.write_shards(df, str(tmp_path / "shards"), 6, tasks_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r.doc_id, r.text, r._shard) for r in back.collect()) == [(i, f"t{i}", walk(key_of(i), 6)) for i in range(2000)]
    assert {r.doc_id for r in sharding.moved(df, 6).collect()} == {i for i in range(2000) if walk(key_of(i), 7) == 6}
