"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A key's shard comes from a walk of a linear congruential generator seeded with the key: no ring table, no
state, the same in every task. The walk for n + 1 shards is the one for n with at most one step more, which
leads to the new shard; so appending a shard moves 1 / (n + 1) of the keys, all of them into it.

The stable key of a document is a hash of its id. Rows get gapless slots in their shard from a sort over all
partitions and counts before each, so that no shard is gathered in one task.

Defined results: rows of one id are in one shard, whatever their text; a null id is a key like any other; a
null text has no bytes; rows that are alike in all that is returned get neighbouring slots; an empty table
gives an empty result; further columns play no part, or are carried along by ``sharded``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .mixing import ranked

SHARDS = 24
ROW_BYTES = 8
FILE_ROWS = 1_000_000
# Fixed value: the published multiplier of the generator.
MULTIPLIER = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each unsigned 64-bit key among ``shards`` and among one more."""
    state = keys.astype(np.uint64)
    now, grown = np.zeros(len(keys), np.int32), np.zeros(len(keys), np.int32)
    at, open_ = np.zeros(len(keys), np.int64), np.arange(len(keys))
    while len(open_):
        state[open_] = state[open_] * MULTIPLIER + np.uint64(1)
        step = (at[open_] + 1) * (float(1 << 31) / ((state[open_] >> np.uint64(33)).astype(np.float64) + 1))
        at[open_] = step.astype(np.int64)
        inside = open_[at[open_] < shards]
        now[inside] = at[inside]
        open_ = open_[at[open_] <= shards]
        grown[open_] = at[open_]
    return now, grown


def stable_key(*parts: Column | str) -> Column:
    """A 64-bit key from columns: the first digits of a SHA-256 of their text."""
    columns = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("\0")) for p in parts]
    h = F.sha2(F.concat_ws("\x1f", *columns), 256)
    high, low = (F.conv(F.substring(h, at, 8), 16, 10).cast("long") for at in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def shard_of(key: Column, shards: int = SHARDS) -> Column:
    """``struct<shard int, grown_shard int>`` of a 64-bit key: its shard among ``shards`` and among one more."""
    if shards < 1:
        raise ValueError("at least one shard")

    @F.pandas_udf("shard int, grown_shard int")
    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for keys in batches:
            now, grown = jump(keys.to_numpy(np.int64).view(np.uint64), shards)
            yield pd.DataFrame({"shard": now, "grown_shard": grown})

    return walk(key)


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with ``_shard`` and ``_grown_shard``."""
    put = docs.withColumn("_put", shard_of(stable_key("doc_id"), shards))
    return put.select(*docs.columns, F.col("_put.shard").alias("_shard"), F.col("_put.grown_shard").alias("_grown_shard"))


def placements(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot, grown_shard)`` of every row; slots follow the id."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text").cast("long"), F.lit(0)) + ROW_BYTES).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    put = rows.withColumn("_put", shard_of(stable_key("doc_id"), shards)).select(*rows.columns, "_put.shard", "_put.grown_shard")
    return ranked(put, "shard", ["doc_id", "text_crc32", "size"]).withColumnRenamed("rank", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, tasks_per_shard: int = 1) -> None:
    """Writes ``docs`` as ``_shard=<n>`` folders of Parquet files of at most ``FILE_ROWS`` rows. A shard is
    dealt over ``tasks_per_shard`` tasks by its keys."""
    put = sharded(docs, shards).drop("_grown_shard").withColumn("_task", F.pmod(F.xxhash64("doc_id"), F.lit(tasks_per_shard)))
    dealt = put.repartition(shards * tasks_per_shard, "_shard", "_task").sortWithinPartitions("_shard", "doc_id").drop("_task")
    dealt.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("_shard").parquet(path)


def moved(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The rows of ``docs`` that one more shard takes: what a growing set of shards has to rewrite."""
    return sharded(docs, shards).where(F.col("_grown_shard") == shards).select(*docs.columns, "_shard")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = placements(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


#: The same rows; the checksum is linear over bits: what a byte adds depends on its distance from the end (``w``).
OP13_SQL = """WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS bytes, sha256(coalesce(CAST(doc_id AS VARCHAR), chr(0))) AS h FROM documents),
  t AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(CAST(b AS UBIGINT), CAST(range(8) AS UBIGINT[])), lambda c, k: xor(c >> 1, CAST(3988292384 AS UBIGINT) * (c & 1))) AS c FROM range(256) x(b))),
  w(k, v) AS (SELECT CAST(0 AS BIGINT), list_append(list_transform(range(8), lambda b: t[(1 << b) + 1]), CAST(4294967295 AS UBIGINT)) FROM t
    UNION ALL SELECT k + 1, list_transform(v, lambda c: xor(c >> 8, t[CAST(c & 255 AS BIGINT) + 1])) FROM w, t WHERE k < (SELECT max(bytes) FROM d)),
  b AS (SELECT r, bytes, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x, unnest(range(bytes)) AS i FROM d),
  s AS (SELECT r, bit_xor(list_reduce(list_prepend(CAST(0 AS UBIGINT), list_transform(range(8), lambda j: v[j + 1] * ((CAST('0x' || x AS UBIGINT) >> j) & 1))), lambda p, q: xor(p, q))) AS c FROM b JOIN w ON k = bytes - 1 - i GROUP BY r),
  j(r, state, place) AS (SELECT r, CAST('0x' || substr(h, 1, 16) AS UHUGEINT), CAST(0 AS BIGINT) FROM d UNION ALL
    SELECT r, z, CAST(floor(least((place + 1) * (2147483648.0::DOUBLE / CAST((z >> 33) + 1 AS DOUBLE)), 1e15)) AS BIGINT) FROM (SELECT r, place, (state * 2862933555777941757 + 1) % 18446744073709551616 AS z FROM j WHERE place < 25)),
  g AS (SELECT r, max(place) FILTER (place < 24) AS shard, max(place) FILTER (place < 25) AS grown_shard FROM j GROUP BY r)
  SELECT doc_id, bytes + 8 AS size, CAST(xor(xor(coalesce(s.c, 0), w.v[9]), 4294967295) AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY doc_id, xor(xor(coalesce(s.c, 0), w.v[9]), 4294967295), bytes) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
  FROM d JOIN w ON w.k = bytes JOIN g USING (r) LEFT JOIN s USING (r)"""
