"""The acquisition flow over documents (PIP01): texts stand for raw content, a planted service for requests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import shared_dir
from ..streaming import acquisition
from . import views as v
from .registry import query

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def artefacts(rows: DataFrame) -> DataFrame:
    """A text is sound from 500 characters on, and its capitals are what is made of it; one whose length
    divides by 29 gives a faulty one."""
    text = F.col("raw").cast("string")
    return rows.withColumns({
        "raw_fault": F.when(F.length(text) < 500, "raw_raster_qa_failed"),
        "faults": F.when(F.col("raw").isNotNull() & (F.length(text) % 29 == 0), F.array(F.lit("slope:range"))).when(F.col("raw").isNotNull(), F.array().cast("array<string>")),
        "patch_sha256": F.sha2(F.concat(F.lit("patch:"), text), 256), "made": F.translate(text, LOWER, UPPER).cast("binary"),
    })


def answers(rows: DataFrame) -> DataFrame:
    """Some requests are answered at the third attempt, some in part only, some with the wrong type."""
    k = F.col("item")
    reason = F.when(k % 23 == 0, "unexpected_content_type").when(k % 19 == 0, "partial_response").when((k % 5 == 0) & (F.col("attempt") < 3), "http_503")
    return rows.withColumn("reason", reason).withColumn("raw", F.when(reason.isNull(), F.col("text").cast("binary")))


#: States of the planted cache, first match first.
STATE = """CASE WHEN doc_id % 3 = 0 THEN 'raw_missing' WHEN doc_id % 7 = 1 OR length(text) < 500 THEN 'raw_invalid' WHEN length(text) % 29 = 0 THEN 'representation_invalid'
  WHEN doc_id % 11 = 0 THEN 'processed_missing' WHEN doc_id % 13 = 0 THEN 'processed_invalid' ELSE 'valid' END"""
FETCHED = """CASE WHEN doc_id % 23 = 0 THEN 'unexpected_content_type' WHEN doc_id % 19 = 0 THEN 'retry_exhausted_partial' END"""


@query(
    "pip01_acquired_items",
    f"""WITH s AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), t AS (SELECT *, {STATE} AS state, {FETCHED} AS reason FROM s),
      r AS (SELECT *, state LIKE 'raw%' AS lost, CASE WHEN doc_id % 23 = 0 THEN 1 WHEN doc_id % 19 = 0 THEN 4 WHEN doc_id % 5 = 0 THEN 3 ELSE 1 END AS asked FROM t),
      a AS (SELECT *, CASE WHEN NOT lost THEN CASE state WHEN 'valid' THEN 'cache_verified' WHEN 'representation_invalid' THEN 'representation_generation_failed' ELSE 'processed_regenerated' END
        WHEN reason IS NOT NULL THEN 'download_failed' WHEN length(text) < 500 THEN 'downloaded_raw_rejected' WHEN length(text) % 29 = 0 THEN 'representation_generation_failed' ELSE 'downloaded' END AS action FROM r)
      SELECT doc_id AS item, action, CASE WHEN action IN ('cache_verified', 'processed_regenerated', 'downloaded') THEN 'pass' ELSE 'rejected' END AS status,
        CASE action WHEN 'download_failed' THEN 'not_run' WHEN 'downloaded_raw_rejected' THEN 'failed' ELSE 'pass' END AS raw_qa,
        CASE action WHEN 'download_failed' THEN 'not_run' WHEN 'downloaded_raw_rejected' THEN 'not_run' WHEN 'representation_generation_failed' THEN 'failed' ELSE 'pass' END AS representation_qa,
        CASE action WHEN 'download_failed' THEN reason WHEN 'downloaded_raw_rejected' THEN 'raw_raster_qa_failed' WHEN 'representation_generation_failed' THEN 'slope:range' ELSE '' END AS reasons,
        CASE WHEN action <> 'download_failed' THEN sha256(text) END AS raw_sha256, CASE WHEN status = 'pass' THEN sha256(translate(text, '{LOWER}', '{UPPER}')) END AS processed_sha256,
        CAST(CASE WHEN lost THEN asked ELSE 0 END AS INTEGER) AS attempts, CAST(CASE WHEN lost THEN asked - 1 ELSE 0 END AS INTEGER) AS retries FROM a""",
)
def acquired_items(spark: SparkSession, d: str) -> DataFrame:
    """Every document through a cache that lacks some texts, holds changed ones, and lacks or spoils some capitals."""
    docs = v.table(spark, d, "documents").select(F.col("doc_id").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    k, raw = F.col("item"), F.col("text").cast("binary")
    items = docs.withColumn("expected", F.when(k % 7 == 1, F.sha2(raw, 256)))
    cache = docs.where(k % 3 != 0).select(
        "item", F.when(k % 7 == 1, F.lit("changed").cast("binary")).otherwise(raw).alias("raw"),
        F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, F.lit("spoiled").cast("binary")).otherwise(F.translate("text", LOWER, UPPER).cast("binary")).alias("processed"),
    )
    run = acquisition.acquire(items, cache, artefacts, answers, f"{shared_dir(spark)}/acquisition-{uuid.uuid4().hex}", pause=lambda _: None)
    return run.results.select("item", "action", "status", "raw_qa", "representation_qa", F.array_join("reasons", ",").alias("reasons"), "raw_sha256", "processed_sha256", "attempts", "retries")
