"""Acquisition of items that can be cut off and taken up again: inspect the cache, reuse, make again, quarantine
or fetch. Each item ends as one row with its action and reasons; no fault of an item is an exception.

``items`` has ``item`` (unique, not NULL), ``expected`` (digest of the raw content, or NULL) and whatever a request
needs; ``cache`` has ``item, raw, processed`` (binary, NULL if not there). Two functions do the work of a field:

- ``kernel`` keeps the columns it gets and adds, from ``raw`` alone, ``raw_fault`` (string, NULL if sound), ``faults``
  (array of strings), ``patch_sha256`` and ``made`` (binary). A NULL ``raw`` gives NULLs.
- ``request`` keeps the columns it gets and adds ``reason`` (NULL if there is an answer) and ``raw``.

A run's steps are tables below its folder. A finished step is read again, a half-written one is written again, so
a run that was killed ends with the rows of one that was not, and asks for no finished round twice. Requests go in
rounds over what is still open; a round reads the one before it and nothing else. Content is written only where it
is new or goes to quarantine, and what a request needs only for items that are still to be asked for: a run over a
sound cache writes rows alone.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Reasons that are tried again, what they are called once no attempt is left, attempts at most.
RETRIED = {
    "http_429": "retry_exhausted_http", "http_500": "retry_exhausted_http", "http_502": "retry_exhausted_http", "http_503": "retry_exhausted_http",
    "http_504": "retry_exhausted_http", "network": "retry_exhausted_network", "partial_response": "retry_exhausted_partial",
}
MOST_ATTEMPTS = 4
ROW = ("item", "status", "action", "raw_qa", "representation_qa", "reasons", "raw_sha256", "patch_sha256", "processed_sha256", "raw_bytes", "processed_bytes", "attempts", "retries")

Step = Callable[[DataFrame], DataFrame]


@dataclass
class Run:
    """``results``, a row for each item (``ROW``); ``changes``, ``(item, action, fetched, raw, processed)`` of
    every item that is not verified as it was; ``quarantine``, ``(item, artefact, reason, content)``."""

    results: DataFrame
    changes: DataFrame
    quarantine: DataFrame


def written(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; made first unless it is complete."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def inspected(items: DataFrame, cache: DataFrame, kernel: Step) -> DataFrame:
    """``items`` with the state of their cached artefacts, its reasons, and the content that goes on from here:
    ``bad_raw`` and ``bad_processed`` to quarantine, ``made`` to the cache."""
    held = items.join(cache.select("item", "raw", "processed"), "item", "left").withColumn("raw_sha256", F.sha2("raw", 256))
    sound = F.coalesce(F.col("expected") == F.col("raw_sha256"), F.lit(True))
    seen = kernel(held.withColumn("_bad", F.when(~sound, F.col("raw"))).withColumn("raw", F.when(sound, F.col("raw"))))
    state = (
        F.when(F.col("_bad").isNull() & F.col("raw").isNull(), "raw_missing").when(F.col("raw").isNull() | F.col("raw_fault").isNotNull(), "raw_invalid")
        .when(F.size("faults") > 0, "representation_invalid").when(F.col("processed").isNull(), "processed_missing")
        .when(F.col("processed") != F.col("made"), "processed_invalid").otherwise("valid")
    )
    seen = seen.withColumn("state", state)
    named = F.when(F.col("_bad").isNotNull(), "raw_checksum_mismatch").otherwise(F.coalesce("raw_fault", F.col("state")))
    lost = F.col("state") == "raw_invalid"
    return seen.select(
        "item", *[F.when(F.col("state").startswith("raw"), F.col(c)).alias(c) for c in items.columns if c != "item"], "state", "raw_sha256", "patch_sha256",
        F.when(F.col("state") == "representation_invalid", F.col("faults")).when(F.col("state") == "valid", F.array().cast("array<string>")).otherwise(F.array(named)).alias("state_reasons"),
        F.length("raw").cast("bigint").alias("raw_bytes"), F.length("made").cast("bigint").alias("processed_bytes"), F.sha2("made", 256).alias("processed_sha256"),
        F.when(lost, F.coalesce("_bad", "raw")).alias("bad_raw"), F.when(lost | (F.col("state") == "processed_invalid"), F.col("processed")).alias("bad_processed"),
        F.when(F.col("state").startswith("processed"), F.col("made")).alias("made"),
    )


def rounds(open_items: DataFrame, request: Step, folder: str, most: int = MOST_ATTEMPTS, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """Asks for each item up to ``most`` times; a row for each item with its last ``reason``, ``attempt``, ``raw``.
    Waits min(8, 2^k) seconds before another round, once for all of its items."""
    spark = open_items.sparkSession
    again = F.col("reason").isin(*RETRIED)
    left, tables = open_items, []
    for k in range(1, most + 1):
        if k > 1:
            left = tables[-1].where(again).select(*open_items.columns)
            if left.isEmpty():
                break
            pause(min(8, 2 ** (k - 2)))
        ask = left.withColumn("attempt", F.lit(k))
        needed = {c: F.when(again, F.col(c)) for c in open_items.columns if c != "item"}
        tables.append(written(spark, f"{folder}/attempt-{k}", lambda ask=ask, needed=needed: request(ask).withColumns(needed)))
    log = reduce(DataFrame.unionByName, tables)
    spent = F.create_map(*[F.lit(x) for pair in RETRIED.items() for x in pair])
    return log.where(F.col("reason").isNull() | ~again | (F.col("attempt") == most)).withColumn("reason", F.coalesce(spent[F.col("reason")], F.col("reason")))


def _row(status: Column, action: Column, raw_qa: Column, representation_qa: Column, reasons: Column, attempts: Column) -> list[Column]:
    passed = status == "pass"
    kept = [F.when(passed, F.col(c)).alias(c) for c in ("processed_sha256", "raw_bytes", "processed_bytes")]
    return [
        F.col("item"), status.alias("status"), action.alias("action"), raw_qa.alias("raw_qa"), representation_qa.alias("representation_qa"), reasons.alias("reasons"),
        F.col("raw_sha256"), F.when(raw_qa == "pass", F.col("patch_sha256")).alias("patch_sha256"), *kept,
        attempts.cast("int").alias("attempts"), F.greatest(attempts - 1, F.lit(0)).cast("int").alias("retries"),
    ]


def acquire(items: DataFrame, cache: DataFrame, kernel: Step, request: Step, folder: str, most: int = MOST_ATTEMPTS, pause: Callable[[float], None] = time.sleep) -> Run:
    """Runs, or takes up again, the acquisition below ``folder`` (shared by all executors)."""
    spark = items.sparkSession
    seen = written(spark, f"{folder}/inspected", lambda: inspected(items, cache, kernel))
    lost = F.col("state").isin("raw_missing", "raw_invalid")
    answers = rounds(seen.where(lost).select(*items.columns), request, f"{folder}/requests", most, pause)
    fetched = written(
        spark, f"{folder}/fetched",
        lambda: kernel(answers.withColumn("raw_sha256", F.sha2("raw", 256))).select(
            "item", "attempt", "reason", "raw", "raw_sha256", "raw_fault", "faults", "patch_sha256", "made",
            F.length("raw").cast("bigint").alias("raw_bytes"), F.length("made").cast("bigint").alias("processed_bytes"), F.sha2("made", 256).alias("processed_sha256"),
        ),
    )
    none = F.array().cast("array<string>")
    broken = F.col("state") == "representation_invalid"
    cached = seen.where(~lost).select(*_row(
        F.when(broken, "rejected").otherwise("pass"),
        F.when(broken, "representation_generation_failed").when(F.col("state") == "valid", "cache_verified").otherwise("processed_regenerated"),
        F.lit("pass"), F.when(broken, "failed").otherwise("pass"), F.when(broken, F.col("state_reasons")).otherwise(none), F.lit(0),
    ))
    refused, unsound, faulty = F.col("reason").isNotNull(), F.col("raw_fault").isNotNull(), F.size("faults") > 0
    new = fetched.select(*_row(
        F.when(refused | unsound | faulty, "rejected").otherwise("pass"),
        F.when(refused, "download_failed").when(unsound, "downloaded_raw_rejected").when(faulty, "representation_generation_failed").otherwise("downloaded"),
        F.when(refused, "not_run").when(unsound, "failed").otherwise("pass"), F.when(refused | unsound, "not_run").when(faulty, "failed").otherwise("pass"),
        F.when(refused, F.array("reason")).when(unsound, F.array("raw_fault")).when(faulty, F.col("faults")).otherwise(none), F.col("attempt"),
    ))
    good = ~refused & ~unsound
    changes = seen.where(F.col("state").startswith("processed")).select("item", F.lit(False).alias("fetched"), F.lit(None).cast("binary").alias("raw"), F.col("made").alias("processed"))
    changes = changes.unionByName(fetched.select("item", F.lit(True).alias("fetched"), F.when(good, F.col("raw")).alias("raw"), F.when(good & ~faulty, F.col("made")).alias("processed")))
    aside = [
        seen.where("bad_raw IS NOT NULL").select("item", F.lit("raw").alias("artefact"), F.element_at("state_reasons", 1).alias("reason"), F.col("bad_raw").alias("content")),
        seen.where("bad_processed IS NOT NULL").select("item", F.lit("processed").alias("artefact"), F.when(lost, "source_raw_invalid").otherwise("processed_qa_failed").alias("reason"), F.col("bad_processed").alias("content")),
        fetched.where(~refused & unsound).select("item", F.lit("raw").alias("artefact"), F.lit("downloaded_raw_qa_failed").alias("reason"), F.col("raw").alias("content")),
    ]
    return Run(cached.unionByName(new), changes, reduce(DataFrame.unionByName, aside))


def cache_after(cache: DataFrame, run: Run) -> DataFrame:
    """The cache that a run leaves: its new artefacts over the old ones, without what it put aside. An item whose
    raw content could not be had has no row."""
    new = run.changes.select("item", "fetched", F.col("raw").alias("_raw"), F.col("processed").alias("_processed"))
    both = cache.select("item", "raw", "processed").join(new, "item", "full")
    replaced = F.coalesce("fetched", F.lit(False))
    out = both.select("item", F.when(replaced, F.col("_raw")).otherwise(F.col("raw")).alias("raw"), F.when(F.col("fetched").isNotNull(), F.col("_processed")).otherwise(F.col("processed")).alias("processed"))
    return out.where("raw IS NOT NULL")
