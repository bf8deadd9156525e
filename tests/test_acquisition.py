import pytest
from pyspark.sql import functions as F

from strata.plans.acquisition import artefacts
from strata.streaming import acquisition

LONG = "x" * 501
ITEMS = "item long, expected string, text string"


def answered(asked=None, fail_at=None):
    """A service; item 5 answers at the third attempt, 6 and 7 never. Requests of item, attempt are marked in ``asked``."""

    def request(rows):
        k = F.col("item")
        if asked is not None:
            asked.extend((r.item, r.attempt) for r in rows.select("item", "attempt").collect())
        if fail_at is not None and rows.where(F.col("attempt") == fail_at).count():
            rows = rows.withColumn("attempt", F.when(F.col("attempt") == fail_at, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("attempt")))
        reason = F.when(k == 6, "network").when(k == 7, "http_404").when((k == 5) & (F.col("attempt") < 3), "http_503")
        return rows.withColumn("reason", reason).withColumn("raw", F.when(reason.isNull(), F.col("text").cast("binary")))

    return request


@pytest.fixture
def tables(spark):
    made = LONG.upper()
    digest = spark.range(1).select(F.sha2(F.lit(LONG), 256)).first()[0]
    items = spark.createDataFrame(
        [(1, digest, LONG), (2, None, LONG), (3, None, LONG), (4, digest, LONG), (5, None, LONG), (6, None, LONG), (7, None, LONG), (8, None, "short"), (9, None, "y" * 522), (10, None, "z" * 522)], ITEMS
    )
    cache = spark.createDataFrame(
        [(1, LONG, made), (2, LONG, None), (3, LONG, "spoiled"), (4, "changed", made), (8, "short", None), (9, "y" * 522, None), (99, "other", None)], "item long, raw string, processed string"
    )
    return items, cache.select("item", F.col("raw").cast("binary").alias("raw"), F.col("processed").cast("binary").alias("processed"))


WANTED = {
    1: ("pass", "cache_verified", "pass", "pass", [], 0, 0), 2: ("pass", "processed_regenerated", "pass", "pass", [], 0, 0), 3: ("pass", "processed_regenerated", "pass", "pass", [], 0, 0),
    4: ("pass", "downloaded", "pass", "pass", [], 1, 0), 5: ("pass", "downloaded", "pass", "pass", [], 3, 2), 6: ("rejected", "download_failed", "not_run", "not_run", ["retry_exhausted_network"], 4, 3),
    7: ("rejected", "download_failed", "not_run", "not_run", ["http_404"], 1, 0), 8: ("rejected", "downloaded_raw_rejected", "failed", "not_run", ["raw_raster_qa_failed"], 1, 0),
    9: ("rejected", "representation_generation_failed", "pass", "failed", ["slope:range"], 0, 0), 10: ("rejected", "representation_generation_failed", "pass", "failed", ["slope:range"], 1, 0),
}


def rows_of(run):
    return {r.item: (r.status, r.action, r.raw_qa, r.representation_qa, r.reasons, r.attempts, r.retries) for r in run.results.collect()}


def test_every_branch_is_a_row(spark, tables, tmp_path):
    items, cache = tables
    waits = []
    run = acquisition.acquire(items, cache, artefacts, answered(), f"file://{tmp_path}/run", pause=waits.append)
    assert rows_of(run) == WANTED and run.results.columns == list(acquisition.ROW) and waits == [1, 2, 4]
    aside = {(r.item, r.artefact, r.reason, bytes(r.content)[:7]) for r in run.quarantine.collect()}
    assert aside == {(3, "processed", "processed_qa_failed", b"spoiled"), (4, "raw", "raw_checksum_mismatch", b"changed"), (4, "processed", "source_raw_invalid", b"XXXXXXX"), (8, "raw", "raw_raster_qa_failed", b"short"), (8, "raw", "downloaded_raw_qa_failed", b"short")}
    sizes = {r.item: (r.raw_bytes, r.processed_bytes) for r in run.results.collect()}
    assert sizes[1] == sizes[5] == (501, 501) and sizes[6] == sizes[10] == (None, None)


def test_the_cache_that_is_left_is_sound(spark, tables, tmp_path):
    items, cache = tables
    run = acquisition.acquire(items, cache, artefacts, answered(), f"file://{tmp_path}/run", pause=lambda _: None)
    left = acquisition.cache_after(cache, run)
    assert sorted((r.item, r.processed is not None) for r in left.collect()) == [(1, True), (2, True), (3, True), (4, True), (5, True), (9, False), (10, False), (99, False)]
    asked = []
    again = acquisition.acquire(items, left, artefacts, answered(asked), f"file://{tmp_path}/again", pause=lambda _: None)
    assert {i: r[1] for i, r in rows_of(again).items() if r[0] == "pass"} == dict.fromkeys(range(1, 6), "cache_verified")
    assert {i for i, _ in asked} == {6, 7, 8} and again.changes.where("raw IS NOT NULL").count() == 0


@pytest.mark.parametrize("lost", [1, 2, 3])
def test_a_killed_run_ends_as_one_that_was_not(spark, tables, tmp_path, lost):
    items, cache = tables
    folder = f"file://{tmp_path}/run"
    with pytest.raises(Exception, match="lost"):
        acquisition.acquire(items, cache, artefacts, answered(fail_at=lost), folder, pause=lambda _: None)
    asked = []
    run = acquisition.acquire(items, cache, artefacts, answered(asked), folder, pause=lambda _: None)
    assert rows_of(run) == WANTED and min(a for _, a in asked) == lost
    done = []
    assert rows_of(acquisition.acquire(items, cache, artefacts, answered(done), folder, pause=lambda _: None)) == WANTED and not done


def test_no_items_and_no_cache(spark, tables, tmp_path):
    items, cache = tables
    none = acquisition.acquire(items.limit(0), cache, artefacts, answered(), f"file://{tmp_path}/none", pause=lambda _: None)
    assert none.results.count() == none.changes.count() == none.quarantine.count() == 0
    fresh = acquisition.acquire(items, cache.limit(0), artefacts, answered(), f"file://{tmp_path}/fresh", pause=lambda _: None)
    assert {i for i, r in rows_of(fresh).items() if r[0] == "pass"} == {1, 2, 3, 4, 5} and fresh.quarantine.count() == 1
