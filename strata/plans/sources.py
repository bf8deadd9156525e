"""Sources, masked reads and resumable state (SRC, SNK, PIP)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.index import content_digest, masked_index
from . import views as v
from .registry import query


@query("src03_filtered_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def filtered_scan(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("src04_masked_scan", f"SELECT sample_id, block, CASE WHEN block NOT IN (3, 7, 11) THEN label END AS label FROM ({v.SAMPLES})")
def masked_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = v.samples(spark, d).withColumn("partition", F.when(F.col("block").isin(3, 7, 11), "final_test").otherwise("train"))
    return masked_index(rows, "partition", "final_test", ["label"]).select("sample_id", "block", "label")


@query("src08_key_lookup", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def key_lookup(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "documents").select("doc_id", "n_chars").join(v.table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi")


@query("snk05_content_digest")
def digest(spark: SparkSession, d: str) -> DataFrame:
    rows = v.table(spark, d, "orders")
    return rows.agg(content_digest(rows).alias("digest"))


@query("pip01_pending_items", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NOT NULL THEN 'reused' WHEN length(d.text) < 500 THEN 'rejected' ELSE 'processed' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY status")
def pending(spark: SparkSession, d: str) -> DataFrame:
    done = v.table(spark, d, "labels").select("doc_id", F.lit(True).alias("done"))
    rows = v.table(spark, d, "documents").select("doc_id", F.length("text").alias("n")).join(done, "doc_id", "left")
    return rows.groupBy(F.when(F.col("done"), "reused").when(F.col("n") < 500, "rejected").otherwise("processed").alias("status")).agg(F.count("*").alias("n"))
