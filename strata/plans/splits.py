"""Splits and contracts (SPL, CON, SET)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contracts, splits
from . import views as v
from .keys_text import hash_sql
from .registry import query

RANDOM = f"""SELECT s.*, coalesce(p.partition, 'train') AS partition FROM ({v.SAMPLES}) s LEFT JOIN (SELECT observation_group, CASE WHEN n <= 100 THEN 'final_test' WHEN n <= 200 THEN 'development' ELSE 'train' END AS partition
  FROM (SELECT observation_group, row_number() OVER (ORDER BY {hash_sql('split-v1', 'observation_group')}, observation_group) AS n FROM (SELECT DISTINCT observation_group FROM ({v.SAMPLES})))) p USING (observation_group)"""
BLOCKS = f"SELECT *, CASE WHEN block IN (3, 7, 11) THEN 'final_test' WHEN block IN (1, 5) THEN 'development' ELSE 'train' END AS partition FROM ({v.SAMPLES})"


def _random(spark: SparkSession, d: str) -> DataFrame:
    return splits.group_random_split(v.samples(spark, d), "observation_group", 100, 100, "split-v1")


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return splits.block_split(v.samples(spark, d), "block", [3, 7, 11], [1, 5])


@query("spl01_group_random", f"SELECT sample_id, partition FROM ({RANDOM})")
def group_random(spark: SparkSession, d: str) -> DataFrame:
    return _random(spark, d).select("sample_id", "partition")


@query("spl02_geographic", f"SELECT sample_id, partition FROM ({BLOCKS})")
def geographic(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("sample_id", "partition")


def violations_sql(rows: str) -> str:
    return f"""SELECT 'repeated_id' AS rule, CAST(sample_id AS VARCHAR) AS key FROM ({rows}) GROUP BY sample_id HAVING count(*) > 1
  UNION ALL SELECT 'group_crosses', CAST(observation_group AS VARCHAR) FROM ({rows}) GROUP BY observation_group HAVING count(DISTINCT partition) > 1
  UNION ALL SELECT 'component_crosses', component FROM ({rows}) WHERE component <> '' GROUP BY component HAVING count(DISTINCT partition) > 1
  UNION ALL SELECT 'class_imbalance', partition FROM ({rows}) GROUP BY partition HAVING sum(label * 2 - 1) <> 0"""


@query("spl03_random_violations", violations_sql(RANDOM))
def random_violations(spark: SparkSession, d: str) -> DataFrame:
    return splits.integrity_violations(_random(spark, d), "sample_id")


@query("spl03_block_violations", violations_sql(BLOCKS))
def block_violations(spark: SparkSession, d: str) -> DataFrame:
    return splits.integrity_violations(_blocks(spark, d), "sample_id")


UNIT = "coalesce(nullif(component, ''), CAST(observation_group AS VARCHAR))"
FOLDS = f"SELECT *, block % 5 AS fold FROM ({v.SAMPLES})"


@query("spl04_fold_counts", f"SELECT fold, count(*) AS rows, count(*) FILTER (label = 1) AS positives, count(DISTINCT block) AS blocks, count(DISTINCT {UNIT}) AS units FROM ({FOLDS}) GROUP BY fold")
def fold_counts(spark: SparkSession, d: str) -> DataFrame:
    s = v.samples(spark, d).withColumn("fold", F.col("block") % 5)
    return s.groupBy("fold").agg(F.count("*").alias("rows"), F.count_if(F.col("label") == 1).alias("positives"), F.count_distinct("block").alias("blocks"), F.count_distinct(splits.unit_column()).alias("units"))


@query("spl05_training_units", f"SELECT unit FROM (SELECT DISTINCT {UNIT} AS unit FROM ({FOLDS}) WHERE fold <> 2) ORDER BY {hash_sql('training-v1:2:0.25', 'unit')}, unit LIMIT (SELECT greatest(1, CAST(round_even(count(DISTINCT {UNIT}) * 0.25, 0) AS BIGINT)) FROM ({FOLDS}) WHERE fold <> 2)")
def training_units(spark: SparkSession, d: str) -> DataFrame:
    s = v.samples(spark, d).withColumn("fold", F.col("block") % 5)
    return splits.training_units(s, splits.unit_column(), 2, 0.25, "training-v1")


@query("spl07_assignment_digests", f"SELECT block, sha256(string_agg(CAST(sample_id AS VARCHAR) || ':' || partition, chr(10) ORDER BY sample_id) || chr(10)) AS digest FROM ({BLOCKS}) GROUP BY block")
def assignment_digests(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.metrics import inventory_digest

    return inventory_digest(_blocks(spark, d), ["block"], F.concat_ws(":", F.col("sample_id").cast("string"), "partition"), "sample_id")


@query("spl09_partition_summary", f"SELECT partition, count(*) AS rows, count(DISTINCT block) AS blocks, count(DISTINCT {UNIT}) AS units, CAST(sum(label) AS BIGINT) AS positives, CAST(sum(1 - label) AS BIGINT) AS backgrounds FROM ({RANDOM}) GROUP BY partition")
def partition_summary(spark: SparkSession, d: str) -> DataFrame:
    return splits.partition_summary(_random(spark, d))


@query("spl10_paired_union", "SELECT id, role FROM (SELECT c_custkey AS id, 'positive' AS role FROM customer UNION ALL SELECT s_suppkey + 1000000, 'background' FROM supplier)")
def paired_union(spark: SparkSession, d: str) -> DataFrame:
    a = v.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("positive").alias("role"))
    return a.unionByName(v.table(spark, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("id"), F.lit("background").alias("role")))


@query("con01_index_violations", """SELECT 'label' AS rule, CAST(doc_id AS VARCHAR) AS key FROM documents WHERE NOT coalesce(lang IN ('en', 'de', 'fr'), false) UNION ALL SELECT 'length', CAST(doc_id AS VARCHAR) FROM documents WHERE NOT coalesce(n_chars = length(text), false)
  UNION ALL SELECT 'repeated_content', key FROM (SELECT sha256(text) AS key FROM documents GROUP BY 1 HAVING count(*) > 1)""")
def index_violations(spark: SparkSession, d: str) -> DataFrame:
    docs = v.table(spark, d, "documents")
    rows = contracts.row_violations(docs, "doc_id", {"label": F.col("lang").isin("en", "de", "fr"), "length": F.col("n_chars") == F.length("text")})
    return rows.unionAll(contracts.repeated(docs.select(F.sha2("text", 256).alias("h")), "h", "repeated_content"))


@query("con03_input_reasons", "SELECT page_id, concat_ws(';', CASE WHEN length(html) > 4000 THEN 'too_large' END, CASE WHEN url LIKE 'http://%' THEN 'insecure' END, CASE WHEN NOT contains(html, '<article') THEN 'no_article' END) AS reasons FROM pages")
def input_reasons(spark: SparkSession, d: str) -> DataFrame:
    rules = [(F.length("html") > 4000, "too_large"), (F.col("url").like("http://%"), "insecure"), (~F.contains(F.col("html"), F.lit("<article")), "no_article")]
    return v.table(spark, d, "pages").select("page_id", contracts.input_reasons(rules).alias("reasons"))


@query("con05_batch_admission", """WITH i AS (SELECT page_id // 32 AS batch, page_id AS item, length(html) AS size, sha256(html) AS digest FROM pages), j AS (SELECT *, CASE WHEN row_number() OVER w > 24 THEN 'too_many_items' WHEN size > 12000 THEN 'item_too_large' WHEN sum(size) OVER w > 80000 THEN 'batch_too_large'
  WHEN row_number() OVER (PARTITION BY batch, digest ORDER BY item) > 1 THEN 'duplicate_content' END AS fault FROM i WINDOW w AS (PARTITION BY batch ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  SELECT batch, item, CASE WHEN count(fault) OVER (PARTITION BY batch ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN 'not_reached' WHEN fault IS NOT NULL THEN fault ELSE 'admitted' END AS status FROM j""")
def batch_admission(spark: SparkSession, d: str) -> DataFrame:
    items = v.table(spark, d, "pages").select(F.floor(F.col("page_id") / 32).alias("batch"), F.col("page_id").alias("item"), F.length("html").alias("size"), F.sha2("html", 256).alias("digest"))
    return contracts.admission(items, "batch", "item", 24, 12000, 80000)


@query("set02_differences", "SELECT 'left' AS side, doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'right', doc_id FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def set_differences(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.joins import set_differences as differ

    return differ(v.table(spark, d, "documents"), v.table(spark, d, "labels"), "doc_id")


@query("prj08_reason_mapping", "SELECT o_orderkey, coalesce(m.name, 'unmapped') AS name FROM orders LEFT JOIN (VALUES ('O', 'open'), ('F', 'filled')) m(code, name) ON o_orderstatus = m.code")
def reason_mapping(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([("O", "open"), ("F", "filled")], "o_orderstatus string, name string")
    return v.table(spark, d, "orders").join(F.broadcast(names), "o_orderstatus", "left").select("o_orderkey", F.coalesce("name", F.lit("unmapped")).alias("name"))  # two fixed rows


@query("pip07_workload", f"""SELECT (SELECT count(*) FROM (SELECT easting, northing FROM ({v.SITES}) GROUP BY 1, 2 HAVING count(*) > 1)) AS repeated_points, count(DISTINCT (floor((easting - 64) / 5000.0), floor((northing - 64) / 5000.0))) AS tiles,
  count(*) FILTER (floor((easting - 64) / 5000.0) <> ceil((easting + 64) / 5000.0) - 1 OR floor((northing - 64) / 5000.0) <> ceil((northing + 64) / 5000.0) - 1) AS crossing FROM ({v.SITES})""")
def workload(spark: SparkSession, d: str) -> DataFrame:
    s = v.sites(spark, d)
    low = lambda c: F.floor((F.col(c) - 64) / 5000.0)
    high = lambda c: F.ceil((F.col(c) + 64) / 5000.0) - 1
    repeated = s.groupBy("easting", "northing").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("repeated_points"))
    own = s.agg(F.count_distinct(low("easting"), low("northing")).alias("tiles"), F.count_if((low("easting") != high("easting")) | (low("northing") != high("northing"))).alias("crossing"))
    return repeated.crossJoin(own)  # one row each
