"""Aggregations, metrics and resampling (AGG, MET, BST)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as m
from ..operators import resample
from . import views as v
from .registry import query

GROUPS = f"SELECT region, score, sum(label) AS p, sum(1 - label) AS n FROM ({v.SCORED}) GROUP BY region, score"
RUNNING = f"SELECT *, sum(p) OVER (PARTITION BY region ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY region ORDER BY score DESC) AS fp FROM ({GROUPS})"
AUC_SQL = f"""SELECT region, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives, round(CASE WHEN sum(p) * sum(n) > 0 THEN sum(n * (tp - p / 2.0)) / (sum(p) * sum(n)) END, 9) AS auc,
  round(CASE WHEN sum(n) > 0 AND sum(p) > 0 THEN sum(p * CAST(tp AS DOUBLE) / (tp + fp)) / sum(p) END, 9) AS average_precision FROM ({RUNNING}) GROUP BY region"""


@query("met02_auc_by_region", AUC_SQL)
def auc_by_region(spark: SparkSession, d: str) -> DataFrame:
    return m.auc_and_precision(v.scored(spark, d), ["region"])


CONFUSION = f"SELECT region, count(*) FILTER (label = 0 AND predicted = 0) AS tn, count(*) FILTER (label = 0 AND predicted = 1) AS fp, count(*) FILTER (label = 1 AND predicted = 0) AS fn, count(*) FILTER (label = 1 AND predicted = 1) AS tp FROM ({v.SCORED}) GROUP BY region"


@query("met01_confusion_by_region", f"""SELECT region, tn, fp, fn, tp, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 9) AS balanced_accuracy, round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM ({CONFUSION})""")
def confusion_by_region(spark: SparkSession, d: str) -> DataFrame:
    return m.confusion(v.scored(spark, d), ["region"])


@query("met04_curves", f"SELECT region, score, round(fp / nullif(sum(n) OVER (PARTITION BY region), 0), 9) AS fpr, round(tp / nullif(sum(p) OVER (PARTITION BY region), 0), 9) AS tpr, round(CAST(tp AS DOUBLE) / (tp + fp), 9) AS precision FROM ({RUNNING})")
def curve_points(spark: SparkSession, d: str) -> DataFrame:
    return m.curves(v.scored(spark, d), ["region"])


@query("met06_external_outcome", f"""SELECT region, CASE WHEN pairs < 12 THEN 'MORE_DATA_REQUIRED' WHEN ba >= 0.75 AND ba - 0.1 > 0.5 THEN 'EXTERNAL_GENERALIZATION_SUPPORTED' WHEN ba > 0.5 THEN 'EXTERNAL_GENERALIZATION_PARTIALLY_SUPPORTED' ELSE 'EXTERNAL_GENERALIZATION_NOT_SUPPORTED' END AS outcome
  FROM (SELECT region, tn + fp + fn + tp AS pairs, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 9) AS ba FROM ({CONFUSION}))""")
def external_outcomes(spark: SparkSession, d: str) -> DataFrame:
    c = m.confusion(v.scored(spark, d), ["region"])
    ba = F.col("balanced_accuracy")
    pairs = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return c.select("region", m.external_outcome(ba, F.greatest(ba - 0.1, F.lit(0.0)), F.least(ba + 0.1, F.lit(1.0)), pairs, 12).alias("outcome"))


@query("agg01_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def counts(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("agg02_group_pivot", "SELECT c_nationkey, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, count(*) FILTER (c_mktsegment = 'MACHINERY') AS machinery, count(*) AS total FROM customer GROUP BY c_nationkey")
def group_pivot(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("c_mktsegment")
    return v.table(spark, d, "customer").groupBy("c_nationkey").agg(F.count_if(s == "BUILDING").alias("building"), F.count_if(s == "MACHINERY").alias("machinery"), F.count("*").alias("total"))


@query("agg04_duplicates", "SELECT source, count(*) AS n, count(DISTINCT sha256(text)) AS distinct_texts, count(*) - count(DISTINCT sha256(text)) AS duplicates FROM documents GROUP BY source")
def duplicates(spark: SparkSession, d: str) -> DataFrame:
    h = v.table(spark, d, "documents").select("source", F.sha2("text", 256).alias("h"))
    per = h.groupBy("source", "h").agg(F.count("*").alias("k"))  # combine copies first: no source gathers its texts
    return per.groupBy("source").agg(F.sum("k").alias("n"), F.count("*").alias("distinct_texts")).withColumn("duplicates", F.col("n") - F.col("distinct_texts"))


@query("agg05_viable_groups", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) >= 60")
def viable(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).where("n >= 60")


@query("agg08_distributions", f"SELECT region, count(score) AS n, round(avg(score), 9) AS mean, round(stddev_pop(score), 9) AS sd, round(min(score), 9) AS low, round(max(score), 9) AS high, round(quantile_cont(score, 0.25), 9) AS q25, round(quantile_cont(score, 0.5), 9) AS q50, round(quantile_cont(score, 0.75), 9) AS q75 FROM ({v.SCORED}) GROUP BY region")
def distributions(spark: SparkSession, d: str) -> DataFrame:
    return m.distribution(v.scored(spark, d), ["region"], "score")


@query("agg12_field_errors", """SELECT field, value, count(*) AS n, count(*) FILTER (l_quantity > 25) AS large FROM (
  SELECT 'flag' AS field, l_returnflag AS value, l_quantity FROM lineitem UNION ALL SELECT 'status', l_linestatus, l_quantity FROM lineitem UNION ALL SELECT 'year', CAST(year(l_shipdate) AS VARCHAR), l_quantity FROM lineitem) GROUP BY field, value""")
def field_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = v.table(spark, d, "lineitem").select("l_quantity", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.year("l_shipdate").cast("string").alias("year"))
    return rows.unpivot("l_quantity", ["flag", "status", "year"], "field", "value").groupBy("field", "value").agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 25).alias("large"))


@query("agg13_joint_balance", f"SELECT block, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS backgrounds, count(*) FILTER (label = 1) = count(*) FILTER (label = 0) AS balanced FROM ({v.SAMPLES}) GROUP BY block")
def joint_balance(spark: SparkSession, d: str) -> DataFrame:
    g = v.samples(spark, d).groupBy("block").agg(F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("backgrounds"))
    return g.withColumn("balanced", F.col("positives") == F.col("backgrounds"))


@query("agg14_class_differences", "SELECT field, max(abs(a - b)) AS difference FROM (SELECT field, value, count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS b FROM (SELECT 'status' AS field, o_orderstatus AS value, o_orderkey % 2 AS y FROM orders UNION ALL SELECT 'priority', o_orderpriority, o_orderkey % 2 FROM orders) GROUP BY field, value) GROUP BY field")
def class_differences(spark: SparkSession, d: str) -> DataFrame:
    rows = v.table(spark, d, "orders").select((F.col("o_orderkey") % 2).alias("y"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    per = rows.unpivot("y", ["status", "priority"], "field", "value").groupBy("field", "value").agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b"))
    return per.groupBy("field").agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("difference"))


@query("agg15_histogram", f"SELECT CAST(least(floor(score * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM ({v.SCORED}) GROUP BY 1")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return m.histogram(v.scored(spark, d), "score")


@query("agg16_correlations", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS quantity_price, round(corr(l_quantity, l_discount), 6) AS quantity_discount, round(corr(l_extendedprice, l_tax), 6) AS price_tax FROM lineitem")
def correlations(spark: SparkSession, d: str) -> DataFrame:
    c = lambda a, b: F.round(F.corr(a, b), 6)
    return v.table(spark, d, "lineitem").agg(
        c("l_quantity", "l_extendedprice").alias("quantity_price"), c("l_quantity", "l_discount").alias("quantity_discount"), c("l_extendedprice", "l_tax").alias("price_tax")
    )


@query("agg17_standardised_medians", f"SELECT region, round((median(score) - (SELECT avg(score) FROM ({v.SCORED}))) / (SELECT stddev_pop(score) FROM ({v.SCORED})), 9) AS standardised FROM ({v.SCORED}) GROUP BY region")
def standardised(spark: SparkSession, d: str) -> DataFrame:
    return m.standardised_medians(v.scored(spark, d), "region", "score")


@query("agg19_inventory_digests", "SELECT c_nationkey, sha256(string_agg(CAST(c_custkey AS VARCHAR) || ':' || c_name, chr(10) ORDER BY c_custkey) || chr(10)) AS digest FROM customer GROUP BY c_nationkey")
def digests(spark: SparkSession, d: str) -> DataFrame:
    return m.inventory_digest(v.table(spark, d, "customer"), ["c_nationkey"], F.concat_ws(":", F.col("c_custkey").cast("string"), "c_name"), "c_custkey")


@query("agg22_table_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("customer", "orders", "documents", "events")))
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t in ("customer", "orders", "documents", "events"):
        one = v.table(spark, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionAll(one)
    return out


N_UNITS = f"(SELECT count(DISTINCT region) FROM ({v.SCORED}))"
BOOT_SQL = f"""WITH u AS (SELECT *, row_number() OVER (ORDER BY region) - 1 AS unit FROM ({CONFUSION})),
  s AS (SELECT r AS replicate, CAST(CAST('0x' || substr(sha256('boot-v1:' || CAST(r AS VARCHAR) || ':' || CAST(k AS VARCHAR)), 1, 8) AS UBIGINT) % {N_UNITS} AS BIGINT) AS unit
    FROM (SELECT unnest(range(0, 5000)) AS r), LATERAL (SELECT unnest(range(0, {N_UNITS})) AS k)),
  b AS (SELECT replicate, sum(tp) AS tp, sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn FROM s JOIN u USING (unit) GROUP BY replicate),
  w AS (SELECT replicate, unit, count(*) AS w FROM s GROUP BY ALL),
  g AS (SELECT unit, score, sum(label) AS p, sum(1 - label) AS n FROM ({v.SCORED}) JOIN u USING (region) GROUP BY ALL),
  a AS (SELECT replicate, score, sum(w * p) AS p, sum(w * n) AS n FROM w JOIN g USING (unit) GROUP BY ALL),
  c AS (SELECT replicate, sum(p * (upto - n / 2)) / nullif(sum(p) * sum(n), 0) AS auc FROM (SELECT *, sum(n) OVER (PARTITION BY replicate ORDER BY score) AS upto FROM a) GROUP BY replicate),
  m AS (SELECT 'balanced_accuracy' AS metric, list_avg(list_filter([tp / nullif(tp + fn, 0), tn / nullif(tn + fp, 0)], lambda x: x IS NOT NULL)) AS x FROM b
    UNION ALL SELECT 'accuracy', (tp + tn) / (tp + tn + fp + fn) FROM b UNION ALL SELECT 'f1', coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) FROM b UNION ALL SELECT 'roc_auc', auc FROM c)
  SELECT metric, count(x) AS defined, count(*) - count(x) AS undefined, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high FROM m GROUP BY metric"""


@query("bst01_group_bootstrap", BOOT_SQL)
def group_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return resample.group_bootstrap(v.scored(spark, d), "region", 5000, "boot-v1")


@query("bst03_permutation_tail", f"""WITH base AS (SELECT sample_id, region, label, predicted FROM ({v.SCORED}) ), p AS (SELECT unnest(range(0, 100)) AS permutation),
 k AS (SELECT permutation, sample_id, predicted, row_number() OVER (PARTITION BY permutation ORDER BY sample_id) AS i FROM base, p), l AS (SELECT permutation, label, row_number() OVER (PARTITION BY permutation ORDER BY sha256('perm-v1:' || CAST(permutation AS VARCHAR) || ':' || CAST(sample_id AS VARCHAR))) AS i FROM base, p),
 a AS (SELECT permutation, sum(CASE WHEN label = predicted THEN 1 ELSE 0 END) AS hits FROM k JOIN l USING (permutation, i) GROUP BY permutation), o AS (SELECT sum(CASE WHEN label = predicted THEN 1 ELSE 0 END) AS hits FROM base)
 SELECT CAST(o.hits AS BIGINT) AS observed, round((1 + count(*) FILTER (a.hits >= o.hits)) / (count(*) + 1.0), 9) AS tail FROM a, o GROUP BY o.hits""")
def permutation_tail(spark: SparkSession, d: str) -> DataFrame:
    base = v.scored(spark, d).select("sample_id", "label", "predicted")
    dealt = resample.permuted_labels(base.select("sample_id", "label"), "sample_id", 100, "perm-v1")
    hits = dealt.join(base.select("sample_id", "predicted"), "sample_id").groupBy("permutation").agg(F.count_if(F.col("label") == F.col("predicted")).alias("hits"))
    observed = base.agg(F.count_if(F.col("label") == F.col("predicted")).alias("observed"))
    return hits.crossJoin(F.broadcast(observed)).groupBy("observed").agg(F.round(resample.plus_one_tail(F.col("hits"), F.col("observed")), 9).alias("tail"))  # observed is one row
