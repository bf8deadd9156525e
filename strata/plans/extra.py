"""Further raster checks, paired bootstrap and summaries (RAS12, RAS17-18, ARR02, BST02, MET09, AGG, GRD03, CON)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import greedy, resample
from ..operators import raster as r
from ..operators.quantiles import exact_quantiles
from . import views as v
from .keys_text import hash_sql
from .raster import PIXELS, POOLED, REPS, _pixels
from .registry import query


@query("ras12_representation_violations", f"""SELECT patch_id, unnest(list_filter([CASE WHEN bool_or(slope NOT BETWEEN 0 AND 90) THEN 'slope_range' END, CASE WHEN bool_or(hillshade NOT BETWEEN 0 AND 1) THEN 'hillshade_range' END, CASE WHEN abs(median(elevation)) > 1e-4 THEN 'elevation_median' END,
  CASE WHEN bool_or((z IS NULL) <> (elevation IS NULL)) THEN 'elevation_gap' END], lambda x: x IS NOT NULL)) AS rule FROM ({PIXELS}) JOIN ({REPS}) USING (patch_id, "row", "col") GROUP BY patch_id""")
def representation_violations(spark: SparkSession, d: str) -> DataFrame:
    p = r.prepared(_pixels(spark, d))
    return r.representation_violations(p, r.representations(p))


@query("ras18_standardised", f"SELECT patch_id, brow, bcol, round((slope - (SELECT avg(slope) FROM ({POOLED}))) / (SELECT stddev_pop(slope) FROM ({POOLED})), 5) AS slope FROM ({POOLED})")
def standardised(spark: SparkSession, d: str) -> DataFrame:
    cells = r.pooled(r.representations(r.prepared(_pixels(spark, d))))
    return r.standardised(cells).select("patch_id", "brow", "bcol", F.round("slope", 5).alias("slope"))


@query("ras17_cache_states", """SELECT p_partkey AS id, CASE WHEN p_partkey % 17 = 0 THEN 'raw_missing' WHEN p_partkey % 13 = 0 THEN 'raw_invalid' WHEN p_partkey % 11 = 0 THEN 'processed_missing' WHEN p_partkey % 7 = 0 THEN 'processed_invalid' WHEN p_size > 45 THEN 'representation_invalid' ELSE 'valid' END AS state FROM part""")
def cache_states(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    state = r.cache_state(k % 17 != 0, k % 13 != 0, k % 11 != 0, k % 7 != 0, F.col("p_size") <= 45)
    return v.table(spark, d, "part").select(k.alias("id"), state.alias("state"))


@query("arr02_content_digests")
def content_digests(spark: SparkSession, d: str) -> DataFrame:
    return r.content_digests(r.packed(_pixels(spark, d)))


@query("agg10_patch_spread", f"SELECT patch_id, round(avg(z), 6) AS mean, round(stddev_pop(z), 6) AS sd, round(quantile_cont(z, 0.75) - quantile_cont(z, 0.25), 6) AS iqr, round(quantile_cont(z, 0.95) - quantile_cont(z, 0.05), 6) AS spread FROM ({PIXELS}) GROUP BY patch_id")
def patch_spread(spark: SparkSession, d: str) -> DataFrame:
    g = r.prepared(_pixels(spark, d)).groupBy("patch_id").agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("s"), F.percentile("z", F.array(*[F.lit(x) for x in (0.05, 0.25, 0.75, 0.95)])).alias("q"))
    return g.select("patch_id", F.round("m", 6).alias("mean"), F.round("s", 6).alias("sd"), F.round(F.col("q")[2] - F.col("q")[1], 6).alias("iqr"), F.round(F.col("q")[3] - F.col("q")[0], 6).alias("spread"))


PAIRS = f"SELECT region, max(predicted) FILTER (label = 1) AS positive, max(predicted) FILTER (label = 0) AS background FROM ({v.SCORED}) GROUP BY region HAVING count(DISTINCT label) = 2"
PAIRED_SQL = f"""WITH u AS (SELECT *, row_number() OVER (ORDER BY region) - 1 AS unit FROM ({PAIRS})), n AS (SELECT count(*) AS n FROM u),
 s AS (SELECT r AS replicate, CAST(CAST('0x' || substr(sha256('paired-v1:' || CAST(r AS VARCHAR) || ':' || CAST(k AS VARCHAR)), 1, 8) AS UBIGINT) % (SELECT n FROM n) AS BIGINT) AS unit FROM (SELECT unnest(range(0, 10000)) AS r), LATERAL (SELECT unnest(range(0, (SELECT n FROM n))) AS k)),
 b AS (SELECT (avg(positive) + 1 - avg(background)) / 2 AS ba FROM s JOIN u USING (unit) GROUP BY replicate) SELECT round(avg(ba), 6) AS mean, round(quantile_cont(ba, 0.025), 6) AS low, round(quantile_cont(ba, 0.975), 6) AS high FROM b"""


@query("bst02_paired_bootstrap", PAIRED_SQL)
def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    g = v.scored(spark, d).groupBy("region").agg(
        F.max(F.when(F.col("label") == 1, F.col("predicted"))).alias("positive"), F.max(F.when(F.col("label") == 0, F.col("predicted"))).alias("background"), F.count_distinct("label").alias("n")
    )
    return resample.paired_bootstrap(g.where("n = 2").drop("n"), "region", 10000, "paired-v1")


@query("met09_score_summary", f"SELECT domain, count(*) AS n, round(quantile_cont(score, 0.25), 9) AS q25, round(quantile_cont(score, 0.5), 9) AS q50, round(quantile_cont(score, 0.75), 9) AS q75, count(*) FILTER (score >= 0.9) AS high FROM ({v.WINDOWS}) GROUP BY domain")
def score_summary(spark: SparkSession, d: str) -> DataFrame:
    w = v.windows(spark, d)
    g = exact_quantiles(w, "score", [0.25, 0.5, 0.75], ["domain"]).join(w.groupBy("domain").agg(F.count_if(F.col("score") >= 0.9).alias("high")), "domain")
    return g.select("domain", "n", *[F.round(F.col("q")[i], 9).alias(k) for i, k in enumerate(("q25", "q50", "q75"))], "high")


@query("agg03_composite_counts", "SELECT c_nationkey, c_mktsegment, c_acctbal < 0 AS owing, count(*) AS n FROM customer GROUP BY ALL")
def composite_counts(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment", (F.col("c_acctbal") < 0).alias("owing")).agg(F.count("*").alias("n"))


@query("agg23_rounded_quartiles", f"SELECT label, round(quantile_cont(score, 0.25), 6) AS q25, round(median(score), 6) AS q50, round(quantile_cont(score, 0.75), 6) AS q75 FROM ({v.SCORED}) GROUP BY label")
def rounded_quartiles(spark: SparkSession, d: str) -> DataFrame:
    g = v.scored(spark, d).groupBy("label").agg(F.percentile("score", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)])).alias("q"))
    return g.select("label", *[F.round(F.col("q")[i], 6).alias(k) for i, k in enumerate(("q25", "q50", "q75"))])


FILL_SQL = f"""WITH RECURSIVE g AS (SELECT *, row_number() OVER (ORDER BY {hash_sql('fill-v1', 'observation_group')}) AS i FROM (SELECT observation_group, sum(label) AS w FROM ({v.SAMPLES}) GROUP BY 1 HAVING sum(label) > 0)),
  r AS (SELECT CAST(0 AS BIGINT) AS i, CAST(40 AS BIGINT) AS rest, CAST(-1 AS INTEGER) AS place, CAST(NULL AS BIGINT) AS observation_group, false AS taken
  UNION ALL SELECT g.i, CAST(r.rest - CASE WHEN g.w <= r.rest THEN g.w ELSE 0 END AS BIGINT), r.place + CASE WHEN g.w <= r.rest THEN 1 ELSE 0 END, g.observation_group, g.w <= r.rest FROM r JOIN g ON g.i = r.i + 1 WHERE r.rest > 0)
  SELECT place, observation_group FROM r WHERE taken"""


@query("grd03_group_fill", FILL_SQL)
def group_fill(spark: SparkSession, d: str) -> DataFrame:
    g = v.samples(spark, d).groupBy("observation_group").agg(F.sum("label").alias("w")).where("w > 0")
    taken = greedy.fill_groups(g.withColumn("rank", keys.hash_rank("fill-v1", F.col("observation_group"))), "observation_group", "w", 40, ["rank"])
    return taken.select(F.col("place").cast("int").alias("place"), "observation_group")


@query("win02_group_ordinals", f"SELECT site_id, row_number() OVER (PARTITION BY block_id ORDER BY {hash_sql('ordinal-v1', 'site_id')}, site_id) AS place FROM ({v.SITES})")
def group_ordinals(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.sampling import top_per_group

    return top_per_group(v.sites(spark, d), ["block_id"], [keys.hash_rank("ordinal-v1", F.col("site_id")), "site_id"], 1 << 30).select("site_id", "place")


@query("str07_links_and_words", "SELECT page_id, CAST(len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS INTEGER) AS links FROM pages")
def links(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("links"))
