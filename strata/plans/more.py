"""Variants and composites of the operators (rest of §2: FIL04, SPA12, JON, AGG, WIN, TOP, SPL, MET, ML, CON, LDG, PIP)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import contracts, metrics, models, spatial
from ..operators.celljoin import box_counts, busy_parts, class_counts, closer_than, in_disc, near_pairs, tiled_pairs
from ..operators.coverage import COMPOSITE, NATIONAL, assess_coverage, matching_provenance
from ..operators.quantiles import exact_quantiles
from . import views as v
from .keys_text import hash_sql
from .registry import query


def _points(spark: SparkSession, d: str) -> DataFrame:
    return v.sites(spark, d).select("site_id", "block_id", F.col("easting").alias("x"), F.col("northing").alias("y"))


@query("fil04_independence_gate", f"""SELECT a.site_id FROM ({v.SITES}) a WHERE a.block_id >= 12 AND NOT EXISTS (SELECT 1 FROM ({v.SITES}) b WHERE b.block_id < 2 AND power(a.easting - b.easting, 2) + power(a.northing - b.northing, 2) < 15000.0 * 15000.0)
  AND sqrt(power(greatest(200000.0 - a.easting, 0.0, a.easting - 210000.0), 2) + power(greatest(200000.0 - a.northing, 0.0, a.northing - 210000.0), 2)) >= 15000""")
def independence(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    far = near_pairs(p.where("block_id >= 12"), p.where("block_id < 2"), 15000, closer_than(15000), "left_anti")
    return far.where(spatial.rectangle_distance(F.col("x"), F.col("y"), 200000.0, 200000.0, 210000.0, 210000.0) >= 15000).select("site_id")


@query("spa12_coverage_assessment")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    s = v.sites(spark, d).repartition(busy_parts(spark))  # few bytes, much work
    pts = s.select("site_id", F.posexplode(spatial.sample_points(F.col("easting").cast("double"), F.col("northing").cast("double")))).select("site_id", F.col("pos").alias("i"), "col.x", "col.y")
    cell = lambda c: F.floor(F.col(c) / 20000.0)
    pts = pts.withColumn("cx", cell("x")).withColumn("cy", cell("y"))
    cells = pts.select(F.col("cx").alias("fx"), F.col("cy").alias("fy")).distinct().where("(fx + fy) % 7 <> 0")
    x0, y0 = F.col("fx") * 20000.0, F.col("fy") * 20000.0
    ring = F.array(*[F.struct((x0 + a * 20000.0).alias("x"), (y0 + b * 20000.0).alias("y")) for a, b in [(0, 0), (0, 1), (1, 1), (1, 0), (0, 0)]])
    k = F.col("fx") * 31 + F.col("fy")
    feats = cells.select(
        "fx", "fy", k.alias("feature_id"), ring.alias("ring"), F.concat(F.lit("p"), (F.floor(F.col("fx") / 4)).cast("string")).alias("polygon_id"), (F.lit(2018) + F.floor(F.col("fy") / 9)).cast("string").alias("year"),
        F.when(k % 11 == 0, "2").otherwise("1").alias("resolution"), F.lit("a").alias("start"), F.when(k % 13 == 0, "").otherwise("b").alias("end"), F.when(k % 5 != 0, "np file").alias("source"), F.lit(None).cast("string").alias("programme_kind"),
    )
    return assess_coverage(pts, feats, (F.col("cx") == F.col("fx")) & (F.col("cy") == F.col("fy")))


#: Mapped features: a square and a diamond for each supplier, 30 to 120 km wide; half metres keep points off the diamond.
FEATURES = f"""SELECT s_suppkey AS k, {v.sql_unit("'FE:' || CAST(s_suppkey AS VARCHAR)")} * {v.EXTENT} // 1 AS cx, {v.sql_unit("'FN:' || CAST(s_suppkey AS VARCHAR)")} * {v.EXTENT} // 1 AS cy, 15000.5 * (1 + s_suppkey % 4) AS half,
  CASE WHEN s_suppkey % 5 > 0 THEN 'p' || CAST(s_suppkey % 2 AS VARCHAR) ELSE '' END AS polygon_id, CAST(2019 + s_suppkey % 2 AS VARCHAR) AS year, CASE s_suppkey % 6 WHEN 0 THEN '2.0' WHEN 1 THEN '0.5' ELSE '1.0' END AS resolution,
  CASE WHEN s_suppkey % 3 = 0 THEN 'survey' ELSE 'NP tile' END AS file FROM supplier"""
MATCH_SQL = f"""WITH f AS ({FEATURES}), s AS (SELECT site_id, easting, northing, 'EAP-' || substr(sha256(CASE WHEN site_id % 2 = 0 THEN '2019|1' ELSE '2020|0.5' END || '|{NATIONAL}|dtm'), 1, 12) AS expected FROM ({v.SITES})),
  p AS (SELECT site_id, easting + 64 * a AS x, northing + 64 * b AS y, (a + 1) * 3 + b + 1 AS i FROM s, (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b)),
  h AS (SELECT site_id, i, polygon_id, year, resolution, file FROM p JOIN f ON (x >= cx - half AND x < cx + half AND y >= cy - half AND y < cy + half) OR abs(x - cx - 2 * half) + abs(y - cy) < half),
  g AS (SELECT site_id, count(DISTINCT i) AS n, count(DISTINCT polygon_id || '|' || year || '|' || resolution || '|' || file) AS many, min(year) AS year, min(regexp_replace(resolution, '[.]0$', '')) AS resolution,
    CASE WHEN min(file) = 'NP tile' THEN '{NATIONAL}' ELSE '{COMPOSITE}' END AS programme FROM h GROUP BY site_id)
  SELECT s.site_id AS patch_id, coalesce(n = 9, false) AS coverage, CAST(CASE WHEN many > 1 THEN 2 ELSE coalesce(many, 0) END AS INTEGER) AS signatures,
    coalesce(n = 9 AND many = 1 AND CAST(resolution AS DOUBLE) <= 1 AND 'EAP-' || substr(sha256(year || '|' || resolution || '|' || programme || '|dtm'), 1, 12) = expected, false) AS matches,
    CASE WHEN n = 9 AND many = 1 THEN year END AS year, CASE WHEN n = 9 AND many = 1 THEN resolution END AS resolution, CASE WHEN n = 9 AND many = 1 THEN programme END AS programme FROM s LEFT JOIN g USING (site_id)"""


def _features(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    cx, cy = (F.floor(keys.unit_draw(keys.sha(f"F{a}:", k)) * v.EXTENT).cast("double") for a in "EN")
    half = F.lit(15000.5) * (1 + k % 4)

    def ring(e: Column, n: Column, corners: list[tuple[int, int]]) -> Column:
        return F.array(*[F.struct((e + a * half).alias("x"), (n + b * half).alias("y")) for a, b in corners])

    rings = F.array(ring(cx, cy, [(-1, -1), (-1, 1), (1, 1), (1, -1), (-1, -1)]), ring(cx + 2 * half, cy, [(-1, 0), (0, 1), (1, 0), (0, -1), (-1, 0)]))
    return v.table(spark, d, "supplier").select(
        rings.alias("rings"), F.when(k % 5 > 0, F.concat(F.lit("p"), (k % 2).cast("string"))).alias("polygon_id"), (F.lit(2019) + k % 2).alias("year"), F.when(k % 6 == 0, "2.0").when(k % 6 == 1, "0.5").otherwise("1.0").alias("resolution"),
        F.lit("a").alias("start"), F.lit("b").alias("end"), F.when(k % 3 == 0, "survey").otherwise("NP tile").alias("file"),
    )


@query("spa16_matching_provenance", MATCH_SQL)
def provenance_matches(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("site_id") % 2 == 0
    expected = keys.provenance_id(F.when(even, "2019").otherwise("2020"), F.when(even, "1").otherwise("0.5"), F.lit(NATIONAL), F.lit("dtm"))
    sites = v.sites(spark, d).select(F.col("site_id").alias("patch_id"), F.col("easting").alias("x"), F.col("northing").alias("y"), expected.alias("expected"))
    return matching_provenance(sites, _features(spark, d), "dtm")


@query("jon03_predictions_with_manifest", f"SELECT s.sample_id, l.toxic, CASE WHEN s.label = s.predicted THEN 'right' ELSE 'wrong' END AS outcome FROM ({v.SCORED}) s JOIN labels l ON l.doc_id = s.sample_id")
def predictions(spark: SparkSession, d: str) -> DataFrame:
    rows = v.scored(spark, d).join(v.table(spark, d, "labels").select(F.col("doc_id").alias("sample_id"), "toxic"), "sample_id")
    return rows.select("sample_id", "toxic", F.when(F.col("label") == F.col("predicted"), "right").otherwise("wrong").alias("outcome"))


@query("jon04_envelope_counts", f"SELECT a.site_id, count(*) AS n FROM ({v.SITES}) a JOIN ({v.SITES}) b ON abs(a.easting - b.easting) <= 9000 AND abs(a.northing - b.northing) <= 6000 GROUP BY a.site_id")
def envelope_counts(spark: SparkSession, d: str) -> DataFrame:
    return box_counts(_points(spark, d), "site_id", 9000, 6000)


@query("jon08_partition_distances", f"SELECT a.block_id % 3 AS first, b.block_id % 3 AS second, count(*) AS n FROM ({v.SITES}) a JOIN ({v.SITES}) b ON a.site_id < b.site_id AND a.block_id % 3 <> b.block_id % 3 AND power(a.easting - b.easting, 2) + power(a.northing - b.northing, 2) < 12000.0 * 12000.0 GROUP BY 1, 2")
def partition_distances(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d).select("site_id", "x", "y", (F.col("block_id") % 3).cast("long").alias("block"))
    counts = tiled_pairs(p.where("block is not null"), "site_id", 12000, in_disc(12000), class_counts(lambda t: t.column("block").to_numpy()), "first long, second long, n long")
    return counts.where("first <> second").groupBy(*[F.col(c).cast("int").alias(c) for c in ("first", "second")]).agg(F.sum("n").alias("n"))


@query("jon10_unreviewed", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND source NOT IN ('src1', 'src2')")
def unreviewed(spark: SparkSession, d: str) -> DataFrame:
    taken = spark.createDataFrame([("src1",), ("src2",)], "source string")
    docs = v.table(spark, d, "documents").select("doc_id", "source")
    return docs.join(v.table(spark, d, "labels"), "doc_id", "left_anti").join(F.broadcast(taken), "source", "left_anti").select("doc_id")  # two fixed rows


@query("jon13_tenant_results", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7 ORDER BY o_totalprice DESC, o_orderkey")
def tenant_results(spark: SparkSession, d: str) -> DataFrame:
    c = v.table(spark, d, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return v.table(spark, d, "orders").join(c, "o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey").select("o_orderkey", "c_name", "o_totalprice")


@query("agg06_size_range", "SELECT source, count(n_chars) AS n, min(n_chars) AS low, CAST(median(n_chars) AS DOUBLE) AS middle, max(n_chars) AS high FROM documents GROUP BY source")
def size_range(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "documents").groupBy("source").agg(F.count("n_chars").alias("n"), F.min("n_chars").alias("low"), F.percentile("n_chars", F.lit(0.5)).alias("middle"), F.max("n_chars").alias("high"))


@query("agg07_quantiles", f"SELECT round(quantile_cont(score, 0.01), 9) AS q01, round(quantile_cont(score, 0.45), 9) AS q45, round(quantile_cont(score, 0.55), 9) AS q55, round(quantile_cont(score, 0.99), 9) AS q99 FROM ({v.WINDOWS})")
def quantiles(spark: SparkSession, d: str) -> DataFrame:
    return exact_quantiles(v.windows(spark, d), "score", [0.01, 0.45, 0.55, 0.99]).select(*[F.round(F.col("q")[i], 9).alias(n) for i, n in enumerate(("q01", "q45", "q55", "q99"))])


@query("agg20_confusion_totals", f"SELECT CAST(sum(CASE WHEN label = 1 AND predicted = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN label = 0 AND predicted = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp FROM ({v.SCORED})")
def confusion_totals(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(v.scored(spark, d), ["region"]).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))


@query("agg24_exploded_observations", "SELECT o, count(*) AS n FROM (SELECT unnest(string_split(o_orderpriority, '-')) AS o FROM orders) GROUP BY o")
def observations(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "orders").select(F.explode(F.split("o_orderpriority", "-")).alias("o")).groupBy("o").agg(F.count("*").alias("n"))


@query("win05_neighbour_steps", "SELECT user_id, round(sum(abs(step)), 6) AS walked, count(step) AS steps FROM (SELECT user_id, value - (lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS step FROM events) GROUP BY user_id")
def neighbour_steps(spark: SparkSession, d: str) -> DataFrame:
    step = F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return v.table(spark, d, "events").select("user_id", step.alias("step")).groupBy("user_id").agg(F.round(F.sum(F.abs("step")), 6).alias("walked"), F.count("step").alias("steps"))


@query("win08_history", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events QUALIFY place <= 3")
def history(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.sampling import top_per_group

    return top_per_group(v.table(spark, d, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 3).select("user_id", "event_id", "place")


@query("top04_selected_positives", f"SELECT g FROM (SELECT DISTINCT CAST(observation_group AS VARCHAR) AS g FROM ({v.SAMPLES})) ORDER BY {hash_sql('positives-v1', 'g')}, g LIMIT 60")
def selected_positives(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.sampling import lowest_ranks

    return lowest_ranks(v.samples(spark, d).select(F.col("observation_group").cast("string").alias("g")).distinct(), "g", 60, "positives-v1").select("g")


@query("top08_blinded_order", f"SELECT window_id, {hash_sql('blind-v1', 'window_id')} AS rank FROM ({v.WINDOWS}) ORDER BY rank, window_id")
def blinded(spark: SparkSession, d: str) -> DataFrame:
    return v.windows(spark, d).select("window_id", keys.hash_rank("blind-v1", F.col("window_id")).alias("rank")).orderBy("rank", "window_id")


@query("top10_extremes", "(SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 3) UNION ALL (SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 3)")
def extremes(spark: SparkSession, d: str) -> DataFrame:
    c = v.table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return c.orderBy("c_acctbal", "c_custkey").limit(3).unionAll(c.orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(3))


@query("spl06_inner_validation", f"SELECT block FROM (SELECT DISTINCT block FROM ({v.SAMPLES}) WHERE block % 5 <> 2) ORDER BY {hash_sql('inner-v1', 'block')}, block LIMIT 4")
def inner_validation(spark: SparkSession, d: str) -> DataFrame:
    blocks = v.samples(spark, d).where("block % 5 <> 2").select("block").distinct()
    return blocks.orderBy(keys.hash_rank("inner-v1", F.col("block")), "block").limit(max(1, round(0.2 * 20))).select("block")


@query("spl08_fold_digest", f"SELECT sha256(string_agg(l, chr(10) ORDER BY l) || chr(10)) AS digest FROM (SELECT DISTINCT CAST(block AS VARCHAR) || ':fold_' || CAST(block % 5 AS VARCHAR) AS l FROM ({v.SAMPLES}))")
def fold_digest(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.col("block").cast("string"), F.lit(":fold_"), (F.col("block") % 5).cast("string"))
    return metrics.inventory_digest(v.samples(spark, d).select(line.alias("l")).distinct(), [], F.col("l"), "l")


@query("met05_groups_with_few_pairs", f"SELECT region, count(*) < 15 AS few, round(CASE WHEN count(DISTINCT label) = 2 THEN (avg(predicted) FILTER (label = 1) + 1 - avg(predicted) FILTER (label = 0)) / 2 END, 9) AS balanced_accuracy FROM ({v.SCORED}) GROUP BY region")
def few_pairs(spark: SparkSession, d: str) -> DataFrame:
    one, zero = (F.avg(F.when(F.col("label") == y, F.col("predicted"))) for y in (1, 0))
    return v.scored(spark, d).groupBy("region").agg((F.count("*") < 15).alias("few"), F.round((one + 1 - zero) / 2, 9).alias("balanced_accuracy"))


@query("met08_against_baseline", f"SELECT region, round(avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END) - greatest(avg(label), 1 - avg(label)), 9) AS gain FROM ({v.SCORED}) GROUP BY region")
def against_baseline(spark: SparkSession, d: str) -> DataFrame:
    right, share = F.avg((F.col("label") == F.col("predicted")).cast("double")), F.avg("label")
    return v.scored(spark, d).groupBy("region").agg(F.round(right - F.greatest(share, 1 - share), 9).alias("gain"))


@query("ml01_prior", f"SELECT round(avg(label), 9) AS prior FROM ({v.SCORED})")
def prior(spark: SparkSession, d: str) -> DataFrame:
    return v.scored(spark, d).agg(F.round(F.avg("label"), 9).alias("prior"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    e = v.table(spark, d, "embeddings").where("label is not null and embedding is not null")
    return e.select("vec_id", (F.col("label") < 5).cast("double").alias("label"), array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))


@query("ml02_logistic_scores")
def logistic_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    train = rows.where("vec_id % 3 <> 0")
    return models.score(models.logistic(train.count()).fit(train), rows.where("vec_id % 3 = 0")).select("vec_id", "label", "score")


@query("ml03_forest_scores")
def forest_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    return models.score(models.forest().fit(rows.where("vec_id % 3 <> 0")), rows.where("vec_id % 3 = 0")).select("vec_id", "label", "score")


@query("con02_accepted_gates", "SELECT 'price' AS rule, CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_orderstatus = 'F' AND NOT o_totalprice > 20000 UNION ALL SELECT 'priority', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT')")
def accepted_gates(spark: SparkSession, d: str) -> DataFrame:
    rows = v.table(spark, d, "orders").where("o_orderstatus = 'F'")
    return contracts.row_violations(rows, "o_orderkey", {"price": F.col("o_totalprice") > 20000, "priority": ~F.col("o_orderpriority").isin("1-URGENT")})


@query("pip03_overrides", f"SELECT sample_id, CASE WHEN status = 'uncertain' AND sample_id % 9 = 0 THEN 'accepted' ELSE status END AS status, status <> 'uncertain' AND sample_id % 9 = 0 AS illegal FROM (SELECT sample_id, CASE WHEN score < 0.3 THEN 'rejected' WHEN score < 0.6 THEN 'uncertain' ELSE 'accepted' END AS status FROM ({v.SCORED}))")
def overrides(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("score")
    rows = v.scored(spark, d).select("sample_id", F.when(s < 0.3, "rejected").when(s < 0.6, "uncertain").otherwise("accepted").alias("status"))
    manual = rows.where("sample_id % 9 = 0").select("sample_id", F.lit("accepted").alias("manual"))
    unsure = F.col("status") == "uncertain"
    return rows.join(manual, "sample_id", "left").select(
        "sample_id", F.when(unsure & F.col("manual").isNotNull(), F.col("manual")).otherwise(F.col("status")).alias("status"), (~unsure & F.col("manual").isNotNull()).alias("illegal")
    )


@query("agg25_rejection_tally", "SELECT reason, count(*) AS n, CAST(sum(quantity) AS DOUBLE) AS attempts FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_discount > 0.05 THEN 'discounted' ELSE 'none' END AS reason, l_quantity AS quantity FROM lineitem) GROUP BY reason")
def rejection_tally(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.joins import first_violation

    reason = F.coalesce(first_violation([(F.col("l_returnflag") == "R", "returned"), (F.col("l_discount") > 0.05, "discounted")]), F.lit("none"))
    return v.table(spark, d, "lineitem").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("attempts"))
