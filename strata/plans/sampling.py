"""Sampling, windows and greedy algorithms (TOP, WIN, GRD)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import greedy, sampling
from ..operators.graph import square_components
from . import views as v
from .keys_text import cell_sql, hash_sql
from .registry import query

SEED = keys.DEFAULT_SAMPLE_SEED


@query("top01_stable_sample", f"SELECT site_id FROM ({v.SITES}) ORDER BY {hash_sql(SEED, 'site_id')}, site_id LIMIT 30")
def stable_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.lowest_ranks(v.sites(spark, d), "site_id", 30, SEED).select("site_id")


QUEUE = f"SELECT site_id, block_id, level FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY {hash_sql('queue-v1', 'site_id')}, site_id) AS level FROM ({v.SITES})) ORDER BY level, {hash_sql('queue-v1:group', 'block_id')}, block_id LIMIT 360"


@query("top02_stratified_queue", QUEUE)
def stratified_queue(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_queue(v.sites(spark, d), "site_id", "block_id", 360, "queue-v1").select("site_id", "block_id", "level")


STATUS = f"SELECT site_id, CASE WHEN site_id % 40 = 0 THEN 'accepted' WHEN site_id % 3 = 0 THEN 'rejected' ELSE 'uncertain' END AS status FROM ({v.SITES})"


@query("top03_second_review", f"""WITH r AS (SELECT *, {hash_sql('second-v1', 'site_id')} AS rank FROM ({STATUS}) WHERE status <> 'uncertain'), a AS (SELECT * FROM r WHERE status = 'accepted' ORDER BY rank, site_id LIMIT 20), b AS (SELECT * FROM r WHERE status = 'rejected' ORDER BY rank, site_id LIMIT 20)
  SELECT site_id, status FROM (SELECT *, CASE WHEN site_id IN (SELECT site_id FROM a UNION ALL SELECT site_id FROM b) THEN 0 ELSE 1 END AS turn FROM r) ORDER BY turn, rank, site_id LIMIT 40""")
def second_review(spark: SparkSession, d: str) -> DataFrame:
    s = v.sites(spark, d).select("site_id", F.when(F.col("site_id") % 40 == 0, "accepted").when(F.col("site_id") % 3 == 0, "rejected").otherwise("uncertain").alias("status"))
    return sampling.second_review(s, "site_id", "status", 40, "second-v1")


@query("top05_review_queues", f"""WITH w AS (SELECT *, {hash_sql('queues-v1', 'window_id')} AS rank FROM ({v.WINDOWS})), q AS (SELECT quantile_cont(score, 0.99) AS a, quantile_cont(score, 0.45) AS b, quantile_cont(score, 0.55) AS c FROM w),
 h AS (SELECT * FROM w, q WHERE score >= a ORDER BY score DESC, window_id LIMIT 25), m AS (SELECT * FROM w, q WHERE score BETWEEN b AND c AND window_id NOT IN (SELECT window_id FROM h) ORDER BY rank, window_id LIMIT 25),
 r AS (SELECT * FROM w WHERE window_id NOT IN (SELECT window_id FROM h) AND window_id NOT IN (SELECT window_id FROM m) ORDER BY rank, window_id LIMIT 25)
 SELECT 'HIGH' AS queue, window_id, score FROM h UNION ALL SELECT 'MEDIUM', window_id, score FROM m UNION ALL SELECT 'REFERENCE', window_id, score FROM r""")
def review_queues(spark: SparkSession, d: str) -> DataFrame:
    return sampling.review_queues(v.windows(spark, d), "queues-v1")


@query("win01_ranked_windows", f"SELECT domain, window_id, row_number() OVER (PARTITION BY domain ORDER BY score DESC, window_id) AS place FROM ({v.WINDOWS})")
def ranked_windows(spark: SparkSession, d: str) -> DataFrame:
    return sampling.top_per_group(v.windows(spark, d), ["domain"], [F.col("score").desc(), "window_id"], 1 << 30).select("domain", "window_id", "place")


@query("win03_exemplars", f"SELECT outcome, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY {hash_sql('show-v1', 'sample_id')}, sample_id) AS i FROM (SELECT sample_id, CASE WHEN label = predicted THEN 'right' ELSE 'wrong' END AS outcome FROM ({v.SCORED}))) WHERE i <= 2")
def exemplars(spark: SparkSession, d: str) -> DataFrame:
    rows = v.scored(spark, d).select("sample_id", F.when(F.col("label") == F.col("predicted"), "right").otherwise("wrong").alias("outcome"))
    return sampling.top_per_group(rows, ["outcome"], [keys.hash_rank("show-v1", F.col("sample_id")), "sample_id"], 2).select("outcome", "sample_id")


CELL_COUNTS = f"SELECT {cell_sql(25)} AS cell, count(*) AS n FROM ({v.SITES}) GROUP BY 1"


@query("win04_shortest_prefix", f"SELECT cell, n FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY n DESC, cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT * FROM ({CELL_COUNTS}) ORDER BY n DESC, cell LIMIT 5)) WHERE before < 28")
def prefix(spark: SparkSession, d: str) -> DataFrame:
    cells = v.sites(spark, d).groupBy(keys.grid_cell(F.col("easting"), F.col("northing"), 25).alias("cell")).agg(F.count("*").alias("n"))
    return sampling.shortest_prefix(cells, [F.col("n").desc(), "cell"], "n", 28, 5)


@query("top06_hardest_groups", f"SELECT region, rate FROM (SELECT region, round(avg(CASE WHEN label <> predicted THEN 1.0 ELSE 0.0 END), 9) AS rate FROM ({v.SCORED}) GROUP BY region) ORDER BY rate DESC, region LIMIT 5")
def hardest(spark: SparkSession, d: str) -> DataFrame:
    rate = F.round(F.avg((F.col("label") != F.col("predicted")).cast("double")), 9)
    return v.scored(spark, d).groupBy("region").agg(rate.alias("rate")).orderBy(F.col("rate").desc(), "region").limit(5)


@query("top07_primary_model", f"""WITH r AS (SELECT CASE WHEN region < 'src15' THEN 'logistic' ELSE 'forest' END AS model, CAST(length(region) AS INTEGER) AS channels, region AS variant, round(avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END), 9) AS score FROM ({v.SCORED}) GROUP BY region)
  SELECT model, channels, variant, score FROM r WHERE (SELECT max(score) FROM r) - score < 0.02 ORDER BY CAST(model <> 'logistic' AS INTEGER), channels, model, variant LIMIT 1""")
def primary(spark: SparkSession, d: str) -> DataFrame:
    score = F.round(F.avg((F.col("label") == F.col("predicted")).cast("double")), 9)
    r = v.scored(spark, d).groupBy("region").agg(score.alias("score"))
    r = r.select(F.when(F.col("region") < "src15", "logistic").otherwise("forest").alias("model"), F.length("region").alias("channels"), F.col("region").alias("variant"), "score")
    return sampling.select_primary(r)


@query("top09_pair_minimum", f"SELECT observation_group, arg_min(sample_id, h) AS sample_id FROM (SELECT *, {hash_sql('pair-v1', 'sample_id')} AS h FROM ({v.SAMPLES})) GROUP BY observation_group")
def pair_minimum(spark: SparkSession, d: str) -> DataFrame:
    return v.samples(spark, d).groupBy("observation_group").agg(F.min_by("sample_id", keys.hash_rank("pair-v1", F.col("sample_id"))).alias("sample_id"))


KEPT_SQL = f"""WITH RECURSIVE w AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, window_id) AS i FROM ({v.WINDOWS})),
  r AS (SELECT domain, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(i BIGINT, y BIGINT, x BIGINT)[]) AS kept FROM w GROUP BY domain
  UNION ALL SELECT r.domain, w.i, CASE WHEN len(list_filter(r.kept, lambda k: (k.y - w."row") ** 2 + (k.x - w."col") ** 2 < 16384
    OR greatest(128 - abs(k.y - w."row"), 0) * greatest(128 - abs(k.x - w."col"), 0) / (32768.0 - greatest(128 - abs(k.y - w."row"), 0) * greatest(128 - abs(k.x - w."col"), 0)) > 0.25)) = 0
    THEN list_append(r.kept, {{'i': w.i, 'y': w."row", 'x': w."col"}}) ELSE r.kept END FROM r JOIN w ON w.domain = r.domain AND w.i = r.i + 1),
  k AS (SELECT domain, unnest(kept).i AS i, unnest(range(1, len(kept) + 1)) AS place FROM (SELECT domain, arg_max(kept, i) AS kept FROM r GROUP BY domain))
  SELECT domain, window_id, "row", "col", score, place FROM k JOIN w USING (domain, i)"""


@query("grd01_suppression", KEPT_SQL)
def suppression(spark: SparkSession, d: str) -> DataFrame:
    return greedy.suppress(v.windows(spark, d).withColumn("domain", F.col("domain").cast("bigint")))


UNITS = "coalesce(nullif(component, ''), CAST(observation_group AS VARCHAR))"
FOLD_SQL = f"""WITH RECURSIVE g AS (SELECT block, size, row_number() OVER (ORDER BY size DESC, units DESC, block) AS i FROM (SELECT block, count(*) AS size, count(DISTINCT {UNITS}) AS units FROM ({v.SAMPLES}) GROUP BY block)),
  r AS (SELECT CAST(0 AS BIGINT) AS i, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS t, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS k, CAST(0 AS BIGINT) AS f, CAST(NULL AS BIGINT) AS block, CAST(0 AS BIGINT) AS size
  UNION ALL SELECT i, list_transform(range(1, 6), lambda x: t[x] + CASE WHEN x = f THEN size ELSE 0 END), list_transform(range(1, 6), lambda x: k[x] + CASE WHEN x = f THEN 1 ELSE 0 END), f, block, size
  FROM (SELECT g.i, r.t, r.k, g.block, g.size, list_position(list_transform(range(1, 6), lambda x: r.t[x] * 1000000 + r.k[x] * 10 + x), list_min(list_transform(range(1, 6), lambda x: r.t[x] * 1000000 + r.k[x] * 10 + x))) AS f FROM r JOIN g ON g.i = r.i + 1))
  SELECT block, CAST(f - 1 AS INTEGER) AS fold, size FROM r WHERE i > 0"""


@query("grd02_balanced_folds", FOLD_SQL)
def folds(spark: SparkSession, d: str) -> DataFrame:
    s = v.samples(spark, d).withColumn("unit", keys.related_unit(F.col("component"), F.col("observation_group").cast("string")))
    return greedy.balanced_folds(s, "block", "unit")


CELL_SQL = f"""WITH RECURSIVE g AS (SELECT *, row_number() OVER (ORDER BY c DESC, cell) AS i FROM (SELECT {cell_sql(100)} AS cell, CAST(floor(easting / 100000.0) AS BIGINT) AS x, CAST(floor(northing / 100000.0) AS BIGINT) AS y, count(*) AS c
    FROM ({v.SITES}) GROUP BY ALL HAVING count(*) >= 12)),
  r AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(x BIGINT, y BIGINT, cell VARCHAR)[]) AS taken UNION ALL SELECT g.i, CASE WHEN len(list_filter(r.taken, lambda t: abs(t.x - g.x) <= 1 AND abs(t.y - g.y) <= 1)) = 0
    AND len(r.taken) < 4 THEN list_append(r.taken, {{'x': g.x, 'y': g.y, 'cell': g.cell}}) ELSE r.taken END FROM r JOIN g ON g.i = r.i + 1)
  SELECT CAST(k - 1 AS INTEGER) AS place, taken[k].cell AS cell FROM (SELECT taken, unnest(range(1, len(taken) + 1)) AS k FROM r WHERE i = (SELECT max(i) FROM r))"""


@query("grd04_nonadjacent_cells", CELL_SQL)
def nonadjacent(spark: SparkSession, d: str) -> DataFrame:
    e, n = keys.cell_indices(F.col("cell"))
    cells = v.sites(spark, d).groupBy(keys.grid_cell(F.col("easting"), F.col("northing")).alias("cell")).agg(F.count("*").alias("count"))
    chosen = greedy.apart(cells.withColumn("e", e).withColumn("n", n))
    return spark.createDataFrame([(i, c) for i, c in enumerate(chosen)], "place int, cell string")


DIVERSE_SQL = f"""WITH RECURSIVE s AS (SELECT {hash_sql('diverse-v1', 'site_id')} AS key, block_id AS a, easting % 7 AS b FROM ({v.SITES})),
  r AS (SELECT 0 AS i, CAST([] AS VARCHAR[]) AS keys, CAST([] AS BIGINT[]) AS seen_a, CAST([] AS BIGINT[]) AS seen_b
  UNION ALL SELECT i + 1, list_append(keys, best.key), list_append(seen_a, best.a), list_append(seen_b, best.b)
  FROM (SELECT i, any_value(keys) AS keys, any_value(seen_a) AS seen_a, any_value(seen_b) AS seen_b,
    arg_min({{'key': key, 'a': CAST(a AS BIGINT), 'b': CAST(b AS BIGINT)}}, CAST(2 - CAST(NOT list_contains(seen_a, a) AS INTEGER) - CAST(NOT list_contains(seen_b, b) AS INTEGER) AS VARCHAR) || key) AS best
    FROM r, s WHERE i < 40 AND NOT list_contains(keys, key) GROUP BY i))
  SELECT CAST(unnest(range(len(keys))) AS INTEGER) AS place, unnest(keys) AS key FROM (SELECT arg_max(keys, i) AS keys FROM r)"""


@query("grd05_diverse_order", DIVERSE_SQL)
def diverse(spark: SparkSession, d: str) -> DataFrame:
    s = v.sites(spark, d).select(F.col("site_id"), "block_id", (F.col("easting") % 7).alias("year"))
    order = greedy.diverse_order(s.withColumn("key", keys.hash_rank("diverse-v1", F.col("site_id"))), "key", ["block_id", "year"], 40)
    return spark.createDataFrame([(i, k) for i, k in enumerate(order)], "place int, key string")


@query("grd06_rejection_sampling")
def rejection(spark: SparkSession, d: str) -> DataFrame:
    s = v.sites(spark, d).select((F.col("block_id") % 5).cast("bigint").alias("region"), F.col("site_id").alias("positive"), F.col("easting").alias("x"), F.col("northing").alias("y"))
    draw = greedy.annulus_attempts("draw-v1", 2000.0, 10000.0, (0.0, 0.0, float(v.EXTENT), float(v.EXTENT)))
    return greedy.rejection_sample(s, draw, 10_001.0, 15_000.0)  # a rounded draw may lie a metre farther out


@query("grd07_overlap_components", f"""WITH RECURSIVE e AS (SELECT a.site_id AS a, b.site_id AS b FROM ({v.SITES}) a JOIN ({v.SITES}) b ON a.site_id <> b.site_id AND abs(a.easting - b.easting) < 5000 AND abs(a.northing - b.northing) < 5000),
 r(node, reach) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a) SELECT node AS site_id, min(reach) AS component FROM r GROUP BY node""")
def overlap_components(spark: SparkSession, d: str) -> DataFrame:
    p = v.sites(spark, d).select("site_id", F.col("easting").alias("x"), F.col("northing").alias("y"))
    return square_components(p, "site_id", 5000).withColumnRenamed("node", "site_id")


@query("mth04_annulus_draws", f"""SELECT site_id, round_even(easting + r * cos(a), 0) AS x, round_even(northing + r * sin(a), 0) AS y FROM (SELECT site_id, easting, northing, 2 * pi() * {v.sql_unit("'draw-v1:' || CAST(site_id AS VARCHAR) || ':1'")} AS a, sqrt(4000000.0 + {v.sql_unit("'draw-v1:' || CAST(site_id AS VARCHAR) || ':1'", 17)} * 96000000.0) AS r FROM ({v.SITES}))""")
def annulus(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.spatial import annulus_draw

    x, y = annulus_draw(keys.sha("draw-v1:", F.col("site_id"), ":1"), F.col("easting").cast("double"), F.col("northing").cast("double"), 2000.0, 10000.0)
    return v.sites(spark, d).select("site_id", x.alias("x"), y.alias("y"))
