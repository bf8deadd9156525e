"""Spatial operators and neighbour joins (SPA, JON)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import spatial as s
from ..operators.celljoin import busy_parts, class_counts, closer_than, id_pairs, in_disc, in_square, near_pairs, tiled_pairs
from . import views as v
from .registry import query

BOUNDS = f"SELECT site_id, easting - 64.0 AS \"left\", northing - 64.0 AS bottom, easting + 64.0 AS \"right\", northing + 64.0 AS top FROM ({v.SITES})"


def _bounds(spark: SparkSession, d: str) -> DataFrame:
    b = s.patch_bounds(F.col("easting"), F.col("northing"), 128)
    return v.sites(spark, d).select("site_id", *[c.alias(k) for k, c in b.items()])


def _points(spark: SparkSession, d: str) -> DataFrame:
    return v.sites(spark, d).select("site_id", "block_id", F.col("easting").alias("x"), F.col("northing").alias("y"))


@query("spa01_patch_bounds", BOUNDS)
def bounds(spark: SparkSession, d: str) -> DataFrame:
    return _bounds(spark, d)


@query("spa02_grid_tiles", f"""SELECT site_id, printf('BNG5K_E%03d_N%03d', e, n) AS tile_id FROM (SELECT site_id, unnest(range(CAST(floor("left" / 5000) AS BIGINT), CAST(ceil("right" / 5000) AS BIGINT))) AS e, bottom, top FROM ({BOUNDS})),
  LATERAL (SELECT unnest(range(CAST(floor(bottom / 5000) AS BIGINT), CAST(ceil(top / 5000) AS BIGINT))) AS n)""")
def tiles(spark: SparkSession, d: str) -> DataFrame:
    return s.grid_tiles(_bounds(spark, d)).select("site_id", "tile_id")


@query("spa03_distances", f"""SELECT site_id, round(sqrt((easting - 300000) * (easting - 300000) + (northing - 300000) * (northing - 300000)), 6) AS centre,
  round(sqrt(power(greatest(200000.0 - easting, 0.0, easting - 350000.0), 2) + power(greatest(100000.0 - northing, 0.0, northing - 400000.0), 2)), 6) AS rectangle FROM ({v.SITES})""")
def distances(spark: SparkSession, d: str) -> DataFrame:
    e, n = F.col("easting").cast("double"), F.col("northing").cast("double")
    return v.sites(spark, d).select(
        "site_id", F.round(s.distance(e, n, F.lit(300000.0), F.lit(300000.0)), 6).alias("centre"), F.round(s.rectangle_distance(e, n, 200000.0, 100000.0, 350000.0, 400000.0), 6).alias("rectangle")
    )


CELLS = f"SELECT DISTINCT CAST(floor(easting / 25000.0) AS BIGINT) AS e, CAST(floor(northing / 25000.0) AS BIGINT) AS n FROM ({v.SITES})"


@query("spa05_cell_gaps", f"SELECT a.e AS e1, a.n AS n1, b.e AS e2, b.n AS n2, round(sqrt(power(greatest(abs(a.e - b.e) - 1, 0) * 25000.0, 2) + power(greatest(abs(a.n - b.n) - 1, 0) * 25000.0, 2)), 6) AS gap, greatest(abs(a.e - b.e), abs(a.n - b.n)) <= 1 AS touching FROM ({CELLS}) a JOIN ({CELLS}) b ON abs(a.e - b.e) <= 2 AND abs(a.n - b.n) <= 2")
def cell_gaps(spark: SparkSession, d: str) -> DataFrame:
    rows = v.sites(spark, d)
    cells = rows.select(F.floor(F.col("easting") / 25000.0).cast("bigint").alias("x"), F.floor(F.col("northing") / 25000.0).cast("bigint").alias("y")).distinct()
    pairs = near_pairs(cells, cells, 3, lambda a, b: (F.abs(F.col(f"{a}.x") - F.col(f"{b}.x")) <= 2) & (F.abs(F.col(f"{a}.y") - F.col(f"{b}.y")) <= 2))
    e1, n1, e2, n2 = F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y")
    return pairs.select(e1.alias("e1"), n1.alias("n1"), e2.alias("e2"), n2.alias("n2"), F.round(s.cell_gap(e1, n1, e2, n2, 25000), 6).alias("gap"), s.cells_touch(e1, n1, e2, n2).alias("touching"))


#: A closed L-shaped ring around each site, clockwise for even ids; its size depends on the id.
RING = "[(0, 0), (3, 0), (3, 1), (1, 1), (1, 4), (0, 4), (0, 0)]"
RING_SQL = f"""SELECT site_id, i, easting + (10 + site_id % 40) * CAST(list_extract([0,3,3,1,1,0,0], i) AS DOUBLE) AS x1, northing + (10 + site_id % 40) * CAST(list_extract([0,0,1,1,4,4,0], i) AS DOUBLE) AS y1,
  easting + (10 + site_id % 40) * CAST(list_extract([3,3,1,1,0,0,0], i) AS DOUBLE) AS x2, northing + (10 + site_id % 40) * CAST(list_extract([0,1,1,4,4,0,0], i) AS DOUBLE) AS y2, easting + 20.0 AS px, northing + 35.0 AS py
  FROM ({v.SITES}), (SELECT unnest(range(1, 8)) AS i)"""


def _rings(spark: SparkSession, d: str) -> DataFrame:
    scale = (F.col("site_id") % 40 + 10).cast("double")
    shape = [(0, 0), (3, 0), (3, 1), (1, 1), (1, 4), (0, 4), (0, 0)]
    ring = F.array(*[F.struct((F.col("easting") + scale * a).alias("x"), (F.col("northing") + scale * b).alias("y")) for a, b in shape])
    return v.sites(spark, d).withColumn("ring", ring)


@query("spa07_ring_measures", f"""SELECT site_id, round(sum(x1 * y2 - x2 * y1) / 2, 3) AS area, CAST(sum(CASE WHEN (y1 > py) <> (y2 > py) THEN CASE WHEN px < (x2 - x1) * (py - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END ELSE 0 END) % 2 AS INTEGER) AS inside,
  round(sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)), 3) AS cx, round(sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)), 3) AS cy FROM ({RING_SQL.replace("easting + (10", "CAST(site_id % 100 AS DOUBLE) + (10").replace("northing + (10", "CAST(site_id % 90 AS DOUBLE) + (10").replace("easting + 20.0", "site_id % 100 + 20.0").replace("northing + 35.0", "site_id % 90 + 35.0")}) GROUP BY site_id""")
def rings(spark: SparkSession, d: str) -> DataFrame:
    sites = v.sites(spark, d).select("site_id", (F.col("site_id") % 100).cast("double").alias("easting"), (F.col("site_id") % 90).cast("double").alias("northing"))
    scale = (F.col("site_id") % 40 + 10).cast("double")
    shape = [(0, 0), (3, 0), (3, 1), (1, 1), (1, 4), (0, 4), (0, 0)]
    ring = F.array(*[F.struct((F.col("easting") + scale * a).alias("x"), (F.col("northing") + scale * b).alias("y")) for a, b in shape])
    r = sites.withColumn("ring", ring)
    cx, cy = s.ring_centroid(F.col("ring"))
    inside = s.point_in_ring(F.col("easting") + 20.0, F.col("northing") + 35.0, F.col("ring")).cast("int")
    return r.select("site_id", F.round(s.signed_ring_area(F.col("ring")), 3).alias("area"), inside.alias("inside"), F.round(cx, 3).alias("cx"), F.round(cy, 3).alias("cy"))


@query("spa10_geometry_review")
def geometry_review(spark: SparkSession, d: str) -> DataFrame:
    r = _rings(spark, d).repartition(busy_parts(spark))  # few bytes, much work
    rings_ = F.when(F.col("site_id") % 7 == 0, F.array().cast("array<array<struct<x:double,y:double>>>")).when(F.col("site_id") % 5 == 0, F.array("ring", "ring")).otherwise(F.array("ring"))
    area = F.when(F.col("site_id") % 3 == 0, F.lit(None).cast("double")).otherwise((F.col("site_id") % 10) / 12.0)
    x, y = F.col("easting") + (F.col("site_id") % 40 + 10) * 0.5, F.col("northing") + (F.col("site_id") % 40 + 10) * 1.0
    return r.select("site_id", s.geometry_review(rings_, x, y, area).alias("g")).select("site_id", "g.*")


@query("spa11_sample_points", f"SELECT site_id, i, easting + 64.0 * list_extract([0,-1,0,1,-1,1,-1,0,1], i) AS x, northing + 64.0 * list_extract([0,-1,-1,-1,0,0,1,1,1], i) AS y FROM ({v.SITES}), (SELECT unnest(range(1, 10)) AS i)")
def sample_points(spark: SparkSession, d: str) -> DataFrame:
    return v.sites(spark, d).select("site_id", F.posexplode(s.sample_points(F.col("easting").cast("double"), F.col("northing").cast("double")))).select("site_id", (F.col("pos") + 1).cast("bigint").alias("i"), "col.x", "col.y")


@query("spa13_window_grid", 'SELECT "row", "col", CAST(128 AS INTEGER) AS size FROM (SELECT unnest(range(0, 5000 - 127, 64)) AS "row"), (SELECT unnest(range(0, 5000 - 127, 64)) AS "col")')
def window_grid(spark: SparkSession, d: str) -> DataFrame:
    return s.window_grid(spark, 5000, 5000)


@query("spa14_window_iou", f"""SELECT a.window_id AS a, b.window_id AS b, round((128.0 - abs(a.r - b.r)) * (128.0 - abs(a.c - b.c)) / (2 * 128.0 * 128.0 - (128.0 - abs(a.r - b.r)) * (128.0 - abs(a.c - b.c))), 9) AS iou
  FROM (SELECT window_id, domain, "row" AS r, "col" AS c FROM ({v.WINDOWS})) a JOIN (SELECT window_id, domain, "row" AS r, "col" AS c FROM ({v.WINDOWS})) b ON a.domain = b.domain AND a.window_id < b.window_id AND abs(a.r - b.r) < 128 AND abs(a.c - b.c) < 128""")
def window_iou(spark: SparkSession, d: str) -> DataFrame:
    w = v.windows(spark, d).select("window_id", "domain", F.col("row").alias("x"), F.col("col").alias("y"))

    def pairs(part: pa.Table) -> Callable[[np.ndarray, np.ndarray], pa.RecordBatch]:
        ids, x, y = part.column("window_id").combine_chunks(), part.column("x").to_numpy(), part.column("y").to_numpy()
        return lambda i, j: pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(np.abs(x[i] - x[j])), pa.array(np.abs(y[i] - y[j]))], ["a", "b", "dr", "dc"])

    met = tiled_pairs(w, "window_id", 128, in_square(128), pairs, "a string, b string, dr double, dc double", "domain", 64)
    return met.select("a", "b", F.round(s.window_iou(F.col("dr"), F.col("dc"), F.lit(0.0), F.lit(0.0)), 9).alias("iou"))


@query("spa15_candidate_cells", f"""WITH o AS (SELECT DISTINCT CAST(floor(easting / 5000.0) AS BIGINT) AS e, CAST(floor(northing / 5000.0) AS BIGINT) AS n FROM ({v.SITES})),
  f AS (SELECT de, dn FROM (SELECT unnest(range(-2, 3)) AS de), (SELECT unnest(range(-2, 3)) AS dn) WHERE abs(de) + abs(dn) BETWEEN 1 AND 2)
  SELECT e, n, sha256('cells-v1:' || CAST(e AS VARCHAR) || '_' || CAST(n AS VARCHAR)) AS rank FROM (SELECT DISTINCT o.e + f.de AS e, o.n + f.dn AS n FROM o, f) c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.e = c.e AND o.n = c.n)""")
def candidate_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = v.sites(spark, d)
    o = rows.select(F.floor(F.col("easting") / 5000.0).cast("bigint").alias("e"), F.floor(F.col("northing") / 5000.0).cast("bigint").alias("n")).distinct()
    steps = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if 1 <= abs(a) + abs(b) <= 2]
    near = o.select("e", "n", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps])).alias("s"))
    near = near.select((F.col("e") + F.col("s.a")).alias("e"), (F.col("n") + F.col("s.b")).alias("n")).distinct()
    return near.join(o, ["e", "n"], "left_anti").withColumn("rank", keys.hash_rank("cells-v1", F.concat_ws("_", F.col("e").cast("string"), F.col("n").cast("string"))))


@query("jon05_distance_semi_anti", f"""SELECT a.site_id, EXISTS (SELECT 1 FROM ({v.SITES}) b WHERE b.block_id < 3 AND (a.easting - b.easting) * (a.easting - b.easting) + (a.northing - b.northing) * (a.northing - b.northing) < 15000.0 * 15000.0) AS near FROM ({v.SITES}) a WHERE a.block_id >= 3""")
def semi_anti(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    left, right = p.where("block_id >= 3"), p.where("block_id < 3")
    near = near_pairs(left, right, 15000, closer_than(15000), "left_semi").select("site_id", F.lit(True).alias("near"))
    return left.select("site_id").join(near, "site_id", "left").select("site_id", F.coalesce("near", F.lit(False)).alias("near"))


@query("jon06_near_pair_counts", f"""SELECT a.block_id, count(*) AS pairs FROM ({v.SITES}) a JOIN ({v.SITES}) b ON a.site_id < b.site_id AND a.block_id = b.block_id AND (a.easting - b.easting) * (a.easting - b.easting) + (a.northing - b.northing) * (a.northing - b.northing) < 20000.0 * 20000.0 GROUP BY a.block_id""")
def near_counts(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d).where("block_id is not null")
    counts = tiled_pairs(p, "site_id", 20000, in_disc(20000), class_counts(lambda t: t.column("block_id").to_numpy()), "first int, second int, n long", "block_id")
    return counts.groupBy(F.col("first").alias("block_id")).agg(F.sum("n").alias("pairs"))


@query("jon07_cross_partition_overlaps", f"""SELECT a.site_id AS first, b.site_id AS second FROM ({v.SITES}) a JOIN ({v.SITES}) b ON a.site_id < b.site_id AND a.block_id % 3 <> b.block_id % 3 AND abs(a.easting - b.easting) < 2000 AND abs(a.northing - b.northing) < 2000""")
def cross_overlaps(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d).select("site_id", "x", "y", (F.col("block_id") % 3).alias("block")).where("block is not null")
    return tiled_pairs(p, "site_id", 2000, in_square(2000), id_pairs("site_id", lambda t: t.column("block").to_numpy()), "first long, second long")


@query("jon09_cross_group_patches", f"""SELECT a.site_id AS first, b.site_id AS second FROM ({BOUNDS}) a JOIN ({BOUNDS}) b ON a.site_id < b.site_id AND a.site_id % 5 <> b.site_id % 5 AND a."left" < b."right" + 3000 AND b."left" < a."right" + 3000 AND a.bottom < b.top + 3000 AND b.bottom < a.top + 3000""")
def cross_patches(spark: SparkSession, d: str) -> DataFrame:
    b = s.patch_bounds(F.col("easting"), F.col("northing"), 128)
    p = v.sites(spark, d).select("site_id", b["left"].alias("x"), b["bottom"].alias("y"))
    return tiled_pairs(p, "site_id", 3128, in_square(3128), id_pairs("site_id", lambda t: t.column("site_id").to_numpy() % 5), "first long, second long")


@query("jon11_content_overlap", "SELECT count(*) AS shared FROM (SELECT sha256(text) FROM documents INTERSECT SELECT sha256(text) FROM benchmark)")
def content_overlap(spark: SparkSession, d: str) -> DataFrame:
    a, b = (v.table(spark, d, t).select(F.sha2("text", 256).alias("h")) for t in ("documents", "benchmark"))
    return a.intersect(b).agg(F.count("*").alias("shared"))


@query("jon12_pair_rows", "SELECT observation_group, max(CASE WHEN label = 1 THEN s END) AS positive, max(CASE WHEN label = 0 THEN s END) AS background FROM (SELECT o_custkey AS observation_group, CAST(o_orderkey % 2 AS INTEGER) AS label, round(o_totalprice, 2) AS s FROM orders) GROUP BY observation_group HAVING count(DISTINCT label) = 2")
def pair_rows(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.joins import matched_pairs

    o = v.table(spark, d, "orders").select(F.col("o_custkey").alias("observation_group"), (F.col("o_orderkey") % 2).cast("int").alias("label"), F.round("o_totalprice", 2).alias("s"))
    return matched_pairs(o, "observation_group", "label", "s")


@query("jon01_exact_set_join", "SELECT l.doc_id, d.source, l.quality FROM labels l JOIN documents d USING (doc_id)")
def exact_join(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "labels").select("doc_id", "quality").join(v.table(spark, d, "documents").select("doc_id", "source"), "doc_id").select("doc_id", "source", "quality")


@query("jon02_left_default", "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'unlabelled') AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_default(spark: SparkSession, d: str) -> DataFrame:
    rows = v.table(spark, d, "documents").select("doc_id").join(v.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("unlabelled")).alias("status"))


@query("jon14_role_pairs", f"""SELECT least(a.r, b.r) || '+' || greatest(a.r, b.r) AS roles, count(*) AS n FROM (SELECT *, CASE WHEN block_id % 2 = 0 THEN 'background' ELSE 'positive' END AS r FROM ({v.SITES})) a
  JOIN (SELECT *, CASE WHEN block_id % 2 = 0 THEN 'background' ELSE 'positive' END AS r FROM ({v.SITES})) b ON a.site_id < b.site_id AND abs(a.easting - b.easting) < 4000 AND abs(a.northing - b.northing) < 4000 GROUP BY 1""")
def role_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d).withColumn("r", F.when(F.col("block_id") % 2 == 0, 0).otherwise(1).cast("long"))
    counts = tiled_pairs(p.select("site_id", "x", "y", "r"), "site_id", 4000, in_square(4000), class_counts(lambda t: t.column("r").to_numpy()), "first long, second long, n long")
    role = [F.when(F.col(c) == 0, "background").otherwise("positive") for c in ("first", "second")]
    return counts.groupBy(F.concat_ws("+", F.array_sort(F.array(*role))).alias("roles")).agg(F.sum("n").alias("n"))


@query("fil05_rejection_reasons", f"""WITH p AS (SELECT * FROM ({v.SITES}) WHERE block_id < 4), c AS (SELECT * FROM ({v.SITES}) WHERE block_id >= 4), b AS (SELECT * FROM ({v.SITES}) WHERE block_id = 4)
  SELECT c.site_id, CASE WHEN floor(easting / 100000.0) > 4 THEN 'outside_geographic_group'
   WHEN EXISTS (SELECT 1 FROM p WHERE power(p.easting - c.easting, 2) + power(p.northing - c.northing, 2) < 10000.0 * 10000.0) THEN 'positive_exclusion'
   WHEN EXISTS (SELECT 1 FROM b WHERE b.site_id <> c.site_id AND power(b.easting - c.easting, 2) + power(b.northing - c.northing, 2) < 8000.0 * 8000.0) THEN 'too_close_background' END AS reason FROM c""")
def rejection_reasons(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.joins import first_violation

    p = _points(spark, d)
    c = p.where("block_id >= 4")
    near_p = near_pairs(c, p.where("block_id < 4"), 10000, closer_than(10000), "left_semi").select("site_id", F.lit(True).alias("near_positive"))
    close = closer_than(8000)
    near_b = near_pairs(c, p.where("block_id = 4"), 8000, lambda a, b: (F.col(f"{a}.site_id") != F.col(f"{b}.site_id")) & close(a, b), "left_semi").select("site_id", F.lit(True).alias("near_background"))
    rows = c.join(near_p, "site_id", "left").join(near_b, "site_id", "left")
    rules = [(F.floor(F.col("x") / 100000.0) > 4, "outside_geographic_group"), (F.col("near_positive"), "positive_exclusion"), (F.col("near_background"), "too_close_background")]
    return rows.select("site_id", first_violation(rules).alias("reason"))
