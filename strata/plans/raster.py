"""Raster operators on closed-form surfaces, one for each nation (RAS, SRC16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import raster as r
from . import views as v
from .registry import query

SURFACE = """SELECT patch_id, "row", "col", CASE s WHEN 0 THEN 100 + (1.1 + k * 0.06) * exp(-((x - k) * (x - k) + (y + k) * (y + k)) / (260.0 + k * 18))
  WHEN 1 THEN 100 - (0.8 + k * 0.05) * exp(-((x + k) * (x + k) + (y - k) * (y - k)) / (320.0 + k * 20)) WHEN 2 THEN 100 + (0.008 + k * 0.001) * x + 0.006 * y
  WHEN 3 THEN 100 + 0.25 * sin(x / (7 + k * 0.2) + k * 0.37) + 0.18 * cos(y / 9.0 - k * 0.37) ELSE 100 + 0.55 * exp(-(x * x + y * y) / 300.0) + 0.18 * sin((x + k) / 8.0) - 0.12 * cos((y - k) / 11.0) END AS z,
  patch_id % 4 = 1 AND ("row" * 7 + "col" * 3) % 97 = 0 AS masked
  FROM (SELECT n_nationkey AS patch_id, "row", "col", CAST("col" - 64 AS DOUBLE) AS x, CAST("row" - 64 AS DOUBLE) AS y, CAST(n_nationkey % 6 AS DOUBLE) AS k, n_nationkey % 5 AS s FROM nation, (SELECT unnest(range(0, 128)) AS "row"), (SELECT unnest(range(0, 128)) AS "col"))"""
PIXELS = f'SELECT patch_id, "row", "col", CASE WHEN NOT masked THEN z END AS z FROM ({SURFACE})'
REPS = f"""SELECT g.patch_id, "row", "col", z - median AS elevation, CASE WHEN z IS NOT NULL THEN degrees(atan(sqrt(ge * ge + gs * gs))) END AS slope, CASE WHEN z IS NOT NULL AND ge IS NOT NULL AND gs IS NOT NULL THEN greatest(0.0, least(1.0, (-ge * -0.5 + gs * 0.5 + sqrt(0.5)) / sqrt(ge * ge + gs * gs + 1))) END AS hillshade, z - box AS relief
 FROM (SELECT patch_id, "row", "col", z, ge, CASE WHEN "row" = 0 THEN (lead(z) OVER c) - z WHEN "row" = 127 THEN z - (lag(z) OVER c) ELSE ((lead(z) OVER c) - (lag(z) OVER c)) / 2 END AS gs,
   (sum(rs) OVER cw) / nullif(sum(rc) OVER cw, 0) AS box FROM (SELECT patch_id, "row", "col", z, CASE WHEN "col" = 0 THEN (lead(z) OVER r) - z WHEN "col" = 127 THEN z - (lag(z) OVER r) ELSE ((lead(z) OVER r) - (lag(z) OVER r)) / 2 END AS ge,
     sum(z) OVER rw AS rs, count(z) OVER rw AS rc FROM ({PIXELS}) WINDOW r AS (PARTITION BY patch_id, "row" ORDER BY "col"), rw AS (PARTITION BY patch_id, "row" ORDER BY "col" ROWS BETWEEN 16 PRECEDING AND 16 FOLLOWING))
   WINDOW c AS (PARTITION BY patch_id, "col" ORDER BY "row"), cw AS (PARTITION BY patch_id, "col" ORDER BY "row" ROWS BETWEEN 16 PRECEDING AND 16 FOLLOWING)) g
 JOIN (SELECT patch_id, median(z) AS median FROM ({PIXELS}) GROUP BY patch_id) m ON g.patch_id = m.patch_id"""


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    return r.surfaces(v.table(spark, d, "nation").select(F.col("n_nationkey").alias("patch_id")))


@query("src16_surfaces", f"SELECT patch_id, round(sum(z), 3) AS total, round(min(z), 6) AS low, round(max(z), 6) AS high, count(*) FILTER (masked) AS masked FROM ({SURFACE}) GROUP BY patch_id")
def surfaces(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d).groupBy("patch_id").agg(F.round(F.sum("z"), 3).alias("total"), F.round(F.min("z"), 6).alias("low"), F.round(F.max("z"), 6).alias("high"), F.count_if("masked").alias("masked"))


#: Closed-form surfaces give values that end in a 5 at the seventh decimal; which way they round would hang on
#: the order of sums. All are moved off such ties before rounding.
OFF_TIES = 3e-8
ROUNDED = ", ".join(f"round({c} + {OFF_TIES}, 6) AS {c}" for c in r.CHANNELS)


@query("ras08_representations", f'SELECT patch_id, "row", "col", {ROUNDED} FROM ({REPS})')
def representations(spark: SparkSession, d: str) -> DataFrame:
    reps = r.representations(r.prepared(_pixels(spark, d)))
    return reps.select("patch_id", "row", "col", *[F.round(F.col(c) + OFF_TIES, 6).alias(c) for c in r.CHANNELS])


POOLED = f'SELECT patch_id, CAST(floor("row" / 4) AS INTEGER) AS brow, CAST(floor("col" / 4) AS INTEGER) AS bcol, coalesce(avg(elevation), 0) AS elevation, coalesce(avg(slope), 0) AS slope, coalesce(avg(hillshade), 0) AS hillshade, coalesce(avg(relief), 0) AS relief FROM ({REPS}) GROUP BY 1, 2, 3'


@query("ras09_mean_pool", f"SELECT patch_id, brow, bcol, {ROUNDED} FROM ({POOLED})")
def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    cells = r.pooled(r.representations(r.prepared(_pixels(spark, d))))
    return cells.select("patch_id", "brow", "bcol", *[F.round(F.col(c) + OFF_TIES, 6).alias(c) for c in r.CHANNELS])


FEATURE_SUMS = f"""SELECT patch_id, CAST(4096 AS INTEGER) AS n, round(sum(elevation), 2) AS elevation, round(sum(slope), 2) AS slope, round(sum(hillshade), 1) AS hillshade, round(sum(relief), 2) AS relief
  FROM ({POOLED}) GROUP BY patch_id"""


def _feature_sums(features: DataFrame) -> DataFrame:
    """Length of the feature vector and the sum of each channel's 1,024 values."""

    def total(k: int) -> Column:
        return F.aggregate(F.slice("features", 1024 * k + 1, 1024), F.lit(0.0), lambda s, x: s + x.cast("double"))

    return features.select(
        F.col("patch_id").cast("int").alias("patch_id"), F.size("features").alias("n"), F.round(total(0), 2).alias("elevation"), F.round(total(1), 2).alias("slope"),
        F.round(total(2), 1).alias("hillshade"), F.round(total(3), 2).alias("relief"),
    )


@query("ras10_features_packed", FEATURE_SUMS)
def features_packed(spark: SparkSession, d: str) -> DataFrame:
    return _feature_sums(r.packed_features(r.packed(_pixels(spark, d))))


@query("ras10_features_long", FEATURE_SUMS)
def features_long(spark: SparkSession, d: str) -> DataFrame:
    return _feature_sums(r.feature_vectors(r.pooled(r.representations(r.prepared(_pixels(spark, d))))))


@query("ras11_patch_review", f"""SELECT patch_id, round(n, 9) AS nodata, CASE WHEN n > 0.005 THEN 'nodata_excess' ELSE '' END AS reasons, n <= 0.005 AS passed FROM (SELECT patch_id, avg(CASE WHEN masked THEN 1.0 ELSE 0.0 END) AS n FROM ({SURFACE}) GROUP BY patch_id)""")
def patch_review(spark: SparkSession, d: str) -> DataFrame:
    return r.patch_review(_pixels(spark, d), most_nodata=0.005)


@query("ras13_byte_scaling", f"""SELECT patch_id, byte, count(*) AS n FROM (SELECT p.patch_id, CAST(floor(greatest(0.0, least(1.0, (z - low) / nullif(high - low, 0))) * 255) AS INTEGER) AS byte FROM ({PIXELS}) p JOIN (SELECT patch_id, quantile_cont(z, 0.02) AS low, quantile_cont(z, 0.98) AS high FROM ({PIXELS}) GROUP BY patch_id) q USING (patch_id)) GROUP BY ALL""")
def byte_scaling(spark: SparkSession, d: str) -> DataFrame:
    return r.byte_scaled(r.prepared(_pixels(spark, d)), "z").groupBy("patch_id", "byte").agg(F.count("*").alias("n"))


@query("ras14_mosaic", f"""SELECT patch_id, round(sum(z), 3) AS total, count(*) AS n FROM (SELECT patch_id, "row", "col", arg_min(z, path) AS z FROM (SELECT patch_id, "row", "col", 'b' AS path, z FROM ({PIXELS}) UNION ALL SELECT patch_id, "row", "col", 'a', z + 1 FROM ({PIXELS}) WHERE "col" < 40) WHERE z IS NOT NULL GROUP BY 1, 2, 3) GROUP BY patch_id""")
def mosaic(spark: SparkSession, d: str) -> DataFrame:
    p = r.prepared(_pixels(spark, d))
    sources = p.withColumn("path", F.lit("b")).unionByName(p.where("col < 40").withColumn("z", F.col("z") + 1).withColumn("path", F.lit("a")))
    return r.mosaic(sources).groupBy("patch_id").agg(F.round(F.sum("z"), 3).alias("total"), F.count("*").alias("n"))


@query("agg11_terrain_summary", f"""SELECT p.patch_id, round(median(p.z), 6) AS elevation, round(avg(slope), 6) AS slope, round(avg(abs(relief)), 6) AS relief, round(avg(CASE WHEN p.z IS NULL THEN 1.0 ELSE 0.0 END), 9) AS missing FROM ({PIXELS}) p JOIN ({REPS}) q USING (patch_id, "row", "col") GROUP BY p.patch_id""")
def terrain_summary(spark: SparkSession, d: str) -> DataFrame:
    p = r.prepared(_pixels(spark, d))
    reps = r.representations(p).groupBy("patch_id").agg(F.round(F.avg("slope"), 6).alias("slope"), F.round(F.avg(F.abs("relief")), 6).alias("relief"))
    own = p.groupBy("patch_id").agg(F.round(F.percentile("z", F.lit(0.5)), 6).alias("elevation"), F.round(F.avg(F.col("z").isNull().cast("double")), 9).alias("missing"))
    return own.join(reps, "patch_id")


@query("agg18_channel_moments", f"SELECT round(avg(slope), 6) AS slope_mean, round(stddev_pop(slope), 6) AS slope_sd, round(avg(relief), 9) AS relief_mean, round(stddev_pop(relief), 6) AS relief_sd FROM ({POOLED})")
def channel_moments(spark: SparkSession, d: str) -> DataFrame:
    cells = r.pooled(r.representations(r.prepared(_pixels(spark, d))))
    return cells.agg(F.round(F.avg("slope"), 6).alias("slope_mean"), F.round(F.stddev_pop("slope"), 6).alias("slope_sd"), F.round(F.avg("relief"), 9).alias("relief_mean"), F.round(F.stddev_pop("relief"), 6).alias("relief_sd"))


@query("ras15_seam_steps", f"""WITH s AS (SELECT patch_id, "col", median(abs(dz)) AS step FROM (SELECT patch_id, "col", z - (lag(z) OVER (PARTITION BY patch_id, "row" ORDER BY "col")) AS dz FROM ({PIXELS})) WHERE dz IS NOT NULL GROUP BY 1, 2)
 SELECT a.patch_id, round(a.step, 6) AS step, round(100.0 * avg(CASE WHEN round(b.step, 9) <= round(a.step, 9) THEN 1.0 ELSE 0.0 END), 6) AS percentile FROM (SELECT * FROM s WHERE "col" = 64) a JOIN s b USING (patch_id) GROUP BY a.patch_id, a.step""")
def seam_steps(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    p = r.prepared(_pixels(spark, d))
    dz = p.withColumn("dz", F.col("z") - F.lag("z").over(Window.partitionBy("patch_id", "row").orderBy("col"))).where("dz is not null")
    steps = dz.groupBy("patch_id", "col").agg(F.percentile(F.abs("dz"), F.lit(0.5)).alias("step"))
    seam = steps.where("col = 64").select("patch_id", F.col("step").alias("seam"))
    share = F.avg((F.round("step", 9) <= F.round("seam", 9)).cast("double")) * 100
    return steps.join(seam, "patch_id").groupBy("patch_id", "seam").agg(F.round(share, 6).alias("percentile")).select("patch_id", F.round("seam", 6).alias("step"), "percentile")
