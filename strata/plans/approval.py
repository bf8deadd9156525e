"""Judged rasters, verified loads, frozen settings and request gates (RAS12, RAS15, PIP08, PIP09, CON14, CON15, CON18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import approval, models, quality
from ..operators import raster as r
from . import views as v
from .raster import PIXELS, REPS
from .registry import query

#: Faults planted in representations, by patch: a gap filled, a stray gap beyond one pixel, a slope out of range, a
#: shifted median, a relief that differs from the reference.
JUDGED = """SELECT patch_id, array_to_string(list_filter([
    CASE WHEN patch_id % 4 = 1 AND patch_id % 5 = 0 THEN 'elevation:gap_filled' END, CASE WHEN patch_id % 7 = 3 THEN 'elevation:median' END,
    CASE WHEN patch_id % 6 = 2 THEN 'slope:stray_gap' END, CASE WHEN patch_id % 11 = 4 THEN 'slope:range' END, CASE WHEN patch_id % 8 = 5 THEN 'relief:differs' END], lambda x: x IS NOT NULL), ';') AS reasons"""


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    return r.prepared(r.surfaces(v.table(spark, d, "nation").select(F.col("n_nationkey").alias("patch_id"))))


@query("ras12_packed_quality", f"SELECT *, reasons = '' AS passed FROM ({JUDGED} FROM (SELECT n_nationkey AS patch_id FROM nation))")
def packed_quality(spark: SparkSession, d: str) -> DataFrame:
    """Representations with planted faults, judged packed. The reference copy has all faults but those of relief."""
    p = _prepared(spark, d)
    k, at = F.col("patch_id"), (F.col("row") == 9) & (F.col("col") == 11)
    planted = r.representations(p).withColumns({
        "elevation": F.when((k % 4 == 1) & (k % 5 == 0), F.coalesce("elevation", F.lit(0.0))).otherwise(F.col("elevation")) + F.when(k % 7 == 3, 0.5).otherwise(0.0),
        "slope": F.when((k % 6 == 2) & at, F.lit(None)).when((k % 11 == 4) & (F.col("row") == 100) & (F.col("col") == 3), 91.0).otherwise(F.col("slope")),
    })
    rows = quality.packed_representations(p, planted)
    for c in r.CHANNELS:
        rows = rows.withColumn(f"reference_{c}", F.transform(c, lambda x, i: x + F.when((k % 8 == 5) & (i == 77), 0.25).otherwise(0.0).cast("float")) if c == "relief" else F.col(c))
    return quality.packed_violations(rows, reference="reference_").select(F.col("patch_id").cast("int").alias("patch_id"), "reasons", "passed")


CELL = 50
#: The first column of each raster that starts a cell; in every fifth raster it repeats the column before it.
TILED = f'SELECT patch_id, "row", "col", CASE WHEN patch_id % 5 = 2 AND "col" = {CELL} * (patch_id * 36 // {CELL} + 1) - patch_id * 36 THEN lag(z) OVER (PARTITION BY patch_id, "row" ORDER BY "col") ELSE z END AS z FROM ({PIXELS})'
SEAM_ROWS = "SELECT t.*, q.slope, q.relief FROM t JOIN q USING (patch_id, \"row\", \"col\")"
SEAM_STEPS = """SELECT patch_id, 'vertical' AS orientation, "col" AS "index", abs(z - lag(z) OVER w) AS step, z IS NOT DISTINCT FROM lag(z) OVER w AS same, slope, lag(slope) OVER w AS slope2, abs(relief) AS relief FROM p WINDOW w AS (PARTITION BY patch_id, "row" ORDER BY "col")
  UNION ALL SELECT patch_id, 'horizontal', "row", abs(z - lag(z) OVER w), z IS NOT DISTINCT FROM lag(z) OVER w, slope, lag(slope) OVER w, abs(relief) FROM p WINDOW w AS (PARTITION BY patch_id, "col" ORDER BY "row")"""


@query("ras15_tiling_seams", f"""WITH t AS ({TILED}), q AS ({REPS.replace(PIXELS, TILED)}), p AS ({SEAM_ROWS}), s AS (SELECT * FROM ({SEAM_STEPS}) WHERE "index" > 0),
  l AS (SELECT * FROM (SELECT n_nationkey AS patch_id, 'vertical' AS orientation, {CELL} * k - n_nationkey * 36 AS "index" FROM nation, (SELECT unnest(range(0, 60)) AS k) UNION ALL SELECT n_nationkey, 'horizontal', 1000 - n_nationkey * 11 - {CELL} * k FROM nation, (SELECT unnest(range(0, 60)) AS k)) WHERE "index" > 0 AND "index" < 128),
  o AS (SELECT patch_id, orientation, "index", median(step) AS step, bool_and(same) AS duplicate_edge, median(relief) AS relief_median FROM s JOIN l USING (patch_id, orientation, "index") GROUP BY ALL),
  m AS (SELECT patch_id, orientation, "index", median(x) AS slope_median FROM (SELECT patch_id, orientation, "index", unnest([slope, slope2]) AS x FROM s JOIN l USING (patch_id, orientation, "index")) GROUP BY ALL)
  SELECT patch_id, orientation, "index", round(o.step + 3e-8, 6) AS step, duplicate_edge, round(slope_median + 3e-8, 6) AS slope_median, round(relief_median + 3e-8, 6) AS relief_median,
    round((SELECT 100.0 * avg(CASE WHEN round(s.step, 9) <= round(o.step, 9) THEN 1.0 ELSE 0.0 END) FROM s WHERE s.patch_id = o.patch_id AND s.orientation = o.orientation AND s.step IS NOT NULL), 6) AS percentile
  FROM o JOIN m USING (patch_id, orientation, "index")""")
def tiling_seams(spark: SparkSession, d: str) -> DataFrame:
    k, w = F.col("patch_id"), Window.partitionBy("patch_id", "row").orderBy("col")
    edge = CELL * (F.floor(k * 36 / CELL) + 1) - k * 36
    p = _prepared(spark, d).withColumn("z", F.when((k % 5 == 2) & (F.col("col") == edge), F.lag("z").over(w)).otherwise(F.col("z")))
    extents = v.table(spark, d, "nation").select(F.col("n_nationkey").alias("patch_id")).select(
        "patch_id", (k * 36.0).alias("left"), (1000.0 - k * 11).alias("top"), F.lit(128).alias("width"), F.lit(128).alias("height")
    )
    seams = quality.seam_diagnostics(p, r.representations(p), extents, float(CELL))
    off = [F.round(F.col(c) + 3e-8, 6).alias(c) for c in ("step", "slope_median", "relief_median")]
    return seams.select("patch_id", "orientation", F.col("index").cast("bigint").alias("index"), "duplicate_edge", *off, F.round("percentile", 6).alias("percentile"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 2).alias("label"), F.col("embedding").alias("features"))


@query("pip08_verified_load", """WITH e AS (SELECT vec_id AS id, label % 2 AS label FROM embeddings)
  SELECT 'content' AS rule, CAST(id AS VARCHAR) AS key FROM e WHERE id % 13 <> 12 AND (id % 17 = 5 OR id % 19 = 3 OR id % 23 = 2) UNION ALL SELECT 'shape', CAST(id AS VARCHAR) FROM e WHERE id % 13 <> 12 AND (id % 19 = 3 OR id % 23 = 2)
  UNION ALL SELECT 'label', CAST(id AS VARCHAR) FROM e WHERE id % 13 <> 12 AND id % 29 = 1 AND label IS NOT NULL UNION ALL SELECT 'missing', CAST(id AS VARCHAR) FROM e WHERE id % 13 = 12
  UNION ALL SELECT 'unknown', CAST(-1 - id AS VARCHAR) FROM e WHERE id % 31 = 7 UNION ALL SELECT 'repeated', CAST(id AS VARCHAR) FROM e WHERE id % 37 = 6 AND id % 13 <> 12
  UNION ALL SELECT 'balance', '0' WHERE (SELECT count(*) FROM e) > 0 UNION ALL SELECT 'balance', '1' WHERE (SELECT count(*) FROM e) > 0""")
def verified_load(spark: SparkSession, d: str) -> DataFrame:
    """All vectors against digests frozen from them, after rows were turned by one bit, cut, made no number, given
    another label, taken out, added and repeated. The pins ask for one row of each class."""
    rows, k = _vectors(spark, d), F.col("id")
    frozen = approval.with_digest(rows, "features").drop("features")
    first = F.get("features", F.lit(0))
    features = (
        F.when(k % 23 == 2, F.concat(F.array(F.lit("NaN").cast("float")), F.slice("features", 2, 10_000))).when(k % 19 == 3, F.slice("features", 2, 10_000))
        .when(k % 17 == 5, F.concat(F.array((first + F.when(first == 0, 1.0).otherwise(first * 2.0**-23)).cast("float")), F.slice("features", 2, 10_000))).otherwise(F.col("features"))
    )
    kept = rows.where("id % 13 <> 12").select("id", F.when(k % 29 == 1, 1 - F.col("label")).otherwise(F.col("label")).alias("label"), features.alias("features"))
    now = kept.unionByName(kept.where("id % 37 = 6")).unionByName(rows.where("id % 31 = 7").withColumn("id", -1 - k))
    return approval.load_violations(now, frozen, 64, {0: 1, 1: 1})


@query("pip09_frozen_settings", "SELECT label % 2 AS label, count(*) AS n, '' AS faults, 'maxDepth;trees' AS other_faults FROM embeddings WHERE label IS NOT NULL GROUP BY 1")
def frozen_settings(spark: SparkSession, d: str) -> DataFrame:
    """The forest fitted on all vectors, judged by the frozen settings, and by others that ask for a deeper one."""
    from pyspark.ml.functions import array_to_vector

    rows = _vectors(spark, d).where("label is not null").withColumn("features", array_to_vector(F.col("features").cast("array<double>"))).withColumn("label", F.col("label").cast("double"))
    model = models.forest().fit(rows)
    faults = approval.parameter_faults(model)
    other = approval.parameter_faults(model, {**approval.FROZEN_FOREST, "maxDepth": 9, "numTrees": 299})
    other = [f for f in other if f != "numTrees"]
    return rows.groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n")).withColumns({"faults": F.lit(";".join(faults)), "other_faults": F.lit(";".join(other))})


FAULTS = """CASE WHEN vec_id % 11 = 1 THEN 'model_not_approved' WHEN vec_id % 13 = 2 THEN 'config_mismatch' WHEN vec_id % 17 = 3 THEN 'path_not_approved' WHEN vec_id % 19 = 4 THEN 'artifact_mismatch'
  WHEN embedding IS NULL OR len(embedding) <> 64 OR vec_id % 23 = 5 THEN 'feature_contract' WHEN vec_id % 29 = 6 THEN 'adapter_unavailable' WHEN vec_id % 31 = 7 THEN 'adapter_mismatch'
  WHEN vec_id % 37 = 8 THEN 'score_out_of_range' END"""


@query("con18_request_gates", f"SELECT vec_id, {FAULTS} AS fault FROM embeddings")
def request_gates(spark: SparkSession, d: str) -> DataFrame:
    """One request for each vector; several gates fail for some, the first is named."""
    k, model, config, artifact, place = F.col("vec_id"), "evidence-forest-v1", "c" * 64, "a" * 64, "private/models/forest"
    off = lambda n, i, right, wrong: F.when(k % n == i, F.lit(wrong)).otherwise(F.lit(right))
    rows = v.table(spark, d, "embeddings").select(
        k, off(11, 1, model, "other").alias("model"), off(13, 2, config, None).alias("config"), off(17, 3, place, "/tmp/forest").alias("path"), off(19, 4, artifact, "b" * 64).alias("artifact"),
        F.when(k % 23 == 5, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("features"), off(29, 6, model, None).alias("adapter_model"), off(31, 7, config, "d" * 64).alias("adapter_config"),
        F.lit(artifact).alias("adapter_artifact"), F.when(k % 37 == 8, F.lit("NaN").cast("double")).otherwise((F.get("embedding", F.lit(0)) > 0).cast("double")).alias("score"),
    )
    return rows.select("vec_id", approval.request_fault({model: config}, artifact, place, 64).alias("fault"))
