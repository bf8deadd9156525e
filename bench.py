"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

``value`` is the sum over the queries of the best of two runs to a sink that takes every row.
``patches_per_second`` is the packed preprocessing path (quality mask, stencils, pooling into 4,096
features) over in-memory patches, the one published figure that can be compared; its cores are given.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from strata.operators import raster
from strata.plans import registry
from strata.session import local_session

HEADLINE = (
    "met02_auc_by_region", "met01_confusion_by_region", "bst01_group_bootstrap", "agg04_duplicates", "agg12_field_errors", "fil01_title_triage", "fil02_entry_rubric", "jon05_distance_semi_anti",
    "jon07_cross_partition_overlaps", "grd01_suppression", "grd07_overlap_components", "top02_stratified_queue", "top05_review_queues", "ras08_representations", "ras10_features_packed",
    "spl03_random_violations", "ldg08_illegal_moves", "con05_batch_admission",
)
PATCHES = 2048


def seconds(run) -> float:
    t = time.perf_counter()
    run()
    return time.perf_counter() - t


def sink(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, memory="12g")
    registry.load()
    took = {name: round(min(seconds(lambda n=name: sink(registry.QUERIES[n](spark, sf_dir))) for _ in range(2)), 3) for name in HEADLINE}
    pixels = raster.surfaces(raster.patch_ids(spark, 8))
    few = raster.packed(pixels).withColumnRenamed("patch_id", "kind")
    many = spark.range(PATCHES).withColumnRenamed("id", "patch_id").withColumn("kind", F.col("patch_id") % 8).join(F.broadcast(few), "kind").repartition(cpus * 2).cache()  # eight surfaces
    many.count()
    rate = PATCHES / min(seconds(lambda: sink(raster.packed_features(many))) for _ in range(3))
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus, "patches_per_second": round(rate, 1)}))


if __name__ == "__main__":
    main()
