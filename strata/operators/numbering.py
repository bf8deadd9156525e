"""Places and running sums over sorted rows of any number, without a window that gathers a key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize


def numbered(rows: DataFrame, keys: list[str], order: list[str | Column], value: str | None = None) -> DataFrame:
    """Adds ``rank``, the place from 0 within ``keys``, and with ``value`` also ``before``, the sum of it over
    the rows before. Rows are sorted over all partitions; a partition counts on from what the ones before it
    hold of the key, which is a row for each key and partition."""
    by = [F.col(k) for k in keys]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = rows.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order)
    placed = materialize(at.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    summed = F.sum(value) if value else F.lit(0)
    held = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"), summed.alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    held = held.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sums"),
    )
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = placed.join(F.broadcast(held), same) if not keys else placed.join(held, same)  # without keys, a row for each partition
    out = out.withColumn("rank", F.col("_row") - F.col("_first") + F.col("_before"))
    if value:
        inside = Window.partitionBy(*keys, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("before", F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col("_sums"))
    return out.drop("_part", "_row", "_first", "_before", "_sums", "_p", *[f"_k{i}" for i in range(len(keys))])
