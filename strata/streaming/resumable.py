"""Resumable item processing: finished ids are Parquet rows; a run takes what is not among them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def finished(spark: SparkSession, path: str, key: str, kind: str) -> DataFrame:
    """Ids done so far; empty before the first run."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], f"{key} {kind}")
    return spark.read.parquet(path).select(key).distinct()


def run_pending(items: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], state: str) -> DataFrame:
    """Works on items that have no row in ``state`` and appends their results there. ``work`` must keep
    ``key``. A run that is cut off leaves no part of its result; the next one takes the same items."""
    kind = dict(items.dtypes)[key]
    pending = items.join(finished(items.sparkSession, state, key, kind), key, "left_anti")
    work(pending).write.mode("append").parquet(state)
    return items.sparkSession.read.parquet(state)


def stream_pending(spark: SparkSession, source: str, schema: StructType, key: str, work: Callable[[DataFrame], DataFrame], state: str, checkpoint: str) -> StreamingQuery:
    """The same over a growing folder of Parquet files; each batch's rows are appended once."""
    kind = dict((f.name, f.dataType.simpleString()) for f in schema.fields)[key]

    def batch(rows: DataFrame, _: int) -> None:
        done = finished(rows.sparkSession, state, key, kind)
        work(rows.dropDuplicates([key]).join(done, key, "left_anti")).write.mode("append").parquet(state)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tally(results: DataFrame, status: str = "status") -> DataFrame:
    """Counts by status and by first reason, with attempts."""
    return results.groupBy(status, F.element_at("reasons", 1).alias("reason")).agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))
