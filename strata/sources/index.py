"""Index tables as CSV: explicit schema, checks on reading, exclusive creation, verified writes, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.contracts import assert_empty, assert_public, repeated
from ..operators.metrics import inventory_digest

#: A modelling index; column order is the CSV header.
MODELLING_INDEX = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("sample_id", "class_label", "observation_group_id", "overlap_component_id", "geographic_block_id", "survey_year", "provenance_id")]
    + [T.StructField("source_resolution_m", T.DoubleType()), T.StructField("patch_size_m", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("processing_version", "qa_status", "sampling_stratum", "patch_sha256", "split_random", "split_geographic")]
)


def read_index(spark: SparkSession, path: str, schema: T.StructType, where: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header and a fixed schema; malformed rows fail. Text without a value is an empty string."""
    rows = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    texts = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in texts})
    rows = rows if where is None else rows.where(where)
    return rows if columns is None else rows.select(*columns)


def masked_index(rows: DataFrame, partition: str, hidden: str, columns: list[str]) -> DataFrame:
    """Columns of rows in the hidden partition are NULL: nobody reads a final test's labels by accident."""
    return rows.withColumns({c: F.when(F.col(partition) != hidden, F.col(c)) for c in columns})


def write_index(rows: DataFrame, path: str, schema: T.StructType, violations: DataFrame | None = None, public: bool = True) -> None:
    """Checks first, then writes; refuses to overwrite. One file for each partition."""
    if violations is not None:
        assert_empty(violations)
    out = rows.select(*schema.names)
    (assert_public(out) if public else out).write.mode("errorifexists").option("header", True).option("emptyValue", "").csv(path)


def content_digest(rows: DataFrame) -> Column:
    """Order-free digest of all rows: count and two 64-bit sums of row hashes, as one string. Hashes skip
    NULLs, so each column comes with a flag; nested values are hashed as JSON, which shows theirs."""

    def plain(name: str) -> Column:
        kind = rows.schema[name].dataType
        nested = isinstance(kind, (T.ArrayType, T.MapType, T.StructType))
        return F.to_json(F.struct(name), {"ignoreNullFields": "false"}) if nested else F.col(name)

    marked = [x for c in rows.columns for x in (F.col(c).isNull(), plain(c))]
    h = F.xxhash64(*marked)
    g = F.xxhash64(*reversed(marked), F.lit(1))
    total = F.coalesce(F.sum(g.cast("decimal(38,0)")), F.lit(0))
    return F.concat_ws(":", F.count("*").cast("string"), F.coalesce(F.bit_xor(h), F.lit(0)).cast("string"), total.cast("string"))


def verified_write(rows: DataFrame, path: str) -> str:
    """Writes Parquet, reads it back and compares digests; gives the digest."""
    digest = rows.agg(content_digest(rows).alias("d")).first().d
    rows.write.mode("errorifexists").parquet(path)
    back = rows.sparkSession.read.parquet(path)
    if back.agg(content_digest(back).alias("d")).first().d != digest:
        raise OSError(f"what was read back from {path} differs")
    return digest


def quarantine(rows: DataFrame, good: Column, reason: Column, path: str) -> DataFrame:
    """Rows that fail go to ``path`` under their reason; the others come back."""
    bad = rows.where(~F.coalesce(good, F.lit(False))).withColumn("reason", reason)
    bad.write.mode("append").partitionBy("reason").parquet(path)
    return rows.where(good)


def read_folds(spark: SparkSession, path: str, digest: str, prefix: str = "fold_", folds: int = 5) -> DataFrame:
    """``(group, fold int)`` of a frozen fold file. A repeated group, a name without the prefix, a fold out of
    range or one that no group has, and a digest other than the frozen one, are errors."""
    rows = spark.read.schema("group string, fold string").option("header", True).option("mode", "FAILFAST").csv(path)
    number = F.expr(f"try_cast(substring(fold, {len(prefix) + 1}) as int)")
    named = rows.withColumn("_n", F.when(F.startswith(F.col("fold"), F.lit(prefix)), number))
    bad = named.where("_n is null or _n < 0 or _n >= " + str(folds)).select(F.lit("fold_name").alias("rule"), F.coalesce("group", F.lit("")).alias("key"))
    missing = spark.range(folds).join(named.select(F.col("_n").cast("long").alias("id")), "id", "left_anti").select(F.lit("missing_fold").alias("rule"), F.col("id").cast("string").alias("key"))
    assert_empty(bad.unionAll(repeated(rows, "group", "repeated_group")).unionAll(missing))
    line = F.concat_ws(":", "group", "fold")
    found = inventory_digest(rows, [], line, "group").first().digest
    if found != digest:
        raise ValueError("the folds differ from the frozen ones")
    return named.select("group", F.col("_n").alias("fold"))
