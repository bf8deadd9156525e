"""What stands between frozen rows and a score: digests of packed arrays, a verified load, frozen parameters,
artefact digests and the chain of gates of one request."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .contracts import row_violations


def with_digest(rows: DataFrame, values: str, name: str = "digest") -> DataFrame:
    """Adds the SHA-256 of an array of numbers as little-endian float32: of the batch's own buffer, in Arrow. NULL for
    a NULL array or one with a NULL in it. No shuffle."""
    schema = rows.select("*", F.lit(None).cast("string").alias(name)).schema
    column = rows.columns.index(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(column)
            at = lists.offsets.to_numpy()
            flat = lists.values
            absent = np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False))
            raw = memoryview(np.ascontiguousarray(flat.fill_null(0).to_numpy(zero_copy_only=False), "<f4")).cast("B")
            out = []
            for i, whole in enumerate(lists.is_valid().to_pylist()):
                whole = whole and np.searchsorted(absent, at[i]) == np.searchsorted(absent, at[i + 1])
                out.append(hashlib.sha256(raw[4 * at[i] : 4 * at[i + 1]]).hexdigest() if whole else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, schema)


def load_violations(rows: DataFrame, frozen: DataFrame, length: int, counts: dict[int, int] | None = None, key: str = "id", values: str = "features") -> DataFrame:
    """``(rule, key)`` of a load of ``(key, label, values)`` against the frozen ``(key, label, digest)``: ``missing``,
    ``unknown``, ``repeated`` (in either), ``content`` (digest), ``shape`` (length, or an entry that is no finite number),
    ``label``; and with ``counts``, ``balance`` with the label whose number of rows is another. NULL breaks a rule; a
    NULL key is ``unknown``. Digests are made in the pass that reads the rows; the join is on the key."""
    seen = with_digest(rows.select(F.col(key).alias("_id"), F.col("label").alias("_label"), F.col(values).cast("array<float>").alias("_v")), "_v", "_digest")
    sane = (F.size("_v") == length) & F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    seen = seen.select("_id", "_label", "_digest", sane.alias("_sane"), F.lit(1).alias("_here"))
    kept = frozen.select(F.col(key).alias("_k"), F.col("label").alias("_l"), F.col("digest").alias("_d"), F.lit(1).alias("_there"))
    both = seen.join(kept, F.col("_id") == F.col("_k"), "full").withColumn("_key", F.coalesce("_id", "_k"))
    here, there = F.col("_here").isNotNull(), F.col("_there").isNotNull()
    apart = ~here | ~there  # what is on one side only breaks that rule and no other
    rules = {
        "missing": here, "unknown": there, "content": apart | (F.col("_digest") == F.col("_d")), "shape": apart | F.col("_sane"), "label": apart | (F.col("_label") == F.col("_l")),
    }
    found = row_violations(both, "_key", rules).distinct()
    for side, k in ((rows, key), (frozen, key)):
        many = side.groupBy(F.col(k).cast("string").alias("key")).agg(F.count("*").alias("n")).where("n > 1 and key is not null")
        found = found.unionByName(many.select(F.lit("repeated").alias("rule"), "key"))
    if counts is not None:
        wanted = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])
        have = rows.groupBy(F.coalesce(F.col("label").cast("int"), F.lit(-1)).alias("l")).agg(F.count("*").alias("n"))
        have = have.unionByName(rows.sparkSession.createDataFrame([(k, 0) for k in counts], "l int, n long")).groupBy("l").agg(F.sum("n").alias("n"))
        off = ~F.coalesce(F.get(F.map_values(F.map_filter(wanted, lambda k, _: k == F.col("l"))), F.lit(0)) == F.col("n"), F.lit(False))
        found = found.unionByName(have.where(off).select(F.lit("balance").alias("rule"), F.col("l").cast("string").alias("key")))
    return found.distinct()


def load_verified(rows: DataFrame, frozen: DataFrame, length: int, counts: dict[int, int], key: str = "id", values: str = "features") -> DataFrame:
    """The rows, once nothing is broken; else an error that names the first few faults."""
    from .contracts import assert_empty

    assert_empty(load_violations(rows, frozen, length, counts, key, values))
    return rows


# The settings of the frozen forest.
FROZEN_FOREST = {
    "numTrees": 300, "maxDepth": 8, "minInstancesPerNode": 5, "featureSubsetStrategy": "sqrt", "impurity": "gini", "bootstrap": True, "subsamplingRate": 1.0, "minInfoGain": 0.0,
    "minWeightFractionPerNode": 0.0, "seed": 20260827,
}


def parameter_faults(model: PipelineModel, frozen: dict[str, object] | None = None) -> list[str]:
    """Names of settings of a fitted pipeline's last stage that are not the frozen ones, and ``trees`` if it holds
    another number of trees than it was told to."""
    frozen = FROZEN_FOREST if frozen is None else frozen
    last = model.stages[-1]
    has = {p.name: v for p, v in last.extractParamMap().items()}
    faults = [name for name, value in frozen.items() if name not in has or has[name] != value]
    if "numTrees" in frozen and len(last.trees) != frozen["numTrees"]:
        faults.append("trees")
    return faults


def artifact_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over ``path:digest`` of all files of a saved model in path order; its files are few, and each is hashed
    where it is read. Markers and checksum files (names that begin with ``_`` or ``.``) are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    inner = F.substring_index("path", path.rstrip("/").split(":")[-1].lstrip("/") + "/", -1)
    lines = files.select(F.concat(inner, F.lit(":"), F.sha2("content", 256)).alias("line")).where(~inner.rlike(r"(^|/)[._][^/]*$"))
    return lines.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256)).first()[0]


def request_fault(approved: dict[str, str], artifact: str, location: str, length: int = 4096) -> Column:
    """First fault of a request ``(model, config, path, artifact, adapter_model, adapter_config, adapter_artifact, features,
    score)``, NULL if it may be answered. In order: identity, settings, place, bytes, feature vector, adapter (absent, then
    bound to something else), score. Nothing behind the first fault is looked at; NULL is a fault of its gate.
    ``approved`` holds the settings digest of each approved model."""
    holds = lambda c: F.coalesce(c, F.lit(False))
    digests = F.create_map(*[F.lit(x) for pair in approved.items() for x in pair])
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    bound = (F.col("adapter_model") == F.col("model")) & (F.col("adapter_config") == F.col("config")) & (F.col("adapter_artifact") == artifact)
    score = F.col("score")
    return (
        F.when(~holds(F.col("model").isin(*approved)), "model_not_approved").when(~holds(F.col("config") == F.element_at(digests, F.col("model"))), "config_mismatch")
        .when(~holds(F.col("path") == location), "path_not_approved").when(~holds(F.col("artifact") == artifact), "artifact_mismatch")
        .when(~holds((F.size("features") == length) & F.forall("features", finite)), "feature_contract")
        .when(F.col("adapter_model").isNull(), "adapter_unavailable").when(~holds(bound), "adapter_mismatch").when(~holds(finite(score) & score.between(0, 1)), "score_out_of_range")
    )
