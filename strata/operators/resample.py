"""Bootstrap intervals and permutation tails. A replicate is a group-by key, so replicates run side by
side; draws come from hashes of (seed, replicate, slot)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .numbering import numbered
from .shared import materialize


def draw_indices(spark, units: int, replicates: int, seed: str) -> DataFrame:
    """``(replicate, slot, unit)``: unit numbers from 0, drawn with replacement."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("replicate").cast("string"), F.lit(":"), F.col("slot").cast("string")), 256), 1, 8), 16, 10).cast("bigint")
    rows = spark.range(replicates).withColumnRenamed("id", "replicate").select("replicate", F.explode(F.sequence(F.lit(0), F.lit(units - 1))).alias("slot"))
    return rows.withColumn("unit", h % units)


METRICS = ("balanced_accuracy", "accuracy", "f1", "roc_auc")
#: Units times distinct scores that every task may hold; beyond it, replicates are joins.
PACKED = 2_000_000


def group_bootstrap(rows: DataFrame, unit: str, replicates: int, seed: str, digits: int = 6, packed: int = PACKED) -> DataFrame:
    """``(metric, defined, undefined, mean, low, high)``: percentile intervals of balanced accuracy, accuracy,
    F1 and ROC area over units drawn with replacement. ``rows`` has ``label``, ``predicted`` and ``score``; a
    unit's rows are drawn together.

    A unit counts in a replicate as often as it is drawn. Counts of a unit are added up with that weight; for
    the ROC area so are its counts at each score, and the weighted area is a running sum over scores. Balanced
    accuracy is the mean recall of the classes that a replicate has; without both of them it has no ROC area."""
    score = rows.groupBy(unit, "score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    counts = rows.groupBy(unit).agg(
        *[F.count_if((F.col("label") == a) & (F.col("predicted") == b)).alias(k) for k, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))]
    )
    groups = score.limit(packed + 1).collect()
    if len(groups) <= packed and len({g[unit] for g in groups}) * len({g["score"] for g in groups}) <= packed:
        every = _packed_replicates(rows.sparkSession, counts.collect(), groups, unit, replicates, seed)
    else:
        every = _joined_replicates(materialize(numbered(counts, [], [unit]).withColumnRenamed("rank", "unit_"), "bootstrap-units"), score, unit, replicates, seed)
    long = every.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("x")) for k in METRICS])).alias("m")).select("m.*")
    q = F.percentile("x", F.array(F.lit(0.025), F.lit(0.975)))  # a value for each replicate
    got = long.groupBy("metric").agg(F.count("x").alias("defined"), (F.count("*") - F.count("x")).alias("undefined"), F.round(F.avg("x"), digits).alias("mean"), q.alias("q"))
    return got.select("metric", "defined", "undefined", "mean", F.round(F.col("q")[0], digits).alias("low"), F.round(F.col("q")[1], digits).alias("high"))


def _packed_replicates(spark: SparkSession, rows: list, groups: list, unit: str, replicates: int, seed: str) -> DataFrame:
    """A row of metrics for each replicate, from matrices of units by scores that every task gets."""
    rows, n = sorted(rows, key=lambda r: (r[unit] is not None, r[unit])), len(rows)
    table = np.array([[r[k] for k in ("tn", "fp", "fn", "tp")] for r in rows], np.int64).reshape(n, 4)
    number, place = {r[unit]: i for i, r in enumerate(rows)}, {s: i for i, s in enumerate(sorted({g["score"] for g in groups}))}
    pos, neg = np.zeros((n, len(place)), np.int64), np.zeros((n, len(place)), np.int64)
    for g in groups:
        pos[number[g[unit]], place[g["score"]]], neg[number[g[unit]], place[g["score"]]] = g["p"], g["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids = batch.column(0).slice(at, 256).to_pylist()
                drawn = np.array([[int.from_bytes(hashlib.sha256(f"{seed}:{r}:{k}".encode()).digest()[:4], "big") % n for k in range(n)] for r in ids])
                w = np.zeros((len(ids), n), np.int64)
                np.add.at(w, (np.arange(len(ids))[:, None], drawn), 1)
                tn, fp, fn, tp = (w @ table).T.astype(float)
                p, below = w @ pos, np.cumsum(w @ neg, axis=1)
                area = (p * (below - (w @ neg) / 2)).sum(axis=1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    recall, other = tp / (tp + fn), tn / (tn + fp)
                    both = np.where(np.isnan(recall), other, np.where(np.isnan(other), recall, (recall + other) / 2))
                    found = [both, (tp + tn) / (tp + tn + fp + fn), np.nan_to_num(2 * tp / (2 * tp + fp + fn)), area / ((tp + fn) * (tn + fp))]
                yield pa.RecordBatch.from_arrays([pa.array(x, from_pandas=True) for x in found], names=list(METRICS))

    return spark.range(replicates).mapInArrow(run, ", ".join(f"{k} double" for k in METRICS))


def _joined_replicates(units: DataFrame, score: DataFrame, unit: str, replicates: int, seed: str) -> DataFrame:
    """The same rows for units and scores of any number: weights are joined with a unit's counts."""
    weights = draw_indices(units.sparkSession, units.count(), replicates, seed).groupBy("replicate", F.col("unit").alias("unit_")).agg(F.count("*").alias("w"))
    weights = materialize(weights, "bootstrap-weights")
    sums = weights.join(units, "unit_").groupBy("replicate").agg(*[F.sum(F.col(k) * F.col("w")).alias(k) for k in ("tn", "fp", "fn", "tp")])
    tn, fp, fn, tp = (F.col(k) for k in ("tn", "fp", "fn", "tp"))
    recalls = F.array_compact(F.array(F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)))
    simple = sums.select(
        "replicate", F.try_divide(F.aggregate(recalls, F.lit(0.0), lambda a, x: a + x), F.size(recalls)).alias("balanced_accuracy"),
        F.try_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"), F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
    )
    groups = score.join(units.select(unit, "unit_"), unit).select("unit_", "score", "p", "n")
    at = weights.join(groups, "unit_").groupBy("replicate", "score").agg(F.sum(F.col("p") * F.col("w")).alias("p"), F.sum(F.col("n") * F.col("w")).alias("n"))
    below = F.sum("n").over(Window.partitionBy("replicate").orderBy("score"))  # a row for each score
    area = at.withColumn("upto", below).groupBy("replicate").agg(F.sum(F.col("p") * (F.col("upto") - F.col("n") / 2)).alias("area"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return simple.join(area.select("replicate", F.try_divide("area", F.col("p") * F.col("n")).alias("roc_auc")), "replicate").select(*[F.col(k).cast("double").alias(k) for k in METRICS])


def permuted_labels(rows: DataFrame, key: str, permutations: int, seed: str) -> DataFrame:
    """``(permutation, key, label)``: labels dealt anew in hash order. Rows and labels are numbered apart
    and matched by number, permutation by permutation, over all partitions."""
    many = rows.select(key, "label", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("permutation"))
    h = F.sha2(F.concat_ws(":", F.lit(seed), F.col("permutation").cast("string"), F.col(key).cast("string")), 256)
    keys = numbered(rows.select(key), [], [key]).select(key, F.col("rank").alias("_n"))  # the same for every permutation
    dealt = numbered(many.select("permutation", "label", h.alias("_h")), ["permutation"], ["_h"]).select("permutation", "label", F.col("rank").alias("_n"))
    return dealt.join(keys, "_n").select("permutation", key, "label")


def plus_one_tail(values: Column, observed: Column) -> Column:
    """(1 + number at or above the observed) / (number + 1)."""
    return (1 + F.count_if(values >= observed)) / (F.count(values) + 1)


def paired_bootstrap(pairs: DataFrame, pair: str, replicates: int, seed: str, digits: int = 6) -> DataFrame:
    """Percentile interval of the balanced accuracy of ``(positive, background)`` predictions: half the
    mean of the positives and of one minus the backgrounds, over pairs drawn with replacement."""
    units = materialize(numbered(pairs, [], [pair]).withColumnRenamed("rank", "unit"), "bootstrap-pairs")
    drawn = draw_indices(pairs.sparkSession, units.count(), replicates, seed).join(units, "unit")
    ba = drawn.groupBy("replicate").agg(((F.avg("positive") + 1 - F.avg("background")) / 2).alias("ba"))
    return ba.agg(F.round(F.avg("ba"), digits).alias("mean"), F.percentile("ba", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select(
        "mean", F.round(F.col("q")[0], digits).alias("low"), F.round(F.col("q")[1], digits).alias("high")
    )
