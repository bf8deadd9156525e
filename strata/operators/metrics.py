"""Classifier metrics, distributions and decision rules, as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outcome(label: Column, predicted: Column) -> Column:
    return F.when((label == 1) & (predicted == 1), "TP").when((label == 0) & (predicted == 0), "TN").when(predicted == 1, "FP").otherwise("FN")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(rows: DataFrame, by: list[str], digits: int = 9) -> DataFrame:
    """Counts, balanced accuracy, accuracy, precision, recall and F1 by group; 0 where undefined."""
    c = {k: F.count_if(outcome(F.col("label"), F.col("predicted")) == k).alias(k.lower()) for k in ("TN", "FP", "FN", "TP")}
    n = rows.groupBy(*by).agg(*c.values()) if by else rows.agg(*c.values())
    tn, fp, fn, tp = (F.col(k) for k in ("tn", "fp", "fn", "tp"))
    recall, precision = _ratio(tp, tp + fn), _ratio(tp, tp + fp)
    values = {
        "balanced_accuracy": (recall + _ratio(tn, tn + fp)) / 2, "accuracy": _ratio(tp + tn, tp + tn + fp + fn), "precision": precision, "recall": recall,
        "f1": _ratio(tp * 2, tp * 2 + fp + fn),
    }
    return n.withColumns({k: F.round(x, digits) for k, x in values.items()})


def _score_groups(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row for each score with its positives and negatives, and both running totals downwards."""
    g = rows.groupBy(*by, "score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.col("score").desc())
    return g.withColumn("tp", F.sum("p").over(w)).withColumn("fp", F.sum("n").over(w))


def auc_and_precision(rows: DataFrame, by: list[str], digits: int = 9) -> DataFrame:
    """Area under the ROC curve (ties half) and average precision (ties together) by group; NULL if a
    class is missing. Rows with equal scores combine before the window, so it sees distinct scores."""
    g = _score_groups(rows, by)
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2))
    steps = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    out = g.groupBy(*by).agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), area.alias("area"), steps.alias("steps"))
    return out.select(
        *by, "positives", "negatives", F.round(F.try_divide("area", F.col("positives") * F.col("negatives")), digits).alias("auc"),
        F.round(F.when(F.col("negatives") > 0, F.try_divide("steps", "positives")), digits).alias("average_precision"),
    )


def curves(rows: DataFrame, by: list[str], digits: int = 9) -> DataFrame:
    """Points of the ROC and precision-recall curves, one for each distinct score."""
    g = _score_groups(rows, by)
    every = Window.partitionBy(*by)
    p, n = F.sum("p").over(every), F.sum("n").over(every)
    return g.select(
        *by, "score", F.round(F.try_divide("fp", n), digits).alias("fpr"), F.round(F.try_divide("tp", p), digits).alias("tpr"), F.round(F.col("tp") / (F.col("tp") + F.col("fp")), digits).alias("precision")
    )


def distribution(rows: DataFrame, by: list[str], value: str, digits: int = 9) -> DataFrame:
    """Count, mean, population deviation, minimum, quartiles and maximum by group."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"), q.alias("q")]
    out = rows.groupBy(*by).agg(*stats) if by else rows.agg(*stats)
    return out.select(*by, "n", *[F.round(c, digits).alias(c) for c in ("mean", "sd", "low", "high")], *[F.round(F.col("q")[i], digits).alias(f"q{k}") for i, k in enumerate((25, 50, 75))])


def histogram(rows: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Counts of fixed bins on [0, 1]; the last one is closed."""
    return rows.groupBy(F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def standardised_medians(rows: DataFrame, group: str, value: str, digits: int = 9) -> DataFrame:
    """(Group median - pooled mean) / pooled deviation; 0 if the deviation is."""
    pooled = rows.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    medians = rows.groupBy(group).agg(F.percentile(value, F.lit(0.5)).alias("median"))
    return medians.crossJoin(F.broadcast(pooled)).select(group, F.round(F.coalesce(F.try_divide(F.col("median") - F.col("m"), "s"), F.lit(0.0)), digits).alias("standardised"))  # pooled is one row


def inventory_digest(rows: DataFrame, by: list[str], line: Column, key: str) -> DataFrame:
    """SHA-256 over the lines of each group in key order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("l")))), lambda x: x["l"])
    return rows.groupBy(*by).agg(F.sha2(F.concat(F.array_join(lines, "\n"), F.lit("\n")), 256).alias("digest"))


def external_outcome(accuracy: Column, low: Column, high: Column, pairs: Column, least: int = 40) -> Column:
    """Reading of a published result: more data, supported, partly supported or not."""
    finite = ~(accuracy.isNull() | low.isNull() | high.isNull() | F.isnan(accuracy) | F.isnan(low) | F.isnan(high))
    sane = (low >= 0) & (low <= accuracy) & (accuracy <= high) & (high <= 1)
    return (
        F.when((pairs < least) | ~finite, "MORE_DATA_REQUIRED")
        .when(~sane, F.raise_error(F.lit("metric and interval are inconsistent")))
        .when((accuracy >= 0.75) & (low > 0.5), "EXTERNAL_GENERALIZATION_SUPPORTED")
        .when(accuracy > 0.5, "EXTERNAL_GENERALIZATION_PARTIALLY_SUPPORTED")
        .otherwise("EXTERNAL_GENERALIZATION_NOT_SUPPORTED")
    )


def robustness_outcome(mean: Column, low: Column, seed_range: Column, half_mean: Column) -> Column:
    """Outcome of the robustness rule; its bounds are fixed values."""
    robust = (mean >= 0.70) & (low >= 0.60) & (seed_range <= 0.05) & (half_mean >= 0.65)
    return F.when(robust, "ROBUST").when((mean >= 0.60) & (low >= 0.50), "MIXED ROBUSTNESS").otherwise("FRAGILE")


def go_decision(accepted: Column, viable: Column, holdouts: Column, fine: Column, sourced: Column) -> Column:
    """Final gate over accepted sites, viable groups, holdout candidates, resolution and provenance."""
    go = (accepted >= 250) & (viable >= 8) & (holdouts >= 2) & fine & sourced
    return F.when(go, "FINAL GO").otherwise("CONDITIONAL GO REMAINS")


def figures_differ(published: DataFrame, again: DataFrame, keys: list[str], figures: list[str]) -> DataFrame:
    """``(*keys, differs)``: whether a published figure is missing, too many or not what the rows give."""
    a, b = published.select(*keys, F.struct(*figures).alias("_a")), again.select(*keys, F.struct(*figures).alias("_b"))
    return a.join(b, keys, "full").select(*keys, (~F.col("_a").eqNullSafe(F.col("_b"))).alias("differs"))


def flattened(rows: DataFrame, nested: str) -> DataFrame:
    """A struct column as columns of their own; structs in it too."""
    out = rows.select(*[c for c in rows.columns if c != nested], f"{nested}.*")
    for f in rows.schema[nested].dataType.fields:
        if f.dataType.typeName() == "struct":
            out = flattened(out, f.name)
    return out
