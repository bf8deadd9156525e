"""Group-safe splits and their audits (SPL)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import hash_rank, related_unit


def unit_column() -> Column:
    return related_unit(F.col("component"), F.col("observation_group").cast("string"))


def group_random_split(rows: DataFrame, group: str, final: int, development: int, seed: str) -> DataFrame:
    """Adds ``partition``: groups in hash order until the final test, then development, are full; the
    rest trains. Every group weighs one, so the fill is a prefix of the order."""
    groups = rows.select(group).distinct().withColumn("_rank", hash_rank(seed, F.col(group)))
    first = groups.orderBy("_rank", group).limit(final + development).withColumn("_n", F.row_number().over(Window.orderBy("_rank", group)))
    part = first.select(group, F.when(F.col("_n") <= final, "final_test").otherwise("development").alias("partition"))
    return rows.join(part, group, "left").withColumn("partition", F.coalesce("partition", F.lit("train")))


def block_split(rows: DataFrame, block: str, final: list, development: list) -> DataFrame:
    """Adds ``partition`` by whole blocks; the lists must not overlap."""
    if set(final) & set(development):
        raise ValueError("a block is in two partitions")
    b = F.col(block)
    return rows.withColumn("partition", F.when(b.isin(*final), "final_test").when(b.isin(*development), "development").otherwise("train"))


def integrity_violations(rows: DataFrame, key: str) -> DataFrame:
    """``(rule, key)``: repeated ids, groups, components or blocks in two partitions, unbalanced ones. Ids are
    counted as they are; the rest is combined by group, component and partition before each key is judged."""
    repeated = rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated_id").alias("rule"), F.col("key").cast("string").alias("key"))
    columns = {"group_crosses": "observation_group", "component_crosses": "component", "class_imbalance": "partition"}
    few = rows.groupBy("observation_group", "component", "partition").agg(F.sum(F.col("label") * 2 - 1).alias("d"))
    keys = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(c).cast("string").alias("key")) for rule, c in columns.items()])
    seen = few.select("partition", "d", F.explode(keys).alias("k")).where((F.col("k.key") != "") | (F.col("k.rule") != "component_crosses"))
    sides = seen.groupBy("k.rule", "k.key", "partition").agg(F.sum("d").alias("d")).groupBy("rule", "key").agg(F.count("partition").alias("n"), F.sum("d").alias("d"))
    broken = F.when(F.col("rule") == "class_imbalance", F.col("d") != 0).otherwise(F.col("n") > 1)
    return repeated.unionAll(sides.where(broken).select("rule", "key"))


def training_units(rows: DataFrame, unit: Column, fold: int, fraction: float, seed: str) -> DataFrame:
    """The units that train at a fraction: hash order, half-even count, one at least."""
    if fraction not in (0.25, 0.5, 0.75, 1.0):
        raise ValueError("the fraction was not fixed beforehand")
    units = rows.where(F.col("fold") != fold).select(unit.alias("unit")).distinct()
    n = units.count()
    if fraction == 1.0:
        return units
    return units.orderBy(hash_rank(f"{seed}:{fold}:{fraction:.2f}", F.col("unit")), "unit").limit(max(1, round(n * fraction)))


def partition_summary(rows: DataFrame) -> DataFrame:
    unit = unit_column()
    return rows.groupBy("partition").agg(
        F.count("*").alias("rows"), F.count_distinct("block").alias("blocks"), F.count_distinct(unit).alias("units"), F.sum("label").alias("positives"), F.sum(1 - F.col("label")).alias("backgrounds")
    )


def fold_roles(rows: DataFrame, fold: str, folds: int) -> DataFrame:
    """Every row once for each fold, as ``test`` in its own and ``train`` in the others."""
    many = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return many.withColumn("role", F.when(F.col(fold) == F.col("fold"), "test").otherwise("train"))
