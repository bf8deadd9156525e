"""Joins with a rule to them: matched pairs, exact sets, first violation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matched_pairs(rows: DataFrame, pair: str, label: str, value: str) -> DataFrame:
    """One row for each pair that has both roles: ``(pair, positive, background)``."""
    grouped = rows.groupBy(pair).agg(
        F.max(F.when(F.col(label) == 1, F.col(value))).alias("positive"), F.max(F.when(F.col(label) == 0, F.col(value))).alias("background"),
        F.count_distinct(label).alias("_roles"),
    )
    return grouped.where("_roles = 2").drop("_roles")


def set_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``(side, key)`` of what only one side has; empty if the sets are equal."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").select(F.lit("left").alias("side"), key).unionAll(b.join(a, key, "left_anti").select(F.lit("right").alias("side"), key))


def exact_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that fails if a key is missing on either side."""
    missing = set_differences(left, right, key).limit(1).collect()
    if missing:
        raise ValueError(f"{missing[0].side} only: {missing[0][key]}")
    return left.join(right, key)


def first_violation(rules: list[tuple[Column, str]]) -> Column:
    """Name of the first rule that holds, in order; NULL if none does. A NULL condition does not hold."""
    return F.coalesce(*[F.when(c, F.lit(name)) for c, name in rules], F.lit(None).cast("string"))
