"""Exact quantiles with linear interpolation, by selection in two passes.

The first pass brackets each wanted rank with an approximate summary, which is bounded and merges in the
shuffle. The second counts what lies below a bracket and the values inside it, equal ones combined in their
tasks; a running sum over the few values inside gives the order statistics. What the brackets miss, by the
counts, is looked up in a third pass over the whole range, so the result never rests on the summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: The summary's error is one part in so many of the rows; a bracket reaches twice that to each side.
ACCURACY = 10_000


def exact_quantiles(rows: DataFrame, value: str, shares: list[float], by: list[str] | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """``(*by, n, q)``: number of values and the quantiles at ``shares`` as an array of doubles, as linear
    interpolation between order statistics gives them. Nulls play no part; a group without values has no row,
    and without ``by`` an empty table gives one row with n = 0 and nulls."""
    by = by or []
    v = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    reach = 2.0 / accuracy
    ends = [x for s in shares for x in (max(0.0, s - reach), min(1.0, s + reach))]
    summary = v.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("_v", ends, accuracy).alias("_e"))
    brackets = materialize(summary, "quantile-brackets")

    def counted(brackets: DataFrame) -> DataFrame:
        names = [F.col(c).alias(f"_b{i}") for i, c in enumerate(by)]
        met = v.join(brackets.select(*names, "_e"), _same(by)) if by else v.crossJoin(F.broadcast(brackets.select("_e")))  # one row
        # a value inside a bracket stands for itself, one below for all of them (null), one above for nothing
        each = F.array(*[
            F.when(F.col("_v") < F.col("_e")[2 * i], F.struct(F.lit(i).alias("i"), F.lit(None).cast("double").alias("v")))
            .when(F.col("_v") <= F.col("_e")[2 * i + 1], F.struct(F.lit(i).alias("i"), F.col("_v").alias("v")))
            for i in range(len(shares))
        ])
        held = met.select(*by, F.explode(F.array_compact(each)).alias("_h")).select(*by, "_h.i", "_h.v").groupBy(*by, "i", "v").agg(F.count("*").alias("c"))
        upto = F.sum("c").over(Window.partitionBy(*by, "i").orderBy(F.col("v").asc_nulls_first()))
        named = brackets.select(*names, F.col("n").alias("_n"))
        ranked = held.withColumn("upto", upto)
        ranked = ranked.join(named, _same(by)) if by else ranked.crossJoin(F.broadcast(named))  # one row
        at = (F.col("_n") - 1) * F.element_at(F.array(*[F.lit(float(s)) for s in shares]), F.col("i") + 1)
        first, last = F.col("upto") - F.col("c"), F.col("upto") - 1  # ranks that the value takes
        low, high = F.floor(at), F.ceil(at)
        found = ranked.groupBy(*by, "i").agg(
            F.max(F.when(F.col("v").isNotNull() & (first <= low) & (low <= last), F.col("v"))).alias("low"),
            F.max(F.when(F.col("v").isNotNull() & (first <= high) & (high <= last), F.col("v"))).alias("high"), F.max(at - low).alias("part"),
        )
        q = found.select(*by, "i", (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("x"))
        lists = q.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("_l"))  # one entry for each share
        return lists.select(*by, F.transform("_l", lambda s: s["x"]).alias("q"))

    def joined(got: DataFrame, brackets: DataFrame) -> DataFrame:
        names = [F.col(c).alias(f"_b{i}") for i, c in enumerate(by)]
        if by:
            return brackets.join(got.select(*names, "q"), _same(by), "left").select(*by, "n", "q")
        return brackets.join(F.broadcast(got), F.lit(True), "left").select("n", F.when(F.col("n") > 0, F.col("q")).alias("q"))  # one row each

    first = materialize(joined(counted(brackets), brackets), "quantiles")
    lost = F.col("q").isNull() | (F.size("q") < len(shares)) | F.exists("q", lambda x: x.isNull())
    missed = first.where(lost & (F.col("n") > 0))
    if missed.isEmpty():
        return first
    whole = F.array(*[F.lit(float(x)) for _ in shares for x in ("-inf", "inf")])
    wide = missed.select(*by, "n", whole.alias("_e"))
    return first.where(~F.coalesce(lost & (F.col("n") > 0), F.lit(False))).unionAll(joined(counted(wide), wide))


def _same(by: list[str]) -> F.Column:
    same = F.lit(True)
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_b{i}"))
    return same
