"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks. With the weights w(s) as shares that sum to one, block k of
source s is released at slot floor(k / w) and due by slot ceil((k + 1) / w). Earliest deadline first over
the released blocks fills one slot at a time; every block meets its window (Baruah, Cohen, Plaxton and
Varvel, 1996), so after any number of slots each source lies within one block of its share. Weights that
are not whole are taken to ``WEIGHT_BITS`` bits, so that rounding stays far below a block over the whole schedule.

A block holds ``block`` documents, or more once the table has more than ``MAX_SLOTS`` of such blocks: the
driver then schedules ``MAX_SLOTS`` slots or little more, whatever the size of the table. It gets one count
for each source, at most ``MAX_SOURCES``. Smaller sources beyond that are spread by hash over at most
``MAX_GROUPS`` groups of about ``GROUP_SOURCES``: a group is scheduled by the driver as a source that weighs what
its members weigh, and a task for each group schedules the members the same way, each by its own weight. So each of
these lies within one block of its share of its group, which lies within one block of its share of the whole. The
schedule is a table with a row for each block, joined with the documents on source and block, so a source
with a third of all rows stays divided; documents get their place by arithmetic on their rank in their
source.

No row is dropped or repeated: once a source runs out, a new phase starts at that slot with the weights
of those left, on the blocks they have left. In each phase every source lies within one block of its
share. Sources without a weight come last, in a phase of their own that weighs them by their blocks.

Defined results: within a source, documents are ordered by a hash of seed, id and text; repeated
rows each get a place; a null source is a source of its own; empty tables give empty results;
further columns play no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

MAX_SOURCES = 2_000
MAX_SLOTS = 1_000_000
BLOCK = 16
WEIGHT_BITS = 48
SEED = 11
#: Sources of a group beyond ``MAX_SOURCES``, about, and most groups (twice as many if some sources have no weight).
GROUP_SOURCES = 500
MAX_GROUPS = 500


def whole_weights(weights: dict[int, float]) -> dict[int, int]:
    """Positive weights as whole numbers: as they are if they are whole, else of about ``WEIGHT_BITS`` bits in
    all, one at least."""
    kept = {s: float(w) for s, w in weights.items() if w > 0}
    if all(w.is_integer() for w in kept.values()):
        return {s: int(w) for s, w in kept.items()}
    total = sum(kept.values())
    return {s: max(1, round(w / total * (1 << WEIGHT_BITS))) for s, w in kept.items()}


def earliest_deadlines(weights: dict[int, int], blocks: dict[int, int]) -> Iterator[tuple[int, int]]:
    """``(source, k)`` slot by slot, until a source has no block left. Equal deadlines go by number."""
    period = sum(weights.values())
    waiting: list[tuple[int, int, int]] = []
    ready = [(-(-period // w), s, 0) for s, w in weights.items()]
    heapq.heapify(ready)
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // weights[s]), s, k))
        deadline, s, k = heapq.heappop(ready)
        if slot >= deadline:
            raise ValueError("a block missed its window")
        yield s, k
        k += 1
        slot += 1
        if k == blocks[s]:
            return
        heapq.heappush(waiting, (k * period // weights[s], s, k))


def phases(blocks: dict[int, int], weights: dict[int, float]) -> Iterator[list[tuple[int, int, int]]]:
    """Phase by phase, its ``(source, block, slot)``. ``blocks`` holds each source's number of blocks."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    slot = 0
    while left:
        active = {s: weights[s] for s in left if weights.get(s, 0) > 0}
        whole = whole_weights(active or {s: float(n) for s, n in left.items()})
        out = []
        for s, k in earliest_deadlines(whole, left):
            out.append((s, done[s] + k, slot))
            slot += 1
        for s, _, _ in out:
            left[s] -= 1
        done = {s: blocks[s] - n for s, n in left.items()}
        left = {s: n for s, n in left.items() if n > 0}
        yield out


def ranked(docs: DataFrame, key: str, order: list) -> DataFrame:
    """Adds ``rank``, the place from 0 within ``key``, without gathering a key in one task: rows are
    sorted over all partitions, counted by partition, and numbered from the counts before."""
    at = docs.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    placed = materialize(at.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "mixing-sorted")
    counts = placed.groupBy(key, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(F.col(key).alias("_k"), F.col("_part").alias("_p"), "_first", "_before")
    out = placed.join(counts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")))
    return out.withColumn("rank", F.col("_row") - F.col("_first") + F.col("_before")).drop("_k", "_p", "_part", "_row", "_first", "_before")


def group_schedule(members: DataFrame, size: int) -> DataFrame:
    """``(source, _ib, _start)`` of every block of ``members (_s, source, n, w)``: how many documents of its group
    ``_s`` come before it. One group a task, a row for each source of it."""

    def run(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values(["n", "source"], ascending=[False, True], na_position="first").reset_index(drop=True)
        blocks, weights = dict(enumerate(-(-held.n // size))), dict(enumerate(held.w))
        plan = pd.DataFrame([(i, k) for phase in phases(blocks, weights) for i, k, _ in phase], columns=["i", "_ib"])
        rows = np.minimum(size, held.n.to_numpy()[plan.i] - plan._ib.to_numpy() * size)
        return pd.DataFrame({"source": held.source.to_numpy()[plan.i], "_ib": plan._ib, "_start": np.cumsum(rows) - rows})

    return members.select("_s", "source", "n", "w").groupBy("_s").applyInPandas(run, "source string, _ib long, _start long")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK, temperature: float = 0.7, seed: int = SEED) -> DataFrame:
    """``(doc_id, key, source, block, slot, place)`` of every row; ``key`` is a hash of the text if there
    is one, ``place`` orders the whole mix. Without ``weights``, a source of n documents weighs
    n ^ temperature. In a group, ``block`` counts the group's blocks."""
    spark = docs.sparkSession
    key = F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), key.alias("key"))
    counts = materialize(rows.groupBy("source").agg(F.count("*").alias("n")), "mixing-sources")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("sources")).first()
    largest = counts.orderBy(F.desc("n"), "source").limit(MAX_SOURCES).collect()
    number = {r.source: i for i, r in enumerate(largest)}
    sizes = {i: r.n for i, r in enumerate(largest)}
    given = {r.source: float(r.n) ** temperature for r in largest} if weights is None else weights
    shares = {number[s]: w for s, w in given.items() if s in number}
    size = max(block, -(-total.rows // MAX_SLOTS))
    names = spark.createDataFrame([(s, i) for s, i in number.items()], "_name string, _s int")
    numbered = rows.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("_name")), "left").drop("_name")  # MAX_SOURCES rows at most
    numbered = numbered.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "key"))
    placed = ranked(numbered, "source", ["_h", "doc_id", "key"])
    if (rest := total.sources - len(largest)) > 0:
        groups = min(MAX_GROUPS, -(-rest // GROUP_SOURCES))
        others = counts.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("_name")), "left_anti")
        if weights is None:
            others = others.withColumn("w", F.pow("n", F.lit(temperature)))
        else:
            told = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "_name string, _w double")
            others = others.join(told, F.col("source").eqNullSafe(F.col("_name")), "left").withColumn("w", F.coalesce("_w", F.lit(0.0))).drop("_name", "_w")
        group = -1 - 2 * F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(groups)) - (F.col("w") <= 0).cast("int")  # without weights, groups of their own
        members = others.withColumn("_s", group.cast("int"))
        for r in members.groupBy("_s").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).collect():  # 2 * MAX_GROUPS rows at most
            sizes[r._s], shares[r._s] = r.n, max(r.w, 0.0)
        starts = group_schedule(members, size).join(members.select(F.col("source").alias("_name"), F.col("_s").alias("_g")), F.col("source").eqNullSafe(F.col("_name"))).select("_name", "_ib", "_start", "_g")
        found = F.col("source").eqNullSafe(F.col("_name")) & (F.floor(F.col("rank") / F.lit(size)) == F.col("_ib"))
        placed = placed.join(starts, found, "left").withColumns({"_s": F.coalesce("_s", "_g"), "rank": F.coalesce(F.col("_start") + F.col("rank") % size, F.col("rank"))})
    plan = [x for phase in phases({s: -(-n // size) for s, n in sizes.items()}, shares) for x in phase]
    schedule = spark.createDataFrame(pd.DataFrame(plan, columns=["_s", "_b", "slot"]), "_s int, _b long, slot long")  # about MAX_SLOTS rows at most
    placed = placed.withColumn("_b", F.floor(F.col("rank") / F.lit(size)))
    return placed.join(schedule, ["_s", "_b"]).select("doc_id", "key", "source", F.col("_b").alias("block"), "slot", (F.col("slot") * size + F.col("rank") % size).alias("place"))


def placed_documents(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with ``_place``, which orders them by the mix."""
    # rows equal in id, text and source are alike: they stand together at the first of their places
    plan = mix(docs, **params).groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), F.col("source").alias("_s")).agg(F.min("place").alias("_place"))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_k")) & F.col("source").eqNullSafe(F.col("_s"))
    return docs.join(plan, on).select(*docs.columns, "_place")


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """``docs`` in the order of the mix: partitions and the rows in them follow ``place``."""
    return placed_documents(docs, **params).repartitionByRange("_place").sortWithinPartitions("_place").select(*docs.columns)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source")).select("doc_id", "source", "block", "slot", "place")
