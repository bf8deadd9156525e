"""Hash-ranked sampling, queues and top-k (TOP, WIN). A limit here is the feature."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import hash_rank
from .quantiles import exact_quantiles
from .shared import materialize


def lowest_ranks(rows: DataFrame, key: str, k: int, seed: str) -> DataFrame:
    """The ``k`` rows of lowest hash rank: a top-k in each partition, then one of those."""
    return rows.withColumn("rank", hash_rank(seed, F.col(key))).orderBy("rank", key).limit(k)


def stratified_queue(rows: DataFrame, key: str, group: str, size: int, seed: str) -> DataFrame:
    """Round robin over groups in hash order: each group's first, then each group's second, and so on.
    Rows beyond a group's first ``size`` cannot be reached and are dropped inside their partitions."""
    within = Window.partitionBy(group).orderBy(hash_rank(seed, F.col(key)), key)
    levels = rows.withColumn("level", F.row_number().over(within)).where(F.col("level") <= size)
    return levels.withColumn("group_rank", hash_rank(f"{seed}:group", F.col(group))).orderBy("level", "group_rank", group).limit(size)


def second_review(rows: DataFrame, key: str, status: str, size: int, seed: str) -> DataFrame:
    """Half accepted, half rejected by hash rank; what one half lacks is filled from all others."""
    ranked = rows.where(F.col(status).isin("accepted", "rejected")).withColumn("rank", hash_rank(seed, F.col(key)))
    half = size // 2
    first = ranked.where(F.col(status) == "accepted").orderBy("rank", key).limit(half)
    other = ranked.where(F.col(status) == "rejected").orderBy("rank", key).limit(size - half)
    chosen = first.unionByName(other).select(key, F.lit(0).alias("_turn"))
    turns = ranked.join(chosen, key, "left").withColumn("_turn", F.coalesce("_turn", F.lit(1)))
    return turns.orderBy("_turn", "rank", key).limit(size).select(key, status)


def review_queues(windows: DataFrame, seed: str, limit: int = 25, high: float = 0.99, band: tuple[float, float] = (0.45, 0.55)) -> DataFrame:
    """``(queue, window_id, score)``: three disjoint queues. HIGH by score from the upper quantile on;
    MEDIUM by hash within the quantile band; REFERENCE by hash from the rest. Scores and hashes are
    computed once, quantiles by selection."""
    rows = materialize(windows.select("window_id", "score", hash_rank(seed, F.col("window_id")).alias("rank")), "review-windows")
    q = exact_quantiles(rows, "score", [high, *band]).first().q
    if q is None:
        return rows.select(F.lit("").alias("queue"), "window_id", "score").limit(0)
    # a queue loses at most ``limit`` rows to each queue before it, so that many more are enough to choose from
    score, by_hash = [F.col("score").desc(), "window_id"], ["rank", "window_id"]
    top = rows.where(F.col("score") >= q[0]).orderBy(*score).limit(limit)
    middle = rows.where(F.col("score").between(q[1], q[2])).orderBy(*by_hash).limit(2 * limit)
    other = rows.orderBy(*by_hash).limit(3 * limit)
    turns = [c.withColumn("_turn", F.lit(i)) for i, c in enumerate((top, middle, other))]
    best = turns[0].unionAll(turns[1]).unionAll(turns[2]).collect()  # six times the limit at most
    queues, seen = [], set()
    for turn, name in enumerate(("HIGH", "MEDIUM", "REFERENCE")):
        found = [r for r in best if r["_turn"] == turn and r["window_id"] not in seen]
        found = sorted(found, key=lambda r: (-r["score"], r["window_id"]) if turn == 0 else (r["rank"], r["window_id"]))[:limit]
        seen |= {r["window_id"] for r in found}
        queues += [(name, r["window_id"], r["score"]) for r in found]
    kinds = dict(rows.dtypes)
    return rows.sparkSession.createDataFrame(queues, f"queue string, window_id {kinds['window_id']}, score {kinds['score']}")


def shortest_prefix(rows: DataFrame, order: list, value: str, target: int, most: int) -> DataFrame:
    """The first rows whose running sum reaches the target, at most ``most``. Only those can matter, so
    the window sees no more than ``most`` rows."""
    first = rows.orderBy(*order).limit(most)
    before = F.coalesce(F.sum(value).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn("_before", before).where(F.col("_before") < target).drop("_before")


def top_per_group(rows: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= k)


def select_primary(results: DataFrame, margin: float = 0.02) -> DataFrame:
    """The model to keep: of those less than ``margin`` below the best score, logistic first, then fewer
    channels, then by name."""
    best = results.agg(F.max("score").alias("_best"))
    close = results.crossJoin(F.broadcast(best)).where(F.col("_best") - F.col("score") < margin)  # best is one row
    return close.orderBy((F.col("model") != "logistic").cast("int"), "channels", "model", "variant").limit(1).drop("_best")
