"""Greedy set algorithms, exact at any size.

Suppression and rejection sampling go over tiles: a tile decides what does not hang on undecided rows beyond
its border, and rounds follow until nothing is open. Folds, fills and diverse orders work on summaries: equal
sizes, running sums, and the first rows of each combination of traits."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .celljoin import closer_than, near_pairs
from .numbering import numbered
from .shared import materialize
from .spatial import annulus_points

#: Rows that the driver takes at once.
HELD = 100_000
#: Rows of whole tiles that a task settles at once, and pairs it looks at in one step.
TILE_ROWS, PAIRS = 200_000, 4_000_000


def _conflicts(row: np.ndarray, col: np.ndarray, cell: np.ndarray, width: int, size: int, distance: float, overlap: float) -> tuple[np.ndarray, np.ndarray]:
    """``(better, worse)``: row numbers of conflicting windows; rows come in order of rank. ``cell`` numbers
    cells of the reach, ``width`` to a line."""
    order = np.argsort(cell, kind="stable")
    sorted_ = cell[order]
    better, worse = [], []
    for offset in (a * width + b for a in (-1, 0, 1) for b in (-1, 0, 1)):
        first, last = np.searchsorted(sorted_, cell + offset, "left"), np.searchsorted(sorted_, cell + offset, "right")
        total = np.cumsum(last - first)
        at = 0
        while at < len(cell):
            upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
            n = (last - first)[at:upto]
            i = np.repeat(np.arange(at, upto), n)
            j = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:upto], n)]
            i, j = i[i < j], j[i < j]
            dr, dc = np.abs(row[i] - row[j]), np.abs(col[i] - col[j])
            shared = np.maximum(size - dr, 0) * np.maximum(size - dc, 0)
            clash = (dr * dr + dc * dc < distance * distance) | (shared / (2 * size * size - shared) > overlap)
            better.append(i[clash])
            worse.append(j[clash])
            at = upto
    return np.concatenate(better), np.concatenate(worse)


def _settle(better: np.ndarray, worse: np.ndarray, kept: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which own rows are kept and which stay open, given those kept before. Rows that aren't own stay open."""
    kept, open_ = kept.copy(), ~kept
    while True:
        fallen = np.zeros(len(kept), bool)
        fallen[worse[kept[better]]] = True
        open_ &= ~(fallen & own)
        live = open_[worse] & (open_[better] | kept[better])
        better, worse = better[live], worse[live]
        waits = np.zeros(len(kept), bool)
        waits[worse[open_[better]]] = True
        new = open_ & own & ~waits
        if not new.any():
            return kept & own, open_ & own
        kept |= new
        open_ &= ~new


def suppress(windows: DataFrame, size: int = 128, distance: float = 128.0, overlap: float = 0.25, tile_cells: int = 64) -> DataFrame:
    """``(domain, window_id, row, col, score, place)``: in order of score and id, a window stays unless
    one kept before it in its domain is nearer than ``distance`` or overlaps it by more than ``overlap``.

    Of windows at one place only the best can stay. The rest is settled by tiles of ``tile_cells`` cells of the
    reach, each with the windows within the reach around it: a window stays once no better one beside it is
    open, and falls once a better one beside it stays. What hangs on windows of another tile waits for the
    next round, which takes the tiles that still hold open windows."""
    if distance <= 0:
        raise ValueError("windows at one place must exclude each other")
    reach = max(size, math.ceil(distance))
    side, width = reach * tile_cells, tile_cells + 4
    kind = windows.select(F.col("domain").cast("long").alias("domain"), "window_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), (-F.col("score").cast("double")).alias("below"))
    best = kind.groupBy("domain", "row", "col").agg(F.min(F.struct("below", "window_id")).alias("b")).select("domain", "row", "col", "b.below", "b.window_id", F.lit(0).alias("state"))

    def tiles(c: str) -> F.Column:
        return F.explode(F.array_distinct(F.array(*[F.floor((F.col(c) + d) / F.lit(side)) for d in (-reach, reach)])))

    names = ["domain", "row", "col", "below", "window_id", "state", "tr", "tc"]
    schema = "domain long, row long, col long, below double, window_id string, state int"

    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(held).combine_chunks()
        domain, row, col, state, tr, tc = (part.column(c).to_numpy() for c in ("domain", "row", "col", "state", "tr", "tc"))
        tile = np.cumsum(np.concatenate([[0], (domain[1:] != domain[:-1]) | (tr[1:] != tr[:-1]) | (tc[1:] != tc[:-1])]))
        cell = (tile * width + (row - tr * side) // reach + 2) * width + (col - tc * side) // reach + 2
        own = (row // side == tr) & (col // side == tc)
        better, worse = _conflicts(row, col, cell, width, size, distance, overlap)
        kept, open_ = _settle(better, worse, state == 1, own)
        out = (kept & (state == 0)) | open_
        state = np.where(kept, 2, 0).astype(np.int32)
        part = part.select(names[:5]).append_column("state", pa.array(state)).filter(pa.array(out))
        return part.combine_chunks().to_batches()[0] if part.num_rows else pa.RecordBatch.from_pylist([], part.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if count >= TILE_ROWS:  # up to the last whole tile
                tile = [batch.column(names.index(c)).to_numpy() for c in ("domain", "tr", "tc")]
                last = [held[-1].column(names.index(c))[-1].as_py() for c in ("domain", "tr", "tc")]
                fresh = np.flatnonzero(~np.logical_and.reduce([t == x for t, x in zip(tile, last)]))
                if len(fresh):
                    yield settle([*held, batch.slice(0, fresh[0])])
                    held, count, batch = [], 0, batch.slice(fresh[0])
            held.append(batch)
            count += batch.num_rows
        if held:
            yield settle(held)

    kept: list[DataFrame] = []
    todo, first = best, True
    while True:
        placed = todo.withColumn("tr", tiles("row")).withColumn("tc", tiles("col"))
        if not first:
            placed = placed.join(todo.where("state = 0").select("domain", F.floor(F.col("row") / side).alias("tr"), F.floor(F.col("col") / side).alias("tc")).distinct(), ["domain", "tr", "tc"], "left_semi")
        dealt = placed.select(*names).repartition("domain", "tr", "tc").sortWithinPartitions("domain", "tr", "tc", "below", "window_id")
        done = materialize(dealt.mapInArrow(run, schema), "suppression")
        kept.append(done.where("state = 2").withColumn("state", F.lit(1)))
        open_ = done.where("state = 0")
        if open_.isEmpty():
            break
        todo, first = open_, False
        for k in kept:
            todo = todo.unionByName(k)
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return numbered(out, ["domain"], ["below", "window_id"]).select("domain", "window_id", "row", "col", (-F.col("below")).alias("score"), (F.col("rank") + 1).alias("place"))


def _picks(totals: list[int], numbers: list[int], step: int, fold: int, u: int) -> int:
    """Place, in a run of groups of size ``step``, of the ``u``-th group that goes to ``fold``: how many picks of
    all folds come before. A fold's picks have the keys (total + u * step, number + u, fold)."""
    t, n = totals[fold] + u * step, numbers[fold] + u
    before = 0
    for k, (tk, nk) in enumerate(zip(totals, numbers)):
        full, rest = divmod(t - tk, step)
        if t < tk:
            continue
        before += full + (rest > 0)
        if rest == 0 and (nk + full, k) < (n, fold):
            before += 1
    return before


def _shares(totals: list[int], numbers: list[int], step: int, count: int) -> list[int]:
    """How many of ``count`` groups of size ``step`` go to each fold."""
    out = []
    for fold in range(len(totals)):
        low, high = 0, count
        while low < high:
            mid = (low + high) // 2
            if _picks(totals, numbers, step, fold, mid) < count:
                low = mid + 1
            else:
                high = mid
        out.append(low)
    return out


def _fold_at(totals: list[int], numbers: list[int], step: int, place: int) -> int:
    return next(f for f, u in enumerate(_shares(totals, numbers, step, place)) if _picks(totals, numbers, step, f, u) == place)


def balanced_folds(rows: DataFrame, group: str, unit: str, folds: int = 5) -> DataFrame:
    """``(group, fold, size)``: groups from large to small, each to the fold with the fewest rows, then
    groups, then number.

    The driver sees a row for each distinct size (at most the root of twice the rows): what a run of equal
    groups adds to each fold follows from the folds' totals before. Groups get their place in their run from
    a sort over all partitions, and their fold from their place."""
    counts = materialize(rows.groupBy(group).agg(F.count("*").alias("size"), F.count_distinct(unit).alias("units")), "fold-groups")
    totals, numbers = [0] * folds, [0] * folds
    runs = []
    for r in counts.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.col("size").desc()).toLocalIterator():
        runs.append((r["size"], list(totals), list(numbers)))
        for f, k in enumerate(_shares(totals, numbers, r["size"], r["n"])):
            totals[f] += k * r["size"]
            numbers[f] += k
    if sum(numbers) < folds:
        raise ValueError("fewer groups than folds")
    before = rows.sparkSession.createDataFrame(runs, "size long, totals array<long>, numbers array<long>")

    @F.pandas_udf("int")
    def fold_of(totals: pd.Series, numbers: pd.Series, size: pd.Series, place: pd.Series) -> pd.Series:
        return pd.Series([_fold_at([int(x) for x in t], [int(x) for x in n], int(s), int(p)) for t, n, s, p in zip(totals, numbers, size, place)], dtype="int32")

    placed = numbered(counts.withColumn("_u", -F.col("units")), ["size"], ["_u", group]).join(before, "size")
    return placed.select(group, fold_of("totals", "numbers", "size", "rank").alias("fold"), "size")


def fill_groups(groups: DataFrame, group: str, weight: str, target: int, order: list[str]) -> DataFrame:
    """``(group, place)``: groups in order, each taken if it fits into what is left of ``target``; an unmet
    target fails. One pass of running sums takes the groups before the first that doesn't fit; what is left is
    less than that group's weight, and lighter ones after it are looked through by ``HELD`` at a time."""
    names = [f"_o{i}" for i in range(len(order))]
    sums = numbered(groups.select(F.col(group).alias("_g"), F.col(weight).cast("long").alias("_w"), *[F.col(c).alias(n) for c, n in zip(order, names)]), [], [*names, "_g"], "_w")
    sums = materialize(sums, "fill-groups")
    stop = sums.where(F.col("before") + F.col("_w") > target).agg(F.min("rank")).first()[0]
    head = sums if stop is None else sums.where(F.col("rank") < stop)
    left = target - (head.agg(F.sum("_w")).first()[0] or 0)
    taken, last = [], stop
    while left and last is not None:
        rows = sums.where((F.col("rank") > last) & (F.col("_w") <= left)).orderBy("rank").limit(HELD).select("rank", "_w").collect()
        for r in rows:
            if r["_w"] <= left:
                taken.append(r["rank"])
                left -= r["_w"]
        last = rows[-1]["rank"] if len(rows) == HELD else None
    if left:
        raise ValueError("group weights do not meet the target")
    later = sums.join(groups.sparkSession.createDataFrame([(t, i) for i, t in enumerate(taken)], "rank long, _i long"), "rank")
    out = head.select(F.col("_g").alias(group), F.col("rank").alias("place"))
    return out.unionAll(later.select("_g", F.col("_i") + F.lit(stop or 0)))


def apart(cells: DataFrame, limit: int = 4, least: int = 12) -> list[str]:
    """Cells ``(cell, e, n, count)`` from many to few that do not touch one chosen before. A chosen cell
    rules out nine at most, so the first ``9 * (limit - 1) + 1`` cells are enough."""
    chosen: list = []
    for r in cells.where(F.col("count") >= least).orderBy(F.col("count").desc(), "cell").limit(9 * (limit - 1) + 1).collect():
        if len(chosen) == limit:
            break
        if all(max(abs(r.e - c.e), abs(r.n - c.n)) > 1 for c in chosen):
            chosen.append(r)
    return [c.cell for c in chosen]


def diverse_order(rows: DataFrame, key: str, traits: list[str], k: int) -> list:
    """``k`` keys, each next one with the most traits not seen yet; ties go to the first in key order.

    Rows of one combination of traits always gain the same, so only the first ``k`` of each can be chosen
    (the limit holds in each partition before the shuffle). If that is more than ``HELD`` rows, each choice is
    an aggregation over them; else the driver makes the choices."""
    within = Window.partitionBy(*traits).orderBy(key)
    kernel = materialize(rows.select(key, *traits).withColumn("_i", F.row_number().over(within)).where(F.col("_i") <= k).drop("_i"), "diverse-kernel")
    seen: dict[str, set] = {t: set() for t in traits}
    out: list = []
    held = kernel.limit(HELD + 1).collect()
    if len(held) <= HELD:
        left = sorted(held, key=lambda r: r[key])
        while left and len(out) < k:
            best = max(left, key=lambda r: sum(r[t] not in seen[t] for t in traits))
            left.remove(best)
            out.append(best[key])
            for t in traits:
                seen[t].add(best[t])
        return out
    while len(out) < k:
        new = sum(F.when(F.col(t).isNull(), F.lit(None not in seen[t])).otherwise(~F.col(t).isin([x for x in seen[t] if x is not None])).cast("int") for t in traits)  # k values at most
        left = kernel.where(~F.col(key).isin(out)) if out else kernel
        best = left.agg(F.min(F.struct((-new).alias("gain"), F.col(key), *traits)).alias("b")).first().b
        if best is None:
            break
        out.append(best[key])
        for t in traits:
            seen[t].add(best[t])
    return out


Draw = Callable[[int, float, float, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
#: Attempts are drawn by such blocks, so that most rows draw a few.
ATTEMPTS = (8, 64, 1_000_000)


def annulus_attempts(seed: str, inner: float, outer: float, box: tuple[float, float, float, float]) -> Draw:
    """Area-uniform points of a ring around a positive from digests of seed, positive and attempt; those inside
    ``box`` (least x and y, then the bounds they stay below) pass."""

    def draw(positive: int, x: float, y: float, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e, n = annulus_points([f"{seed}:{positive}:{a}" for a in numbers], x, y, inner, outer)
        return e, n, (e >= box[0]) & (n >= box[1]) & (e < box[2]) & (n < box[3])

    return draw


def _full(at: tuple[float, float], reach: float, points: np.ndarray, spacing: float) -> bool:
    """Whether the ``spacing`` around ``points`` leaves no place within ``reach`` of ``at``, by squares that lie whole in
    one such circle, those that don't in smaller ones; False if that stays open."""
    steps = np.arange(8) - 3.5
    half = reach / 8
    x, y = (at[0] + 2 * half * np.repeat(steps, 8), at[1] + 2 * half * np.tile(steps, 8))
    for _ in range(4):
        far = half * math.sqrt(2)
        if spacing > far:
            open_ = ((x[:, None] - points[:, 0]) ** 2 + (y[:, None] - points[:, 1]) ** 2 >= (spacing - far) ** 2 * (1 - 1e-9)).all(axis=1)
        else:
            open_ = np.ones(len(x), bool)
        open_ &= np.hypot(x - at[0], y - at[1]) <= (reach + far) * (1 + 1e-9)
        x, y = x[open_], y[open_]
        if not len(x):
            return True
        if len(x) > 96:
            return False
        half /= 4
        steps = 2 * half * (np.arange(4) - 1.5)
        x, y = (x[:, None] + np.repeat(steps, 4)).ravel(), (y[:, None] + np.tile(steps, 4)).ravel()
    return False


def _first_free(draw: Draw, positive: int, at: tuple[float, float], first: int, most: int, points: np.ndarray, spacing: float, reach: float) -> tuple[int, float, float] | None:
    """The first attempt from ``first`` on that passes and lies ``spacing`` or more from all ``points``. Attempts lie
    within ``reach``; where no room is left, the later ones need not be drawn."""
    for block, upto in enumerate(ATTEMPTS):
        if block == 1 and len(points) and _full(at, reach, points, spacing):
            return None
        numbers = np.arange(first, min(upto, most) + 1)
        if len(numbers):
            x, y, ok = draw(positive, *at, numbers)
            free = ok & ((points[:, :1] - x) ** 2 + (points[:, 1:] - y) ** 2 >= spacing * spacing).all(axis=0)
            if free.any():
                i = int(free.argmax())
                return int(numbers[i]), float(x[i]), float(y[i])
            first = int(numbers[-1]) + 1
    return None


def rejection_sample(positives: DataFrame, draw: Draw, reach: float, spacing: float, attempts: int = 1000, first_batch: int = 1024, tile: float | None = None) -> DataFrame:
    """``(region, positive, attempt, x, y)``: for each positive in order, its first attempt (of ``attempts``) that
    passes the draw's own gates and lies ``spacing`` or more from every point accepted before in the region.
    ``positives`` has ``(region, positive, x, y)``; ``draw(positive, x, y, numbers)`` gives coordinates, within
    ``reach`` of the positive, and whether they pass.

    Positives go by batches of the order that double, so that each batch meets points that already fill much
    of the room: an attempt near an accepted point is out for good, and a positive without attempts left is
    too; accepted points keep apart, so few lie near one positive. The others of a batch are settled by tiles
    with their surroundings: a positive is decided unless an open one before it could still take a point near
    its own; rounds follow until none is open."""
    near, around = reach + spacing, 2 * reach + spacing
    side = tile or 8 * around
    ordered = numbered(positives.select("region", "positive", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), ["region"], ["positive"])
    ordered = materialize(ordered.withColumn("batch", F.floor(F.log2(F.col("rank") / F.lit(first_batch) + 1)).cast("int")), "rejection-order")
    schema = "region long, positive long, x double, y double, rank long, attempt long, px double, py double"
    free = "region long, positive long, x double, y double, rank long, attempt long"

    def first_free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                points = np.array([(p["px"], p["py"]) for p in r.pop("near") or ()]).reshape(-1, 2)
                if found := _first_free(draw, r["positive"], (r["x"], r["y"]), 1, attempts, points, spacing, reach):
                    out.append(r | {"attempt": found[0]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("region", pa.int64()), ("positive", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("rank", pa.int64()), ("attempt", pa.int64())]))

    def settle(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        _, tx, ty = key
        grid: dict[tuple[int, int], list[tuple[float, float]]] = {}

        def cell(x: float, y: float) -> tuple[int, int]:
            return int(x // near), int(y // near)

        for x, y in part.loc[part["px"].notna(), ["px", "py"]].itertuples(index=False):
            grid.setdefault(cell(x, y), []).append((x, y))
        waiting: list[tuple[float, float]] = []
        out = []
        for r in part[part["px"].isna()].sort_values("rank").itertuples(index=False):
            if not (r.x // side == tx and r.y // side == ty):
                waiting.append((r.x, r.y))
                continue
            i, j = cell(r.x, r.y)
            points = np.array([p for m in (i - 1, i, i + 1) for k in (j - 1, j, j + 1) for p in grid.get((m, k), ())]).reshape(-1, 2)
            if found := _first_free(draw, int(r.positive), (r.x, r.y), int(r.attempt), attempts, points, spacing, reach):
                a, x, y = found
                if any((x - u) ** 2 + (y - w) ** 2 < near * near for u, w in waiting):
                    waiting.append((r.x, r.y))
                    x = y = None
                else:
                    grid.setdefault(cell(x, y), []).append((x, y))
                out.append((r.region, r.positive, r.x, r.y, r.rank, a, x, y))
        return pd.DataFrame(out, columns=list(part.columns[:8])).astype({"px": "float64", "py": "float64"})

    def tiles(c: str) -> F.Column:
        return F.explode(F.sequence(F.floor((F.col(c) - around) / F.lit(float(side))), F.floor((F.col(c) + around) / F.lit(float(side)))))

    parts = int(positives.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be coalesced
    taken = None
    for b in range((ordered.agg(F.max("batch")).first()[0] or 0) + 1):
        rows = ordered.where(F.col("batch") == b).drop("batch")
        if taken is None:
            rows = rows.withColumn("near", F.lit(None).cast("array<struct<px:double,py:double>>"))
        else:
            points = taken.select(F.col("region").alias("_r"), F.col("px").alias("x"), F.col("py").alias("y"))
            met = near_pairs(rows.select("region", "positive", "x", "y"), points, near, lambda l, r: (F.col(f"{l}.region") == F.col(f"{r}._r")) & closer_than(near)(l, r))
            lists = met.groupBy(F.col("a.region").alias("region"), F.col("a.positive").alias("positive")).agg(F.collect_list(F.struct(F.col("b.x").alias("px"), F.col("b.y").alias("py"))).alias("near"))  # accepted points keep apart: about twenty
            rows = rows.join(lists, ["region", "positive"], "left")
        open_ = materialize(rows.repartition(parts, "region", "positive").mapInArrow(first_free, free).withColumns({c: F.lit(None).cast("double") for c in ("px", "py")}), "rejection-open")
        while not open_.isEmpty():
            todo = open_ if taken is None else open_.unionByName(taken)
            placed = todo.withColumn("tx", tiles("x")).withColumn("ty", tiles("y"))
            active = open_.select("region", F.floor(F.col("x") / F.lit(float(side))).alias("tx"), F.floor(F.col("y") / F.lit(float(side))).alias("ty")).distinct()
            done = placed.join(active, ["region", "tx", "ty"], "left_semi").select(*open_.columns, "tx", "ty").repartition(parts, "region", "tx", "ty").groupBy("region", "tx", "ty").applyInPandas(settle, schema)
            done = materialize(done, "rejection-round")
            new = done.where("px is not null")
            taken = new if taken is None else taken.unionByName(new)
            open_ = done.where("px is null")
    if taken is None:
        taken = ordered.sparkSession.createDataFrame([], schema)
    return taken.select("region", "positive", "attempt", F.col("px").alias("x"), F.col("py").alias("y"))
