"""Judgement of rasters after the fact: packed representations against their mask, and seams of tiled surveys."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .raster import CHANNELS

#: Channels made from neighbours: they may lack one pixel more around a gap.
NEIGHBOURS = ("slope", "hillshade")
# What a channel may hold, and how far the median of normalised elevation may be from zero.
RANGES = {"slope": (0.0, 90.0), "hillshade": (0.0, 1.0)}
MOST_MEDIAN = 1e-4


def dilated(gaps: np.ndarray) -> np.ndarray:
    """Masks ``(n, rows, cols)`` grown by one pixel in all eight directions; rows first, then columns."""
    grown = gaps.copy()
    grown[:, 1:] |= gaps[:, :-1]
    grown[:, :-1] |= gaps[:, 1:]
    wide = grown.copy()
    wide[:, :, 1:] |= grown[:, :, :-1]
    wide[:, :, :-1] |= grown[:, :, 1:]
    return wide


def packed_violations(patches: DataFrame, size: int = 128, reference: str | None = None) -> DataFrame:
    """``(patch_id, passed, reasons, digest)`` from ``(patch_id, gap array<boolean>, *CHANNELS array<float>)``, a
    patch a row. Reasons are ``channel:fault`` in channel order: ``shape`` (nothing else is judged), ``gap_filled``,
    ``stray_gap``, ``empty``, ``range``, ``median`` and, with ``reference`` (a prefix of four further columns),
    ``differs`` bit by bit. A NULL array has the wrong shape; a NULL in one is a gap. The digest is SHA-256 over
    names, float32 values and masks, empty for what fails. No shuffle; a batch is what Arrow sends."""
    others = [f"{reference}{c}" for c in CHANNELS] if reference else []
    pixels = size * size

    def one(gap, arrays, expected) -> tuple[list[str], str]:
        reasons = []
        digest = hashlib.sha256()
        grown = None if gap is None else dilated(gap[None])[0]
        for k, name in enumerate(CHANNELS):
            v = arrays[k]
            if gap is None or v is None:
                reasons.append(f"{name}:shape")
                continue
            gone = ~np.isfinite(v)
            seen = v[~gone]
            if (gap & ~gone).any():
                reasons.append(f"{name}:gap_filled")
            if (gone & ~(grown if name in NEIGHBOURS else gap)).any():
                reasons.append(f"{name}:stray_gap")
            if not seen.size:
                reasons.append(f"{name}:empty")
            elif name in RANGES and not RANGES[name][0] <= seen.min() <= seen.max() <= RANGES[name][1]:
                reasons.append(f"{name}:range")
            elif name == "elevation" and abs(float(np.median(seen))) > MOST_MEDIAN:
                reasons.append(f"{name}:median")
            if expected and (expected[k] is None or not np.array_equal(v, expected[k], equal_nan=True)):
                reasons.append(f"{name}:differs")
            digest.update(name.encode() + v.astype("<f4").tobytes() + gone.tobytes())
        return reasons, "" if reasons else digest.hexdigest()

    def planes(column: pa.Array, dtype) -> list[np.ndarray | None]:
        """Each list as a plane; None where it is NULL or of another length. A NULL entry is NaN, or True in a mask."""
        out = []
        flat = column.values
        fill = True if pa.types.is_boolean(flat.type) else float("nan")
        at = column.offsets.to_numpy()
        values = flat.fill_null(fill).to_numpy(zero_copy_only=False).astype(dtype)
        for i in range(len(column)):
            whole = column[i].is_valid and at[i + 1] - at[i] == pixels
            out.append(values[at[i] : at[i + 1]].reshape(size, size) if whole else None)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gaps = planes(batch.column(1), bool)
            rows = [planes(batch.column(2 + k), np.float32) for k in range(len(CHANNELS) + len(others))]
            judged = [one(g, [r[i] for r in rows[:4]], [r[i] for r in rows[4:]]) for i, g in enumerate(gaps)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([not r for r, _ in judged]), pa.array([";".join(r) for r, _ in judged], pa.string()), pa.array([d for _, d in judged], pa.string())],
                names=["patch_id", "passed", "reasons", "digest"],
            )

    floats = [F.col(c).cast("array<float>").alias(c) for c in (*CHANNELS, *others)]
    return patches.select(F.col("patch_id").cast("bigint").alias("patch_id"), F.col("gap").cast("array<boolean>").alias("gap"), *floats).mapInArrow(
        run, "patch_id long, passed boolean, reasons string, digest string"
    )


def packed_representations(pixels: DataFrame, reps: DataFrame) -> DataFrame:
    """Long pixels (prepared) and their representations as one row a patch, for ``packed_violations``."""
    rows = pixels.select("patch_id", "row", "col", F.col("z").isNull().alias("gap")).join(reps, ["patch_id", "row", "col"])
    cells = F.array_sort(F.collect_list(F.struct("row", "col", "gap", *[F.coalesce(c, F.lit(float("nan"))).cast("float").alias(c) for c in CHANNELS])))  # a patch's pixels: a fixed number
    return rows.groupBy("patch_id").agg(cells.alias("c")).select("patch_id", *[F.col(f"c.{k}").alias(k) for k in ("gap", *CHANNELS)])


def seam_lines(extents: DataFrame, cell: float) -> DataFrame:
    """``(patch_id, orientation, index)`` of all lines of the tiling inside each raster ``(patch_id, left, top, width,
    height)`` of one-metre pixels: the line lies before column (``vertical``) or row (``horizontal``) ``index``."""

    def lines(orientation: str, low: Column, high: Column, index, count: str) -> DataFrame:
        first, last = F.floor(low / cell) + 1, F.ceil(high / cell) - 1
        every = F.when(first <= last, F.sequence(first.cast("bigint"), last.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
        at = F.rint(index(F.col("k") * cell)).cast("int")
        return extents.withColumn("k", F.explode(every)).select("patch_id", F.lit(orientation).alias("orientation"), at.alias("index"), F.col(count).alias("_n")).where("index > 0 and index < _n").drop("_n")

    left, top = F.col("left"), F.col("top")
    vertical = lines("vertical", left, left + F.col("width"), lambda at: at - left, "width")
    return vertical.unionByName(lines("horizontal", top - F.col("height"), top, lambda at: top - at, "height"))


def seam_diagnostics(pixels: DataFrame, reps: DataFrame, extents: DataFrame, cell: float, digits: int = 9) -> DataFrame:
    """For every line of ``seam_lines``: ``step``, the median absolute step of elevation across it; ``percentile``, the
    share (of 100) of all steps of that raster and direction at most as large; ``duplicate_edge``, whether the pixels of
    both sides are equal one by one, gaps too; the median slope of both sides; the median absolute relief of the far one.
    Gaps give no step; a line without any step has a NULL step and a percentile of NULL. Steps are compared to ``digits``
    decimals. Steps meet the raster's sorted lines as one short array, so that a pixel stays one row."""
    lines = seam_lines(extents, cell)
    rows = pixels.join(reps.select("patch_id", "row", "col", "slope", "relief"), ["patch_id", "row", "col"])

    def steps(orientation: str, along: str, across: str) -> DataFrame:
        w = Window.partitionBy("patch_id", along).orderBy(across)  # one line of pixels
        before = lambda c: F.lag(c).over(w)
        return rows.select(
            "patch_id", F.lit(orientation).alias("orientation"), F.col(across).alias("index"), F.abs(F.col("z") - before("z")).alias("step"), F.col("z").eqNullSafe(before("z")).alias("same"),
            F.array("slope", before("slope")).alias("slopes"), F.abs("relief").alias("relief"),
        ).where(F.col("index") > 0)

    both = steps("vertical", "row", "col").unionByName(steps("horizontal", "col", "row"))
    key = ["patch_id", "orientation"]
    at_line = both.join(lines, [*key, "index"])
    half = F.lit(0.5)
    own = at_line.groupBy(*key, "index").agg(F.percentile("step", half).alias("step"), F.bool_and("same").alias("duplicate_edge"), F.percentile("relief", half).alias("relief_median"))
    slopes = at_line.select(*key, "index", F.explode("slopes").alias("slope")).groupBy(*key, "index").agg(F.percentile("slope", half).alias("slope_median"))
    # the count of steps up to each line's: steps fall between the sorted levels, levels add up
    levels = own.where("step is not null").groupBy(*key).agg(F.array_sort(F.collect_set(F.round("step", digits))).alias("levels"))  # lines of one raster
    placed = both.where("step is not null").join(levels, key).select(*key, F.size(F.filter("levels", lambda x: x < F.round("step", digits))).alias("below"), "levels")
    tallied = placed.groupBy(*key, "below").agg(F.count("*").alias("n"), F.first("levels").alias("levels"))
    w = Window.partitionBy(*key)  # a row for each level of one raster
    running = tallied.select(*key, "below", "levels", F.sum("n").over(w.orderBy("below")).alias("upto"), F.sum("n").over(w).alias("total"))
    shares = running.where(F.col("below") < F.size("levels")).select(*key, F.get("levels", F.col("below")).alias("_level"), (F.col("upto") * 100.0 / F.col("total")).alias("percentile"))
    ranked = own.withColumn("_level", F.round("step", digits)).join(shares, [*key, "_level"], "left").drop("_level")
    return ranked.join(slopes, [*key, "index"]).select(*key, "index", "step", "percentile", "duplicate_edge", "slope_median", "relief_median")
