"""Raster stencils in two forms. Long form ``(patch_id, row, col, z)`` uses windows along rows and
columns and says everything in SQL; packed form keeps a patch in one row as arrays and works on it in
Arrow batches, which is the form for throughput. NULL (long) and NaN (packed) are no data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHANNELS = ("elevation", "slope", "hillshade", "relief")


def surfaces(patches: DataFrame, size: int = 128) -> DataFrame:
    """``(patch_id, row, col, z, masked)`` of closed-form surfaces; ``patches`` has ``patch_id``. The
    scenario is ``patch_id % 5``, the variant ``patch_id % 6``."""
    half = size // 2
    grid = patches.select("patch_id", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("row")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    x, y = F.col("col") - half, F.col("row") - half
    k, s = F.col("patch_id") % 6, F.col("patch_id") % 5
    sq = lambda c: c * c
    z = (
        F.when(s == 0, 100 + (1.1 + k * 0.06) * F.exp(-((sq(x - k) + sq(y + k)) / (260 + k * 18))))
        .when(s == 1, 100 - (0.8 + k * 0.05) * F.exp(-((sq(x + k) + sq(y - k)) / (320 + k * 20))))
        .when(s == 2, 100 + (0.008 + k * 0.001) * x + 0.006 * y)
        .when(s == 3, 100 + 0.25 * F.sin(x / (7 + k * 0.2) + k * 0.37) + 0.18 * F.cos(y / 9 - k * 0.37))
        .otherwise(100 + 0.55 * F.exp(-((sq(x) + sq(y)) / 300)) + 0.18 * F.sin((x + k) / 8) - 0.12 * F.cos((y - k) / 11))
    )
    masked = (F.col("patch_id") % 4 == 1) & ((F.col("row") * 7 + F.col("col") * 3) % 97 == 0)
    return grid.select("patch_id", "row", "col", z.cast("double").alias("z"), masked.alias("masked"))


def prepared(pixels: DataFrame) -> DataFrame:
    """Masked and non-finite elevations become NULL."""
    bad = F.col("masked") | F.isnan("z") | (F.abs("z") == float("inf"))
    return pixels.select("patch_id", "row", "col", F.when(~F.coalesce(bad, F.lit(True)), F.col("z")).alias("z"))


def representations(pixels: DataFrame, size: int = 128, radius: int = 16, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Elevation minus the patch median, slope in degrees, hillshade, and relief over a box mean whose
    window shrinks at the edges. Windows are kept per patch row or column: at most ``size`` rows each."""
    rows, cols = Window.partitionBy("patch_id", "row").orderBy("col"), Window.partitionBy("patch_id", "col").orderBy("row")

    def gradient(at: str, w) -> Column:
        z, before, after = F.col("z"), F.lag("z").over(w), F.lead("z").over(w)
        return F.when(F.col(at) == 0, after - z).when(F.col(at) == size - 1, z - before).otherwise((after - before) / 2)

    rw = rows.rowsBetween(-radius, radius)
    g = pixels.select(
        "patch_id", "row", "col", "z", gradient("col", rows).alias("ge"), F.sum("z").over(rw).alias("rs"), F.count("z").over(rw).alias("rc"),
    )
    cw = cols.rowsBetween(-radius, radius)
    g = g.select("patch_id", "row", "col", "z", "ge", gradient("row", cols).alias("gs"), F.try_divide(F.sum("rs").over(cw), F.sum("rc").over(cw)).alias("box"))
    median = pixels.groupBy("patch_id").agg(F.percentile("z", F.lit(0.5)).alias("median"))
    a, h = np.radians(azimuth), np.radians(altitude)
    east, north, up = float(np.sin(a) * np.cos(h)), float(np.cos(a) * np.cos(h)), float(np.sin(h))
    ge, gn = F.col("ge"), -F.col("gs")
    shade = (ge * -east - gn * north + up) / F.sqrt(ge * ge + gn * gn + 1)
    seen = F.col("z").isNotNull()  # a gap's own neighbours may well be there
    return g.join(median, "patch_id").select(
        "patch_id", "row", "col", (F.col("z") - F.col("median")).alias("elevation"), F.when(seen, F.degrees(F.atan(F.sqrt(ge * ge + F.col("gs") * F.col("gs"))))).alias("slope"),
        F.when(seen & shade.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), shade))).alias("hillshade"), (F.col("z") - F.col("box")).alias("relief"),
    )


def pooled(reps: DataFrame, block: int = 4) -> DataFrame:
    """Mean of each block over its valid pixels; 0 where there is none."""
    at = lambda c: F.floor(F.col(c) / block).cast("int")
    return reps.groupBy("patch_id", at("row").alias("brow"), at("col").alias("bcol")).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in CHANNELS])


def feature_vectors(cells: DataFrame) -> DataFrame:
    """``(patch_id, features)``: channel by channel, cells row by row."""
    packed = F.array_sort(F.collect_list(F.struct("brow", "bcol", *CHANNELS)))  # a patch's cells: a fixed number
    grouped = cells.groupBy("patch_id").agg(packed.alias("c"))
    return grouped.select("patch_id", F.concat(*[_channel(k) for k in CHANNELS]).alias("features"))


def _channel(name: str) -> Column:
    return F.transform("c", lambda x: x[name].cast("float"))


def patch_review(pixels: DataFrame, size: int = 128, most_nodata: float = 0.05, low: float = -500.0, high: float = 2000.0) -> DataFrame:
    """Quality of each patch: share of no data, range and all reasons, in a fixed order."""
    bad = F.coalesce(F.col("masked"), F.lit(False)) | F.col("z").isNull() | F.isnan("z") | (F.abs("z") == float("inf"))
    unexpected = ~F.coalesce(F.col("masked"), F.lit(False)) & (F.col("z").isNull() | F.isnan("z") | (F.abs("z") == float("inf")))
    g = pixels.groupBy("patch_id").agg(
        F.count("*").alias("n"), F.avg(bad.cast("double")).alias("nodata"), F.bool_or(unexpected).alias("odd"), F.min(F.when(~bad, F.col("z"))).alias("lowest"), F.max(F.when(~bad, F.col("z"))).alias("highest")
    )
    reasons = F.array_compact(F.array(
        F.when(F.col("n") != size * size, "dimensions_mismatch"), F.when(F.col("odd"), "nonfinite_values"), F.when(F.col("nodata") == 1, "missing_coverage"),
        F.when((F.col("nodata") < 1) & (F.col("nodata") > most_nodata), "nodata_excess"), F.when((F.col("lowest") < low) | (F.col("highest") > high), "elevation_range"),
    ))
    return g.select("patch_id", F.round("nodata", 9).alias("nodata"), F.array_join(reasons, ";").alias("reasons"), (F.size(reasons) == 0).alias("passed"))


def byte_scaled(reps: DataFrame, value: str) -> DataFrame:
    """0 to 255 between the 2nd and 98th percentile of the patch; 127 if they are equal."""
    q = reps.groupBy("patch_id").agg(F.percentile(value, F.array(F.lit(0.02), F.lit(0.98))).alias("q"))
    low, high = F.col("q")[0], F.col("q")[1]
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col(value) - low, high - low)))
    return reps.join(q, "patch_id").select("patch_id", "row", "col", F.when(high == low, 127).otherwise(F.floor(share * 255)).cast("int").alias("byte"))


def mosaic(sources: DataFrame) -> DataFrame:
    """``(patch_id, row, col, z)``: the first valid source in path order wins each pixel."""
    return sources.where("z is not null and not isnan(z)").groupBy("patch_id", "row", "col").agg(F.min_by("z", "path").alias("z"))


def packed_features(patches: DataFrame, size: int = 128, radius: int = 16, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """``(patch_id, features)`` from ``(patch_id, z array<double>)``, a row for each patch with NaN for no
    data: the same operators on whole batches of patches in numpy. No shuffle; a batch is what Arrow sends."""
    a, h = np.radians(azimuth), np.radians(altitude)
    east, north, up = np.sin(a) * np.cos(h), np.cos(a) * np.cos(h), np.sin(h)

    def sums(v: np.ndarray, axis: int) -> np.ndarray:
        """Sums over the ``2 * radius + 1`` places around each, fewer at the edges."""
        v = np.moveaxis(v, axis, 1)
        s = np.zeros((v.shape[0], v.shape[1] + 1, v.shape[2]))
        np.cumsum(v, axis=1, out=s[:, 1:])
        inner = v.shape[1] - radius
        out = np.empty_like(v, dtype=np.float64)
        out[:, : max(0, inner)] = s[:, radius + 1 :][:, : max(0, inner)]
        out[:, max(0, inner) :] = s[:, -1:]
        out[:, radius:] -= s[:, : max(0, inner)]
        return np.moveaxis(out, 1, axis)

    def boxes(v: np.ndarray) -> np.ndarray:
        return sums(sums(v, 1), 2)

    def steps(z: np.ndarray, axis: int) -> np.ndarray:
        """Central differences, one-sided at the edges."""
        z = np.moveaxis(z, axis, 1)
        out = np.empty_like(z)
        np.subtract(z[:, 2:], z[:, :-2], out=out[:, 1:-1])
        out[:, 1:-1] *= 0.5
        out[:, 0], out[:, -1] = z[:, 1] - z[:, 0], z[:, -1] - z[:, -2]
        return np.moveaxis(out, 1, axis)

    def fours(v: np.ndarray) -> np.ndarray:
        """Sums of 4 x 4 tiles."""
        v = v[:, 0::4] + v[:, 1::4] + v[:, 2::4] + v[:, 3::4]
        return v[..., 0::4] + v[..., 1::4] + v[..., 2::4] + v[..., 3::4]

    full = 1 / boxes(np.ones((1, size, size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 8):  # 8 patches at once: 1 MB a work array
                part = batch.slice(i, 8)
                z = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size, size)
                valid = np.isfinite(z)
                whole = bool(valid.all())
                flat = z.reshape(len(z), -1)
                if not whole:
                    z[~valid] = np.nan
                gs, ge = steps(z, 1), steps(z, 2)
                steep = ge * ge + gs * gs
                slope = np.degrees(np.arctan(np.sqrt(steep)))
                shade = np.clip((gs * north - ge * east + up) / np.sqrt(steep + 1), 0, 1)
                if whole:
                    median = np.median(flat, axis=1)[:, None, None]
                    heights = fours(z)
                    pool = np.stack([heights - 16 * median, fours(slope), fours(shade), heights - fours(boxes(z) * full)], axis=1) / 16
                else:
                    slope[~valid] = shade[~valid] = np.nan  # a gap's own neighbours may well be there
                    with np.errstate(invalid="ignore", divide="ignore"):
                        relief = z - boxes(np.where(valid, z, 0)) / boxes(valid.astype(np.float64))
                        median = np.nanmedian(flat, axis=1)[:, None, None]
                    pool = []
                    for channel in (z - median, slope, shade, relief):
                        seen = np.isfinite(channel)
                        n = fours(seen.astype(np.float64))
                        pool.append(np.where(n > 0, fours(np.where(seen, channel, 0)) / np.maximum(n, 1), 0.0))
                    pool = np.stack(pool, axis=1)
                values = pa.array(pool.astype(np.float32).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * (4 * (size // 4) ** 2)), values)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["patch_id", "features"])

    return patches.select(F.col("patch_id").cast("bigint").alias("patch_id"), "z").mapInArrow(run, "patch_id long, features array<float>")


def packed(pixels: DataFrame) -> DataFrame:
    """Long form to packed form: ``(patch_id, z)``."""
    cells = F.array_sort(F.collect_list(F.struct("row", "col", F.coalesce("z", F.lit(float("nan"))).alias("z"))))  # a patch's pixels: a fixed number
    return prepared(pixels).groupBy("patch_id").agg(cells.alias("c")).select(F.col("patch_id").cast("bigint").alias("patch_id"), F.transform("c", lambda p: p["z"]).alias("z"))


def patch_ids(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "patch_id")


def standardised(cells: DataFrame) -> DataFrame:
    """Channels less their mean over their population deviation, both over all patches; a channel
    without spread fails."""
    stats = cells.agg(*[f(c).alias(f"{n}_{c}") for c in CHANNELS for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    rows = cells.crossJoin(F.broadcast(stats))  # stats is one row
    one = lambda c: F.when(F.col(f"s_{c}") > 1e-8, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(F.raise_error(F.lit(f"{c} has no spread")).cast("double"))
    return rows.select("patch_id", "brow", "bcol", *[one(c).alias(c) for c in CHANNELS])


def representation_violations(pixels: DataFrame, reps: DataFrame, size: int = 128) -> DataFrame:
    """``(patch_id, rule)``: no data must propagate; slope and hillshade may miss one pixel more around it;
    ranges hold; the median of normalised elevation is about zero. ``pixels`` are prepared."""
    joined = pixels.select("patch_id", "row", "col", F.col("z").isNull().alias("gap")).join(reps, ["patch_id", "row", "col"])
    by_row, by_col = Window.partitionBy("patch_id", "row").orderBy("col").rowsBetween(-1, 1), Window.partitionBy("patch_id", "col").orderBy("row").rowsBetween(-1, 1)
    wide = joined.withColumn("_r", F.max(F.col("gap")).over(by_row)).withColumn("near", F.max("_r").over(by_col))
    gone = {c: F.col(c).isNull() for c in CHANNELS}
    rules = {
        "elevation_gap": F.bool_or(F.col("gap") != gone["elevation"]), "relief_gap": F.bool_or(F.col("gap") != gone["relief"]),
        "slope_gap": F.bool_or(F.col("gap") & ~gone["slope"]), "hillshade_gap": F.bool_or(F.col("gap") & ~gone["hillshade"]),
        "stray_slope_gap": F.bool_or(gone["slope"] & ~F.col("near")), "stray_hillshade_gap": F.bool_or(gone["hillshade"] & ~F.col("near")),
        "slope_range": F.bool_or(~F.col("slope").between(0, 90)), "hillshade_range": F.bool_or(~F.col("hillshade").between(0, 1)),
        "elevation_median": F.abs(F.percentile("elevation", F.lit(0.5))) > 1e-4, "size": F.count("*") != size * size,
    }
    found = wide.groupBy("patch_id").agg(*[c.alias(k) for k, c in rules.items()])
    broken = F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in rules]))
    return found.select("patch_id", F.explode(broken).alias("rule"))


def cache_state(raw: Column, raw_ok: Column, processed: Column, processed_ok: Column, reps_ok: Column) -> Column:
    """State of a patch's cached artefacts; the first that holds."""
    return (
        F.when(~raw, "raw_missing").when(~raw_ok, "raw_invalid").when(~processed, "processed_missing").when(~processed_ok, "processed_invalid").when(~reps_ok, "representation_invalid").otherwise("valid")
    )


def content_digests(patches: DataFrame) -> DataFrame:
    """``(patch_id, digest)`` of packed patches: SHA-256 over little-endian float32 values and a mask byte
    for each, patch by patch in Arrow batches."""
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for z in batch["z"]:
                v = np.asarray(z, "<f4")
                gap = ~np.isfinite(v)
                out.append(hashlib.sha256(np.where(gap, np.float32(0), v).astype("<f4").tobytes() + gap.astype(np.uint8).tobytes()).hexdigest())
            yield pd.DataFrame({"patch_id": batch["patch_id"].to_numpy(), "digest": out})

    return patches.select("patch_id", "z").mapInPandas(run, "patch_id long, digest string")
