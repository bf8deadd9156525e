"""Spatial expressions and row operators: patch bounds, tiles, rings, windows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contracts import row_violations


def snap(value: Column, resolution: float = 1.0) -> Column:
    """To the grid, half up (not half even)."""
    return F.floor(value / F.lit(resolution) + 0.5) * F.lit(resolution)


def patch_bounds(e: Column, n: Column, size: float, resolution: float = 1.0) -> dict[str, Column]:
    """Pixel-aligned square bounds around a centre."""
    if size <= 0 or resolution <= 0 or not float(size / resolution).is_integer():
        raise ValueError("size must be a positive whole number of pixels")
    x, y, half = snap(e.cast("double"), resolution), snap(n.cast("double"), resolution), F.lit(size / 2)
    return {"left": x - half, "bottom": y - half, "right": x + half, "top": y + half}


def grid_tiles(df: DataFrame, size: int = 5000) -> DataFrame:
    """One row for each half-open tile that ``left, bottom, right, top`` touch, row by row."""

    def low(c: str) -> Column:
        return F.floor(F.col(c) / F.lit(float(size))).cast("bigint")

    def high(c: str) -> Column:
        return (F.ceil(F.col(c) / F.lit(float(size))) - 1).cast("bigint")

    rows = df.withColumn("tile_n", F.explode(F.sequence(low("bottom"), high("top")))).withColumn("tile_e", F.explode(F.sequence(low("left"), high("right"))))
    return rows.withColumn("tile_id", F.format_string(f"BNG{size // 1000}K_E%03d_N%03d", F.col("tile_e"), F.col("tile_n")))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def rectangle_distance(e: Column, n: Column, left: float, bottom: float, right: float, top: float) -> Column:
    if left >= right or bottom >= top:
        raise ValueError("degenerate rectangle")
    dx = F.greatest(F.lit(left) - e, F.lit(0.0), e - F.lit(right))
    dy = F.greatest(F.lit(bottom) - n, F.lit(0.0), n - F.lit(top))
    return F.sqrt(dx * dx + dy * dy)


def cell_gap(e1: Column, n1: Column, e2: Column, n2: Column, size: float) -> Column:
    """Distance of the boundaries of two cells given by their indices."""

    def gap(a: Column, b: Column) -> Column:
        return F.greatest(F.abs(a - b) - 1, F.lit(0)) * F.lit(float(size))

    return F.sqrt(F.pow(gap(e1, e2), F.lit(2)) + F.pow(gap(n1, n2), F.lit(2)))


def cells_touch(e1: Column, n1: Column, e2: Column, n2: Column) -> Column:
    return F.greatest(F.abs(e1 - e2), F.abs(n1 - n2)) <= 1


def edges(ring: Column) -> Column:
    """Edges of a ring of ``(x, y)``, from the last vertex to the first and on."""
    shifted = F.concat(F.slice(ring, F.size(ring), 1), F.slice(ring, 1, F.size(ring) - 1))
    return F.arrays_zip(shifted.alias("p"), ring.alias("c"))


def signed_ring_area(ring: Column) -> Column:
    return F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + e["p"]["x"] * e["c"]["y"] - e["c"]["x"] * e["p"]["y"]) / 2


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray cast, half open in y."""

    def crosses(e: Column) -> Column:
        x1, y1, x2, y2 = e["p"]["x"], e["p"]["y"], e["c"]["x"], e["c"]["y"]
        return F.when((y1 > y) != (y2 > y), (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1).cast("int")).otherwise(0)

    return F.aggregate(edges(ring), F.lit(0), lambda s, e: s + crosses(e)) % 2 == 1


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """Centroid of a closed ring; NULL if its area is zero."""
    centre = _centre(ring)
    return centre["x"], centre["y"]


def _centre(ring: Column) -> Column:
    pairs = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))

    def sums(area: Column, x: Column, y: Column) -> Column:
        return F.struct(area.alias("area"), x.alias("x"), y.alias("y"))

    def add(s: Column, e: Column) -> Column:
        a, b = e["a"], e["b"]
        cross = a["x"] * b["y"] - b["x"] * a["y"]
        return sums(s["area"] + cross, s["x"] + (a["x"] + b["x"]) * cross, s["y"] + (a["y"] + b["y"]) * cross)

    total = F.aggregate(pairs, sums(F.lit(0.0), F.lit(0.0), F.lit(0.0)), add)
    return once(total, lambda t: F.struct(F.try_divide(t["x"], t["area"] * 3).alias("x"), F.try_divide(t["y"], t["area"] * 3).alias("y")))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def geometry_review(rings: Column, x: Column, y: Column, area_ha: Column) -> Column:
    """``struct(status, reason, outer_rings)`` of a site's rings: missing, compound, off centre, too large."""

    def result(status: str, reason: str | None, n: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"), n.cast("int").alias("outer_rings"))

    def chosen(all_: Column) -> Column:
        outer = F.filter(all_, lambda r: r["a"] < 0)
        widest = F.array_max(F.transform(all_, lambda r: F.struct(F.abs(r["a"]).alias("a"), r["r"].alias("r"))))["r"]
        return once(outer, lambda o: F.struct(F.greatest(F.size(o), F.lit(1)).alias("n"), F.when(F.size(o) == 0, widest).otherwise(o[0]["r"]).alias("r")))

    def measured(c: Column) -> Column:
        xs, ys = F.transform(c["r"], lambda p: p["x"]), F.transform(c["r"], lambda p: p["y"])
        return F.struct((F.array_max(xs) - F.array_min(xs)).alias("dx"), (F.array_max(ys) - F.array_min(ys)).alias("dy"), _centre(c["r"]).alias("centre"))

    def judged(c: Column, m: Column) -> Column:
        offset = F.greatest(F.lit(15.0), F.greatest(m["dx"], m["dy"]) * 0.35)
        return (
            F.when(~point_in_ring(x, y, c["r"]) | (distance(x, y, m["centre"]["x"], m["centre"]["y"]) > offset), result("fail", "geometry_off_centre", F.lit(1)))
            .when(area_ha.isNull() | (area_ha > 0.5) | (m["dx"] > 200) | (m["dy"] > 200), result("needs_review", "geometry_too_large", F.lit(1)))
            .otherwise(result("pass", None, F.lit(1)))
        )

    areas = F.transform(rings, lambda r: F.struct(signed_ring_area(r).alias("a"), r.alias("r")))
    review = once(areas, lambda all_: once(chosen(all_), lambda c: F.when(c["n"] != 1, result("fail", "geometry_compound", c["n"])).otherwise(once(measured(c), lambda m: judged(c, m)))))
    return F.when(F.coalesce(F.size(rings), F.lit(0)) <= 0, result("needs_review", "geometry_missing", F.lit(0))).otherwise(review)


def sample_points(e: Column, n: Column, size: float = 128) -> Column:
    """Centre, corners and edge middles of a patch."""
    half = size / 2
    order = [(0, 0), (-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]
    return F.array(*[F.struct((e + F.lit(a * half)).alias("x"), (n + F.lit(b * half)).alias("y")) for a, b in order])


def window_grid(spark, height: int, width: int, size: int = 128, stride: int = 64) -> DataFrame:
    """Offsets of all windows that lie inside, row by row."""
    rows = spark.range(0, max(0, height - size + 1), stride).withColumnRenamed("id", "row")
    return rows.select("row", F.explode(F.sequence(*[F.lit(n).cast("long") for n in (0, width - size, stride)])).alias("col"), F.lit(size).alias("size"))


def window_iou(r1: Column, c1: Column, r2: Column, c2: Column, size: float = 128) -> Column:
    """Overlap share of two windows of one size."""
    dr = F.greatest(F.lit(size) - F.abs(r1 - r2), F.lit(0))
    dc = F.greatest(F.lit(size) - F.abs(c1 - c2), F.lit(0))
    return (dr * dc) / (F.lit(2.0 * size * size) - dr * dc)


def annulus_draw(digest: Column, e: Column, n: Column, inner: float, outer: float) -> tuple[Column, Column]:
    """Area-uniform point of a ring around a centre from a digest, rounded half even."""
    from ..functions.keys import unit_draw

    angle = unit_draw(digest, 1) * F.lit(2) * F.pi()
    radius = F.sqrt(F.lit(inner**2) + unit_draw(digest, 17) * F.lit(outer**2 - inner**2))
    return F.bround(e + radius * F.cos(angle)), F.bround(n + radius * F.sin(angle))


def annulus_points(keys: list[str], e: float, n: float, inner: float, outer: float) -> tuple[np.ndarray, np.ndarray]:
    """The draws of ``annulus_draw`` for the digests of ``keys``, outside Spark's expressions."""
    digests = np.frombuffer(b"".join([hashlib.sha256(k.encode()).digest() for k in keys]), ">u8").reshape(-1, 4)
    u, w = (digests[:, k].astype(np.float64) / float(16**16) for k in (0, 1))
    angle, radius = 2 * np.pi * u, np.sqrt(inner**2 + w * (outer**2 - inner**2))
    return np.round(e + radius * np.cos(angle)), np.round(n + radius * np.sin(angle))


def policy_violations(rows: DataFrame, key: str) -> DataFrame:
    """``(rule, key)`` of background sampling policies, one a row, that break a bound; the bounds are fixed values."""
    positive = [F.coalesce(F.col(c) > 0, F.lit(False)) for c in ("exclusion_m", "archaeology_exclusion_m", "separation_m", "inner_m")]
    rules = {
        "label": F.col("label") == "unlabelled_background", "ratio": F.col("per_positive") == 1, "distances": positive[0] & positive[1] & positive[2] & positive[3],
        "annulus": F.col("outer_m") > F.col("inner_m"), "gaps": F.col("most_gaps").between(0, 1),
    }
    return row_violations(rows, key, rules)
