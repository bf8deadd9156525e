"""Coverage and provenance of a patch by mapped features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import provenance_id
from .celljoin import busy_parts
from .numbering import numbered
from .shared import materialize
from .spatial import edges, point_in_ring, sample_points

# Names of programmes and outcomes.
NATIONAL, STAMPED, COMPOSITE = "National LIDAR Programme", "Time-stamped EA survey", "EA Composite source survey"


def assess_coverage(points: DataFrame, features: DataFrame, on: Column) -> DataFrame:
    """``(site_id, coverage, provenance, reason, programme)``. ``points(site_id, i, x, y)`` are a patch's
    nine sample points (``i`` from 0); ``features`` have ``feature_id, ring, polygon_id, year, resolution, start, end,
    source, programme_kind``; ``on`` names which features may matter to a point (an equi-condition on a cell).
    Covered: every point lies in a feature. Provenance is sound if all relevant features agree in five
    fields and none is missing."""
    fields = ("polygon_id", "year", "resolution", "start", "end")
    signature = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields])
    known = numbered(features.withColumn("_sign", signature), [], ["feature_id", *fields, "source", "programme_kind"]).withColumnRenamed("rank", "_f")
    known = materialize(known.join(known.groupBy("_sign").agg(F.min("_f").alias("_s")), "_sign"), "coverage-features")
    bit = F.expr("shiftleft(1L, cast(i as int))")
    inside = F.coalesce(point_in_ring(F.col("x"), F.col("y"), F.col("ring")), F.lit(False))
    # places of features and of signatures stand for them, so that sums of numbers are all that a site holds
    met = points.join(known.drop("_sign", *fields, "source", "programme_kind", "feature_id"), on, "left").select("site_id", bit.alias("bit"), *[F.when(inside, c).alias(n) for c, n in ((bit, "held"), (F.col("_s"), "_s"), (F.col("_f"), "_f"))])
    found = met.groupBy("site_id").agg(F.bit_or("bit").alias("points"), F.bit_or("held").alias("covered"), F.min("_s").alias("low"), F.max("_s").alias("high"), F.min("_f").alias("_f"))
    found = found.join(known.select("_f", F.struct("feature_id", *fields, "source", "programme_kind").alias("f")), "_f", "left")
    f = F.col("f")
    programme = (
        F.when((f["programme_kind"] == "national") | F.startswith(F.lower(F.coalesce(f["source"], F.lit(""))), F.lit("np ")), NATIONAL)
        .when(f["programme_kind"] == "stamped", STAMPED).when(F.coalesce(f["source"], F.lit("")) != "", COMPOSITE).otherwise("UNKNOWN")
    )
    missing = programme.eqNullSafe("UNKNOWN")
    for name in fields:
        missing = missing | (F.coalesce(f[name].cast("string"), F.lit("")) == "")
    fine = F.coalesce(F.expr("try_cast(f.resolution as double)"), F.lit(999.0)) <= 1

    def result(coverage: str, provenance: str, reason: str | None) -> Column:
        return F.struct(F.lit(coverage).alias("coverage"), F.lit(provenance).alias("provenance"), F.lit(reason).cast("string").alias("reason"))

    outcome = (
        F.when(F.col("covered").isNull(), result("fail", "not_reviewed", "terrain_no_1m_coverage")).when(F.col("covered") != F.col("points"), result("fail", "not_reviewed", "terrain_patch_incomplete"))
        .when(F.col("low") != F.col("high"), result("pass", "needs_review", "terrain_provenance_confounded")).when(~fine, result("fail", "fail", "terrain_no_1m_coverage"))
        .when(missing, result("pass", "needs_review", "terrain_provenance_missing")).otherwise(result("pass", "pass", None))
    )
    return found.select("site_id", outcome.alias("o"), F.when(F.col("covered") == F.col("points"), programme).alias("programme")).select("site_id", "o.*", "programme")


#: Cell sizes of the cover in metres, each four times the one before, and rings that a cell may keep to the end.
CELLS, KEPT = tuple(1000.0 * 4**k for k in range(10)), 32
_MARGIN = 0.001  # metres around a cell, far above what rounding moves an edge


def _meets(ring: Column, size: float) -> Column:
    """0 if the cell ``(cx, cy)`` lies outside of the ring, 2 if inside, 1 if an edge may cross it."""
    x0, y0 = F.col("cx") * size - _MARGIN, F.col("cy") * size - _MARGIN
    x1, y1 = x0 + size + 2 * _MARGIN, y0 + size + 2 * _MARGIN

    def near(e: Column) -> Column:
        px, py, qx, qy = e["p"]["x"], e["p"]["y"], e["c"]["x"], e["c"]["y"]
        box = (F.least(px, qx) <= x1) & (F.greatest(px, qx) >= x0) & (F.least(py, qy) <= y1) & (F.greatest(py, qy) >= y0)

        def left(x: Column, y: Column) -> Column:
            return (qx - px) * (y - py) - (qy - py) * (x - px)

        corners = [left(x, y) for x in (x0, x1) for y in (y0, y1)]
        slack = (F.abs(qx - px) + F.abs(qy - py)) * _MARGIN
        return box & (F.least(*corners) <= slack) & (F.greatest(*corners) >= -slack)

    middle = point_in_ring(F.col("cx") * size + size / 2, F.col("cy") * size + size / 2, ring)
    return F.when(F.exists(edges(ring), near), 1).when(middle, 2).otherwise(0)


def signature_cover(patches: DataFrame, rings: DataFrame) -> DataFrame:
    """``(patch_id, mask, low, high)``: which of a patch's ``points`` lie in a ring, as bits, and two of the signatures
    ``s`` of the ``rings(ring, s)`` that hold one: equal if there is just one, different if there are more.

    From large cells to small: a ring that holds a whole cell says all there is to say of it, so a cell keeps two of such
    signatures at most. Rings that cross the cell go on to its parts, but not if the cell has two signatures already or
    theirs. Cells crossed by few rings, and the smallest, keep them for the points to be tested. So the work grows with
    rings and patches, not with the pairs that meet."""
    axis = lambda c: F.transform("ring", lambda p: p[c])
    ends = [F.array_min(axis("x")).alias("x0"), F.array_min(axis("y")).alias("y0"), F.array_max(axis("x")).alias("x1"), F.array_max(axis("y")).alias("y1")]
    parts = busy_parts(patches.sparkSession)
    todo = materialize(rings.distinct().repartition(parts).select("ring", "s", *ends).where("x0 is not null"), "cover-rings")
    widest = todo.agg(F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0] or 0.0
    levels = [c for k, c in enumerate(CELLS) if not k or CELLS[k - 1] < widest][::-1]
    above = None
    out = None
    for level in levels:
        k = 1 if above is None else int(above / level)

        def parts_of(c: str) -> Column:
            low, high = (F.floor(F.col(f"{c}{e}") / F.lit(level)) for e in (0, 1))
            if above is not None:
                low, high = F.greatest(low, F.col(f"c{c}") * k), F.least(high, F.col(f"c{c}") * k + k - 1)
            return F.explode(F.when(low <= high, F.sequence(low, high)))

        at = todo.select("ring", "s", "x0", "y0", "x1", "y1", *([] if above is None else [F.col("cy")]), parts_of("x").alias("_cx"))
        at = at.withColumn("_cy", parts_of("y")).drop("cy").withColumnsRenamed({"_cx": "cx", "_cy": "cy"})
        at = materialize(at.repartition(parts).withColumn("meets", _meets(F.col("ring"), level)).where("meets > 0"), "cover-cells")
        whole = at.where("meets = 2").groupBy("cx", "cy", "s").agg(F.count("*").alias("n"))
        if above is not None:  # what larger cells know holds for their parts
            spread = F.sequence(F.lit(0), F.lit(k - 1))
            whole = whole.select("cx", "cy", "s").unionByName(
                known.withColumn("cx", F.explode(F.transform(spread, lambda i: F.col("cx") * k + i))).withColumn("cy", F.explode(F.transform(spread, lambda i: F.col("cy") * k + i))).select("cx", "cy", F.explode(F.array("low", "high")).alias("s"))
            )
        held = whole.groupBy("cx", "cy").agg(F.min("s").alias("low"), F.max("s").alias("high"))
        crossing = at.where("meets = 1").drop("meets").join(held, ["cx", "cy"], "left").where("low is null or (low = high and low <> s)")
        last = level == levels[-1]
        counts = crossing.groupBy("cx", "cy").agg(F.count("*").alias("n"))
        cells = materialize(held.join(counts, ["cx", "cy"], "full").select("cx", "cy", "low", "high", (F.lit(not last) & (F.coalesce("n", F.lit(0)) > KEPT)).alias("open"), F.coalesce("n", F.lit(0)).alias("n")), "cover-known")
        crossing = materialize(crossing.drop("low", "high").join(cells.select("cx", "cy", "open"), ["cx", "cy"]), "cover-crossing")
        out_level = _settled(patches, cells.where("not open").drop("open"), crossing.where("not open").select("cx", "cy", "ring", "s"), level)
        out = out_level if out is None else out.unionByName(out_level)
        todo = crossing.where("open").drop("open")
        known, above = cells.where("open and low is not null").select("cx", "cy", "low", "high"), level
        if last or todo.isEmpty():
            break
    return out.groupBy("patch_id").agg(F.bit_or("mask").alias("mask"), F.min("low").alias("low"), F.max("high").alias("high"))


def _settled(patches: DataFrame, cells: DataFrame, crossing: DataFrame, size: float) -> DataFrame:
    """``(patch_id, mask, low, high)`` of the points of patches in ``cells``, from what these know and the rings that cross them."""
    spot = F.array_distinct(F.transform("points", lambda p: F.struct(F.floor(p["x"] / size).alias("cx"), F.floor(p["y"] / size).alias("cy"))))
    at = patches.select("patch_id", "points", F.explode(spot).alias("c")).select("patch_id", "points", "c.*")

    def mask(test) -> Column:
        here = lambda p: (F.floor(p["x"] / size) == F.col("cx")) & (F.floor(p["y"] / size) == F.col("cy"))
        return F.aggregate(F.transform("points", lambda p: here(p) & test(p)), F.lit(0), lambda s, held: s * 2 + held.cast("int"))

    sure = at.join(cells.where("low is not null").drop("n"), ["cx", "cy"]).select("patch_id", mask(lambda p: F.lit(True)).alias("mask"), "low", "high")
    maybe = at.join(crossing, ["cx", "cy"]).select("patch_id", mask(lambda p: point_in_ring(p["x"], p["y"], F.col("ring"))).alias("mask"), F.col("s").alias("low"), F.col("s").alias("high"))
    return sure.unionByName(maybe.where("mask > 0"))


def matching_provenance(patches: DataFrame, features: DataFrame, dataset: str, size: float = 128) -> DataFrame:
    """``(patch_id, coverage, signatures, matches, year, resolution, programme)`` of each of
    ``patches(patch_id, x, y, expected)`` by ``features(rings, polygon_id, year, resolution, start, end, file)``.

    A feature is relevant if one of its rings holds one of the nine sample points. A patch is covered if each
    point lies in a ring of a relevant feature. Its provenance is known if it is covered and all relevant features
    agree in six fields (null as empty); the programme follows from the file's name. It matches if the
    resolution is a metre or finer and the provenance id is the expected one. ``signatures`` is 0, 1 or 2 (more
    than one)."""
    points = sample_points(F.col("x").cast("double"), F.col("y").cast("double"), size)
    dotted = materialize(patches.repartition(busy_parts(patches.sparkSession)).select("patch_id", points.alias("points")), "cover-patches")
    fields = ("polygon_id", "year", "resolution", "start", "end", "file")
    whole = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in fields]
    rings = features.select(F.explode("rings").alias("ring"), F.struct(*whole).alias("s"))
    found = signature_cover(dotted, rings)
    joined = patches.select("patch_id", "expected").join(found, "patch_id", "left")
    covered, one = F.coalesce(F.col("mask") == 511, F.lit(False)), F.col("low") == F.col("high")
    known = covered & F.coalesce(one, F.lit(False))
    metres = F.expr("try_cast(low.resolution as double)")
    resolution = F.regexp_replace(metres.cast("string"), "[.]0$", "")
    programme = F.when(F.startswith(F.lower(F.col("low.file")), F.lit("np ")), NATIONAL).otherwise(COMPOSITE)
    matches = known & F.coalesce((metres <= 1) & (provenance_id(F.col("low.year"), resolution, programme, F.lit(dataset)) == F.col("expected")), F.lit(False))
    return joined.select(
        "patch_id", covered.alias("coverage"), F.when(F.col("mask").isNull(), 0).when(one, 1).otherwise(2).alias("signatures"), matches.alias("matches"),
        F.when(known, F.col("low.year")).alias("year"), F.when(known, resolution).alias("resolution"), F.when(known, programme).alias("programme"),
    )
