"""Packed judgement of rasters, verified loads, frozen settings, artefacts and gates."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import approval, quality
from strata.operators import raster as r


def test_dilation_reaches_all_eight_neighbours():
    rng = np.random.default_rng(4)
    gaps = rng.random((3, 9, 7)) < 0.1
    padded = np.pad(gaps, ((0, 0), (1, 1), (1, 1)))
    brute = np.any([padded[:, i : i + 9, j : j + 7] for i in range(3) for j in range(3)], axis=0)
    assert (quality.dilated(gaps) == brute).all()


def judged(spark, gap, size=4, reference=None, **channels):
    base = {"elevation": [0.0] * size * size, "slope": [1.0] * size * size, "hillshade": [0.5] * size * size, "relief": [0.1] * size * size}
    base.update(channels)
    row = [7, gap, *[base[c] for c in r.CHANNELS]]
    schema = "patch_id long, gap array<boolean>, " + ", ".join(f"{c} array<float>" for c in r.CHANNELS)
    df = spark.createDataFrame([tuple(row)], schema)
    if reference is not None:
        df = df.select("*", *[F.col(c).alias(f"o_{c}") for c in r.CHANNELS[:3]], F.lit(reference).cast("array<float>").alias("o_relief"))
    return quality.packed_violations(df, size, "o_" if reference is not None else None).first()


def test_each_fault_is_named(spark):
    none, nan = [False] * 16, float("nan")
    good = judged(spark, none)
    digest = hashlib.sha256(b"".join(
        n.encode() + np.full(16, x, "<f4").tobytes() + bytes(16) for n, x in (("elevation", 0), ("slope", 1), ("hillshade", 0.5), ("relief", 0.1))
    )).hexdigest()
    assert good.passed and good.reasons == "" and good.digest == digest
    corner = [True] + [False] * 15
    gone = [nan] + [0.0] * 15
    near = [nan, nan] + [1.0] * 14
    kept = {"elevation": gone, "relief": gone, "slope": near, "hillshade": [None] + [0.5] * 15}
    assert judged(spark, corner, **kept).passed  # one pixel around a gap; NULL is a gap
    assert judged(spark, corner, **{**kept, "slope": [nan, 1.0, nan] + [1.0] * 13}).reasons == "slope:stray_gap"
    assert judged(spark, corner, **{**kept, "relief": [nan, nan] + [0.0] * 14}).reasons == "relief:stray_gap"
    assert judged(spark, corner, **{**kept, "elevation": [0.0] * 16}).reasons == "elevation:gap_filled"
    assert judged(spark, none, elevation=[1.0] * 16, slope=[91.0] * 16, hillshade=[-0.1] * 16).reasons == "elevation:median;slope:range;hillshade:range"
    assert judged(spark, [True] * 16, **{c: [nan] * 16 for c in r.CHANNELS}).reasons == ";".join(f"{c}:empty" for c in r.CHANNELS)
    assert judged(spark, none, slope=[1.0] * 15, relief=None).reasons == "slope:shape;relief:shape"
    assert judged(spark, None).reasons == ";".join(f"{c}:shape" for c in r.CHANNELS)
    assert judged(spark, none, reference=[0.1] * 16).passed
    assert judged(spark, none, reference=[0.1] * 15 + [0.2]).reasons == "relief:differs"


def test_seams_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    z, slope, relief = rng.random((3, 12, 15)).round(3)
    z[rng.random(z.shape) < 0.1] = np.nan
    z[:, 7] = z[:, 6]
    rows = [(1, i, j, *[None if np.isnan(a[i, j]) else float(a[i, j]) for a in (z, slope, relief)]) for i in range(12) for j in range(15)]
    df = spark.createDataFrame(rows, "patch_id long, row int, col int, z double, slope double, relief double")
    extents = spark.createDataFrame([(1, 13.0, 30.0, 15, 12)], "patch_id long, left double, top double, width int, height int")
    got = {(x["orientation"], x["index"]): x for x in quality.seam_diagnostics(df.drop("slope", "relief"), df.drop("z"), extents, 5.0).collect()}
    assert sorted(got) == [("horizontal", 5), ("horizontal", 10), ("vertical", 2), ("vertical", 7), ("vertical", 12)]
    for (way, at), x in got.items():
        a, s, m = (z, slope, relief) if way == "vertical" else (z.T, slope.T, relief.T)
        steps = np.abs(np.diff(a, axis=1))
        step = np.nanmedian(steps[:, at - 1])
        seen = steps[np.isfinite(steps)]
        assert x.step == pytest.approx(step) and x.percentile == pytest.approx(100 * np.mean(seen.round(9) <= round(step, 9)))
        assert x.duplicate_edge == (way == "vertical" and at == 7)
        assert x.slope_median == pytest.approx(np.median(s[:, at - 1 : at + 1])) and x.relief_median == pytest.approx(np.median(np.abs(m[:, at])))
    line = spark.createDataFrame([(1, 10.0, 30.0, 5, 5), (2, 3.0, 9.0, 1, 1)], extents.schema)
    assert quality.seam_lines(line, 5.0).count() == 0  # a raster of one whole cell, and one pixel


SCHEMA = "id long, label int, features array<float>"


def test_digest_of_packed_floats(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 2.5]), (2, 0, None), (3, 1, []), (4, 1, [1.0, None]), (5, 1, [-0.0, float("inf")])], SCHEMA).coalesce(1)
    got = {x.id: x.digest for x in approval.with_digest(rows, "features").collect()}
    want = {k: hashlib.sha256(np.asarray(a, "<f4").tobytes()).hexdigest() for k, a in ((1, [1.0, 2.5]), (3, []), (5, [-0.0, np.inf]))}
    assert got == {**want, 2: None, 4: None}
    assert {x.id: x.digest for x in approval.with_digest(rows.where("id > 2"), "features").collect()} == {k: got[k] for k in (3, 4, 5)}


def test_load_names_what_is_broken(spark):
    rows = spark.createDataFrame([(i, i % 2, [float(i), 1.0]) for i in range(8)], SCHEMA)
    frozen = approval.with_digest(rows, "features").drop("features")

    def broken(df, counts=None, by=frozen):
        return sorted((x.rule, x.key) for x in approval.load_violations(df, by, 2, counts).collect())

    assert broken(rows, {0: 4, 1: 4}) == [] and approval.load_verified(rows, frozen, 2, {0: 4, 1: 4}).count() == 8
    turned = rows.withColumn("features", F.when(F.col("id") == 3, F.array(F.lit(3.0000002384185791).cast("float"), F.lit(1.0).cast("float"))).otherwise(F.col("features")))
    assert broken(turned) == [("content", "3")]
    with pytest.raises(ValueError, match="content: 3"):
        approval.load_verified(turned, frozen, 2, {0: 4, 1: 4})
    assert broken(rows.where("id <> 5"), {0: 4, 1: 4}) == [("balance", "1"), ("missing", "5")]
    assert broken(rows.unionByName(rows.where("id = 2")), {0: 4, 1: 4}) == [("balance", "0"), ("repeated", "2")]
    odd = spark.createDataFrame([(None, 1, [1.0, 1.0]), (0, None, None)], SCHEMA)
    got = {(x.rule, x.key) for x in approval.load_violations(rows.where("id > 0").unionByName(odd), frozen, 2, {0: 4, 1: 4, 2: 1}).collect()}
    assert got == {("unknown", None), ("content", "0"), ("shape", "0"), ("label", "0"), ("balance", "0"), ("balance", "1"), ("balance", "2"), ("balance", "-1")}
    assert {x.rule for x in approval.load_violations(rows.limit(0), frozen, 2).collect()} == {"missing"}


def test_settings_and_artefacts_of_a_fitted_forest(spark, tmp_path):
    from pyspark.ml.functions import array_to_vector

    from strata.operators import models

    rows = spark.createDataFrame([(i, float(i % 2), [float(i % 2), float(i)]) for i in range(40)], "id long, label double, features array<double>")
    model = models.forest(7).fit(rows.withColumn("features", array_to_vector("features")))
    assert approval.parameter_faults(model) == ["numTrees", "trees"]
    assert approval.parameter_faults(model, {**approval.FROZEN_FOREST, "numTrees": 7}) == []
    assert approval.parameter_faults(model, {"maxDepth": 9, "unheard": 1}) == ["maxDepth", "unheard"]
    path = f"{tmp_path}/model"
    model.save(path)
    digest = approval.artifact_digest(spark, path)
    assert digest == approval.artifact_digest(spark, path) and len(digest) == 64
    data = next(p for p in sorted((tmp_path / "model").rglob("part-*")) if not p.name.startswith("."))
    (data.parent / f".{data.name}.crc").unlink()  # the local file system would refuse first
    raw = bytearray(data.read_bytes())
    raw[len(raw) // 2] ^= 1
    data.write_bytes(raw)
    assert approval.artifact_digest(spark, path) != digest


def test_gates_in_order(spark):
    good = ("m", "c", "p", "a", "m", "c", "a", [1.0, 2.0], 0.5)
    cases = {
        None: {}, "model_not_approved": {0: None, 1: "x"}, "config_mismatch": {1: None, 2: "x"}, "path_not_approved": {2: "p/../q", 3: "x"}, "artifact_mismatch": {3: "x", 7: None},
        "feature_contract": {7: [1.0, float("inf")], 4: None}, "adapter_unavailable": {4: None, 5: "x"}, "adapter_mismatch": {6: None, 8: 2.0}, "score_out_of_range": {8: None},
    }
    rows = [(str(name), *[changes.get(i, x) for i, x in enumerate(good)]) for name, changes in cases.items()]
    rows += [("score_out_of_range", *good[:8], x) for x in (float("nan"), 1.0001, -0.1)] + [("None", *good[:8], x) for x in (0.0, 1.0)]
    df = spark.createDataFrame(rows, "want string, model string, config string, path string, artifact string, adapter_model string, adapter_config string, adapter_artifact string, features array<float>, score double")
    for x in df.select("want", F.coalesce(approval.request_fault({"m": "c"}, "a", "p", 2), F.lit("None")).alias("got")).collect():
        assert x.got == x.want


def test_gaps_of_the_surface_are_gaps_of_slope_and_hillshade(spark):
    rng = np.random.default_rng(2)
    z = rng.random((8, 8))
    z[[0, 3, 3, 7], [0, 4, 5, 2]] = np.nan
    rows = [(1, i, j, None if np.isnan(z[i, j]) else float(z[i, j])) for i in range(8) for j in range(8)]
    got = {(x.row, x.col): x for x in r.representations(spark.createDataFrame(rows, "patch_id long, row int, col int, z double"), size=8, radius=2).collect()}
    south, east = np.gradient(z)
    slope = np.degrees(np.arctan(np.hypot(east, south)))
    slope[np.isnan(z)] = np.nan
    for at, x in got.items():
        assert (x.slope is None) == np.isnan(slope[at]) == (x.hillshade is None) and (x.slope is None or x.slope == pytest.approx(slope[at]))
    assert got[3, 4].elevation is None and got[3, 4].slope is None and got[2, 4].slope is None
