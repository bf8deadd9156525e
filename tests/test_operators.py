import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import contracts, graph, greedy, ledger, metrics, raster, resample, sampling, spatial, splits
from strata.operators.coverage import assess_coverage
from strata.operators.celljoin import closer_than, near_pairs, squares_overlap


def test_windows_of_a_square(spark):
    w = spatial.window_grid(spark, 5000, 5000)
    assert w.count() == 5929
    assert w.agg(F.max("row"), F.max("col")).first() == (4864, 4864)


def test_suppression_keeps_the_best_of_each_place(spark):
    w = spark.createDataFrame([(1, "b", 0, 0, 0.8), (1, "a", 0, 64, 0.8), (1, "c", 256, 256, 0.7)], "domain long, window_id string, row long, col long, score double")
    assert [(r.window_id, r.place) for r in greedy.suppress(w).orderBy("place").collect()] == [("a", 1), ("c", 2)]


def greedy_kept(rows):
    """The rule row by row: best first, a window stays unless it clashes with one that stays."""
    kept = {}
    for r in sorted(rows, key=lambda r: (r[0], -r[4], r[1])):
        def clash(k):
            dr, dc = abs(k[2] - r[2]), abs(k[3] - r[3])
            shared = max(128 - dr, 0) * max(128 - dc, 0)
            return math.hypot(dr, dc) < 128 or shared / (2 * 128 * 128 - shared) > 0.25
        if not any(clash(k) for k in kept.setdefault(r[0], [])):
            kept[r[0]].append(r)
    return sorted((d, r[1], r[2], r[3], r[4], i + 1) for d, rows in kept.items() for i, r in enumerate(rows))


WINDOW = "domain long, window_id string, row long, col long, score double"


def window_cases():
    rng = np.random.default_rng(1)
    yield [(i % 3, f"w{i:03d}", int(rng.integers(-20, 40)) * 64, int(rng.integers(-20, 40)) * 64, float(round(rng.random(), 2))) for i in range(1500)]
    yield [(0, f"w{i:04d}", int(rng.integers(0, 900)), int(rng.integers(0, 900)), 0.5) for i in range(900)]  # one score: order by id
    yield [(0, f"w{i:03d}", 100 * i, 0, 1 - i / 1000) for i in range(40)]  # a chain: each hangs on the one before, over all tiles
    yield [(0, f"w{i:03d}", 100 * i, 0, i / 1000) for i in range(40)] + [(1, f"x{i}", 0, 0, 0.1) for i in range(50)]  # the other way, and one place


@pytest.mark.parametrize("case", range(4))
def test_suppression_equals_the_sequential_rule(spark, case):
    rows = list(window_cases())[case]
    for cells in (4, 64):  # small tiles: many borders and rounds
        got = greedy.suppress(spark.createDataFrame(rows, WINDOW), tile_cells=cells)
        assert sorted(tuple(r) for r in got.collect()) == greedy_kept(rows)


def test_suppression_of_nothing(spark):
    assert greedy.suppress(spark.createDataFrame([], WINDOW)).collect() == []
    with pytest.raises(ValueError):
        greedy.suppress(spark.createDataFrame([], WINDOW), distance=0)


def test_review_queues(spark):
    w = spark.createDataFrame([(f"w{i:03d}", i / 99) for i in range(100)], "window_id string, score double")
    got = sampling.review_queues(w, "seed").collect()
    sizes = {q: sum(r.queue == q for r in got) for q in ("HIGH", "MEDIUM", "REFERENCE")}
    assert sizes == {"HIGH": 1, "MEDIUM": 10, "REFERENCE": 25}
    assert len({r.window_id for r in got}) == len(got)


def test_shortest_prefix(spark):
    cells = [("BNG_25KM_E19_N6", 11), ("BNG_25KM_E19_N5", 8), ("BNG_25KM_E18_N4", 7), ("BNG_25KM_E20_N13", 5), ("BNG_25KM_E21_N11", 4)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], "i int, cell string, n int")
    assert [r.cell for r in sampling.shortest_prefix(df, ["i"], "n", 28, 5).orderBy("i").collect()] == [c for c, _ in cells[:4]]


def test_patch_overlap_is_strict(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 127.0, 0.0), (3, 128.0, 0.0)], "id int, x double, y double")
    over = squares_overlap(128)
    pairs = near_pairs(p, p, 128, lambda a, b: (F.col(f"{a}.id") < F.col(f"{b}.id")) & over(a, b)).select("a.id", "b.id").collect()
    assert sorted(map(tuple, pairs)) == [(1, 2), (2, 3)]


def test_near_pairs_equal_the_nested_loop(spark):
    rng = np.random.default_rng(2)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-500, 500, (200, 2)))]
    df = spark.createDataFrame(pts, "id int, x double, y double")
    got = {tuple(r) for r in near_pairs(df, df, 60, closer_than(60)).select("a.id", "b.id").collect()}
    assert got == {(a[0], b[0]) for a in pts for b in pts if math.dist(a[1:], b[1:]) < 60}
    lone = {r.id for r in near_pairs(df, df.where("id >= 100"), 60, closer_than(60), "left_anti").collect()}
    assert lone == {a[0] for a in pts if all(math.dist(a[1:], b[1:]) >= 60 for b in pts[100:])}


def test_rings(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)]])
    r = spark.range(1).select(
        spatial.signed_ring_area(ring).alias("a"), spatial.point_in_ring(F.lit(1.0), F.lit(1.0), ring).alias("i"), spatial.point_in_ring(F.lit(5.0), F.lit(1.0), ring).alias("o"), spatial.ring_centroid(ring)[0].alias("c")
    ).first()
    assert (r.a, r.i, r.o, r.c) == (-16.0, True, False, 2.0)
    with pytest.raises(ValueError):
        spatial.patch_bounds(F.lit(0), F.lit(0), 128.5)


def plane(spark, z):
    return spark.range(33).select(F.lit(1).alias("patch_id"), F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(32))).alias("col")).withColumn("z", z)


def test_slope_of_a_plane_and_light_on_the_flat(spark):
    r = raster.representations(plane(spark, F.col("col") * 2.0), size=33, radius=2)
    low, high = r.agg(F.min("slope"), F.max("slope")).first()
    assert low == pytest.approx(math.degrees(math.atan(2))) == high
    flat = raster.representations(plane(spark, F.lit(5.0)), size=33, radius=2).agg(F.min("hillshade"), F.max("relief")).first()
    assert flat[0] == pytest.approx(math.sin(math.radians(45))) and flat[1] == 0


def test_long_and_packed_features_agree(spark):
    px = raster.surfaces(raster.patch_ids(spark, 4))
    long = {r.patch_id: np.array(r.features) for r in raster.feature_vectors(raster.pooled(raster.representations(raster.prepared(px)))).collect()}
    packed = {r.patch_id: np.array(r.features) for r in raster.packed_features(raster.packed(px)).collect()}
    assert sorted(long) == sorted(packed) == [0, 1, 2, 3]
    for k in long:
        assert len(long[k]) == 4096
        assert np.allclose(long[k], packed[k], atol=1e-4)


def test_patch_without_pixels(spark):
    px = plane(spark, F.lit(None).cast("double")).withColumn("masked", F.lit(True))
    r = raster.patch_review(px, size=33).first()
    assert r.reasons == "missing_coverage" and not r.passed
    assert raster.pooled(raster.representations(raster.prepared(px), size=33)).agg(F.max("slope")).first()[0] == 0


def test_metrics_by_hand(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.9), ("a", 1, 0.6), ("a", 0, 0.2), ("b", 1, 0.4)]
    df = spark.createDataFrame(rows, "region string, label int, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    auc = {r.region: r for r in metrics.auc_and_precision(df, ["region"]).collect()}
    assert auc["a"].auc == 0.625 and auc["a"].average_precision == pytest.approx((1 / 2) * (1 / 2) + (1 / 2) * (2 / 3), abs=1e-9)
    assert auc["b"].auc is None
    c = {r.region: r for r in metrics.confusion(df, ["region"]).collect()}
    assert (c["a"].tp, c["a"].fp, c["a"].balanced_accuracy) == (2, 1, 0.75) and c["b"].precision == 0


def test_bootstrap_of_equal_units_has_no_width(spark):
    df = spark.createDataFrame([(u, y, y, 0.2 + 0.5 * y) for u in range(8) for y in (0, 1)], "unit long, label int, predicted int, score double")
    got = {r.metric: (r.defined, r.undefined, r.mean, r.low, r.high) for r in resample.group_bootstrap(df, "unit", 50, "s").collect()}
    assert got == dict.fromkeys(("balanced_accuracy", "accuracy", "f1", "roc_auc"), (50, 0, 1.0, 1.0, 1.0))


@pytest.mark.parametrize("packed", [0, 1000])
def test_bootstrap_equals_the_plain_replicates(spark, packed):
    """Units of one class: some replicates have no ROC area, and a recall of one class only."""
    rng = random.Random(3)
    rows = [(u, int(u == 3) if u < 4 else rng.randrange(2), round(rng.random(), 1)) for u in range(5) for _ in range(4)]
    rows = [(u, y, int(s >= 0.5), s) for u, y, s in rows if u < 4]
    got = {r.metric: r for r in resample.group_bootstrap(spark.createDataFrame(rows, "unit long, label int, predicted int, score double"), "unit", 200, "b", packed=packed).collect()}
    values = {k: [] for k in got}
    for r in range(200):
        drawn = [int(hashlib.sha256(f"b:{r}:{k}".encode()).hexdigest()[:8], 16) % 4 for k in range(4)]
        part = [x for d in drawn for x in rows if x[0] == d]
        pos, neg = [x for x in part if x[1]], [x for x in part if not x[1]]
        recalls = [np.mean([x[2] == x[1] for x in c]) for c in (pos, neg) if c]
        tp, wrong = sum(x[1] & x[2] for x in part), sum(x[1] != x[2] for x in part)
        values["balanced_accuracy"].append(np.mean(recalls))
        values["accuracy"].append(np.mean([x[1] == x[2] for x in part]))
        values["f1"].append(2 * tp / (2 * tp + wrong) if tp + wrong else 0.0)
        if pos and neg:
            values["roc_auc"].append(np.mean([(p[3] > n[3]) + (p[3] == n[3]) / 2 for p in pos for n in neg]))
    assert 0 < got["roc_auc"].undefined < 200
    for k, x in values.items():
        r = got[k]
        assert (r.defined, r.undefined) == (len(x), 200 - len(x))
        assert [r.mean, r.low, r.high] == pytest.approx([np.mean(x), *np.percentile(x, [2.5, 97.5])], abs=1e-6)


@pytest.mark.parametrize("values", ["spread", "equal", "few", "heavy"])
def test_quantiles_equal_the_sorted_list(spark, values):
    from strata.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(5)
    x = {"spread": rng.normal(size=3000), "equal": np.full(500, 2.5), "few": rng.integers(0, 3, 700).astype(float), "heavy": np.exp(rng.normal(size=3000) * 20)}[values]
    rows = [(i % 3 or None, float(v)) for i, v in enumerate(x)] + [(1, None), (7, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    shares = [0.0, 0.01, 0.25, 0.5, 0.999, 1.0]
    got = exact_quantiles(df, "v", shares).first()
    assert got.n == len(x) and got.q == pytest.approx(np.quantile(x, shares).tolist(), rel=1e-12)
    # a coarse summary brackets too little or too much; the counts make up for it
    for r in exact_quantiles(df, "v", shares, ["k"], accuracy=20).collect():
        mine = [v for k, v in rows if k == r.k and v is not None]
        assert r.n == len(mine) and r.q == pytest.approx(np.quantile(mine, shares).tolist(), rel=1e-12)


def test_quantiles_of_nothing(spark):
    from strata.operators.quantiles import exact_quantiles

    df = spark.createDataFrame([], "k int, v double")
    assert exact_quantiles(df, "v", [0.5], ["k"]).collect() == []
    assert [(r.n, r.q) for r in exact_quantiles(df, "v", [0.5]).collect()] == [(0, None)]
    assert sampling.review_queues(spark.createDataFrame([], "window_id string, score double"), "seed").collect() == []


def test_folds_are_balanced(spark):
    sizes = [54, 40, 33, 30, 30, 21, 20, 14, 12, 9, 8, 7]
    df = spark.createDataFrame([(f"g{i:02d}", f"u{i}-{j}") for i, n in enumerate(sizes) for j in range(n)], "grp string, unit string")
    got = greedy.balanced_folds(df, "grp", "unit").groupBy("fold").agg(F.sum("size").alias("n")).collect()
    assert len(got) == 5 and max(r.n for r in got) - min(r.n for r in got) <= 14
    with pytest.raises(ValueError):
        greedy.balanced_folds(df.where("grp < 'g03'"), "grp", "unit")


def test_folds_equal_the_walk_over_groups(spark):
    rng = random.Random(6)
    for sizes in ([rng.randrange(1, 9) for _ in range(120)], [1] * 57, [40, 1, 1, 1, 1, 1, 1, 1, 39, 39, 3, 3, 3], [7, 7, 7, 7, 7]):
        rows = [(f"g{i:03d}", f"u{i}-{j % (1 + i % 3)}") for i, n in enumerate(sizes) for j in range(n)]
        walk, totals, numbers = {}, [0] * 5, [0] * 5
        for i, n in sorted(enumerate(sizes), key=lambda x: (-x[1], -min(x[1], 1 + x[0] % 3), x[0])):
            f = min(range(5), key=lambda k: (totals[k], numbers[k], k))
            totals[f] += n
            numbers[f] += 1
            walk[f"g{i:03d}"] = (f, n)
        got = greedy.balanced_folds(spark.createDataFrame(rows, "grp string, unit string"), "grp", "unit").collect()
        assert {r.grp: (r.fold, r.size) for r in got} == walk


def test_fill_defers_groups_that_do_not_fit(spark, monkeypatch):
    g = spark.createDataFrame([(1, 5), (2, 4), (3, 2), (4, 1)], "g int, w int")
    assert sorted(map(tuple, greedy.fill_groups(g, "g", "w", 8, ["g"]).collect())) == [(1, 0), (3, 1), (4, 2)]
    assert greedy.fill_groups(g, "g", "w", 12, ["g"]).count() == 4
    with pytest.raises(ValueError):
        greedy.fill_groups(g.where("g < 3"), "g", "w", 8, ["g"])
    monkeypatch.setattr(greedy, "HELD", 3)
    rng = random.Random(7)
    groups = [(i, rng.randrange(1, 30)) for i in range(200)] + [(200 + i, 1) for i in range(30)]
    left, want = 500, []
    for i, w in groups:
        if w <= left:
            want.append(i)
            left -= w
    got = greedy.fill_groups(spark.createDataFrame(groups, "g int, w int"), "g", "w", 500, ["g"]).orderBy("place").collect()
    assert [r.g for r in got] == want and [r.place for r in got] == list(range(len(want))) and left == 0


def test_nonadjacent_cells(spark):
    c = spark.createDataFrame([("a", 0, 0, 30), ("b", 1, 1, 29), ("c", 2, 2, 20), ("d", 9, 9, 3)], "cell string, e long, n long, count long")
    assert greedy.apart(c) == ["a", "c"]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_split_violations(spark):
    df = spark.createDataFrame([(1, 10, "", 1, 1, "train"), (1, 10, "", 1, 0, "train"), (2, 11, "k", 1, 1, "train"), (3, 11, "k", 2, 0, "final_test")], "sample_id long, observation_group long, component string, block int, label int, partition string")
    got = {tuple(r) for r in splits.integrity_violations(df, "sample_id").collect()}
    assert got == {("repeated_id", "1"), ("group_crosses", "11"), ("component_crosses", "k"), ("class_imbalance", "train"), ("class_imbalance", "final_test")}
    with pytest.raises(ValueError):
        splits.training_units(df.withColumn("fold", F.lit(0)), F.col("component"), 0, 0.3, "s")


def test_guards(spark):
    df = spark.sql("select 1 as id, named_struct('Center', 1) as s")
    assert contracts.unsafe_fields(df.schema) == ["s.Center"]
    with pytest.raises(ValueError):
        contracts.assert_public(df)
    with pytest.raises(ValueError):
        contracts.assert_empty(contracts.row_violations(df.select("id"), "id", {"big": F.col("id") > 5}))


def test_admission_stops_at_the_first_fault(spark):
    items = spark.createDataFrame([(0, 1, 10, "a"), (0, 2, 99, "b"), (0, 3, 10, "c"), (1, 1, 10, "a"), (1, 2, 10, "a")], "batch int, item int, size int, digest string")
    got = {(r.batch, r.item): r.status for r in contracts.admission(items, "batch", "item", 8, 50, 500).collect()}
    assert got == {(0, 1): "admitted", (0, 2): "item_too_large", (0, 3): "not_reached", (1, 1): "admitted", (1, 2): "duplicate_content"}


def test_ledger(spark):
    e = spark.createDataFrame([(1, 1, "DRAFT"), (1, 2, "AUTHORIZED"), (1, 3, "REVIEWED"), (2, 1, "AUTHORIZED")], "p int, t int, state string")
    assert {(r.p, r.t) for r in ledger.illegal_moves(e, "p", ["t"], "state").collect()} == {(1, 3), (2, 1)}
    assert {(r.p, r.state) for r in ledger.latest(e, ["p"], ["t"]).collect()} == {(1, "REVIEWED"), (2, "AUTHORIZED")}
    old = spark.createDataFrame([("k", 7, 1, "x")], "key string, id long, at int, v string")
    new = spark.createDataFrame([("k", 8, 2, "y"), ("m", 9, 2, "z")], "key string, id long, at int, v string")
    assert {tuple(r) for r in ledger.upsert(old, new, ["key"], "at").collect()} == {("k", 7, 2, "y"), ("m", 9, 2, "z")}


def square(x, y, size):
    return [(x, y), (x, y + size), (x + size, y + size), (x + size, y), (x, y)]


def test_geometry_review_by_hand(spark):
    ring = "array<array<struct<x:double,y:double>>>"
    cases = [
        (None, 5.0, 5.0, 0.1, ("needs_review", "geometry_missing", 0)), ([], 5.0, 5.0, 0.1, ("needs_review", "geometry_missing", 0)),
        ([square(0.0, 0.0, 10.0)], 5.0, 5.0, 0.1, ("pass", None, 1)), ([square(0.0, 0.0, 10.0)] * 2, 5.0, 5.0, 0.1, ("fail", "geometry_compound", 2)),
        ([square(0.0, 0.0, 10.0)], 50.0, 5.0, 0.1, ("fail", "geometry_off_centre", 1)), ([square(0.0, 0.0, 10.0)], 5.0, 5.0, None, ("needs_review", "geometry_too_large", 1)),
        ([square(0.0, 0.0, 10.0)], 5.0, 5.0, 0.6, ("needs_review", "geometry_too_large", 1)), ([square(0.0, 0.0, 250.0)], 125.0, 125.0, 0.1, ("needs_review", "geometry_too_large", 1)),
        ([square(0.0, 0.0, 10.0)[::-1]], 5.0, 5.0, 0.1, ("pass", None, 1)),  # no outer ring: the largest one stands for it
    ]
    df = spark.createDataFrame([(i, r, x, y, a) for i, (r, x, y, a, _) in enumerate(cases)], f"i int, rings {ring}, x double, y double, a double")
    got = df.select("i", spatial.geometry_review(*[F.col(c) for c in ("rings", "x", "y", "a")]).alias("g")).select("i", "g.*").collect()
    assert {r.i: (r.status, r.reason, r.outer_rings) for r in got} == {i: c[-1] for i, c in enumerate(cases)}


def test_coverage_assessment_by_hand(spark):
    points = [(s, i, s * 100.0 + i, 5.0) for s in range(7) for i in range(9)]
    full, half = lambda s: square(s * 100.0 - 10, 0.0, 30.0), lambda s: square(s * 100.0 - 10, 0.0, 14.0)
    feats = [
        (0, 1, full(0), "p", "2020", "1", "a", "b", "NP file", None), (1, 2, half(1), "p", "2020", "1", "a", "b", "x", None),
        (2, 3, full(2), "p", "2020", "1", "a", "b", "x", None), (2, 4, full(2), "q", "2020", "1", "a", "b", "x", None), (3, 5, full(3), "p", "2020", "2", "a", "b", "x", None),
        (4, 6, full(4), "p", "2020", "1", "a", "", "x", None), (5, 7, full(5), "p", "2020", "1", "a", "b", "", "stamped"),
    ]
    p = spark.createDataFrame(points, "site_id int, i int, x double, y double").withColumn("c", F.col("site_id"))
    f = spark.createDataFrame(feats, "d int, feature_id int, ring array<struct<x:double,y:double>>, polygon_id string, year string, resolution string, start string, end string, source string, programme_kind string")
    got = {r.site_id: (r.coverage, r.provenance, r.reason, r.programme) for r in assess_coverage(p, f, F.col("c") == F.col("d")).collect()}
    assert got == {
        0: ("pass", "pass", None, "National LIDAR Programme"), 1: ("fail", "not_reviewed", "terrain_patch_incomplete", None), 2: ("pass", "needs_review", "terrain_provenance_confounded", "EA Composite source survey"),
        3: ("fail", "fail", "terrain_no_1m_coverage", "EA Composite source survey"), 4: ("pass", "needs_review", "terrain_provenance_missing", "EA Composite source survey"),
        5: ("pass", "pass", None, "Time-stamped EA survey"), 6: ("fail", "not_reviewed", "terrain_no_1m_coverage", None),
    }


def test_diverse_order_equals_the_plain_rule(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(f"k{i:03d}", rng.randrange(6), rng.choice([None, 0, 1, 2])) for i in range(60)]
    for k in (15, 80):
        left, seen, want = sorted(rows, key=lambda r: r[0]), (set(), set()), []
        while left and len(want) < k:
            best = max(left, key=lambda r: sum(r[j + 1] not in seen[j] for j in (0, 1)))
            left.remove(best)
            want.append(best[0])
            for j in (0, 1):
                seen[j].add(best[j + 1])
        df = spark.createDataFrame(rows, "key string, a int, b int")
        assert greedy.diverse_order(df, "key", ["a", "b"], k) == want
    monkeypatch.setattr(greedy, "HELD", 10)  # each choice an aggregation
    assert greedy.diverse_order(df, "key", ["a", "b"], 12) == want[:12]


def sequential_sample(positives, draw, spacing, attempts):
    out = []
    for g in sorted({p[0] for p in positives}):
        taken = []
        for _, p, x, y in sorted(q for q in positives if q[0] == g):
            xs, ys, ok = draw(p, x, y, np.arange(1, attempts + 1))
            for a in np.flatnonzero(ok):
                if all((xs[a] - u) ** 2 + (ys[a] - w) ** 2 >= spacing * spacing for u, w in taken):
                    taken.append((xs[a], ys[a]))
                    out.append((g, p, int(a) + 1, float(xs[a]), float(ys[a])))
                    break
    return out


@pytest.mark.parametrize("n, extent, first, tile", [(150, 400.0, 1024, 120.0), (500, 300.0, 16, 110.0), (60, 90.0, 8, None)])
def test_rejection_equals_the_sequential_rule(spark, n, extent, first, tile):
    """Sparse and crowded rooms, one batch and many, tiles smaller than the room and larger."""
    rng = random.Random(n)
    positives = [(i % 2, i, float(rng.randrange(int(extent))), float(rng.randrange(int(extent)))) for i in range(n)]
    draw = greedy.annulus_attempts("t", 4.0, 20.0, (0.0, 0.0, extent, extent))
    got = greedy.rejection_sample(spark.createDataFrame(positives, "region long, positive long, x double, y double"), draw, 21.0, 30.0, attempts=100, first_batch=first, tile=tile)
    assert sorted(map(tuple, got.collect())) == sequential_sample(positives, draw, 30.0, 100)


def test_annulus_points_are_those_of_the_expression(spark):
    rows = spark.range(300).select("id", *[c.alias(a) for a, c in zip("xy", spatial.annulus_draw(F.sha2(F.concat(F.lit("s:"), F.col("id").cast("string"), F.lit(":1")), 256), F.col("id") * 1000.0, F.col("id") * -7.0, 2000.0, 10000.0))]).collect()
    draw = greedy.annulus_attempts("s", 2000.0, 10000.0, (-1e9, -1e9, 1e9, 1e9))
    for r in rows:
        x, y, ok = draw(r.id, r.id * 1000.0, r.id * -7.0, np.array([1]))
        assert (x[0], y[0], ok[0]) == (r.x, r.y, True)


def test_numbering_counts_on_over_partitions(spark):
    from strata.operators.numbering import numbered

    rng = random.Random(9)
    rows = [(rng.choice("aab"), rng.randrange(50), rng.randrange(9)) for _ in range(400)] + [(None, 3, 1), (None, 2, 5)]
    got = numbered(spark.createDataFrame(rows, "k string, o int, v int"), ["k"], ["o", "v"], "v").collect()
    for k in ("a", "b", None):
        mine = sorted((r for r in got if r.k == k), key=lambda r: r["rank"])
        assert [(r.o, r.v) for r in mine] == sorted((o, v) for a, o, v in rows if a == k)
        assert [r["rank"] for r in mine] == list(range(len(mine)))
        assert [r.before for r in mine] == [sum(x.v for x in mine[:i]) for i in range(len(mine))]


def test_array_digests_by_hand(spark):
    z = [1.5, float("nan"), -2.0]
    got = raster.content_digests(spark.createDataFrame([(7, z)], "patch_id long, z array<double>")).first()
    values, mask = np.array([1.5, 0.0, -2.0], "<f4"), np.array([0, 1, 0], np.uint8)
    assert got.digest == hashlib.sha256(values.tobytes() + mask.tobytes()).hexdigest()


def test_models_separate_what_can_be_separated(spark):
    from pyspark.ml.functions import array_to_vector

    from strata.operators import models

    rng = random.Random(1)
    rows = [(i, float(i % 2), [rng.gauss(2.0 * (i % 2), 0.4), rng.gauss(0, 1)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, label double, f array<double>").withColumn("features", array_to_vector("f")).drop("f")
    train, test = df.where("vec_id % 3 <> 0"), df.where("vec_id % 3 = 0")
    for model in (models.logistic(train.count()), models.forest(20)):
        scores = models.score(model.fit(train), test).collect()
        assert len(scores) == 100 and all(0 <= r.score <= 1 for r in scores)
        assert sum((r.score >= 0.5) == (r.label == 1) for r in scores) >= 95


def test_inserts_keep_the_first_and_come_with_their_audit_row(spark):
    old = spark.createDataFrame([(1, "a", 5)], "id int, v string, at int")
    new = spark.createDataFrame([(2, "late", 9), (2, "early", 3), (1, "again", 1)], "id int, v string, at int")
    assert sorted(map(tuple, ledger.insert_ignore(old, new, "id", "at").collect())) == [(1, "a", 5), (2, "early", 3)]
    got = ledger.insert_audited(new.limit(1).withColumn("who", F.lit("w")), "id", "CREATED", "who", "at").collect()
    assert sorted((r.kind, r.key, r.actor) for r in got) == [("audit", "2", "w"), ("row", "2", "w")]


def test_unknown_labels_and_open_results(spark):
    df = spark.createDataFrame([("p",), ("b",)], "l string")
    label = contracts.encoded_label(F.col("l"), "p", "b")
    assert [r[0] for r in df.select(label).collect()] == [1, 0]
    for bad in ("x", None):
        with pytest.raises(Exception, match="unknown label"):
            spark.createDataFrame([(bad,)], "l string").select(label).collect()
    events = spark.createDataFrame([(1, 1, "UNREVIEWED"), (1, 2, "IN_REVIEW"), (1, 3, "ESCALATED"), (2, 1, "IN_REVIEW"), (3, 1, "UNREVIEWED"), (3, 2, "REVIEWED")], "k int, at int, state string")
    assert sorted((r.k, r.at) for r in ledger.illegal_results(events, "k", ["at"], "state").collect()) == [(2, 1), (3, 2)]


def test_provenance_equals_the_nested_loop(spark):
    """Features from metres to the whole country, with two rings, against every patch and point."""
    from strata.operators import coverage

    rng = random.Random(11)

    def box(x, y, w):
        return [(x, y), (x, y + w), (x + w, y + w), (x + w, y), (x, y)]

    feats = []
    for i in range(60):
        w = 10.0 ** rng.uniform(2, 5.5)
        x, y = rng.uniform(-1e4, 4e4), rng.uniform(-1e4, 4e4)
        feats.append(([box(x, y, w), box(x + 2 * w, y, w / 2)], rng.choice(["a", None]), "2020", rng.choice(["1.0", "0.5", "x"]), "s", "e", rng.choice(["np 1", "NP 2", "other"])))
    feats += [([], "z", "2020", "1.0", "s", "e", "np 1"), ([box(5.09e6, 9e4, 500.0)], "b", "2021", "1.0", "s", "e", "NP 7"), ([box(5.08e6, 9e4, 500.0)], "b", "2021", "2", "s", "e", "NP 7")]
    patches = [(i, rng.randrange(-9000, 40000), rng.randrange(-9000, 40000), "?") for i in range(150)]
    wanted = "EAP-" + hashlib.sha256(b"2021|1|National LIDAR Programme|set").hexdigest()[:12]
    patches += [(900, 5_090_200, 90_200, wanted), (901, 5_090_200, 90_200, "?"), (902, 5_090_480, 90_200, wanted), (903, 5_080_200, 90_200, wanted), (904, 9_300_000, 0, wanted)]

    def inside(x, y, ring):
        odd = False
        for (x1, y1), (x2, y2) in zip([ring[-1], *ring[:-1]], ring):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
        return odd

    want = {}
    for i, x, y, _ in patches:
        points = [(x + 64 * a, y + 64 * b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        held = {n: [any(inside(*p, r) for r in f[0]) for p in points] for n, f in enumerate(feats)}
        relevant = [n for n, h in held.items() if any(h)]
        covered = bool(relevant) and all(any(held[n][k] for n in relevant) for k in range(9))
        want[i] = (covered, min(2, len({tuple(v or "" for v in feats[n][1:]) for n in relevant})))
    schema = "rings array<array<struct<x:double,y:double>>>, polygon_id string, year string, resolution string, start string, end string, file string"
    rows = coverage.matching_provenance(spark.createDataFrame(patches, "patch_id int, x int, y int, expected string"), spark.createDataFrame(feats, schema), "set").collect()
    assert {r.patch_id: (r.coverage, r.signatures) for r in rows} == want and len({v for v in want.values()}) > 3
    last = {r.patch_id: (r.matches, r.year, r.resolution, r.programme) for r in rows if r.patch_id >= 900}
    assert last == {
        900: (True, "2021", "1", "National LIDAR Programme"), 901: (False, "2021", "1", "National LIDAR Programme"), 902: (False, None, None, None),
        903: (False, "2021", "2", "National LIDAR Programme"), 904: (False, None, None, None),
    }


def test_sealed_figures_find_one_changed_row(spark):
    from strata.operators import evidence

    rng = random.Random(12)
    rows = [(i, f"u{i % 9}", y, int(s >= 0.5), s) for i in range(90) for y, s in [(i % 2, round(rng.random(), 2))]]
    df = spark.createDataFrame(rows, "sample_id int, u string, label int, predicted int, score double")
    receipt = evidence.published_figures(df, "u", 30, "s")
    assert all(r.agrees for r in evidence.reproduced(receipt, df.repartition(5), "u", 30, "s").collect())
    turned = df.withColumn("score", F.when(F.col("sample_id") == 7, F.col("score") + 1e-9).otherwise(F.col("score")))
    assert "rows" in {r.figure for r in evidence.reproduced(receipt, turned, "u", 30, "s").collect() if not r.agrees}
    wrong = df.withColumn("predicted", F.when(F.col("sample_id") == 7, 1 - F.col("predicted")).otherwise(F.col("predicted")))
    lost = {r.figure for r in evidence.reproduced(receipt, wrong, "u", 30, "s").collect() if not r.agrees}
    assert {"rows", "accuracy", "balanced_accuracy"} <= lost and lost & {"tn", "fp", "fn", "tp"}
    receipt["figures"]["tp"] += 1
    with pytest.raises(ValueError):
        evidence.reproduced(receipt, df, "u", 30, "s")
