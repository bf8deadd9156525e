import random

import numpy as np
import pytest
import xxhash

from strata.llm import common, simhash


def reference(text, words=3):
    w = [x for x in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", "  \n", "One", "one TWO", "a b c", "a b c a b c", "É É é x y z", "w " * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == reference(text)


@pytest.mark.parametrize("radius", [1, 3, 5, 7])
def test_every_difference_within_the_radius_is_covered(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1 and min(m.bit_count() for m in masks) >= 20
    rng = random.Random(radius)
    for _ in range(2000):
        x = sum(1 << i for i in rng.sample(range(64), radius))
        assert any(x & m == 0 for m in masks)


def brute(fps, ids, radius=3):
    lab = np.array(ids)
    near = [np.flatnonzero(np.bitwise_count(fps ^ f) <= radius) for f in fps]
    while True:
        new = np.array([lab[n].min() for n in near])
        if (new == lab).all():
            return lab
        lab = new


def test_links_equal_brute_force_with_split_buckets(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 30, dtype=np.uint64)
    fps = [int(b) ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 5), replace=False)) for b in base for _ in range(12)]
    fps = np.array(sorted(set(fps)), np.uint64)
    df = spark.createDataFrame([([int(f)], i) for i, f in enumerate(fps.view(np.int64).tolist())], "fps array<long>, rep long")
    monkeypatch.setattr(common.bounded_units, "__defaults__", (4,))
    got = {r.node: r.component for r in common.connected_components(simhash.hamming_links(df)).collect()}
    want = brute(fps, range(len(fps)))
    assert [got.get(i, i) for i in range(len(fps))] == want.tolist()


def test_copies_nulls_repeats_and_extra_columns(spark):
    rows = [(5, "alpha beta gamma delta", "x"), (2, "ALPHA beta  gamma delta", "y"), (9, None, "z"), (7, "", "z"), (5, "alpha beta gamma delta", "x"), (8, "something else entirely here", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((r.doc_id, r.component_id) for r in simhash.simhash_components(df).collect())
    assert got == [(2, 2), (5, 2), (5, 2), (7, 7), (8, 8), (9, 7)]
    assert simhash.simhash_components(df.limit(0)).count() == 0


def test_pipeline_stage_keeps_one_of_each_group(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    original = [rng.choice(words) for _ in range(400)]
    near = list(original)
    for i in (17, 190, 350):
        near[i] = "changed"
    other = [rng.choice(words) for _ in range(400)]
    rows = [(4, " ".join(original)), (3, " ".join(near)), (6, " ".join(original)), (9, " ".join(other)), (10, None), (11, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "y")
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 9, 10]


def test_units_hold_every_pair_of_a_bucket_once_in_bounds(spark):
    df = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 1), (3, 2)) for i in range(n)], "k int, id long")
    units = common.bounded_units(df, ["k"], "id", 8).collect()
    assert {u.k for u in units} == {1, 3}
    by = {}
    for u in units:
        by.setdefault((u.k, u.bi, u.bj), set()).add(u.id)
    pairs = {(a, b) for (k, _, _), ids in by.items() if k == 1 for a in ids for b in ids if a < b}
    assert len(pairs) == 50 * 49 // 2


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 199), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in common.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {199: 199, 200: 199}
    assert common.connected_components(edges.limit(0)).count() == 0


def test_pipeline_stage_links_contiguous_and_scattered_edits_exactly(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    rows, linked = [], set()
    for k in range(120):
        text = [rng.choice(words) for _ in range(300)]
        extra = [rng.choice(words) for _ in range(60)]
        at = rng.randrange(60, 200)
        edited = [text + extra[:60], text[:at] + text[at + 50 :], text[:at] + extra[:24] + text[at + 24 :], [extra[0] if i in (30, 100, 170, 240) else w for i, w in enumerate(text)]][k % 4]
        if k % 3 == 0:
            edited = text + [rng.choice(words) for _ in range(90)]  # below the similarity
        a, b = (set(zip(*(t[i:] for i in range(5)))) for t in (text, edited))
        if len(a & b) >= 0.8 * len(a | b):
            linked.add(2 * k + 1)
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(edited))]
    assert len(linked) == 80
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_duplicates(df).collect()} == {r[0] for r in rows} - linked
