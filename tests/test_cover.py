"""The cover of patches by rings, refined down to the smallest cells, against every ring and point."""

import random

import pytest

from strata.operators import coverage


def holds(ring, x, y):
    inside = False
    for (ax, ay), (bx, by) in zip([ring[-1], *ring], ring):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
    return inside


@pytest.mark.parametrize("kept", [0, 3])
def test_cover_equals_the_nested_loop(spark, monkeypatch, kept):
    monkeypatch.setattr(coverage, "KEPT", kept)
    r = random.Random(5)
    rings = []
    for k in range(60):
        x, y, h = r.uniform(-20000, 20000), r.uniform(-20000, 20000), r.choice([200.0, 900.0, 3000.0, 9000.0])
        shape = r.choice([[(-1, -1), (-1, 1), (1, 1), (1, -1)], [(-1, 0), (0, 1), (1, 0), (0, -1)], [(-1, -1), (1, 1), (1, -1), (-1, 1)]])
        rings.append(([(x + a * h, y + b * h) for a, b in shape + shape[:1]], k % 4))
    rings += [([(3990.0, 3990.0), (3990.0, 4100.0), (4100.0, 4100.0), (4100.0, 3990.0)], 9), ([(-9.0, -9.0), (-9.0, 0.0), (0.0, 0.0), (0.0, -9.0)], 8)] * 2
    places = [(i, r.uniform(-21000, 21000), r.uniform(-21000, 21000)) for i in range(300)] + [(300, 3950.0, 3950.0), (301, -30.0, -30.0)]
    patches = [(i, [(x + 64.0 * a, y + 64.0 * b) for a in (-1, 0, 1) for b in (-1, 0, 1)]) for i, x, y in places]
    got = coverage.signature_cover(
        spark.createDataFrame(patches, "patch_id int, points array<struct<x:double,y:double>>"), spark.createDataFrame(rings, "ring array<struct<x:double,y:double>>, s int")
    )
    want = {}
    for i, points in patches:
        met = {s for ring, s in rings for p in points if holds(ring, *p)}
        if met:
            want[i] = (int("".join(str(int(any(holds(ring, *p) for ring, _ in rings))) for p in points), 2), len(met) > 1, met)
    rows = {g.patch_id: g for g in got.collect()}
    assert set(rows) == set(want)
    assert {i: (g.mask, g.low != g.high) for i, g in rows.items()} == {i: w[:2] for i, w in want.items()}
    assert all({g.low, g.high} <= want[i][2] for i, g in rows.items())
    assert len({w[0] for w in want.values()}) > 2
